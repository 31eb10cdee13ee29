"""Raw files to rows: delimited text, JSON lines, JSON documents, zip members and spreadsheets.

Values stay strings; typing is the normaliser's work. Every row has a ``locator`` naming where it came from.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FORMATS = {"csv": ",", "tsv": "\t", "psv": "|"}
KEYS = {"format", "member", "records_path", "columns", "header_row", "strict", "sheet", "one_line_records"}
BATCH = 5000  # rows that a task holds of an archive before it passes them on


def validated(config: dict) -> dict:
    """The reader options, or an error that names the unknown ones."""
    unknown = set(config) - KEYS
    if unknown:
        raise ValueError(f"unknown reader options: {', '.join(sorted(unknown))}")
    if config.get("format") not in {*FORMATS, "jsonl", "json", "xlsx"}:
        raise ValueError(f"unknown format: {config.get('format')}")
    return config


def read_rows(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Rows of the files at a path. Gzip is read by suffix; ``member`` is a pattern of names inside zip files.

    ``columns`` keeps the named ones, in that order; ``sheet`` is a worksheet's name or number from 1. Delimited files may
    have line breaks within quotes; ``one_line_records`` says that they have none, so that large files are split.
    """
    config = validated(config)
    wanted = config.get("columns")
    rows = _read(spark, path, config)
    if not wanted:
        return rows
    if "row" in rows.columns and dict(rows.dtypes)["row"].startswith("map"):
        return rows.withColumn("row", F.map_filter("row", lambda k, _: k.isin(*wanted)))
    return rows.select(*[F.col(f"`{c}`") for c in wanted], "locator")


def _read(spark: SparkSession, path: str, config: dict) -> DataFrame:
    kind = config["format"]
    if kind == "xlsx" or "member" in config:
        return _archived(spark, path, config)
    located = F.concat(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("@"), F.col("_metadata.file_block_start").cast("string"))
    if kind in FORMATS:
        mode = "FAILFAST" if config.get("strict") else "PERMISSIVE"
        rows = spark.read.csv(path, header=True, sep=FORMATS[kind], inferSchema=False, mode=mode, multiLine=not config.get("one_line_records", False))
        return rows.select("*", located.alias("locator"))
    if kind == "jsonl":
        return spark.read.text(path).where("value rlike '\\\\S'").select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST" if config.get("strict") else "PERMISSIVE"}).alias("row"), located.alias("locator"))
    doc = spark.read.text(path, wholetext=True).select(F.col("value"), located.alias("_at"))
    where = "$" + "".join(f".{p}" for p in config.get("records_path", []))
    records = F.from_json(F.get_json_object("value", where), "array<map<string,string>>")
    return doc.select(F.posexplode(records).alias("n", "row"), "_at").select("row", F.concat("_at", F.lit("/"), F.col("n").cast("string")).alias("locator"))


def _archived(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Rows of zip members or worksheets as ``(row map, locator)``; a file is parsed by one task."""
    kind, member = config["format"], config.get("member", "*")

    def rows(name: str, content: bytes) -> Iterator[tuple[dict, str]]:
        short = name.rsplit("/", 1)[-1]
        if kind == "xlsx":
            for n, r in worksheet(content, config.get("header_row", 1), config.get("sheet", 1)):
                yield r, f"{short}!{n}"
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = [m for m in z.namelist() if fnmatch.fnmatch(m.lower(), member.lower()) and not m.endswith("/")]
            if not found:
                raise ValueError(f"no member of {short} matches {member}")
            for m in sorted(found):
                for n, r in enumerate(_members(z.read(m), kind, config.get("records_path", [])), 1):
                    yield r, f"{short}/{m}#{n}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                found = rows(name, bytes(content))
                while some := list(islice(found, BATCH)):
                    yield pd.DataFrame({"row": [r for r, _ in some], "locator": [x for _, x in some]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "row map<string,string>, locator string")


def _text(value) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value)


def _members(content: bytes, kind: str, records_path: list[str]) -> Iterator[dict]:
    text = content.decode("utf-8-sig")
    if kind in FORMATS:
        yield from pd.read_csv(io.StringIO(text), sep=FORMATS[kind], dtype=str, keep_default_na=False).to_dict("records")
        return
    if kind == "jsonl":
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    else:
        found = json.loads(text)
        for part in records_path:
            found = found[part]
        if not isinstance(found, list):
            raise ValueError(f"no list of records at {'/'.join(records_path) or 'the top'}")
    for record in found:
        yield {k: _text(v) for k, v in record.items()}


def worksheet(content: bytes, header_row: int = 1, sheet: str | int = 1) -> Iterator[tuple[int, dict]]:
    """Numbered rows of a sheet of a workbook, by name or number, by the header's names; blank rows are skipped."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        if isinstance(sheet, str):
            listed = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")]
            if sheet not in listed:
                raise ValueError(f"no sheet {sheet}")
            sheet = listed.index(sheet) + 1
        page = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    names: dict[str, str] = {}
    for row in page.iter(f"{{{ns['m']}}}row"):
        n, cells = int(row.get("r")), {}
        for c in row.findall("m:c", ns):
            v = c.find("m:v", ns)
            value = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
            if value is not None:
                cells[re.match("[A-Z]+", c.get("r"))[0]] = shared[int(value)] if c.get("t") == "s" else value
        if n == header_row:
            names = cells
        elif n > header_row and cells:
            yield n, {names[k]: v for k, v in cells.items() if k in names}


def feed(spark: SparkSession, path: str, schema: T.StructType, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines feed that meet a declared schema and named conditions, and the others with ``broken``."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(with_bad).option("columnNameOfCorruptRecord", "_bad").json(path)
    marks = [F.when(F.col("_bad").isNotNull(), F.lit("malformed")), *[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in checks.items()]]
    judged = rows.withColumn("broken", F.filter(F.array(*marks), lambda x: x.isNotNull()))
    return judged.where(F.size("broken") == 0).drop("broken", "_bad"), judged.where(F.size("broken") > 0)
