"""A content-addressed store of dataset versions: Parquet folders, manifests and latest pointers.

A version is named by the hash of its rows, order-free, so publishing equal rows again gives the same version.
Manifests are JSON files beside the data, written through Spark's file system, so that a store may live wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.staging import delete


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _put(self, path: str, value: dict) -> None:
        """Writes a file of its own and moves it over the old one in a single step, so that a reader sees one or the other."""
        fs, p = self._fs(path)
        temporary = self._fs(f"{path}.{uuid.uuid4().hex}.new")[1]
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        sc, hadoop = self.spark.sparkContext, self.spark._jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = hadoop.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(temporary), fs.makeQualified(p), options)

    def _get(self, path: str) -> dict | None:
        fs, p = self._fs(path)
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None

    @staticmethod
    def digest(rows: DataFrame) -> str:
        """Order-free hash of a table: sums and count of two row hashes, and the schema."""
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
        got = rows.select(F.xxhash64(row).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), row).cast("decimal(38,0)").alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        text = F.concat_ws("|", F.lit(json.dumps(sorted((f.name, f.dataType.simpleString()) for f in rows.schema))), *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "a", "b")])
        return got.select(F.sha2(text, 256)).first()[0]

    def publish(self, dataset: str, stage: str, rows: DataFrame, inputs: list[dict] | None = None) -> dict:
        """Writes a version if it is new, and points ``latest`` at it; returns its reference."""
        version = self.digest(rows)
        ref, base = {"dataset": dataset, "stage": stage, "version": version}, f"{self.root}/{dataset}/{stage}"
        if self._get(f"{base}/{version}.json") is None:
            rows.write.mode("overwrite").parquet(f"{base}/{version}")
            self._put(f"{base}/{version}.json", {**ref, "inputs": inputs or [], "rows": rows.count(), "published": datetime.now(timezone.utc).isoformat()})
        self._put(f"{base}/latest.json", ref)
        return ref

    def latest(self, dataset: str, stage: str) -> dict | None:
        return self._get(f"{self.root}/{dataset}/{stage}/latest.json")

    def manifest(self, ref: dict) -> dict | None:
        return self._get(f"{self.root}/{ref['dataset']}/{ref['stage']}/{ref['version']}.json")

    def records(self, ref: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{ref['dataset']}/{ref['stage']}/{ref['version']}")

    def verify(self, ref: dict) -> bool:
        """Whether the stored rows and all that they were made from still have their hashes."""
        found = self.manifest(ref)
        return found is not None and self.digest(self.records(ref)) == ref["version"] and all(self.verify(i) for i in found["inputs"])

    def lineage(self, ref: dict) -> list[dict]:
        """All versions that a version was made from, itself first, each once."""
        seen, queue = [], [ref]
        while queue:
            at = queue.pop(0)
            if at not in seen:
                seen.append(at)
                queue += (self.manifest(at) or {"inputs": []})["inputs"]
        return seen

    def drop(self, ref: dict) -> None:
        base = f"{self.root}/{ref['dataset']}/{ref['stage']}/{ref['version']}"
        delete(self.spark, base)
        delete(self.spark, base + ".json")
