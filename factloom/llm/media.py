"""Media columns: content-defined chunks in a deduplicated store, and verified media read back from it.

A payload is cut where a rolling gear hash of the last 32 bytes has its top bits zero, so equal
stretches of different payloads give equal chunks. Chunks are named by their SHA-256.

1. Recipes: each document's ordered chunk digests and lengths. No payload bytes move.
2. Store: chunks, compressed with a dictionary trained on a bounded sample of documents, are
   deduplicated by digest and written to a table bucketed by digest. A named store stays, with its dictionary
   (``<store>_dictionary``, under its SHA-256) and the recipes (``<store>_recipes``), so that ``restored`` reads payloads in any later
   session; without a name the table goes once it has been read back.
3. Reading: the recipes of distinct payloads are joined with the store in place (its buckets are not
   shuffled), chunks are gathered by payload, checked against their digests and joined in order; features come
   from these bytes. Copies of a payload are read once and their rows joined by payload digest.

The stored form of a payload is its manifest (magic, count, then length and digest of each chunk)
followed by its compressed chunks in order; ``media_bytes`` and ``media_sha256`` describe that form.

Defined cases: null and empty text are equal, 64 zero bytes; equal texts give equal values in one run; rows that
repeat an id, or have none, are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from factloom.operators.staging import CLEANUP, Staging

LEAST, MOST, BITS = 2048, 65536, 13  # bytes of the smallest and largest chunk; an average of 2 ** BITS between
DICTIONARY = 112_640
SAMPLE = 400  # documents that the dictionary is trained on


def _gear() -> np.ndarray:
    """256 odd-looking 32-bit numbers, from SHA-256 of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def chunk_ends(payload: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of a payload."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = gear[np.frombuffer(payload, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    cuts = np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + 1
    ends, start = [], 0
    while n - start > LEAST:
        i = np.searchsorted(cuts, start + LEAST)
        end = min(n, start + MOST, int(cuts[i]) if i < len(cuts) else n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def payload_of(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """A text's bytes with zeros up to a positive multiple of ``unit``, and their number before that."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(unit * max(1, -(-len(raw) // unit)) - len(raw)), len(raw)


def chunks_of(payload: bytes, gear: np.ndarray) -> list[bytes]:
    start, out = 0, []
    for end in chunk_ends(payload, gear):
        out.append(payload[start:end])
        start = end
    return out


def recipes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media, digests)`` of each document; ``media`` is the payload's SHA-256, digests are
    NULL if the payload is one chunk, which then has the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        for batch in batches:
            sizes, names, digests = [], [], []
            for text in batch.column(1).to_pylist():
                payload, n = payload_of(text)
                sizes.append(n)
                names.append(hashlib.sha256(payload).digest())
                chunks = chunks_of(payload, gear)
                digests.append([hashlib.sha256(c).digest() for c in chunks] if len(chunks) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "digests"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary, digests array<binary>")


def compressed_chunks(docs: DataFrame, dictionary: bytes, level: int = 12, batch_bytes: int = 4 << 20) -> DataFrame:
    """``(digest, data)`` of every chunk of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        recent: set[bytes] = set()
        names, data, held = [], [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for c in chunks_of(payload_of(text)[0], gear):
                    digest = hashlib.sha256(c).digest()
                    if digest in recent:
                        continue
                    if len(recent) > 100_000:
                        recent.clear()
                    recent.add(digest)
                    names.append(digest)
                    data.append(press.compress(c))
                    held += len(data[-1])
                if held > batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])
                    names, data, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])

    return docs.select("text").mapInArrow(run, "digest binary, data binary")


def feature_of(payload: bytes) -> str:
    """Mean, spread and entropy of the 8-bit samples, and a 64-bit signature of their coarse shape."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    blocks = np.array([float(b.mean()) for b in np.array_split(x, 64)])
    bits = int("".join("1" if v else "0" for v in blocks > np.median(blocks)), 2)
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={entropy:.4f};shape={bits:016x}"


def read_back(gathered: DataFrame, dictionary: bytes) -> DataFrame:
    """Media rows from ``(media, chunks)``, chunks being ``array<struct<place,digest,data>>`` in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                chunks = sorted(row["chunks"], key=lambda c: c["place"])
                plain = [press.decompress(c["data"], max_output_size=MOST + LEAST) for c in chunks]
                for c, v in zip(chunks, plain):
                    if hashlib.sha256(v).digest() != c["digest"]:
                        raise ValueError(f"chunk {c['digest'].hex()} doesn't match its digest")
                payload = b"".join(plain)
                found = hashlib.sha256(payload).digest()
                if found != row["media"]:
                    raise ValueError(f"media {row['media'].hex()} doesn't match its digest")
                manifest = b"CDC1" + len(chunks).to_bytes(4, "little") + b"".join(len(v).to_bytes(4, "little") + c["digest"] for c, v in zip(chunks, plain))
                form = manifest + b"".join(c["data"] for c in chunks)
                for column, value in zip(out, (found, len(payload), zlib.crc32(payload[-64:]), len(form), hashlib.sha256(form).digest(), feature_of(payload))):
                    column.append(value)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["media", "payload_bytes", "tail_crc32", "media_bytes", "form", "feature"])

    return gathered.mapInArrow(run, "media binary, payload_bytes long, tail_crc32 long, media_bytes long, form binary, feature string")


def train_dictionary(texts: DataFrame) -> bytes:
    ids = texts.where("length(text) > 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE).collect()  # both bounded by the sample
    samples = [r["text"].encode("utf-8", "replace") for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples for a dictionary
        return b""


def _gathered(known: DataFrame, store: DataFrame) -> DataFrame:
    """``(media, chunks)`` of the distinct payloads of some recipes."""
    payloads = known.groupBy("media").agg(F.first("digests").alias("digests"))
    wanted = payloads.select("media", F.posexplode(F.coalesce("digests", F.array("media"))).alias("place", "digest"))
    return wanted.join(store.hint("merge"), "digest").groupBy("media").agg(F.collect_list(F.struct("place", "digest", "data")).alias("chunks"))


def restored(spark, store: str) -> DataFrame:
    """The media rows of a named store, read and verified with the dictionary that it keeps."""
    row = spark.table(f"{store}_dictionary").first()  # one row
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).digest() != bytes(row["digest"]):
        raise ValueError("the dictionary doesn't match its digest")
    return read_back(_gathered(spark.table(f"{store}_recipes"), spark.table(store)), dictionary)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """One row per document: ``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_chunks)``. With ``store`` the chunk store stays under that name."""
    spark = docs.sparkSession
    st = Staging(spark, "media")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(texts)
    known = st.write(recipes(texts), "recipes")

    table = store or f"chunk_store_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = compressed_chunks(texts, dictionary).groupBy("digest").agg(F.first("data").alias("data"))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        unique.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").option("compression", "none").saveAsTable(table)
    finally:
        spark.conf.set(CLEANUP, before)

    media = st.write(read_back(_gathered(known, spark.table(table)), dictionary), "media")
    if store:
        known.write.saveAsTable(f"{store}_recipes")
        spark.createDataFrame([(bytearray(hashlib.sha256(dictionary).digest()), bytearray(dictionary))], "digest binary, dictionary binary").write.saveAsTable(f"{store}_dictionary")
    else:
        spark.sql(f"DROP TABLE {table}")
    out = known.select("doc_id", "n_bytes", "media", F.coalesce(F.size("digests"), F.lit(1)).cast("long").alias("n_chunks")).join(media, "media")
    digests = {"payload_sha256": F.lower(F.hex("media")), "media_sha256": F.lower(F.hex("form"))}
    out = out.withColumns(digests)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
