"""Substring deduplication by level-wise doubling over word windows.

A window of ``length`` words is cut from a document if the same words also start in a document with a
smaller id. Windows are judged on the input. Levels run ``base``, 2 x base, ... up to ``length``:

* Level ``base``. Not every window is needed: of the base windows inside each window of twice the
  length, the one with the smallest hash (the leftmost of equals) stands for it, so equal windows choose equal
  representatives, about 2 in base + 1 words. Representatives found in two documents survive.
* Each next level forms the windows of twice the length whose representative (at the first step) or
  whose two halves (after it) survived, and keeps those found in two documents. It ends at ``length``, or
  earlier when no candidate survives.

Equal word sequences collapse first: a copy of a smaller document is cut as a whole, and copies of any number
cost one document. A level is one aggregation by window hash (64 bits; partial sums first) and one join back.

Defined cases: null text has no words; documents shorter than a window keep everything; rows that
repeat an id are one document for the rule "smaller id", each keeping its own text; a null id is neither cut nor
cuts others; an empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from factloom.operators.staging import Staging

CACHED_WORDS = 400_000
FACTOR = 0x9E3779B97F4A7C15


class Windows:
    """Word and window hashes of whole texts; words are separated by ASCII white space and not changed."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").split()

    def ids(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def rolled(ids: np.ndarray, length: int) -> np.ndarray:
        """The polynomial of each window of ``length`` ids, by doubling."""
        power, rest, out, done = ids, length, None, 0
        size = 1
        while rest:
            if rest & 1:
                if out is None:
                    out = power
                else:
                    n = len(ids) - done - size + 1
                    out = out[:n] * np.uint64(pow(FACTOR, size, 1 << 64)) + power[done : done + n]
                done += size
            rest >>= 1
            if rest:
                power = power[: len(power) - size] * np.uint64(pow(FACTOR, size, 1 << 64)) + power[size:]
                size *= 2
        return out

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def hashes(self, ids: np.ndarray, length: int) -> np.ndarray:
        return self.mixed(self.rolled(ids, length)) if len(ids) >= length else np.empty(0, np.int64)

    def representatives(self, ids: np.ndarray, base: int) -> np.ndarray:
        """For each window of twice ``base`` words, the place of its smallest base window."""
        h = self.hashes(ids, base)
        if len(ids) < 2 * base:
            return np.empty(0, np.int64)
        return np.lib.stride_tricks.sliding_window_view(h, base + 1).argmin(axis=1) + np.arange(len(ids) - 2 * base + 1)


def _fingerprint(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def _profiles(texts: DataFrame, base: int) -> DataFrame:
    """``(id, n_words, f1, f2, seeds)``: fingerprint of the words and hashes of the representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows()
        for batch in batches:
            counts, prints, seeds = [], [], []
            for text in batch.column(1).to_pylist():
                words = w.words(text)
                ids = w.ids(words)
                counts.append(len(words))
                prints.append(_fingerprint(words))
                chosen = np.unique(w.representatives(ids, base))
                seeds.append(np.unique(w.hashes(ids, base)[chosen]) if len(chosen) else chosen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), _lists(seeds)], names=["id", "n_words", "f1", "f2", "seeds"])

    return texts.mapInArrow(run, "id long, n_words long, f1 long, f2 long, seeds array<long>")


def _windows(texts: DataFrame, base: int, length: int, first: bool, batch_rows: int = 200_000) -> DataFrame:
    """``(id, f1, f2, start, more, h)`` of the candidate windows of ``length`` words.

    A window that a document repeats within itself is one row: its first start, and the others in ``more``
    (else NULL), so that a window's rows are its documents, however often each repeats it.

    ``texts`` has ``(id, text, f1, f2, held)``; held are the surviving base hashes, or the surviving starts of
    windows of half the length. Rows whose words don't have the fingerprint give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows()

        def out(parts: list) -> pa.RecordBatch:
            ids, f1, f2, starts, more, hashes = zip(*parts)
            sizes = [len(x) for x in starts]
            lists = pa.array([m for x in more for m in x], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(c, np.int64), sizes)) for c in (ids, f1, f2)] + [pa.array(np.concatenate(starts).astype(np.int32)), lists, pa.array(np.concatenate(hashes))], names=["id", "f1", "f2", "start", "more", "h"])

        parts, count = [], 0
        for batch in batches:
            held_column = batch.column(4)
            for i, (doc, text, f1, f2) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                words = w.words(text)
                if _fingerprint(words) != (f1, f2):
                    continue
                ids = w.ids(words)
                held = held_column[i].values.to_numpy(zero_copy_only=False)
                n = max(0, len(ids) - length + 1)
                if first:
                    starts = np.flatnonzero(np.isin(w.hashes(ids, base)[w.representatives(ids, base)], held)) if n else np.empty(0, np.int64)
                else:
                    alive = np.zeros(len(ids) + length, bool)
                    alive[held] = True
                    starts = np.flatnonzero(alive[:n] & alive[length // 2 : length // 2 + n])
                if len(starts):
                    h, at = np.unique(w.hashes(ids, length)[starts], return_index=True)
                    more: list = [None] * len(h)
                    if len(h) < len(starts):
                        rest = np.delete(np.arange(len(starts)), at)
                        for j, s in zip(np.searchsorted(h, w.hashes(ids, length)[starts[rest]]).tolist(), starts[rest].tolist()):
                            if more[j] is None:
                                more[j] = []
                            more[j].append(s)
                    parts.append((doc, f1, f2, starts[at], more, h))
                    count += len(h)
                if count >= batch_rows:
                    yield out(parts)
                    parts, count = [], 0
        if parts:
            yield out(parts)

    return texts.mapInArrow(run, "id long, f1 long, f2 long, start int, more array<int>, h long")


def cut_repeats(docs: DataFrame, length: int = 50, base: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, n_words, n_removed, kept)``, the kept words joined by one space."""
    if base < 1 or length % base or (length // base) & (length // base - 1) or length // base < 2:
        raise ValueError("length must be base times 2, 4, 8, ...")
    st = Staging(docs.sparkSession, "substrings")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = st.write(_profiles(texts, base), "profiles")
    firsts = known.where("id is not null").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"))
    first = st.write(firsts, "firsts")

    own = known.where(f"n_words >= {length}").join(first.select("f1", "f2", "id"), ["f1", "f2", "id"], "left_semi")
    seeds = own.select("id", "f1", "f2", F.explode("seeds").alias("h"))
    twice = seeds.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    alive = st.write(seeds.join(twice, "h").groupBy("id", "f1", "f2").agg(F.collect_set("h").alias("held")), "alive")
    candidates = st.write(texts.join(alive, "id").select("id", "text", "f1", "f2", "held"), "candidates")
    level = 2 * base
    while True:
        windows = st.write(_windows(candidates, base, level, level == 2 * base), f"windows-{level}")
        owners = windows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
        again = windows.join(owners, "h")
        if level == length:
            starts = again.where("id > lo").groupBy("id", "f1", "f2").agg(F.collect_list("start").alias("one"), F.flatten(F.collect_list("more")).alias("more")).select("id", "f1", "f2", F.concat("one", "more").alias("starts"))
            break
        alive = again.groupBy("id", "f1", "f2").agg(F.collect_list("start").alias("one"), F.flatten(F.collect_list("more")).alias("more")).select("id", "f1", "f2", F.concat("one", "more").cast("array<long>").alias("held"))
        nxt = st.write(candidates.drop("held").join(alive, ["id", "f1", "f2"]).select("id", "text", "f1", "f2", "held"), "candidates")
        st.drop(candidates, windows)
        candidates, level = nxt, level * 2
    cuts = st.write(starts.groupBy("id").agg(F.collect_list(F.struct("f1", "f2", "starts")).alias("cuts")), "cuts")
    copies = known.join(first.select("f1", "f2", F.col("id").alias("lo")), ["f1", "f2"]).where(f"id > lo and n_words >= {length}")
    whole = copies.groupBy("id").agg(F.collect_set(F.struct("f1", "f2")).alias("whole"))
    decided = st.write(cuts.join(whole, "id", "full_outer"), "decided")
    st.drop(candidates, windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, removed = [], [], []
            for text, cuts, whole in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                if cuts or whole:
                    mine = _fingerprint(words)
                    if any((x["f1"], x["f2"]) == mine for x in whole or ()):
                        words = []
                    for c in cuts or ():
                        if (c["f1"], c["f2"]) == mine and words:
                            edge = np.zeros(len(words) + 1, np.int64)
                            np.add.at(edge, c["starts"], 1)
                            np.add.at(edge, np.array(c["starts"]) + length, -1)
                            words = [w for w, k in zip(words, np.cumsum(edge[:-1]) == 0) if k]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return texts.join(decided, "id", "left").select("id", "text", "cuts", "whole").mapInArrow(run, "id long, n_words long, n_removed long, kept string")
