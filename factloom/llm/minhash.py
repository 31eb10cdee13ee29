"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct shingles of ``words`` words; its sketch is
the ``k`` smallest. Two sets with Jaccard similarity of at least ``threshold`` per cent share at
least ``shared_bound`` sketch values except with probability ``miss`` (a binomial tail), and in full
whenever a set is no larger than its sketch.

1. Equal sets collapse to one class, so copies of any number cost one row.
2. Inverted lists of retained values. Only values that at least two classes retain count; each class
   keeps the rarest of them, as many as the prefix filter needs. Each list proposes its members
   against its smallest member: candidates grow with the entries, never with a list's square.
3. Union-sketch estimation drops candidates, exact Jaccard on full sets confirms the rest, and
   connected components merge what is linked.
4. Lists whose members are still in different components go to an exact index: a prefix filter on
   the full sets, by pairs of size classes, with the positional bound. It loses no pair, and pairs
   inside one component are not formed. What it proposes passes the same exact test.

Defined cases: null or empty text, or text of white space, has an empty set and no links; fewer words
than a shingle give the whole sequence as one; rows that repeat an id are one node of the graph,
each row keeping its own set size; a null id is never linked and gives component null, kept true. An empty table gives an
empty result. Columns besides the id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from factloom.operators.components import connected_components
from factloom.operators.staging import Staging

CACHED_WORDS = 400_000  # distinct words a Python worker remembers before it starts over


@lru_cache
def shared_bound(k: int, threshold: int, miss: float) -> int:
    """The largest c with P(Binomial(k, threshold) < c) <= miss."""
    p, total = threshold / 100, 0.0
    for c in range(k + 1):
        total += comb(k, c) * p**c * (1 - p) ** (k - c)
        if total > miss:
            return max(1, c)
    return k


class Shingler:
    """Hashes word sequences; A-Z are lower-cased, words are separated by ASCII white space."""

    def __init__(self, words: int):
        self.words, self.seen = words, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a whole text."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.empty(0, np.int64)
        seen = self.seen
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for w in found:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
        size = min(self.words, len(ids))
        h = np.full(len(ids) - size + 1, size, np.uint64)
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - size + 1 + j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.unique(h.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """``(id, n, f1, f2, sketch)``: set size, a 128-bit fingerprint of the set and its k smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, prints, small = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingler.hashes(text)
                n.append(len(h))
                prints.append(xxhash.xxh3_128_digest(h.tobytes()))
                small.append(h[:k])
            both = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), _lists(small)], names=["id", "n", "f1", "f2", "sketch"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, sketch array<long>")


def full_sets(docs: DataFrame, words: int, batch_values: int = 500_000) -> DataFrame:
    """``(id, n, set)`` with the whole sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)

        def out(ids: list, sets: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], names=["id", "n", "set"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                sets.append(shingler.hashes(text))
                held += len(sets[-1])
                if held > batch_values:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)

    return docs.mapInArrow(run, "id long, n long, set array<long>")


def _least_overlap(a: Column | str, b: Column | str, threshold: int) -> Column:
    """The smallest intersection of sets of sizes a and b at the threshold."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.floor((threshold * (a + b) + (100 + threshold) - 1) / (100 + threshold)).cast("long")


def _rarest(entries: DataFrame, key: str) -> DataFrame:
    """Entries ``(id, n, v)`` whose value at least two ids hold, with its place ``r`` (from 0) among the id's
    ``m`` such values, rarest first, ties by value."""
    df = entries.groupBy("v").agg(F.count("*").alias("df")).where("df >= 2")
    order = W.partitionBy("id").orderBy("df", "v")
    return entries.join(df, "v").withColumns({"r": F.row_number().over(order) - 1, "m": F.count("*").over(W.partitionBy("id"))})


def _estimated(pairs: DataFrame, sketch: DataFrame, k: int, threshold: int, miss: float) -> DataFrame:
    """Pairs whose union sketch doesn't rule out the threshold."""
    low = shared_bound(k, threshold, miss)
    s = sketch.select("id", "sketch")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    hits = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    return both.withColumn("u", union).where(F.when(F.size("u") < k, 100 * hits >= threshold * F.size("u")).otherwise(hits >= low)).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    both = pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(inter * (100 + threshold) >= threshold * (F.col("na") + F.col("nb"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 75, k: int = 64, miss: float = 1e-7, size_step: float = 1.05) -> DataFrame:
    """One row per document: ``(id, n, component, kept)``.

    ``component`` is the smallest id that links reach and ``kept`` says that the document is it.
    """
    spark: SparkSession = docs.sparkSession
    st = Staging(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = st.write(sketches(texts, words, k), "sketches")
    classes = st.write(base.where("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    # Inverted lists of the retained values, rarest first, as long as the prefix filter asks for.
    low = F.least(F.lit(shared_bound(k, threshold, miss)), F.ceil(F.col("n") * threshold / 100)).cast("long")
    kept = _rarest(classes.select("id", "n", F.explode("sketch").alias("v")), "id").where(F.col("r") <= F.col("m") - low)
    lists = st.write(kept.select("v", "id", "n"), "lists")
    first = lists.groupBy("v").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("c")).where("c >= 2").select("v", F.col("p.id").alias("a"), F.col("p.n").alias("na"))
    size_ok = "least(n, na) * 100 >= greatest(n, na) * " + str(threshold)
    members = lists.join(first, "v")
    stars = members.where("id <> a").where(size_ok).select("a", F.col("id").alias("b")).distinct()
    wanted = members.select("id").distinct()
    sets = st.write(full_sets(texts.join(wanted, "id", "left_semi"), words), "sets")
    links = st.write(_linked(_estimated(stars, classes, k, threshold, miss), sets, threshold), "links")
    comps = st.write(connected_components(links, st), "components")

    # Lists not yet in one component: the exact index on full sets.
    placed = members.select("v", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("v", "id", F.coalesce("component", "id").alias("comp"))
    placed = st.write(placed, "placed")
    open_lists = placed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v")
    undecided = st.write(placed.join(open_lists, "v", "left_semi").select("id", "comp").distinct(), "undecided")
    entries = sets.join(undecided, "id").select("id", "n", F.explode("set").alias("v"))
    ranked = st.write(_rarest(entries, "id").where(F.col("r") <= F.col("m") - F.ceil(F.col("n") * threshold / 100)).withColumn("place", F.col("n") - F.col("m") + F.col("r")).select("v", "id", "n", "r", "m", "place"), "ranked")
    step = log(size_step)
    reach = ceil(-log(threshold / 100) / step) + 1
    cls = F.floor(F.log("n") / step).cast("long")
    least_n = F.greatest(F.floor(F.pow(F.lit(size_step), F.col("q"))) - 1, F.ceil(F.col("n") * threshold / 100), F.lit(1)).cast("long")
    keyed = ranked.withColumn("s", cls).withColumn("q", F.explode(F.sequence(F.col("s") - reach, F.col("s") + reach)))
    keyed = keyed.where(F.col("r") <= F.col("m") - _least_overlap("n", least_n, threshold)).where(F.pow(F.lit(size_step), F.col("q")) * threshold <= (F.col("n") + 2) * 100)
    keyed = keyed.join(undecided, "id").select("v", "id", "n", "place", "comp", "s", "q")
    left = keyed.where("s <= q").select("v", F.col("s").alias("s1"), F.col("q").alias("s2"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("comp").alias("ca"))
    right = keyed.where("s >= q").select("v", F.col("q").alias("s1"), F.col("s").alias("s2"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("comp").alias("cb"))
    fits = (F.col("ca") != F.col("cb")) & ((F.col("s1") < F.col("s2")) | (F.col("a") < F.col("b"))) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _least_overlap("na", "nb", threshold))
    rest = left.join(right, ["v", "s1", "s2"]).where(fits).select("a", "b").distinct()
    more = st.write(_linked(_estimated(rest, classes, k, threshold, miss), sets, threshold), "links-rest")
    st.drop(placed, ranked, undecided, lists)
    comps = st.write(connected_components(links.unionByName(more), st), "components") if not more.isEmpty() else comps

    reps = classes.select("f1", "f2", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    out = base.select("id", "n", "f1", "f2").join(reps, ["f1", "f2"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    out = out.select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
