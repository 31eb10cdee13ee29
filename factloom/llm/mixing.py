"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target share of the mix by weight, no more than ``max_repeat`` times its size. A
document of a source is expected ``target / size of source`` times. Documents of a source are laid in
one fixed order, the expected copies are prefix-summed, one random offset (a hash of seed and source)
is added, and a document is emitted once for each integer boundary that its step crosses. So a
document's copies are the expectation rounded down or up, and the source's words stay close to the
target: within a block the order follows size, rising and falling in turn, so that neighbours stand
for each other.

Prefix sums are taken in two levels: inside blocks of a source, and over the counts of blocks. With n
rows in the largest source there are about sqrt(n)/8 blocks a source, so neither level puts more than
the order of sqrt(n) rows of a source into one task, however hot the source is.

Defined cases: null text has size 0; a null source is a source of its own and comes last; sources of
size 0 get target 0 and take nothing; rows that repeat an id are separate documents, equal in size ordered by a hash of
their columns; a null id counts as a document, dealt by its text. An empty table gives an empty result. ``mix`` carries all
columns under any names; ``copies`` reads no others.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.operators.staging import Staging

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Water-filling in closed form: with sources in the order of cap / weight, the level if all before a
    source are capped rises up to the true level and falls after it, so the level is its maximum.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(picks, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("double"))
    capped = ranked.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    before = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = capped.withColumn("lambda", level).withColumn("top", F.max("lambda").over(every))
    return filled.select("source", "source_size", F.least(F.col("cap"), F.col("top") * F.col("w")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0, seed: str = "mix", rows: bool = False) -> DataFrame:
    """One row per document: ``(id, size, source, source_size, target, copies)``, with ``rows`` also ``row``, its columns."""
    st = Staging(docs.sparkSession, "mixing")
    sized = st.write(docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size")), "sizes")
    sources = st.write(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    largest = sources.agg(F.max("rows")).first()[0] or 1
    blocks = 2 ** max(0, ceil(log2(max(1.0, sqrt(largest) / 8))))
    goal = targets(sources.select("source", "source_size"), weights, share, max_repeat)
    st.drop(sized)

    key = F.coalesce(F.col("source"), F.lit("\0"))
    name = F.coalesce(F.col("id").cast("string"), F.md5(F.col("text")), F.lit(""))
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).alias("source"), F.xxhash64(*hashed).alias("print"), *carried)
    placed = read.select("id", n_words("text").alias("size"), key.alias("key"), F.floor(uniform(F.lit(seed), name) * blocks).cast("int").alias("block"), "print", *(["row"] if rows else []))
    inside = W.partitionBy("key", "block").orderBy(F.when(F.col("block") % 2 == 0, F.col("size")).otherwise(-F.col("size")), "id", "print")
    ranked = placed.withColumn("r", F.row_number().over(inside))
    upto = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = placed.groupBy("key", "block").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    rated = goal.select(key.alias("key"), "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), uniform(F.lit(seed), F.lit("offset"), key).alias("u"))
    steps = bases.join(rated, "key").select("key", "block", "base", "source", "source_size", "target", "rate", "u")
    rank = F.col("base") + F.col("r")
    crossed = F.floor(F.col("rate") * rank + F.col("u")) - F.floor(F.col("rate") * (rank - 1) + F.col("u"))
    return ranked.join(steps, ["key", "block"]).select("id", "size", "source", "source_size", "target", crossed.cast("long").alias("copies"), *(["row"] if rows else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each document's row, all columns, as many times as it is taken."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    taken = copies(inner, at[id_col], at[text_col], at[source_col], rows=True, **options).where("copies > 0")
    times = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select(*[F.col(f"row.{c}").alias(n) for n, c in at.items()])
