"""Search, vector search, screening and grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from factloom.operators.graph import ends
from factloom.operators.staging import Staging


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, token)``, lower-cased runs of letters and digits."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[a-z0-9]+"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("token"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str], k1: float = 1.2, b: float = 0.75, limit: int = 20) -> DataFrame:
    """The best documents for a few query tokens. Lengths and term counts are regular-expression counts, no array of words."""
    text = F.lower(F.col(text_col))
    counts = {f"_t{i}": F.regexp_count(text, F.lit(rf"(?<![a-z0-9]){q}(?![a-z0-9])")) for i, q in enumerate(query)}
    hits = docs.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit("[a-z0-9]+")).alias("_n"), *[c.alias(n) for n, c in counts.items()])
    got = hits.agg(F.count("*").alias("docs"), F.avg("_n").alias("mean"), *[F.count_if(F.col(n) > 0).alias(n) for n in counts]).first()
    score = F.lit(0.0)
    for n in counts:
        idf = F.log(F.lit((got["docs"] - got[n] + 0.5) / (got[n] + 0.5) + 1))
        tf = F.col(n)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.lit(got["mean"] or 1.0)))
    held = " or ".join(f"{n} > 0" for n in counts) or "false"
    return hits.where(held).withColumn("score", score).where("score > 0").orderBy(F.desc(F.round("score", 9)), "id").limit(limit).select("id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = 1024, vector_block: int = 16_384) -> DataFrame:
    """``(qid, id, distance, rank)``: the k nearest vectors by Euclidean distance of each query, exactly.

    Vectors and queries are dealt into blocks; a task holds one block of each and keeps k candidates a query. The blocks
    grow in number with the tables, not in size.
    """
    import numpy as np
    import pandas as pd

    count = lambda df, size: max(1, -(-df.count() // size))
    nq, nv = count(queries, query_block), count(vectors, vector_block)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    q = queries.select("qid", F.col("q").cast("array<double>").alias("q"), block("qid", nq).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("vb"))
    v = vectors.select("id", F.col("v").cast("array<double>").alias("v"), block("id", nv).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("id")
            ids, matrix = right["id"].to_numpy(), np.stack(right["v"].to_numpy())
            for qid, vector in zip(left["qid"], left["q"]):
                d = np.sqrt(((matrix - vector) ** 2).sum(axis=1))
                order = np.lexsort((ids, d))
                out += [(qid, ids[i], float(d[i])) for i in order[: k + 1] if ids[i] != qid]
        return pd.DataFrame(out, columns=["qid", "id", "distance"])

    kinds = dict(q.dtypes) | dict(v.dtypes)
    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, distance double")
    rank = W.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def screen(edges: DataFrame, listed: DataFrame, subjects: DataFrame, hops: int, staging: Staging, least: float = 0.0) -> DataFrame:
    """``(subject, listed, hop, share, status)``: the listed parties above each subject through chains of shares.

    A chain goes from the subject to its owners and ends at a listed party: it isn't followed beyond. Shares multiply; chains below
    ``least`` end. Status is ``match`` (a listed party, with its strongest nearest chain), ``clear`` (all chains ended) or ``inconclusive``
    (some chain was still open after ``hops``), so that a bounded search never says clear of what it has not seen.
    """
    own = edges.where("share > 0").select(F.col("object").alias("owned"), F.col("subject").alias("owner"), "share")
    marked = staging.write(listed.select(F.col("entity").alias("node")).distinct().withColumn("is_listed", F.lit(True)), "listed")
    seeds = subjects.select(F.col("entity").alias("subject")).distinct()
    front = seeds.select("subject", F.col("subject").alias("node"), F.lit(0).alias("hop"), F.lit(1.0).alias("share")).join(marked, "node", "left")
    front = staging.write(front.select("subject", "node", "hop", "share", F.coalesce("is_listed", F.lit(False)).alias("is_listed")), "front-0")
    seen, hits = front, front.where("is_listed")
    for hop in range(1, hops + 1):
        step = front.where("not is_listed").select("subject", F.col("node").alias("owned"), F.col("share").alias("s")).join(own, "owned")
        new = step.groupBy("subject", F.col("owner").alias("node")).agg(F.max(F.col("s") * F.col("share")).alias("share")).where(F.col("share") >= least)
        new = new.join(seen.select("subject", "node"), ["subject", "node"], "left_anti").join(marked, "node", "left")
        front = staging.write(new.select("subject", "node", F.lit(hop).alias("hop"), "share", F.coalesce("is_listed", F.lit(False)).alias("is_listed")), f"front-{hop}")
        seen = staging.write(seen.unionByName(front), f"seen-{hop}")
        if front.isEmpty():
            break
    hits = seen.where("is_listed").select("subject", F.col("node").alias("listed"), "hop", "share")
    still = front.where("not is_listed").join(own.select(F.col("owned").alias("node")).distinct(), "node", "left_semi").select("subject").distinct().withColumn("open", F.lit(True))
    found = hits.select("subject").distinct().withColumn("hit", F.lit(True))
    rest = seeds.join(found, "subject", "left_anti").join(still, "subject", "left").select("subject", F.when(F.col("open"), "inconclusive").otherwise("clear").alias("status"))
    return hits.withColumn("status", F.lit("match")).unionByName(rest, allowMissingColumns=True)


def aggregate_ownership(edges: DataFrame, listed: DataFrame, threshold: float, staging: Staging, control: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """``(entity, round, basis)``: the least fixed point of "blocked if listed, or if blocked owners together hold at least the
    threshold (within 1e-12) and more than nothing", optionally also if a blocked party controls it (``controller, controlled``).

    Raises if entities are still added after ``max_rounds``.
    """
    blocked = staging.write(listed.select("entity", F.lit(0).alias("round"), F.lit("designated").alias("basis")).distinct(), "blocked-0")
    for r in range(1, max_rounds + 1):
        held = edges.join(blocked.select(F.col("entity").alias("subject")), "subject").groupBy(F.col("object").alias("entity")).agg(F.sum("share").alias("held"))
        new = held.where((F.col("held") >= threshold - 1e-12) & (F.col("held") > 0)).select("entity", F.lit("ownership_aggregate").alias("basis"))
        if control is not None:
            new = new.unionByName(control.join(blocked.select(F.col("entity").alias("controller")), "controller", "left_semi").select(F.col("controlled").alias("entity"), F.lit("control").alias("basis")))
        new = staging.write(new.join(blocked, "entity", "left_anti").groupBy("entity").agg(F.max("basis").alias("basis")).select("entity", F.lit(r).alias("round"), "basis"), f"new-{r}")
        if new.isEmpty():
            break
        blocked = staging.write(blocked.unionByName(new), f"blocked-{r}")
    else:
        raise RuntimeError(f"blocking did not settle in {max_rounds} rounds")
    return blocked


def counterparty_exposure(exposures: DataFrame, blocked: DataFrame, indirect: DataFrame) -> DataFrame:
    """``(holder, total, blocked, look_through, clean)``: amounts towards blocked parties, indirectly held ones in part, and the rest.

    Exposures are ``(holder, counterparty, amount)``; ``indirect`` is ``(entity, exposure)``.
    """
    b = blocked.select(F.col("entity").alias("counterparty")).distinct().withColumn("b", F.lit(True))
    i = indirect.select(F.col("entity").alias("counterparty"), "exposure")
    joined = exposures.join(b, "counterparty", "left").join(i, "counterparty", "left")
    part = F.when(F.col("b"), 0.0).otherwise(F.col("amount") * F.coalesce("exposure", F.lit(0.0)))
    held = joined.groupBy("holder").agg(F.sum("amount").alias("total"), F.coalesce(F.sum(F.when(F.col("b"), F.col("amount"))), F.lit(0.0)).alias("blocked"), F.sum(part).alias("look_through"))
    return held.withColumn("clean", F.col("total") - F.col("blocked") - F.col("look_through"))


def edge_groups(edges: DataFrame, entity: str, examples: int = 3) -> DataFrame:
    """An entity's edges by direction and predicate, with counts and the first counterparties."""
    out = edges.where(F.col("subject") == entity).select(F.lit("out").alias("direction"), "predicate", F.col("object").alias("other"))
    into = edges.where(F.col("object") == entity).select(F.lit("in").alias("direction"), "predicate", F.col("subject").alias("other"))
    per = out.unionByName(into).groupBy("direction", "predicate", "other").agg(F.count("*").alias("n"))
    w = W.partitionBy("direction", "predicate").orderBy(F.desc("n"), "other")
    ranked = per.withColumn("_r", F.row_number().over(w))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.struct("_r", "other")))), lambda x: x["other"]), ",")
    return ranked.groupBy("direction", "predicate").agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_others"), shown.alias("examples"))


def counterparties(edges: DataFrame, entity: str, degree_cap: int) -> DataFrame:
    """Entities two steps away through nodes of bounded degree, with the number of shared neighbours."""
    e = ends(edges).select("node", "other").distinct()
    near = e.where(F.col("node") == entity).select(F.col("other").alias("node"))
    small = e.join(near, "node", "left_semi").groupBy("node").agg(F.count("*").alias("d")).where(F.col("d") <= degree_cap).select("node")
    return e.join(small, "node", "left_semi").where(F.col("other") != entity).groupBy(F.col("other").alias("entity")).agg(F.count("*").alias("shared"))
