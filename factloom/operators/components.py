"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.staging import Staging


def connected_components(edges: DataFrame, staging: Staging, src: str = "a", dst: str = "b", max_rounds: int = 50) -> DataFrame:
    """One row ``(node, component)`` for each node of an edge; the component is its smallest node.

    Each round replaces edges by edges to smaller nodes (Kiveris et al., 2014), so a chain of n nodes
    takes O(log n) rounds. A round is two aggregations to one row per node and two joins against that
    row, so a hub's edges can be split over tasks. Edges with a null end and loops are ignored.
    """
    cur = staging.write(
        edges.where(f"`{src}` is not null and `{dst}` is not null and `{src}` <> `{dst}`")
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low2, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = staging.write(small, "stars")
        now = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        staging.drop(cur)
        cur = nxt
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
