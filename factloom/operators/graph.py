"""Property-graph reading over an edge table ``(subject, predicate, object, weight, ...)``.

Degrees, flows and incident edges are aggregations and equi-joins. Reachability, shortest paths and
PageRank run level by level over tables written in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from factloom.operators.asof import AsOf
from factloom.operators.components import connected_components
from factloom.operators.staging import Staging


def resolved(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges between canonical entities; ``canonical`` is ``(entity, canonical)``, identity where absent."""
    s = canonical.toDF("subject", "_s")
    o = canonical.toDF("object", "_o")
    joined = edges.join(s, "subject", "left").join(o, "object", "left")
    return joined.withColumns({"subject": F.coalesce("_s", "subject"), "object": F.coalesce("_o", "object")}).select(edges.columns)


def ends(edges: DataFrame, direction: str = "both") -> DataFrame:
    """``(node, other, ...)`` seen from the subject (out), the object (in) or both."""
    out = edges.withColumns({"node": F.col("subject"), "other": F.col("object")})
    into = edges.withColumns({"node": F.col("object"), "other": F.col("subject")})
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)


def degree(edges: DataFrame, direction: str = "both", limit: int | None = None) -> DataFrame:
    """``(node, degree, weight)``, the most connected first."""
    found = ends(edges, direction).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))
    return found.orderBy(F.desc("degree"), "node").limit(limit) if limit else found


def flow(edges: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Total weight and count by subject, object or both."""
    found = edges.groupBy(*by).agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    return found.orderBy(F.desc("total"), *by).limit(limit) if limit else found


def levels(edges: DataFrame, seeds: DataFrame, hops: int, staging: Staging, direction: str = "both") -> DataFrame:
    """``(node, hop)`` for nodes within ``hops`` of the seeds, each at its shortest distance."""
    step = ends(edges, direction).select("node", "other").distinct()
    frontier = staging.write(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "hop-0")
    reached = [frontier]
    for hop in range(1, hops + 1):
        seen = reached[0]
        for r in reached[1:]:
            seen = seen.unionByName(r)
        found = step.join(frontier.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct()
        frontier = staging.write(found.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), f"hop-{hop}")
        reached.append(frontier)
        if frontier.isEmpty():
            break
    out = reached[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    return out


def selected(edges: DataFrame, predicates: list[str] | None = None, min_weight: float | None = None, policy: AsOf | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """Edges by predicate, least weight, validity and publication, between canonical entities if a resolution is given."""
    out = policy.read(edges) if policy else edges
    if predicates is not None:
        out = out.where(F.col("predicate").isin(predicates))
    if min_weight is not None:
        out = out.where(F.col("weight") >= min_weight)
    return resolved(out, canonical) if canonical is not None else out


def _search(step: DataFrame, source: str, hops: int, staging: Staging, target: str | None = None) -> tuple[DataFrame, bool]:
    """``(node, hop, parents...)``: the links by which each node is first reached, level by level.

    ``step`` is ``(node, other, *link)``. One table of reached nodes grows with the levels; a level joins the frontier
    alone. Stops at the target's level if one is given; the second value says that it was reached.
    """
    links = [c for c in step.columns if c not in ("node", "other")]
    spark = step.sparkSession
    frontier = staging.write(spark.range(1).select(F.lit(source).alias("node")), "frontier-0")
    seen, out, found = frontier, None, False
    for hop in range(1, hops + 1):
        reached = step.join(frontier, "node").join(seen.withColumnRenamed("node", "other"), "other", "left_anti")
        level = staging.write(reached.select(F.col("other").alias("node"), F.lit(hop).alias("hop"), F.col("node").alias("parent"), *links), f"level-{hop}")
        out = level if out is None else out.unionByName(level)
        frontier = staging.write(level.select("node").distinct(), f"frontier-{hop}")
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            found = True
            break
        if frontier.isEmpty():
            break
        seen = staging.write(seen.unionByName(frontier), f"seen-{hop}") if hop % 4 == 0 else seen.unionByName(frontier)
    return out, found


def shortest_paths(edges: DataFrame, source: str, hops: int, staging: Staging, direction: str = "out") -> DataFrame:
    """``(node, hop, parent)``: the smallest parent on a shortest path from the source."""
    step = staging.write(ends(edges.select("subject", "object"), direction).select("node", "other").distinct(), "steps")
    reached, _ = _search(step, source, hops, staging)
    root = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"))
    return root.unionByName(reached.groupBy("node", "hop").agg(F.min("parent").alias("parent")))


def all_shortest_paths(edges: DataFrame, source: str, target: str, hops: int, staging: Staging, direction: str = "both", limit: int | None = None) -> DataFrame:
    """``(path, length, steps)``: all shortest paths from source to target, or the first ``limit``, parallel edges apart.

    Edges have an ``eid``. Steps are ``(source, target, predicate, eid, forward)`` in order. Paths are numbered in the order of
    (parent, edge) read back from the target, edges without ``eid`` last; as every tail leads to the source, no more tails grow
    than there are paths, and of a limit only the first at each level can matter. A path from a node to itself is one of no steps.
    """
    spark = edges.sparkSession
    kind = "array<struct<source:string,target:string,predicate:string,eid:long,forward:boolean>>"
    if source == target:
        return spark.range(1).select(F.lit(1).alias("path"), F.lit(0).alias("length"), F.array().cast(kind).alias("steps"))
    link = edges.select("subject", "object", "predicate", "eid")
    step = ends(link, direction).select("node", "other", "predicate", "eid", (F.col("node") == F.col("subject")).alias("forward"))
    reached, found = _search(step, source, hops, staging, target)
    if not found:
        return spark.range(0).select(F.lit(1).alias("path"), F.lit(0).alias("length"), F.array().cast(kind).alias("steps"))
    length = reached.agg(F.max("hop")).first()[0]
    order = F.array().cast("array<struct<parent:string,unknown:boolean,eid:long>>")
    tails = spark.range(1).select(F.lit(target).alias("at"), order.alias("o"), F.array().cast(kind).alias("steps"))
    for hop in range(length, 0, -1):
        links = reached.where(F.col("hop") == hop).select(F.col("node").alias("at"), "parent", "predicate", "eid", "forward")
        one = F.struct(F.col("parent").alias("source"), F.col("at").alias("target"), "predicate", "eid", "forward")
        grown = tails.join(links, "at").select(F.col("parent").alias("at"), F.concat("o", F.array(F.struct("parent", F.col("eid").isNull().alias("unknown"), "eid"))).alias("o"), F.concat(F.array(one), "steps").alias("steps"))
        tails = staging.write(grown if limit is None else grown.orderBy("o").limit(limit), f"tails-{hop}")
    return _numbered(tails, "o", "path", staging).select("path", F.lit(length).alias("length"), "steps")


def _numbered(rows: DataFrame, order: str, name: str, staging: Staging) -> DataFrame:
    """Rows with an int ``name`` from 1 on in the order of a column: sorted by ranges, each range counting on from those before it."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    ranged = staging.write(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    bases = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select("_range", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return ranged.join(bases, "_range").withColumn(name, (F.col("_at") + F.col("_base")).cast("int")).drop("_range", "_at", "_base")


def neighbors(records: DataFrame, seed: str, hops: int, limit: int, staging: Staging) -> tuple[DataFrame, bool]:
    """The first ``limit`` assertions around a node and whether there were more, with the hop that met each.

    Records are ``(rid, subject, object, ...)``, object NULL for a literal. Order: hop, the node met from, record.
    """
    linked = records.where("object is not null").select("subject", "object")
    near = levels(linked, records.sparkSession.range(1).select(F.lit(seed).alias("node")), hops - 1, staging)
    subject = records.join(near.withColumnRenamed("node", "subject"), "subject").select("rid", F.col("subject").alias("met_from"), (F.col("hop") + 1).alias("hop"))
    object_ = records.join(near.withColumnRenamed("node", "object"), "object").select("rid", F.col("object").alias("met_from"), (F.col("hop") + 1).alias("hop"))
    first = subject.unionByName(object_).groupBy("rid").agg(F.min(F.struct("hop", "met_from")).alias("m")).select("rid", "m.hop", "m.met_from")
    kept = staging.write(first.orderBy("hop", "met_from", "rid").limit(limit + 1), "neighbors")
    more = kept.count() > limit
    return records.join(kept.orderBy("hop", "met_from", "rid").limit(limit), "rid"), more


def members(canonical: DataFrame, entity: str) -> DataFrame:
    """All ids of an entity's cluster, itself if it has none."""
    own = canonical.where(F.col("entity") == entity).select("canonical")
    found = canonical.join(own, "canonical", "left_semi").select("entity", "canonical")
    alone = canonical.sparkSession.range(1).select(F.lit(entity).alias("entity"), F.lit(entity).alias("canonical"))
    return found.unionByName(alone).groupBy("entity").agg(F.min_by("canonical", F.col("canonical") == F.lit(entity)).alias("canonical"))


def resolved_entity(records: DataFrame, canonical: DataFrame, entity: str, limit: int = 100, policy: AsOf | None = None) -> DataFrame:
    """The entity records of a whole cluster, by id, at most ``limit``; records are ``(rid, entity_id, ...)``."""
    rows = policy.read(records) if policy else records
    own = members(canonical, entity).select(F.col("entity").alias("entity_id"), "canonical")
    return rows.join(own, "entity_id").orderBy("entity_id", "rid").limit(limit)


def observations(records: DataFrame, metric: str, limit: int = 100, policy: AsOf | None = None) -> DataFrame:
    """The first observations of a metric in the order of dataset and record."""
    rows = policy.read(records) if policy else records
    return rows.where((F.col("kind") == "observation") & (F.col("metric") == metric)).orderBy("dataset", "rid").limit(limit)


def edge_records(records: DataFrame, paths: DataFrame) -> DataFrame:
    """The records behind the edges of paths, each once; records have the edges' ``eid``."""
    return records.join(paths.select(F.explode("steps.eid").alias("eid")).distinct(), "eid", "left_semi")


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int, staging: Staging) -> DataFrame:
    """Edges with an end fewer than ``hops`` steps from the seeds, each once."""
    near = levels(edges, seeds, hops - 1, staging).select("node")
    s = edges.join(near.withColumnRenamed("node", "subject"), "subject", "left_semi")
    o = edges.join(near.withColumnRenamed("node", "object"), "object", "left_semi")
    return s.unionByName(o.select(s.columns)).distinct()


def pagerank(edges: DataFrame, iterations: int, staging: Staging, damping: float = 0.85, tolerance: float = 1e-10, weighted: bool = True) -> DataFrame:
    """``(node, rank)``: loops are dropped, parallel edges added up, negative weights are 0; nodes that give nothing
    spread evenly. Ends after ``iterations`` rounds or when the ranks move by less than ``tolerance`` in all."""
    weight = F.greatest(F.col("weight").cast("double"), F.lit(0.0)) if weighted else F.lit(1.0)
    if not weighted:
        edges = edges.select("subject", "object").distinct()
    nodes = staging.write(edges.select(F.col("subject").alias("node")).unionByName(edges.select(F.col("object").alias("node"))).distinct(), "nodes")
    arcs = edges.where("subject <> object").groupBy("subject", "object").agg(F.sum(weight).alias("w")).where("w > 0")
    arcs = staging.write(arcs.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy("subject"))).select("subject", "object", "share"), "arcs")
    n = nodes.count()
    giving = staging.write(arcs.select(F.col("subject").alias("node")).distinct(), "giving")
    rank = staging.write(nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0)), "rank-0")
    for i in range(1, iterations + 1):
        lost = rank.join(giving, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = arcs.join(rank.withColumnRenamed("node", "subject"), "subject").groupBy(F.col("object").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = F.lit((1 - damping) / max(n, 1) + damping * lost / max(n, 1))
        new = staging.write(rank.withColumnRenamed("rank", "old").join(given, "node", "left").select("node", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "old"), f"rank-{i}")
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        staging.drop(rank)
        rank = new.drop("old")
        rank._staged_path = new._staged_path
        if moved < tolerance:
            break
    return rank


def identity_clusters(links: DataFrame, staging: Staging, max_size: int | None = None) -> DataFrame:
    """``(entity, canonical)`` from same-as links ``(a, b)``; clusters above ``max_size`` are refused."""
    found = connected_components(links, staging).toDF("entity", "canonical")
    if max_size is None:
        return found
    large = found.groupBy("canonical").agg(F.count("*").alias("n")).where(F.col("n") > max_size).select("canonical")
    return found.join(large, "canonical", "left_anti").select("entity", "canonical")
