"""The record model: four kinds of dated evidence, their rules, and how rows become records.

Rules are checked as data: ``violations`` adds one array column that names every broken rule, so that bad
records can be counted, quarantined or refused by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

KINDS = ("entity", "observation", "assertion", "event")

EVIDENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "kind", "dataset", "stage", "version", "entity_id", "entity_type", "label", "subject", "metric", "value", "unit", "missing_reason", "predicate", "object", "event_type", "epistemic_status", "published_source", "price_basis", "base_period")]
    + [T.StructField(n, T.DoubleType()) for n in ("weight", "confidence")]
    + [T.StructField(n, T.TimestampNTZType()) for n in ("occurred_at", "valid_from", "valid_to", "observed_at", "published_at")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("participants", "retracts", "supersedes")]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("dimensions", "attributes")]
    + [T.StructField("evidence", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("dataset", "stage", "version", "artifact", "record_id", "locator")])))]
)


def namespaced(c: Column | str) -> Column:
    """An id is ``namespace:value``."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"^[^:\s]+:.+")


def rules(columns: list[str]) -> dict[str, Column]:
    """The named rules that apply to a table with these columns; true where a rule is broken."""
    has = set(columns).__contains__
    found: dict[str, Column] = {}
    if has("id"):
        found["id_not_namespaced"] = ~namespaced("id")
    if has("kind"):
        found["unknown_kind"] = ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    if has("valid_from") and has("valid_to"):
        found["interval_not_positive"] = F.coalesce(F.col("valid_from") >= F.col("valid_to"), F.lit(False))
    if has("confidence"):
        found["confidence_out_of_range"] = F.coalesce(~F.col("confidence").between(0, 1), F.lit(False))
    if has("kind") and has("value") and has("missing_reason"):
        found["missing_without_reason"] = (F.col("kind") == "observation") & F.col("value").isNull() & F.col("missing_reason").isNull()
    if has("kind") and has("value") and has("object"):
        found["object_and_value"] = (F.col("kind") == "assertion") & (F.col("object").isNull() == F.col("value").isNull())
    if has("price_basis") and has("base_period"):
        found["real_without_base"] = (F.col("price_basis") == "real") & F.col("base_period").isNull()
    if has("evidence"):
        one = lambda e: e["version"].isNull() != e["artifact"].isNull()
        found["evidence_missing"] = F.coalesce(F.size("evidence"), F.lit(0)) <= 0
        found["evidence_ambiguous"] = ~F.coalesce(F.forall("evidence", one), F.lit(True))
    return found


def violations(records: DataFrame) -> DataFrame:
    """Adds ``violations``, the sorted names of the rules each record breaks."""
    marks = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(rules(records.columns).items())]
    return records.withColumn("violations", F.filter(F.array(*marks), lambda x: x.isNotNull()) if marks else F.array().cast("array<string>"))


def valid_or_raise(records: DataFrame) -> DataFrame:
    """The records, failing the job at the first one that breaks a rule."""
    checked = violations(records)
    return checked.where(F.when(F.size("violations") > 0, F.raise_error(F.concat_ws(" ", F.lit("record breaks:"), F.array_join("violations", ",")))).otherwise(F.lit(True)).cast("boolean")).drop("violations")


def record_id(prefix: str, *parts: Column | str) -> Column:
    """A stable id from the hash of its parts."""
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256))


def normalize(rows: DataFrame, subject: Column, metrics: dict[str, tuple[str, str]], id_columns: list[str], dataset: str, nulls: tuple[str, ...] = ("",), constants: dict[str, Column] | None = None) -> DataFrame:
    """Wide rows to one observation per metric.

    ``metrics`` maps a column to (metric, unit). Values among ``nulls`` become NULL with a reason.
    """
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.col(c).cast("string").alias("raw")) for c, (m, u) in metrics.items()]
    long = rows.withColumn("_cell", F.explode(F.array(*cells)))
    raw = F.col("_cell.raw")
    missing = raw.isNull() | raw.isin(*nulls)
    return long.select(
        record_id(dataset, *id_columns, F.col("_cell.metric")).alias("id"),
        F.lit("observation").alias("kind"),
        F.lit(dataset).alias("dataset"),
        subject.alias("subject"),
        F.col("_cell.metric").alias("metric"),
        F.when(~missing, F.expr("try_cast(_cell.raw as double)")).alias("value"),
        F.col("_cell.unit").alias("unit"),
        F.when(missing, "blank").when(F.expr("try_cast(_cell.raw as double)").isNull(), "not_a_number").alias("missing_reason"),
        *[c.alias(n) for n, c in (constants or {}).items()],
    )


def union_evidence(*tables: tuple[str, DataFrame]) -> DataFrame:
    """All records, contradictions kept: each gets an id of its own and points at its parent record."""
    out = None
    for ref, table in tables:
        own = table.withColumn("parent", F.concat_ws("/", F.lit(ref), F.col("id"))).withColumn("id", record_id("view", F.lit(ref), "id"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def profile(rows: DataFrame) -> DataFrame:
    """``(column, n, missing, distinct)``; empty strings count as missing."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in rows.columns]))
    present = F.when(F.col("c.v") != "", F.col("c.v"))
    return rows.select(cells.alias("c")).groupBy("c.column").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("c.v"), F.lit("")) == "").alias("missing"), F.count_distinct(present).alias("distinct_values"))


def duplicate_ids(records: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one record has, with the count."""
    return records.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Records whose parent doesn't exist."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
