"""Structured Streaming counterparts of the batch operators.

Event time is the rows' own time; rows later than the watermark are late and dropped. Each function takes a
streaming or a batch DataFrame, so a result can be held against the same operator over all rows at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.staging import Staging


def tumbling(events: DataFrame, time: str, key: list[str], width: str, late: str) -> DataFrame:
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *key).agg(F.count("*").alias("n"), F.sum("amount").alias("total")).select(F.col("window.start").alias("start"), *key, "n", "total")


def sliding(events: DataFrame, time: str, key: list[str], width: str, step: str, late: str) -> DataFrame:
    w = F.window(time, width, step)
    return events.withWatermark(time, late).groupBy(w, *key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *key, "n")


def sessions(events: DataFrame, time: str, key: list[str], gap: str, late: str) -> DataFrame:
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w, *key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *key, "n")


def deduplicated(events: DataFrame, time: str, key: list[str], late: str) -> DataFrame:
    """The first row seen of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def latest(events: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """The last value by event time of each key, as a running state."""
    return events.groupBy(*key).agg(F.max(F.struct(time, value)).alias("m")).select(*key, F.col(f"m.{time}").alias(time), F.col(f"m.{value}").alias(value))


def enriched(events: DataFrame, table: DataFrame, key: list[str], time: str) -> DataFrame:
    """Rows of a stream with those of a dated table, ``(key, ..., valid_from, valid_to)``, valid at their time; others stay."""
    joined = events.join(table, key, "left")
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(time))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(time)))
    found = [c for c in table.columns if c not in (*key, "valid_from", "valid_to")]
    return joined.select(*events.columns, *[F.when(inside, F.col(c)).alias(c) for c in found])


def followed(first: DataFrame, then: DataFrame, key: str, time: str, within: str, late: str) -> DataFrame:
    """Pairs of rows of two streams with the same key, the second at most ``within`` after the first.

    Both sides' watermarks and the time range bound the state: a row is forgotten once nothing can match it.
    """
    a = first.withWatermark(time, late).select(F.col(key), F.col("event_id").alias("first_id"), F.col(time).alias("first_at"))
    b = then.withWatermark(time, late).select(F.col(key).alias("_key"), F.col("event_id").alias("then_id"), F.col(time).alias("then_at"))
    return a.join(b, (F.col(key) == F.col("_key")) & (F.col("then_at") > F.col("first_at")) & (F.col("then_at") <= F.col("first_at") + F.expr(f"interval {within}"))).drop("_key")


def revised(facts: DataFrame, key: list[str], time: str, published: str, value: str, late: str) -> DataFrame:
    """First and last published value of each fact; a revision later than the watermark after the fact's window doesn't count."""
    w = F.window(time, "1 day")
    marked = facts.withWatermark(time, late).groupBy(w, *key).agg(F.min(F.struct(published, value)).alias("a"), F.max(F.struct(published, value)).alias("b"), F.count("*").alias("n"))
    return marked.select(F.col("window.start").alias("start"), *key, F.col(f"a.{value}").alias("first_value"), F.col(f"b.{value}").alias("last_value"), "n")


def run_available(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], mode: str = "append", label: str = "stream", files_per_batch: int | None = None) -> DataFrame:
    """Runs a stream over the Parquet files at a path until all are read, and returns its output table.

    Complete and update outputs go through ``foreachBatch``: each batch replaces the table of the one before.
    """
    st = Staging(spark, label)
    target, checkpoint = st.folder("out"), st.folder("checkpoint")
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    source = reader.parquet(folder)
    result = shape(source)
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", target)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
    writer.start().awaitTermination()
    return spark.read.schema(result.schema).parquet(target)
