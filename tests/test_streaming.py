"""Late rows, revisions and joins of streams that come in several batches."""

import os

from pyspark.sql import functions as F

from factloom import streaming


def written(spark, folder, batches, schema):
    """One Parquet file a batch, in order of their times."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp-{i}")
        (part,) = [f for f in os.listdir(f"{folder}/tmp-{i}") if f.startswith("part-")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp-{i}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{folder}/in/*.parquet"


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    """A later batch holds a row ten hours late, beyond the watermark of one hour, and one within it."""
    batches = [[("k", "2024-01-01 00:10:00", 1.0), ("k", "2024-01-01 10:30:00", 1.0)], [("k", "2024-01-01 10:40:00", 0.0)], [("k", "2024-01-01 00:20:00", 5.0), ("k", "2024-01-01 10:10:00", 2.0), ("k", "2024-01-01 14:00:00", 1.0)], [("k", "2024-01-01 20:00:00", 1.0)]]
    path = written(spark, str(tmp_path), batches, "key string, ts string, amount double")
    shape = lambda df: streaming.tumbling(df.withColumn("ts", F.to_timestamp("ts")), "ts", ["key"], "1 hour", "1 hour")
    got = {str(r["start"]): (r["n"], r["total"]) for r in streaming.run_available(spark, path, shape, files_per_batch=1).collect()}
    assert got["2024-01-01 00:00:00"] == (1, 1.0) and got["2024-01-01 10:00:00"] == (3, 3.0) and "2024-01-01 20:00:00" not in got


def test_revisions_within_the_watermark_count(spark, tmp_path):
    batches = [[("a", "2024-01-01 05:00:00", 1, 10.0)], [("a", "2024-01-01 05:00:00", 2, 11.0), ("b", "2024-01-02 12:00:00", 2, 1.0)], [("b", "2024-01-09 00:00:00", 3, 1.0)]]
    path = written(spark, str(tmp_path), batches, "key string, ts string, published int, value double")
    shape = lambda df: streaming.revised(df.withColumn("ts", F.to_timestamp("ts")), ["key"], "ts", "published", "value", "2 days")
    got = {r["key"]: (r["first_value"], r["last_value"], r["n"]) for r in streaming.run_available(spark, path, shape, files_per_batch=1).where("start < '2024-01-03'").collect()}
    assert got["a"] == (10.0, 11.0, 2) and got["b"] == (1.0, 1.0, 1)


def test_streams_join_across_batches(spark, tmp_path):
    """A match may come in a later batch; outside the range there is none."""
    batches = [[("u", 1, "2024-01-01 00:00:00", "click")], [("u", 2, "2024-01-01 01:00:00", "buy"), ("u", 3, "2024-01-01 03:00:00", "buy")]]
    path = written(spark, str(tmp_path), batches, "user_id string, event_id int, ts string, kind string")

    def shape(df):
        e = df.withColumn("ts", F.to_timestamp("ts"))
        return streaming.followed(e.where("kind = 'click'"), e.where("kind = 'buy'"), "user_id", "ts", "2 hours", "1 day")

    got = streaming.run_available(spark, path, shape, files_per_batch=1).collect()
    assert [(r["first_id"], r["then_id"]) for r in got] == [(1, 2)]
