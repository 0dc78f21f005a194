"""What the engine has beyond its dialect: streams, and joins with care."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.registry import plan


def _events_folder(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A stream's source is a folder of files: the table as a folder, and its schema."""
    from tidemill.sources.scratch import scratch

    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = scratch(spark, "events")
    df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").write.parquet(path)
    return path, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours of lateness over four files: the month's halves, then rows that come late, then one far ahead that closes all windows.

    Of the late rows one is an hour behind the latest and counts, one is weeks behind, its window closed and its state gone, and doesn't.
    """
    from tidemill.sources.scratch import scratch
    from tidemill.streaming.windows import read_events, run_available, tumbling_counts

    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    late = [(-1, last - datetime.timedelta(hours=1), "late"), (-2, first, "too late")]
    path = scratch(spark, "events")
    for part in (df.where(F.col("ts") <= F.lit(middle)), df.where(F.col("ts") > F.lit(middle)), spark.createDataFrame(late, df.schema), spark.createDataFrame([(-3, last + datetime.timedelta(days=1), "end")], df.schema)):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken in the order of their times
    out = scratch(spark, "counts")
    counts = tumbling_counts(read_events(spark, path, df.schema, lateness="2 hours", files_per_batch=1), "1 hour", "event_type")
    run_available(counts, scratch(spark, "checkpoint"), out)
    return spark.read.parquet(out).where("event_type <> 'end'").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.sources.scratch import scratch
    from tidemill.store.connection import Database
    from tidemill.streaming.windows import upsert_stream

    path, schema = _events_folder(spark, sf_dir)
    c = Database(spark, scratch(spark, "store")).connect()
    c.exec("CREATE TABLE seen (event_id INTEGER PRIMARY KEY, event_type TEXT, value REAL); INSERT INTO seen VALUES (0, 'old', -1.0), (-7, 'kept', 0.5)")
    upsert_stream(spark.readStream.schema(schema).parquet(path).select("event_id", "event_type", "value"), c, "seen", scratch(spark, "checkpoint"))
    return c.sql("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM seen GROUP BY event_type")


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.joins import range_join

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    bands = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") * 20000.0).alias("lo"), (F.col("n_nationkey") * 20000.0 + 15000.0).alias("hi"))
    return range_join(orders, bands, "o_totalprice", "lo", "hi", 15000.0).groupBy("n_nationkey").agg(F.count("*").alias("n"))


def _salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.joins import salted_join

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity")
    flags = spark.createDataFrame([("A", "returned"), ("N", "kept"), ("R", "refused")], "l_returnflag string, meaning string")
    return salted_join(lines, flags, ["l_returnflag"]).groupBy("meaning").agg(F.count("*").alias("n"))


def register() -> None:
    plan("stream_tumbling_count", _tumbling, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM (SELECT ts, event_type FROM events UNION ALL SELECT max(ts) - INTERVAL 1 HOUR, 'late' FROM events) GROUP BY 1, 2")
    plan("stream_upsert", _upsert, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value FROM events UNION ALL SELECT 'kept', 0.5) GROUP BY event_type")
    plan("join_range_bucketed", _range, "SELECT n_nationkey, count(*) AS n FROM orders JOIN nation ON o_totalprice BETWEEN n_nationkey * 20000.0 AND n_nationkey * 20000.0 + 15000.0 GROUP BY n_nationkey")
    plan("join_salted", _salted, "SELECT CASE l_returnflag WHEN 'A' THEN 'returned' WHEN 'N' THEN 'kept' ELSE 'refused' END AS meaning, count(*) AS n FROM lineitem GROUP BY 1")
