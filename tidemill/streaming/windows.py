"""Windowed counts of a stream of files, and upserts of a stream into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemill.errors import MisuseError
from tidemill.store.connection import Connection, Database


def read_events(spark: SparkSession, path: str, schema: StructType | str, time: str = "ts", lateness: str = "10 minutes", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in ``path``; rows later than ``lateness`` behind the latest may be dropped."""
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def tumbling_counts(events: DataFrame, size: str, *keys: str, time: str = "ts", value: str | None = None) -> DataFrame:
    """(window_start, keys, n and, with ``value``, total) for windows of ``size``."""
    more = [F.sum(value).alias("total")] if value else []
    out = events.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), *more)
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def session_counts(events: DataFrame, gap: str, *keys: str, time: str = "ts") -> DataFrame:
    """(session_start, session_end, keys, n): runs of a key's events with less than ``gap`` between them."""
    out = events.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def run_available(df: DataFrame, checkpoint: str, target: str, mode: str = "append") -> StreamingQuery:
    """Process what there is into Parquet files and stop."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_stream(events: DataFrame, connection: Connection, table: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is an INSERT OR REPLACE into ``table`` by its key, so a batch that runs again changes nothing. A table without a key is refused."""
    columns = events.columns
    if not connection.manifest.table(table).key:
        raise MisuseError(f"{table} has no key to upsert by")

    def write(batch: DataFrame, _: int) -> None:
        # A micro-batch lives in a session of its own, which the statement has to run in.
        db = Database(batch.sparkSession)
        db.log, db.attached = connection.db.log, {**connection.db.attached, "__batch": batch}
        own = db.connect(connection.branch)
        own.session, own.bypass = connection.session, connection.bypass
        names = ", ".join(f'"{c}"' for c in columns)
        own.exec(f'INSERT OR REPLACE INTO "{table}" ({names}) SELECT {names} FROM __batch')

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
