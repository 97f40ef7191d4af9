"""Incremental runs: the batch functions over a file stream, one pass with availableNow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import runs
from ..sources import files
from . import durable


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct kinds of events per user as they arrive, appended to files; the sink's log makes each batch count once."""
    root = files.work_dir(spark)
    stream = _stream(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out", format="parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def daily_counts(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Events per day and kind, those counted before included."""
    now = rows.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    if before is None:
        return now
    return now.unionByName(before).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and kind, kept as a state of its own from batch to batch."""
    return durable.advance(_stream(spark, sf_dir, "events").select("ts", "event_type"), daily_counts, files.work_dir(spark))


def failures(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Failures in a row at the end of each user's events: those of the batch, and those before it where the batch had nothing else.

    Batches come in order of time; inside a batch rows go by (ts, event_id), and a user of any size is spread over partitions.
    """
    told = runs(rows, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()], F.col("failed"), "n")
    now = told.groupBy("user_id").agg(F.max_by("n", F.struct("ts", "event_id")).alias("now"), F.every("failed").alias("all"))
    if before is None:
        return now.select("user_id", F.col("now").alias("failures"))
    both = now.join(before.withColumnRenamed("user_id", "u"), F.col("user_id").eqNullSafe(F.col("u")), "full")
    seen = F.col("now").isNotNull()
    count = F.when(seen, F.col("now") + F.when(F.col("all"), F.coalesce("failures", F.lit(0))).otherwise(0)).otherwise(F.col("failures"))
    return both.select(F.when(seen, F.col("user_id")).otherwise(F.col("u")).alias("user_id"), count.alias("failures"))


def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row at the end of each user's events, in six batches or more; the run is stopped in the second one and started again."""
    root = files.work_dir(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    stream = durable.in_pieces(events, root, 2_000_000, 6, "ts", "event_id")
    durable.advance(stream, failures, root, stop_after=2)
    return durable.advance(stream, failures, root)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"stream_dedup": stream_dedup, "stream_daily_counts": stream_daily_counts, "stream_failures": stream_failures}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "stream_failures": """SELECT user_id, count(*) FILTER (event_type = 'error' AND NOT later) AS failures FROM (
            SELECT user_id, event_type, coalesce(bool_or(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM events) t GROUP BY user_id""",
    }
