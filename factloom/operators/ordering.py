"""Places in a global order without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with name, their place (from 0) in the order, which must tell all rows apart.

    Rows are dealt by ranges of the order and written once, so that partition numbers stay; each partition starts after the counts of
    those before it, and a window numbers rows inside a partition alone.
    """
    held = files.kept(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).select("__p", before.alias("__start"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return held.withColumn("__r", inside).join(F.broadcast(starts), "__p").withColumn(name, (F.col("__start") + F.col("__r")).cast("long")).drop("__p", "__r", "__start")


def runs(rows: DataFrame, key: list[str], order: list[Column], hit: Column, name: str) -> DataFrame:
    """rows with name: how many hits in a row end at each row of its key, 0 where it is no hit.  key and order together must tell all rows apart.

    Rows are dealt by ranges of key and order, so a key of any size is spread.  Each partition counts by itself and says for its keys how many hits it ends
    with and whether anything broke the run; a window over these few rows carries the counts on.  A partition goes on with one key at most, so the
    carried counts are no more than the partitions and are broadcast.
    """
    by = [F.col(k).asc_nulls_first() for k in key]
    dealt = files.kept(rows.withColumn("__h", F.coalesce(hit, F.lit(False))).repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    here = Window.partitionBy("__p", *key).orderBy(*order)
    held = dealt.withColumns({"__b": F.sum((~F.col("__h")).cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0)), "__i": F.row_number().over(here)})
    counted = held.withColumn("__c", F.when(F.col("__h"), F.sum(F.col("__h").cast("long")).over(Window.partitionBy("__p", *key, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    ends = counted.groupBy("__p", *key).agg(F.max_by("__c", "__i").alias("end"), (F.max("__b") > 0).alias("broke"))
    parts = Window.partitionBy(*key).orderBy("__p")
    ends = ends.withColumn("g", F.sum(F.col("broke").cast("int")).over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("total", F.sum("end").over(Window.partitionBy(*key, "g").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)))
    carried = ends.withColumn("__carry", F.lag("total", 1, 0).over(parts)).filter("__carry > 0").select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], "__carry")
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = counted.join(F.broadcast(carried), same, "left")
    whole = F.col("__c") + F.when(F.col("__h") & (F.col("__b") == 0), F.coalesce("__carry", F.lit(0))).otherwise(0)
    return out.withColumn(name, whole.cast("long")).drop("__h", "__p", "__b", "__i", "__c", "__q", "__carry", *[f"__k{i}" for i in range(len(key))])


def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row at each event of a user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    return runs(events, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()], F.col("event_type") == "error", "failures").select("user_id", "event_id", "failures")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Takes the place of the declarative form, whose SQL stays the oracle."""
    return {"consecutive_failures": consecutive_failures}
