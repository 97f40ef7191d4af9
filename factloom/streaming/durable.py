"""Runs that can be stopped and started again: each batch writes its own folder, and a checkpoint says which batches are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rows of the batch, state after the batch before or None) -> state after the batch.
Step = Callable[[DataFrame, DataFrame | None], DataFrame]


class Stopped(Exception):
    """A run was asked to stop before all batches were done."""


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches written whole, in order; their count is that of the batches kept, not of the data."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName()) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def advance(stream: DataFrame, step: Step, root: str, stop_after: int | None = None) -> DataFrame | None:
    """Take in all that the stream has, from where the last run over root stopped; the state after it (None if there never was a batch).

    The state after batch n is the folder n of root/state, made of folder n - 1 and the batch alone.  A batch that is run again, because its run ended between
    its writing and the checkpoint's, writes the same folder anew, so nothing counts twice.  The two latest states are kept.
    stop_after ends the run, as a lost driver would, once that many batches were written and before the last of them is in the checkpoint.
    """
    spark = stream.sparkSession
    written = 0

    def each(rows: DataFrame, batch: int) -> None:
        nonlocal written
        session = rows.sparkSession
        done = [b for b in _batches(session, root) if b < batch]
        before = session.read.parquet(f"{root}/state/{done[-1]}") if done else None
        step(rows, before).write.mode("overwrite").parquet(f"{root}/state/{batch}")
        for old in done[:-1]:
            path = session._jvm.org.apache.hadoop.fs.Path(f"{root}/state/{old}")
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
        written += 1
        if stop_after is not None and written >= stop_after:
            raise Stopped(batch)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if stop_after is None or written < stop_after:
            raise
    done = _batches(spark, root)
    return spark.read.parquet(f"{root}/state/{done[-1]}") if done else None


def in_pieces(table: DataFrame, root: str, rows: int, least: int, *order: str) -> DataFrame:
    """table as a stream of files of about so many rows, at least least of them, one a batch, in the order of columns: for tables that arrived at once."""
    spark = table.sparkSession
    pieces = max(least, -(-table.count() // rows))
    table.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id()).write.partitionBy("piece").parquet(f"{root}/pieces")
    table.limit(0).write.parquet(f"{root}/source")
    held = [r.piece for r in spark.read.schema("piece int").parquet(f"{root}/pieces").distinct().collect()] if pieces else []
    for piece in sorted(held):  # the stream takes files in the order in which they were written
        spark.read.schema(table.schema).parquet(f"{root}/pieces/piece={piece}").coalesce(1).write.mode("append").parquet(f"{root}/source")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
