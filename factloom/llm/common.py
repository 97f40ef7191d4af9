"""Shared plumbing: tables cut in the cluster's shared folder and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables that the scopes now open have made, the innermost scope last.
_SCOPES: list[list[str]] = []

#: Plan nodes under which a row's place is the same in every pass.
_STILL = ("Project", "Filter", "LogicalRelation", "Relation")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Only a local session, whose tasks share the driver's disk, may do without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Lineage ends here: a lost executor costs a re-read, and values that depend on the
    placement of rows (partition ids, row ids) are fixed once and for all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() makes inside are deleted at the end; write what they give before that.  Tables made outside a scope stay."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _SCOPES.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with a row id that is the same in every pass.

    Where rows are selected from Parquet files, the id is made of the file's number (files by path) and the row's index in it, which do not depend on how
    files are split into tasks; anything else is cut as a table.
    """
    node = rows._jdf.queryExecution().optimizedPlan()
    still = node.deterministic()
    while still and node.nodeName().split(" ")[0] in _STILL and node.children().size() == 1:
        node = node.children().head()
    still = still and node.nodeName().split(" ")[0] in _STILL and node.children().isEmpty() and node.nodeName() != "LocalRelation"
    if still:
        try:
            place = rows.metadataColumn("_metadata")
            placed = rows.select("*", place["file_path"].alias("__file"), place["row_index"].alias("__index"))
        except AnalysisException:  # not files, or files without row indexes
            still = False
    if not still:
        return cut(rows.select("*", F.monotonically_increasing_id().alias(name)))
    files = cut(placed.select("__file").distinct())
    if files.count() == 1:
        return placed.withColumn(name, F.col("__index")).drop("__file", "__index")
    files = files.withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("long"))
    return placed.join(F.broadcast(files), "__file").withColumn(name, F.shiftleft("__number", 40) + F.col("__index")).drop("__file", "__index", "__number")


def small(table: DataFrame, max_rows: int) -> DataFrame:
    """table with a broadcast hint if it is counted to hold max_rows rows at most, else as it is."""
    return F.broadcast(table) if table.count() <= max_rows else table


def running_totals(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], group: Sequence[str] = (), index: str | None = None
) -> DataFrame:
    """Add, for each (name, column) of sums, the total of the column over all earlier rows of the row's group.

    index names a column for the number of earlier rows.  Rows are range-partitioned by group and
    order, so a group of any size is spread over partitions; per-partition totals give each partition
    its start, and the rest is a window inside one partition.  Group columns must not be null.
    """
    sums = dict(sums)
    if index:
        df = df.withColumn("__one", F.lit(1).cast("long"))
        sums[index] = "__one"
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    table = cut(df.repartitionByRange(*keys).withColumn("__pid", F.spark_partition_id()))
    part = ["__pid", *group]
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        table.groupBy(*part)
        .agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
        .select(*part, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).cast("long").alias(f"__s_{n}") for n in sums])
    )
    inside = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = table.join(starts, part)
    for n, c in sums.items():
        out = out.withColumn(n, (F.col(f"__s_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long"))
    return out.drop("__pid", "__one", *[f"__s_{n}" for n in sums])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
