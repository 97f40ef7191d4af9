"""Files in and out: flat CSV, nested JSON, a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session may do without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or 'file://' + tempfile.gettempdir()).rstrip('/')}/files/{uuid.uuid4().hex}"


#: Spark's setting that takes the shuffle files of a query away when it ends; else they stay until the driver next collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(rows: DataFrame) -> DataFrame:
    """rows written once and read back, so that what is used in several places is made once and only the rows stay on disk, not what was shuffled for them."""
    spark, path = rows.sparkSession, work_dir(rows.sparkSession)
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(rows.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file per partition with a header; quotes are doubled, so commas, quotes and line ends in values survive."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)


def nested(records: DataFrame, evidence: DataFrame, history: DataFrame) -> DataFrame:
    """records (id, ...) with evidence as a map from field to (value, quote, source_url, grounded) and change_history as an ordered array."""
    told = evidence.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "quote", "source_url", "grounded"))))).alias("evidence"))
    past = history.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("change_id", "field", "old_value", "new_value", "note"))).alias("change_history"))
    return records.join(told, "id", "left").join(past, "id", "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)
