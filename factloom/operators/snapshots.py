"""A store of page texts by content, appended run by run, and counters gathered while a run writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files


class SnapshotStore:
    """Two append-only tables in a shared folder: snapshots (run, a row for each page) and texts (a row for each content).

    A run's folders are written whole or anew, so a run that failed halfway can be repeated.  A text is kept once, by its hash, in the
    run that brought it first; pages without text have no hash and an empty text.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str]) -> None:
        self.spark, self.root, self.key = spark, root, key
        self.runs: list[int] = []

    def _read(self, name: str, runs: list[int]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/{name}/{r}").withColumn("run", F.lit(r)) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def append(self, run: int, pages: DataFrame) -> None:
        """Add pages (key, text) of a run, later than all before it; of repeated keys one row stays, that of the largest text."""
        before = [r for r in self.runs if r < run]
        told = pages.groupBy(*self.key).agg(F.max("text").alias("text")).withColumn("hash", F.sha2("text", 256))
        told.select(*self.key, "hash").write.mode("overwrite").parquet(f"{self.root}/snapshots/{run}")
        new = told.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("text").alias("text"))
        if before:
            new = new.join(self._read("texts", before).select("hash"), "hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{self.root}/texts/{run}")
        self.runs = [*before, run]

    def texts(self) -> DataFrame:
        """hash, text, run (the first that had it)."""
        return self._read("texts", self.runs)

    def history(self) -> DataFrame:
        """key, run, hash, changed against the run before, text of every snapshot."""
        order = Window.partitionBy(*self.key).orderBy("run")
        first = F.row_number().over(order) == 1
        rows = self._read("snapshots", self.runs).withColumn("changed", first | ~F.col("hash").eqNullSafe(F.lag("hash").over(order)))
        return rows.join(self.texts().select("hash", "text"), "hash", "left").withColumn("text", F.coalesce("text", F.lit("")))


def observed_write(rows: DataFrame, path: str, counters: dict[str, Column]) -> dict:
    """Write rows and return the counters, which were gathered in passing and not by another reading."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.parquet(path)
    return dict(seen.get)


def _store(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """Two runs over the pages of conversations: in the second each page shows the next turn's text, and the last one none."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    store = SnapshotStore(spark, files.work_dir(spark), ["conv_id", "turn"])
    store.append(1, turns)
    store.append(2, turns.withColumn("text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))))
    return store


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).history().select("conv_id", "turn", "run", "hash", "changed", F.length("text").cast("long").alias("n_chars"))


def snapshot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).texts().select("hash", "run", F.length("text").cast("long").alias("n_chars"))


def run_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run that writes the orders out, appended as one row of the table of runs."""
    root = files.work_dir(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.col("o_orderstatus")
    told = observed_write(orders, f"{root}/orders", {"seen": F.count(F.lit(1)), "finished": F.count_if(status == "F"), "open": F.count_if(status == "O"), "last_order": F.max("o_orderkey")})
    spark.createDataFrame([(1, *[told[c] for c in ("seen", "finished", "open", "last_order")])], "run int, seen long, finished long, open long, last_order long").write.mode("append").parquet(f"{root}/runs")
    return spark.read.parquet(f"{root}/runs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"snapshot_history": snapshot_history, "snapshot_texts": snapshot_texts, "run_accumulators": run_accumulators}


_RUNS = """WITH t AS (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY conv_id, turn),
  n AS (SELECT conv_id, turn, max(text) AS text FROM (SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text FROM conversations) m GROUP BY conv_id, turn),
  r AS (SELECT *, 1 AS run FROM t UNION ALL SELECT *, 2 FROM n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "snapshot_history": f"{_RUNS} SELECT conv_id, turn, run, sha256(text) AS hash, run = 1 OR text IS DISTINCT FROM lag(text) OVER (PARTITION BY conv_id, turn ORDER BY run) AS changed, length(coalesce(text, '')) AS n_chars FROM r",
        "snapshot_texts": f"{_RUNS} SELECT sha256(text) AS hash, min(run) AS run, length(text) AS n_chars FROM r WHERE text IS NOT NULL GROUP BY text",
        "run_accumulators": "SELECT 1 AS run, count(*) AS seen, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, max(o_orderkey) AS last_order FROM orders",
    }
