"""Similarity joins of short keys by an index of their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy


def _segment(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """(start, length) of segment i of a key of n characters in parts segments, whose lengths differ by one at most."""
    base, short = F.floor(n / parts), parts - n % parts
    return (i * base + F.greatest(F.lit(0), i - short)).cast("int"), (base + (i >= short).cast("int")).cast("int")


def _letters(key: Column) -> Column:
    """Bits for the first and second letters of 32 kinds: a letter more or less in a key changes one bit at most."""

    def seen(bits: Column, ch: Column) -> Column:
        kind = F.ascii(ch) % 32
        one = F.call_function("shiftleft", F.lit(1).cast("long"), kind)
        return bits.bitwiseOR(F.when(bits.bitwiseAND(one) == 0, one).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), kind + 32)))

    return F.aggregate(F.split(key, ""), F.lit(0).cast("long"), seen)


def similar_keys(keys: DataFrame, floor: float = 90.0) -> DataFrame:
    """Pairs (a, b, score), a < b, of distinct non-empty keys (key) whose ratio 200 * LCS / (both lengths) reaches floor (75 to 100).

    Keys of lengths m <= n that reach floor differ by D = (1 - floor / 100) (m + n) characters at most that only one of them has.  The shorter one
    is cut into more segments than that for any partner, so one segment at least stands whole in the longer key, and at a place that
    the characters before and behind it allow.  Keys meet only by an equal segment of that number, length of key and place; a pair
    that meets is aligned if its letters, whatever their order, do not differ by more.  No list holds all keys of a length: a segment is a sixth or so of its key.
    """
    if not 75 <= floor <= 100:
        raise ValueError("a floor from 75 to 100")
    part = 1 - floor / 100
    spark = keys.sparkSession
    # few keys give many candidates, so the small table of keys is spread over all cores
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = keys.filter("key IS NOT NULL AND key <> ''").select("key").distinct().repartition(tasks).withColumns({"n": F.char_length("key"), "letters": _letters(F.col("key"))})
    m, n, i = F.col("m"), F.col("n"), F.col("i")

    def characters(of: Column) -> Column:
        return F.floor(F.lit(part) * of + 1e-9).cast("int")

    parts = characters(m + F.floor(m * ((1 + part) / (1 - part)) + 1e-9)) + 1
    start, length = _segment(m, parts, i)
    held = distinct.select(F.col("key").alias("a"), n.alias("m"), F.col("letters").alias("has")).withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
    held = held.select("a", "m", "has", "i", F.expr("a").substr(start + 1, length).alias("segment"))
    lengths = F.sequence(F.ceil(n * ((1 - part) / (1 + part)) - 1e-9).cast("int"), n)
    asked = distinct.select(F.col("key").alias("b"), "n", "letters").withColumn("m", F.explode(lengths)).withColumn("d", characters(m + n)).filter(n - m <= F.col("d"))
    asked = asked.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
    more = n - m
    few = F.floor((F.col("d") - more) / 2).cast("int")  # characters of the shorter key alone; the longer one has as many and the difference
    low = F.greatest(-few, -i, more - (F.col("parts") - 1 - i), -start)
    high = F.least(few + more, i, more + (F.col("parts") - 1 - i), n - length - start)
    asked = asked.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("s", F.explode(F.sequence(F.col("low"), F.col("high"))))
    asked = asked.select("b", "n", "letters", "m", "d", "i", F.expr("b").substr(start + F.col("s") + 1, length).alias("segment"))
    met = held.join(asked, ["m", "i", "segment"]).filter((F.col("m") < F.col("n")) | (F.col("a") < F.col("b")))
    met = met.filter(F.bit_count(F.col("has").bitwiseXOR(F.col("letters"))) <= F.col("d")).select("a", "b").distinct()
    # a deterministic ratio would be moved below distinct and be reckoned for every equal segment
    aligned = met.withColumn("score", fuzzy.plain_once(F.col("a"), F.col("b"))).filter(F.col("score") >= floor)
    return aligned.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
