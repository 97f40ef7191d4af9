"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, running_totals, small, text_or_empty

#: Rows that a broadcast join may hold.
SMALL = 500_000


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """Deal all documents into n_shards contiguous shards whose byte sizes are near equal (law ``bytes``).

    A document weighs its UTF-8 bytes (null text: none) plus overhead.  Rows are in the order of a digest of the text, so equal texts
    are neighbours, and then of doc_id.  A group of equal texts moves as one unit unless it is larger than a whole shard: sizes could not
    be near equal then, so its rows are units.  A unit goes to the shard in which the middle of its stretch of the global prefix
    sum of bytes lies, where shards are equal parts of the whole.  So shards are contiguous cuts of one order, and each cut is
    off its target by half of the unit across it at most.

    Adds size, text_crc32, law, shard, slot (gapless from 0 in the order of a shard) and grown_shard (null).
    Null or repeated doc_ids are ordinary rows; an empty table gives an empty result; other columns but text are kept
    except those that have one of the added names.
    """
    text = text_or_empty()
    extra = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "doc_id")]
    rows = numbered(docs.select("doc_id", *extra, "text"), "__rid")
    # Texts are equal iff they have the same digest of 256 bits.
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    rows = cut(rows.select("__rid", "doc_id", *extra, (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), digest.alias("__text")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    several = cut(rows.groupBy("__text").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").select("__text", "__bytes"))
    rows = rows.join(small(several, SMALL), "__text", "left").withColumn("__whole", F.coalesce(F.col("__bytes") * n_shards <= total, F.lit(False)))
    groups = several.filter(F.col("__bytes") * n_shards <= total)
    # Rows that are units, and one row for each group that is one.
    single = rows.filter("not __whole").withColumn("__bytes", F.col("size")).drop("__whole")
    units = cut(running_totals(single.unionByName(groups, allowMissingColumns=True), ["__text", "doc_id", "__rid"], {"__before": "__bytes"}))
    # The shard is floor(n_shards * middle / total), in whole numbers.
    shard = F.expr(f"cast(least({n_shards} - 1, cast(__before * 2 + __bytes as decimal(38, 0)) * {n_shards} div {max(1, 2 * total)}) as int)")
    units = units.withColumn("shard", shard).drop("__bytes", "__before")
    copies = rows.filter("__whole").drop("__whole", "__bytes").join(small(units.filter("__rid is null").select("__text", "shard"), SMALL), "__text")
    dealt = units.filter("__rid is not null").unionByName(copies)
    out = running_totals(dealt, ["__text", "doc_id", "__rid"], {}, group=["shard"], index="slot")
    return out.select("doc_id", *extra, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
