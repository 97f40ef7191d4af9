"""Exact duplicates by deterministic block naming (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, small, text_or_empty

#: Characters in a block.
BLOCK = 4096
#: Rows that a broadcast join may hold.
SMALL = 500_000


def name_texts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Give each row of rows (__rid, text) a collision-free identity: (__level, __name), equal iff the texts are equal.

    A text is cut into blocks of a fixed number of characters.  Distinct blocks are sorted and numbered;
    then adjacent pairs of names are sorted and numbered in turn, until one name is left for each text.
    The sort key of a block is its 64-bit hash and, only where two different blocks share a hash, the
    block itself: texts are compared where hashes agree, and only those texts move.
    A text of k blocks ends at level ceil(log2 k); all names of a level come from one numbering.
    """
    n_blocks = F.greatest(F.lit(1), F.ceil(F.char_length("text") / F.lit(block))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    blocks = rows.select("__rid", F.posexplode(pieces).alias("__i", "__block")).withColumn("__h", F.xxhash64("__block"))
    plain = cut(blocks.select("__rid", F.col("__i").cast("int").alias("__i"), "__h"))
    shared = cut(plain.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__h"))
    texts = blocks.select("__h", "__block").join(small(shared, 1_000_000), "__h", "left_semi").distinct()
    clash = cut(texts.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__h"))).filter("__n > 1").select("__h", "__block"))
    tie = F.lit(None).cast("string")
    if clash.isEmpty():
        keyed = plain.withColumn("__tie", tie)
    else:
        clashing = blocks.join(clash.select("__h").distinct(), "__h", "left_semi").select("__rid", F.col("__i").cast("int").alias("__i"), "__h", F.col("__block").alias("__tie"))
        keyed = plain.join(clash.select("__h").distinct(), "__h", "left_anti").withColumn("__tie", tie).unionByName(clashing)
    now = _named(keyed, ["__h", "__tie"])
    done, level = None, 0
    while True:
        counted = now.groupBy("__rid").agg(F.count(F.lit(1)).alias("__k"))
        ended = counted.filter("__k = 1").join(now, "__rid").select("__rid", F.lit(level).alias("__level"), "__name")
        done = ended if done is None else done.unionByName(ended)
        more = counted.filter("__k > 1").select("__rid")
        left = now.join(more, "__rid")
        pairs = left.groupBy("__rid", F.floor(F.col("__i") / 2).cast("int").alias("__i")).agg(
            F.max(F.when(F.col("__i") % 2 == 0, F.col("__name"))).alias("__a"), F.max(F.when(F.col("__i") % 2 == 1, F.col("__name"))).alias("__b")
        )
        pairs = cut(pairs)
        if pairs.isEmpty():
            return done
        now, level = _named(pairs, ["__a", "__b"]), level + 1


def _named(df: DataFrame, key: list[str]) -> DataFrame:
    """(__rid, __i, __name): __name numbers the distinct keys in their sorted order."""
    order = [F.col(c).asc_nulls_first() for c in key]
    names = cut(df.select(*key).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__name", F.monotonically_increasing_id()))
    left, right = df.alias("l"), names.alias("r")
    same = F.col(f"l.{key[0]}") == F.col(f"r.{key[0]}")
    same = same & F.col(f"l.{key[1]}").eqNullSafe(F.col(f"r.{key[1]}"))
    return cut(left.join(right, same).select("l.__rid", "l.__i", "r.__name"))


def exact_duplicates(docs: DataFrame, block: int = BLOCK, keep_text: bool = True) -> DataFrame:
    """All columns of docs plus keep_id, group_size, kept and text_sha256; one row per row of docs.

    Null texts count as empty.  Texts are equal when identical.  Of equal texts the row with the largest doc_id
    stays (null doc_ids are smallest; among rows with the same doc_id the one with the largest row number, so exactly one
    row of each group has kept = true).  Without keep_text the text goes before anything is joined.  An empty table gives an empty result; columns of docs with the names of added columns give way.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    text = text_or_empty()
    base = docs.select(*[c for c in docs.columns if c not in added])
    if keep_text:
        base = numbered(base, "__rid")
        digest = base.select("__rid", "doc_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))
    else:
        base = numbered(base.withColumn("text_sha256", F.sha2(F.encode(text, "UTF-8"), 256)), "__rid")
        digest = base.select("__rid", "doc_id")
    ids = name_texts(base.select("__rid", text.alias("text")), block)
    rows = cut(digest.join(ids, "__rid"))
    # Copies are counted for each part of the rows first, so a group of any size is spread over tasks.
    named = rows.select("__rid", "__level", "__name", F.struct("doc_id", "__rid").alias("__last"))
    groups = cut(named.groupBy("__level", "__name").agg(F.count(F.lit(1)).alias("group_size"), F.max("__last").alias("__keep")))
    several = small(groups.filter("group_size > 1"), SMALL)
    alone = F.col("group_size").isNull()
    verdict = rows.join(several, ["__level", "__name"], "left").select(
        "__rid", *["text_sha256"] * keep_text, F.when(alone, F.col("doc_id")).otherwise(F.col("__keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("__keep.__rid") == F.col("__rid"))).alias("kept")
    )
    out = (base if keep_text else base.drop("text")).join(verdict, "__rid")
    return out.select(*[c for c in docs.columns if c not in added and (keep_text or c != "text")], *added)
