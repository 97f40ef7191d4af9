"""Mixing of sources to target weights under a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, running_totals, small

#: A document's size: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources that a broadcast join may hold.
SMALL = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source of rows (__source, size): source_size, weight and target.

    Sources in code-point order (null last) weigh weights[0], weights[1], ..., repeating, and share the sum of
    all sizes.  A target stops at cap times its source's size and the excess is shared again by weight: the
    targets are min(cap * size, level * weight) for the one level at which they add up to the whole.
    """
    sizes = cut(rows.groupBy("__null", "__source").agg(F.sum("size").alias("source_size")))
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    ranked = cut(running_totals(sizes, ["__null", "__source"], {}, index="__at").withColumn("weight", turn).withColumn("__cap", F.col("source_size") * cap).withColumn("__fill", F.col("__cap") / F.col("weight")))
    # With the sources sorted by the level at which each is full, a level is right where it lies between its neighbours' fills.
    steps = running_totals(ranked, ["__fill", "__null", "__source"], {"__capped": "__cap", "__lighter": "weight"})
    total, heavy = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, heavy = total or 0, heavy or 1
    level = (F.lit(total) - F.col("__capped")) / (F.lit(heavy) - F.col("__lighter"))
    found = steps.withColumn("v", level).filter("v <= __fill").agg(F.min_by("v", F.struct("__fill", "__null", "__source"))).first()[0]
    target = F.least(F.col("__cap").cast("double"), F.lit(float(found or 0.0)) * F.col("weight"))
    return cut(ranked.select("__null", "__source", "source_size", "weight", target.alias("target"), "__at"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, tilt: float = 0.5) -> DataFrame:
    """Plan a training mix of docs: one row per row of docs, with its size, source_size, target, copies, taken and positions.

    A source's tokens are its documents in the order of a hash of doc_id and text, over and over.  Its weight
    at training time t in [0, 1] is weight * (1 + slope * (2 t - 1)), where slope runs over -tilt, 0, tilt by source;
    the integral gives its cumulative demand target * ((1 - slope) t + slope t^2), and inverting that at
    the number of tokens before an occurrence gives the occurrence's training position.  Occurrences
    that end within the target are taken; what is then open goes, in the same order, to documents that fit in it, so
    a source misses its target by less than half a document, and no document is taken more than cap times.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own, the last one.  Repeated rows
    are separate documents.  An empty table gives an empty result; columns of docs with names of added columns give way.
    """
    added = ("size", "source_size", "target", "taken", "copies", "positions")
    rows = numbered(docs.select(*[c for c in docs.columns if c not in added]), "__rid")
    key = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))), "UTF-8"))
    lean = cut(rows.select("__rid", n_words(F.col("text")).alias("size"), F.col("source").isNull().cast("int").alias("__null"), F.coalesce("source", F.lit("")).alias("__source"), key.alias("__key")))
    targets = source_targets(lean, weights, cap)
    group = ["__null", "__source"]
    placed = running_totals(lean, ["__key", "__rid"], {"__before": "size"}, group=group).join(small(targets, SMALL), group)
    # Occurrence number e starts at e * source_size + before; it is in if it ends within the target.
    all_starts = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda e: e * F.col("source_size") + F.col("__before"))
    placed = cut(placed.withColumn("__starts", F.filter(all_starts, lambda c: (F.col("size") > 0) & (c + F.col("size") <= F.col("target")))))
    # What the first document too many leaves open goes to documents that fit in it.
    lacking = cut(placed.groupBy(*group).agg((F.first("target") - F.sum(F.size("__starts") * F.col("size"))).alias("__open")))
    more = placed.join(small(lacking, SMALL), group).filter((F.col("size") > 0) & (F.size("__starts") < cap) & (F.col("size") <= F.col("__open"))).select("__rid", *group, "size", "__key", "__open", "target")
    more = running_totals(more, ["__key", "__rid"], {"__later": "size"}, group=group).filter(F.col("__later") * 2 + F.col("size") <= F.col("__open") * 2)
    more = more.select("__rid", (F.col("target") - F.col("__open") + F.col("__later")).alias("__extra"))
    placed = placed.join(more, "__rid", "left").withColumn("__starts", F.array_compact(F.array_append(F.col("__starts").cast("array<double>"), F.col("__extra"))))
    slope = (F.col("__at") % 3 - 1) * F.lit(float(tilt))

    def position(c: Column) -> Column:
        share = F.least(F.lit(1.0), c / F.col("target"))
        back = F.lit(1.0) - slope
        return F.when(slope == 0, share).otherwise((F.sqrt(back * back + slope * share * 4) - back) / (slope * 2))

    plan = cut(
        placed.select("__rid", "size", "source_size", "target", F.size("__starts").cast("int").alias("copies"), F.transform("__starts", position).alias("positions"))
    )
    return rows.join(plan, "__rid").withColumn("taken", F.col("copies") * F.col("size")).drop("__rid")


def training_order(mixed: DataFrame) -> DataFrame:
    """The occurrences of a mix in training order: a row for each position, range-sorted by it."""
    rows = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
