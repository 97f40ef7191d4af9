"""Twins: whole results against pairs of single records."""

import random

from pyspark.sql import functions as F

from factloom.functions import fuzzy
from factloom.operators import verification as V
from factloom.operators.similarity import similar_keys


def _known(spark):
    rows = []
    for i in range(1, 61):
        g = {f: v for f, v in (("close_date", [None, "2026-11-10", "2026-11-11"][i % 3]), ("amount", [None, "Rs. 1,000", "Rs. 2,000 or 1,000", "no number"][i % 4]), ("income_limit", [None, "2.5 lakh", "3.5 lakh"][i // 3 % 3])) if v}
        rows.append((i, f"kind {i % 4}", ["Blue Ring Award 1", "Blue Ring Award 2", "Ring Award 1, Blue", "other scheme of kites", ""][i % 5], g, (i % 3 > 0,)))
    return spark.createDataFrame(rows, "id long, topic string, name string, g map<string,string>, own struct<owns: boolean>")


def _plain(known):
    return [(r.id, r.topic, r.g, r.own.owns) for r in known.collect()]


def test_agreement_by_is_the_agreement_of_all_pairs_and_moves_no_pairs(spark):
    known = _known(spark)
    pairs = known.select("id", "topic").join(known.select(F.col("id").alias("other"), "topic"), "topic").filter("id <> other").select("id", "other")
    told = V.agreement_by(known, "topic")
    row = lambda r: (r.id, r.other, r.agrees, tuple(r.clash), r.owns_other, r.conflict)
    got = sorted(map(row, told.collect()))
    assert got == sorted(map(row, V.twin_agreement(known, pairs).collect())) and len(got) == 60 * 14
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1

    def clash(a, b):
        out = ["close_date"] if {"close_date"} <= a.keys() & b.keys() and a["close_date"] != b["close_date"] else []
        numbers = {None: set(), "no number": set(), "Rs. 1,000": {1000}, "Rs. 2,000 or 1,000": {1000, 2000}, "2.5 lakh": {2.5, 250000}, "3.5 lakh": {3.5, 350000}}
        return tuple(out + [f for f in ("amount", "income_limit") if numbers[a.get(f)] and numbers[b.get(f)] and not numbers[a.get(f)] & numbers[b.get(f)]])

    plain = _plain(known)
    assert {(r[0], r[1]): r[3] for r in got} == {(i, j): clash(a, b) for i, s, a, _ in plain for j, t, b, _ in plain if i != j and s == t}


def test_twin_summary_lists_and_counts_are_those_of_pairs(spark):
    """Names alike over two keys: counts, lists and the providers' own twin, as pairs of single records give them."""
    known = _known(spark)
    pairs = {(r.id, r.other): r for r in V.twin_agreement(known, V.same_key_pairs(known)).collect()}
    got = {r.id: r for r in V.twin_summary(known).collect()}
    assert set(got) == {i for i, _ in pairs} and any(r.conflicts for r in got.values())
    for i, r in got.items():
        mine = [p for (a, _), p in pairs.items() if a == i]
        assert (r.n_agree, r.n_conflict) == (sum(p.agrees for p in mine), sum(p.conflict for p in mine))
        assert r.official_twin == min((p.other for p in mine if p.owns_other), default=None)
        named, apart = {(c.other, tuple(c.clash)) for c in r.conflicts}, {(p.other, tuple(p.clash)) for p in mine if p.conflict}
        assert named <= apart and len(named) == len(r.conflicts) and bool(named) == bool(apart) and {c for _, c in named} == {c for _, c in apart}
        alike = {p.other for p in mine if p.agrees}
        assert set(r.agree) <= alike and len(set(r.agree)) == len(r.agree) and bool(r.agree) == bool(alike) and min(alike, default=None) == min(r.agree, default=None)


def test_ratios_of_many_pairs_are_those_of_single_ones_and_stand_above_distinct(spark):
    rng = random.Random(5)
    a, b = (["".join(rng.choices("ab cé😀", k=rng.randint(0, 64))) for _ in range(500)] for _ in "ab")
    assert list(fuzzy.ratios(a, b)) == [fuzzy.ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert list(fuzzy.ratios(["x" * 65, "", ""], ["x" * 64, "", "y"])) == [fuzzy.ratio("x" * 65, "x" * 64), 100.0, 0.0]
    plan = similar_keys(spark.createDataFrame([("blue ring award",), ("blue ring awards",)], "key string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_plain(") == 1 and plan.index("_plain(") < plan.index("Aggregate [a")
