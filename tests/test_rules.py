"""Fuzzy ratios against plain dynamic programming, and rules on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy
from factloom.functions import rules as R
from factloom.operators import records


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b))


def test_ratios_against_plain_programming():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(2))
        assert fuzzy.ratio(a, b) == pytest.approx(plain(a, b))
        best = 0
        for short, long in [(a, b)] * (len(a) <= len(b)) + [(b, a)] * (len(b) <= len(a)):
            for end in range(1, len(long) + len(short)):
                best = max(best, plain(short, long[max(0, end - len(short)) : end]))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(best)


def test_token_set():
    assert fuzzy.token_set_ratio("a b c", "c b") == 100
    assert fuzzy.token_set_ratio("", "c b") == 0
    assert fuzzy.ratio("", "") == 100


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rules(spark):
    assert one(spark, R.names_in(F.lit("see Ada Young Fellowship Scheme, Is The Best Scholarship?"))) == ["Ada Young Fellowship Scheme"]
    assert one(spark, R.distinctive_tokens(F.lit("Pragati Scholarship Scheme (ADF) pdf"))) == ["adf", "pragati"]
    assert one(spark, R.provider_type(F.lit("Ministry of Ports"))) == "government"
    assert one(spark, R.provider_type(F.lit(None).cast("string"))) is None
    assert one(spark, R.quote_in_page(F.lit("abc"), F.lit("abc"))) == 0
    assert one(spark, R.quote_in_page(F.lit("the   Dean's list"), F.lit("x THE DEAN’S LIST y"))) == 100
    assert one(spark, R.url_on_page(F.lit("https://www.a.org/x/"), F.lit("go to a.org/x now"), F.array(F.lit("b")))) is True


def test_ground(spark):
    said = F.array(F.lit("income below 2.5 lakh"))
    got = one(spark, R.ground(F.lit("income below 250000"), said, F.lit("Family income below 2.5 lakh only")))
    assert got.grounded and got.value == "income below 250000" and got.score == 100
    assert not one(spark, R.ground(F.lit("income below 300000"), said, F.lit("Family income below 2.5 lakh only"))).grounded
    assert not one(spark, R.ground(F.lit("n/a"), said, F.lit(""))).grounded
    assert not one(spark, R.ground(F.lit("x"), F.array().cast("array<string>"), F.lit(""))).grounded


def test_links(spark):
    html = '<a href="/p#q">One  <b>x</b></a><a href="mailto:a@b">m</a><a class="c" href="https://z.org/k/">z</a>'
    got = one(spark, R.link_parts(F.lit(html), F.lit("http://h.org/d/e?f")))
    assert [tuple(r) for r in got] == [(1, "http://h.org/p", "One x"), (2, "https://z.org/k", "z")]


def plain_partial(a, b):
    """Best ratio of the shorter text with every stretch of the longer one."""
    best = 0
    for short, long in [(a, b)] * (len(a) <= len(b)) + [(b, a)] * (len(b) <= len(a)):
        for end in range(1, len(long) + len(short)):
            best = max(best, plain(short, long[max(0, end - len(short)) : end]))
    return best


def reworded(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(["", "x", out[at] + "y"])
    return "".join(out)


def test_quotes_against_plain_programming(spark):
    """Altered quotes in whole texts: the same pairs and scores as plain programming over all stretches."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(4)) for _ in range(6)] + [None, "", "abcd"]
    quotes = ["abc", "abxd", ""]
    for edits in range(0, 9):
        t = rng.choice(texts[:6])
        at = rng.choice([0, len(t) - 40, rng.randrange(len(t) - 40)])
        quotes.append(reworded(rng, t[at : at + 40], edits))
    low = lambda x: " ".join((x or "").split())
    want = {}
    for i, q in enumerate(map(low, quotes)):
        for j, t in enumerate(map(low, texts)):
            score = (100 if q in t else plain_partial(q, t)) if len(q) >= 4 and t else 0
            if score >= 90:
                want[i, j] = pytest.approx(score)
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.item_id, r.doc_id): r.score for r in records.quotes_in_texts(asked, docs).collect()}
    assert got == want and sum(v != 100 for v in got.values()) > 2


def test_registered_quotes_reach_the_fuzzy_ratio(spark):
    sf = "/root/testdata/sf0.001"
    got = records.quote_fuzzy(spark, sf).collect()
    assert got and all(90 <= r.score for r in got) and any(r.score < 100 for r in got)
    assert {"item_id", "doc_id", "score"} == set(got[0].asDict())
    there = [r.present for r in records.quote_still_present(spark, sf).collect()]
    assert len(there) == 200 and True in there and False in there
