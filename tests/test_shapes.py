"""Answers of every shape against json.loads, acceptance of schemes, and addresses against urljoin."""

from __future__ import annotations

import json
from urllib.parse import urljoin

from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.operators import shapes as S
from factloom.operators import verification as V

ANSWERS = [
    '{"s": [{"name": {"value": "A Grant", "evidence": ["a grant", "", 4, null]}, "amount": "Rs. 5"}, 7, null, [1], "x", {"name": {"value": 12, "evidence": "twelve"}, "amount": {"evidence": {"q": 1}}}]}',
    '{"s": [{"name": null, "amount": 0}, {"name": false, "amount": []}, {"name": {}, "amount": {"value": ["a", {"b": 1}], "evidence": []}}, {}]}',
    '{"s": {"name": {"value": "A"}}}', '{"s": null}', '{"t": []}', "[1, 2]", '"s"', "", "{broken", None, '{"s": []}', '{"s": [{"name": true, "amount": 5.5, "other": 1}]}',
    json.dumps({"s": [{"name": {"value": "long " * 50_000, "evidence": ["é" * 100_000]}}]}),
]


def brute(answer):
    """(pos, field, value, quotes) by json.loads."""
    try:
        data = json.loads(answer or "")
    except ValueError:
        return []
    listed = data.get("s") if isinstance(data, dict) else None
    out = []
    for i, raw in enumerate(listed if isinstance(listed, list) else [], 1):
        if not isinstance(raw, dict):
            continue
        for f in ("name", "amount"):
            item = raw.get(f) or {}
            whole = isinstance(item, dict)
            value, said = (item.get("value"), item.get("evidence")) if whole else (item, None)
            quotes = [q for q in ([said] if isinstance(said, str) else said) if isinstance(q, str) and q] if isinstance(said, (str, list)) else None
            text = value if isinstance(value, str) else json.dumps(value, separators=(",", ":")) if value else None
            out.append((i, f, text or None, quotes))
    return out


def test_stated(spark):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS + ANSWERS[:1])], "id int, answer string")
    got = S.stated(rows, "answer", "s", ["name", "amount"]).collect()
    for i, a in enumerate(ANSWERS + ANSWERS[:1]):
        assert sorted(((r["pos"], r["field"], r["value"], r["quotes"]) for r in got if r["id"] == i), key=repr) == sorted(brute(a), key=repr), a and a[:80]
    shapes = {(r["id"], r["pos"], r["field"]): r["shape"] for r in got}
    assert shapes[0, 1, "name"] == "object" and shapes[0, 1, "amount"] == "scalar" and shapes[1, 1, "name"] == "null" and shapes[1, 2, "amount"] == "array" and shapes[1, 4, "name"] == "absent"
    assert S.stated(rows.limit(0), "answer", "s", ["name"]).count() == 0


def test_accepted(spark):
    page = "Blue Hills Scholarship\nThe Blue Hills Scholarship pays Rs. 5,000. The Red Scheme is open."
    answer = {"s": [
        {"name": {"value": "Blue Hills Scholarship", "evidence": ["Blue Hills Scholarship"]}, "amount": {"value": "Rs. 5,000", "evidence": ["pays Rs. 5,000"]}},
        {"name": {"value": "Red Scheme", "evidence": ["The Red Scheme is open"]}},
        {"name": "Blue Hills Scholarship"},
        {"name": {"value": "Green Grant", "evidence": ["the Green Grant is here for all"]}},
        "Blue Hills Scholarship",
    ]}
    rows = spark.createDataFrame([(1, json.dumps(answer), page)], "id int, answer string, page string").withColumn("links", F.array().cast("array<string>"))
    got = S.accepted(S.stated(rows, "answer", "s", ["name", "amount"]), ["id", "pos"]).collect()
    assert [(r["pos"], r["name"], r["fields"]) for r in got] == [(1, "Blue Hills Scholarship", {"name": "Blue Hills Scholarship", "amount": "Rs. 5,000"})]


def test_addresses(spark):
    bases = ["http://h.org/d/e/f?q=1#z", "https://h.org/d/", "https://h.org/a/b/c/d.html"]
    hrefs = ["../x", "./x?y=..", "..", "../..", "../../../../x", "/a/./b/../c", "?page=2", "//cdn.org/../k", "k.html", "https://o.org/a/../b", "x..y/z", "a/b/../../c/."]
    pairs = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(pairs, "url string, href string").select("url", "href", R.resolve(F.col("href"), F.col("url")).alias("r")).collect()
    assert {(r["url"], r["href"]): r["r"] for r in got} == {(b, h): urljoin(b, h) for b, h in pairs}


def test_quotes_of_attributes(spark):
    html = """<a data-href="no" href='../up'>1</a><a class=x href=/bare>2</a><A HREF = " /s?a=1&amp;b=2 ">3</A><a data-href="/no">4</a><a href=''>5</a><abbr href="/no">6</abbr>"""
    got = spark.range(1).select(R.link_parts(F.lit(html), F.lit("http://h.org/d/e/f")).alias("r")).first()["r"]
    assert [tuple(r) for r in got] == [(1, "http://h.org/d/up", "1"), (2, "http://h.org/bare", "2"), (3, "http://h.org/s?a=1&b=2", "3")]


def test_quotes_keep_their_ends(spark):
    page = F.lit("the first 10. It pays Rs. 5,000 each. Round 11 and 2022 then")
    claim = lambda value, *quotes: spark.range(1).select(V.ground_field(F.lit("documents"), F.lit(value), F.array(*[F.lit(q) for q in quotes]), page, F.array().cast("array<string>")).alias("g")).first()["g"]
    got = claim("Rs. 5,000", "  It pays Rs. 5,000 ")
    assert got["grounded"] and got["quote"] == "It pays Rs. 5,000"
    assert claim("11 and 2022", "the first 10", "Round 11", "and 2022")["quote"] == R.QUOTE_JOIN.join(["the first 10", "Round 11", "and 2022"])
