"""Rules over records on literal cases, and connectors with a transport made up here."""

import json

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import discovery as D
from factloom.operators import records as O
from factloom.operators import verification as V
from factloom.sources import web

PROFILE = V.Profile(third_party=("list.example.com",), government=(".gov.in", ".nic.in", ".gov"), university=(".ac.in", ".edu"), known={"bank.example.com": "corporate_csr"}, portals=("portal.gov.in",))


def test_score_of_a_whole_record(spark):
    """A record with everything earns all points but the penalties; one on a list page earns none for its source."""
    fields = {"name": "National aid 2026-27", "provider": "Ministry of Aid", "application_url": "https://aid.gov.in/apply", "amount": "Rs. 5,000", "close_date": "2026-11-01", "income_limit": "2.5 lakh", "category": "SC", "gender": "Female"}
    records = spark.createDataFrame([(1, fields["name"], "https://aid.gov.in/s"), (2, "Some aid 2019", "https://list.example.com/s")], "id long, name string, official_url string")
    rows = [(1, f, v, f"it says {v}", "u", True, v) for f, v in fields.items()] + [(2, "amount", None, None, "u", False, "Rs. 1")]
    evidence = spark.createDataFrame(rows, "id long, field string, value string, quote string, source_url string, grounded boolean, raw_value string")
    sources = spark.createDataFrame([("https://aid.gov.in/s", "government", 200, 0), ("https://list.example.com/s", "aggregator", 200, 1)], "url string, source_type string, http_status int, fail_count int")
    texts = spark.createDataFrame([("https://aid.gov.in/s", "", 2)], "url string, text string, runs int")
    got = {r.id: r for r in V.score(records, evidence, sources, texts, PROFILE, F.lit("2026-10-02").cast("date")).collect()}
    assert got[1].confidence == 100.0 and got[1].verification_status == "VERIFIED" and got[1].owns_source and len(got[1].checks) == 9
    assert got[2].confidence == 0.0 and [c.check for c in got[2].checks if c.points < 0] == ["aggregator_only"]
    reasons = {c.check: c.reason for c in got[2].checks}
    assert reasons["present_on_official_page"] == "source page failed to load in the latest crawl" and reasons["field_traceability"] == "0/1 extracted values traced to quotes" and "2019" in reasons["freshness"]


def test_twins_by_name(spark):
    records = spark.createDataFrame([(1, "Aid for weavers 2025-26"), (2, "Weavers, aid for (2026)"), (3, "Aid for weaver"), (4, "Something else")], "id long, name string")
    assert sorted(tuple(r) for r in V.same_key_pairs(records).collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_candidate_links(spark):
    records = spark.createDataFrame([(1, "Pragati aid", "https://www.weave.gov.in/s", "Weave", True, "portal.weave.gov.in/x")], "id long, name string, official_url string, provider string, single boolean, app_url string")
    hrefs = ["https://www.weave.gov.in/s/", "https://weave.gov.in/pragati", "https://weave.gov.in/pragati-guideline", "https://weave.gov.in/faq", "https://weave.gov.in/pragati-result", "https://weave.gov.in/pragati-2019", "https://other.example.com/pragati", "https://weaveindia.org/pragati"]
    links = spark.createDataFrame([("https://www.weave.gov.in/s", i, h, "more") for i, h in enumerate(hrefs)], "url string, pos long, href string, anchor string")
    got = [(r.place, r.href) for r in D.candidate_links(records, links, PROFILE).orderBy("place").collect()]
    assert got == [(1, "https://portal.weave.gov.in/x"), (2, "https://weave.gov.in/pragati-guideline"), (3, "https://weave.gov.in/pragati")]


def test_quotes_verbatim(spark):
    """Quotes of many, few and no words, repeated and null ones, in null, empty, long and repeated texts, against a search letter by letter."""
    long = " ".join(f"w{i % 97}" for i in range(4000))
    quotes = [(1, "b c d e f"), (2, "ne two three four fi"), (3, "c d"), (4, "e"), (5, ""), (6, None), (7, "b c d e f"), (8, "w95 w96 w0 w1 w2 w3"), (9, "not  there at all here"), (10, "a\u00e9\U0001f600z"), (11, " x  y  z "), (None, "c d")]
    texts = [(1, "a b c d e f g"), (2, "one two three four five"), (3, "abc d"), (4, None), (5, ""), (6, long), (6, long), (None, "a b c d e f g"), (8, "q a\u00e9\U0001f600z"), (9, "u x  y  z v"), (10, "\n c\td  ")]
    want = sorted(((i, d) for i, q in quotes for d, t in texts if q is not None and t is not None and q in t), key=repr)
    asked, docs = spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, O.quotes_verbatim(asked, docs).collect()), key=repr) == want
    assert O.quotes_verbatim(asked.limit(0), docs).count() == 0 and O.quotes_verbatim(asked, docs.limit(0)).count() == 0


def test_words_and_cycles(spark):
    row = spark.range(1).select(T.has_word(F.lit("adf"), F.lit("see adf2 now")).alias("a"), T.has_word(F.lit("adf"), F.lit("see adfx now")).alias("b"), T.cycle_year(F.lit("Aid 2025-26"), F.lit("x")).alias("c"), T.cycle_year(F.lit("no year")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (True, False, 2026, 0)


def _transport(url: str) -> tuple[int, str, bytes]:
    host, path = url.split("/")[2], "/" + "/".join(url.split("/")[3:])
    if host == "tls.example.org":
        raise web.TlsError("handshake")
    if path == "/robots.txt":
        return (200, "text/plain", b"User-agent: *\nDisallow: /private") if host == "a.example.org" else (404, "", b"")
    return {"/down": (503, "", b""), "/gone": (404, "", b""), "/doc": (200, "application/pdf", b"%PDF-1"), "/image": (200, "image/png", b"x")}.get(path, (200, "text/html", url.encode()))


def _fallback(url: str) -> tuple[int, str, bytes]:
    return 200, "text/html", b"by the other way"


def test_fetch(spark):
    paths = ["/x", "/private/x", "/down", "/gone", "/doc", "/image"]
    urls = spark.createDataFrame([(f"https://a.example.org{p}",) for p in [*paths, "/x"]] + [("https://tls.example.org/x",)], "url string")
    got = {r.url.split("org", 1)[1] if "a.example" in r.url else "tls": r for r in web.fetch(urls, _transport, _fallback, web.Manners(delay=0.0, backoff=0.0)).collect()}
    assert {k: (r.ok, r.status, r.error) for k, r in got.items()} == {
        "/x": (True, 200, None), "/private/x": (False, 0, "blocked by robots.txt"), "/down": (False, 0, "HTTP 503"), "/gone": (False, 404, "HTTP 404"),
        "/doc": (True, 200, None), "/image": (False, 200, "unsupported content type image/png"), "tls": (True, 200, None),
    }
    assert got["/doc"].kind == "pdf" and bytes(got["tls"].body) == b"by the other way"


def test_export_nested_keeps_nulls(spark, tmp_path):
    from factloom.sources import files

    records = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, name string, note string")
    evidence = spark.createDataFrame([(1, "amount", None, "q", "u", False)], "id long, field string, value string, quote string, source_url string, grounded boolean")
    history = spark.createDataFrame([(1, 2, "f", "o", "n", "t"), (1, 1, "f", None, "o", "t")], "id long, change_id int, field string, old_value string, new_value string, note string")
    files.write_json(files.nested(records, evidence, history), f"file://{tmp_path}/out")
    rows = sorted((json.loads(line) for p in (tmp_path / "out").glob("*.json") for line in p.read_text().splitlines()), key=lambda r: r["id"])
    assert rows[0]["evidence"]["amount"] == {"value": None, "quote": "q", "source_url": "u", "grounded": False} and [c["change_id"] for c in rows[0]["change_history"]] == [1, 2]
    assert rows[1]["evidence"] is None and rows[0]["note"] is None
