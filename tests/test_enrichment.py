"""The enrichment run against a plain loop over small pages: quota, busy readers, links done before, ties, nulls, repeats and empty tables."""

from __future__ import annotations

import json

import pytest

from factloom.operators import enrichment as N
from factloom.operators.record_queries import PROFILE

SITE, MANY, DOWN = "https://colour.gov.in", "https://colour.gov.in/schemes", "https://lace.ac.in/down"
RECORDS = [(5, "Pragati Scholarship", MANY, True, "Ministry"), (2, "Udaan Fellowship", MANY, True, None), (3, "Saksham Award", MANY, True, "Ministry"), (4, "Vidya Grant", MANY, False, None), (1, "Yashasvi Scheme", SITE + "/one", True, None), (6, "Swanath Scheme", DOWN, True, None), (7, "Medha Award", MANY, None, None), (8, "Lilavati Award", MANY, True, None)]
FULL = ["close_date", "application_url", "amount", "gender", "category", "age_limit"]
EVIDENCE = [(8, f, "x", True) for f in FULL] + [(5, "amount", "Rs. 10", True), (5, "amount", "Rs. 10", True), (5, "close_date", "soon", False), (2, "application_url", "colour.gov.in/udaan/apply", True), (3, "gender", None, None)]
CRITERIA = [(5, "max_age", "30"), (2, "level", "UG")]
LINKS = [(MANY, k, SITE + h, a) for k, (h, a) in enumerate([("/pragati", "More"), ("/pragati/apply", "Apply"), ("/x", "Pragati guideline"), ("/pragati-result", "Result"), ("/pragati-2019", "Old"), ("/pragati/list", None), ("/udaan/a", "Udaan"), ("/udaan/b", "Udaan"), ("/saksham", "read more"), ("/saksham/faq", ""), ("/saksham", "details")])]
LINKS += [(SITE + "/one", 1, SITE + "/general/guideline", "Guideline"), (SITE + "/one", 2, SITE + "/other", "Other"), (DOWN, 1, "https://lace.ac.in/swanath", "Swanath"), (MANY, 90, "https://nowhere.net/pragati", "Pragati"), (None, 1, None, None)]
CHOSEN = {5: [SITE + "/pragati/apply", SITE + "/x", SITE + "/pragati"], 2: ["https://colour.gov.in/udaan/apply", SITE + "/udaan/a", SITE + "/udaan/b"], 3: [SITE + "/saksham", SITE + "/saksham/faq"], 1: [SITE + "/general/guideline"]}
ANSWERS = [(SITE + p, ok, f"h{k}", busy, "Text") for k, (p, ok, busy) in enumerate([("/pragati/apply", True, False), ("/x", True, None), ("/pragati", True, False), ("/udaan/apply", True, False), ("/udaan/a", True, True), ("/udaan/b", True, False), ("/saksham", False, False), ("/saksham/faq", True, False), ("/general/guideline", True, False)])]
SCHEMES = [(u, k, n) for u, *_ in ANSWERS for k, n in enumerate(["Nothing of it", "Pragati Scholarship Scheme for Girls", "Udaan", "Yashasvi", "Pragati Scholarship Scheme for Girls"])]
SCHEMES = [s for s in SCHEMES if s[:2] != (SITE + "/x", 1) and s[0] != SITE + "/saksham/faq"]
WANT = {5: "Pragati", 2: "Udaan", 1: "Yashasvi"}
FACTS = [(u, k, f, f"{f} of {u[-4:]} {k}", "a quote", g) for u, k, _ in SCHEMES for f, g in [("name", True), ("amount", True), ("close_date", not u.endswith("/apply")), ("documents", None), ("selection", u.endswith("/pragati"))]]
OFFERED = [(u, k, key, u[-3:]) for u, k, _ in SCHEMES for key in ("max_age", "level")]
LOG = [(5, SITE + "/pragati", "other"), (1, SITE + "/general/guideline", "h8"), (None, None, None)]


def brute(quota):
    calls, filled, keys, log, counts, used = {}, {}, {}, [], [0, 0, 0, False], 0
    answers = {a[0]: a[1:] for a in ANSWERS}
    for i, name, url, owned, _ in sorted(RECORDS):
        have = {f for j, f, _, g in EVIDENCE if j == i and g}
        if not owned or set(FULL) <= have:
            continue
        if not counts[3]:
            counts[0] += 1
        stop, mine = counts[3], 0
        for place, href in enumerate(CHOSEN.get(i, []), 1):
            ok, hash_, busy, _ = answers[href]
            if stop:
                calls[i, place] = "not reached"
                continue
            if not ok or (i, href, hash_) in LOG:
                calls[i, place] = "done before" if ok else "not fetched"
                continue
            used += 1
            if used > quota or busy:
                calls[i, place], stop = "quota" if used > quota else "busy", True
                counts[3] |= used > quota
                continue
            calls[i, place] = "read"
            here = [(k, n) for u, k, n in SCHEMES if u == href]
            best = next(((k, n) for k, n in here if WANT.get(i, "-") in n), None)
            new = []
            for u, k, f, v, _, g in FACTS:
                if best and (u, k) == (href, best[0]) and f != "name" and g and f not in have:
                    have.add(f)
                    new.append(f)
                    filled[i, f] = (v, href)
            for u, k, key, v in OFFERED:
                if best and (u, k) == (href, best[0]) and (i, key) not in {c[:2] for c in CRITERIA}:
                    keys.setdefault((i, key), v)
            mine += len(new)
            log.append((i, href, hash_, sorted(new), f"matched '{best[1]}'" if best else f"scheme not found among {len(here)} extracted"))
        if not stop and mine:
            counts[1] += 1
            counts[2] += mine
    return calls, filled, keys, sorted(log), counts


def tables(spark, empty=False):
    some = lambda rows: [] if empty else rows
    frame = lambda rows, schema: spark.createDataFrame(some(rows), schema)
    home = [(MANY, True), (SITE + "/one", True), (DOWN, False), (MANY, True)]
    return [
        frame(RECORDS, "id long, name string, official_url string, owned boolean, provider string"), frame(EVIDENCE, "id long, field string, value string, grounded boolean"), frame(CRITERIA, "id long, key string, value string"),
        frame(home, "url string, ok boolean"), frame(LINKS, "url string, pos long, href string, anchor string"), frame(ANSWERS, "url string, ok boolean, hash string, busy boolean, text string"),
        frame(SCHEMES, "url string, pos long, name string"), frame(FACTS, "url string, pos long, field string, value string, quote string, grounded boolean"), frame(OFFERED, "url string, pos long, key string, value string"), frame(LOG, "id long, url string, hash string"),
    ]


@pytest.mark.parametrize("quota", [0, 3, 4, 100])
def test_enrichment_run(spark, quota):
    got = N.enrichment_run(*tables(spark), PROFILE, quota)
    calls, filled, keys, log, counts = brute(quota)
    rows = got.calls.collect()
    assert {(r.id, r.place): r.outcome for r in rows} == calls
    assert sorted(r.call for r in rows if r.call is not None) == list(range(sum(o in ("read", "busy", "quota") for o in calls.values())))
    assert {(r.id, r.field): (r.value, r.source_url) for r in got.fields.collect()} == filled
    assert {(r.id, r.key): r.value for r in got.criteria.collect()} == keys
    assert sorted((r.id, r.url, r.hash, json.loads(r.filled), r.note.split("; ", 1)[1]) for r in got.log.collect()) == log
    assert [list(r) for r in got.counts.collect()] == [counts]
    met = {r.href for r in rows if r.outcome in ("read", "busy", "quota")}
    assert {(r.url, r.domain, r.kind, r.official, r.depth) for r in got.sources.collect()} == {(u, "colour.gov.in", "government", True, 1) for u in met}


def test_enrichment_run_of_nothing(spark):
    got = N.enrichment_run(*tables(spark, empty=True), PROFILE, 5)
    assert [list(r) for r in got.counts.collect()] == [[0, 0, 0, False]]
    assert all(df.count() == 0 for df in (got.calls, got.fields, got.criteria, got.log, got.sources))


def test_a_filled_log_stops_a_second_run(spark):
    """Rows appended to the log make the next run read on where the quota ended this one."""
    t = tables(spark)
    first = N.enrichment_run(*t, PROFILE, 3)
    done = first.log.select("id", "url", "hash").collect()
    t[-1] = spark.createDataFrame([tuple(r) for r in done], "id long, url string, hash string")
    second = N.enrichment_run(*t, PROFILE, 100)
    before, after = ({(r.id, r.href) for r in run.calls.collect() if r.outcome == "read"} for run in (first, second))
    assert before and after and not before & after
