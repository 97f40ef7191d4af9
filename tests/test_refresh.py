"""The pages of a run into the records, against a plain loop over pages in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import refresh as N

A, B, C, OLD = "https://lace.ac.in/a", "https://lace.ac.in/b", "https://lace.ac.in/c", "https://lace.ac.in/unread"
FIELDS = ["name", "close_date", "amount", "documents", "selection"]
Q = {k: f"{w} is what the page of the house says about it" for k, w in {"d1": "The thirtieth of November", "d2": "A quite other winter evening", "m1": "Two thousand rupees monthly", "m2": "Five crisp banknotes yearly", "p1": "Marks card with letter", "p2": "Bring your own passport photographs", "s1": "Interview by committee", "s2": "Lottery drawn among villagers", "n1": "Weavers Merit Award", "n9": "Forgotten Silk Prize"}.items()}
# id, name, page, missing
RECORDS = [(1, "Weavers Merit", A, 1), (2, "Spinners Aid", A, 0), (3, "Dyers Fund", A, 2), (4, "Carders Help", B, 3), (5, "Unread Prize", OLD, 7), (6, "Knitters Prize", B, 1), (7, "Tailors Prize", A, 4)]
EVIDENCE = [
    (1, "name", "Weavers Merit", Q["n1"], True, A), (1, "close_date", "2026-11-30", Q["d1"], True, A), (1, "amount", "Rs. 2,000", Q["m1"], True, A), (1, "documents", "card", Q["p1"], True, B), (1, "selection", None, None, False, A),
    (2, "amount", "Rs. 2,000", Q["m2"], True, A), (2, "documents", "marks card and letter", Q["p2"], True, A), (2, "close_date", "2026-01-01", Q["d2"], True, A),
    (3, "name", "Dyers Fund", Q["n9"], True, A), (3, "amount", "Rs. 1", Q["m1"], True, A), (4, "name", "Carders Help", None, True, B), (7, "amount", None, None, None, A), (5, "amount", "Rs. 9", Q["m2"], True, OLD),
]
PAGES = [(20, A, " ".join([Q["d1"], Q["m1"], Q["p1"], Q["s1"], "Tailors Prize stands here"]), Q["s1"]), (10, B, Q["m2"], None), (30, C, None, None)]
SCHEMES = [(A, 3, "Weavers Merit 2025", None, None), (A, 4, "Weavers Merit 2026", None, None), (A, 5, "Weavers Merit 2026", None, None), (A, 1, "Spinners Aid", None, "2027-01-01"), (A, 2, "New One", None, None), (A, 9, "Second New", None, None), (B, 1, "Knitters Prize", None, None), (B, 2, "Weavers Merit", None, None), (B, 3, "New One", None, None), (B, 5, "Dyers Fund", None, None), (C, 1, "Weavers Merit", None, None), (C, 2, "New One", None, None), (C, 3, "Carders Help", None, None), ("https://never.read/x", 1, "Nothing", None, None)]
SAYS = {
    (A, 4): {"close_date": ("2026-12-31", Q["d1"]), "amount": ("Rs. 3,000", Q["m1"]), "selection": ("interview", Q["s1"])}, (A, 1): {"amount": ("2000 rupees", Q["m1"]), "documents": ("a passport", Q["p1"]), "selection": ("lottery", Q["s2"])},
    (A, 2): {"amount": ("Rs. 7", Q["m1"])}, (B, 2): {"selection": ("villagers", Q["s2"]), "amount": ("Rs. 8", Q["m2"])}, (B, 3): {"amount": ("Rs. 6", Q["m2"]), "documents": (None, None)}, (B, 5): {"selection": ("lot", Q["s2"]), "amount": ("Rs. 5", Q["m2"])},
    (C, 1): {"documents": ("late", Q["p2"])}, (C, 2): {"documents": ("a card", Q["p1"]), "amount": ("Rs. 4", Q["m1"])}, (C, 3): {"amount": ("Rs. 3", Q["m1"])}, (B, 1): {"amount": ("Rs. 2", Q["m2"])},
}
FACTS = [(u, p, f, *SAYS.get((u, p), {}).get(f, (None, None))) for u, p, *_ in SCHEMES for f in FIELDS]
FACTS = [(u, p, f, n if f == "name" else v, "A name " + n if f == "name" else q, True if f == "name" or v else None if p == 1 else False) for (u, p, f, v, q), n in zip(FACTS, [s[2] for s in SCHEMES for _ in FIELDS], strict=True)]


def there(quote, text):
    return bool(quote) and quote.lower() in (text or "").lower()


def brute():
    key = lambda name: name.lower().removesuffix(" 2025").removesuffix(" 2026")
    records = {key(n): {"id": i, "name": n, "url": u, "missing": m} for i, n, u, m in RECORDS}
    ev = {(i, f): [v, q, bool(g), s, 0] for i, f, v, q, g, s in EVIDENCE}
    log, ways = [], {}
    for place, url, text, before in sorted(PAGES):
        best = {}
        for u, pos, name, *_ in sorted(s[:3] for s in SCHEMES if s[0] == url):
            year = 2026 if name.endswith("2026") else 2025 if name.endswith("2025") else 0
            if key(name) not in best or year > best[key(name)][0]:
                best[key(name)] = (year, pos, name)
        seen = set()
        for k, (_, pos, name) in best.items():
            facts = {f: (v, q, bool(g)) for u, p, f, v, q, g in FACTS if (u, p) == (url, pos)}
            r = records.get(k)
            if r is None:
                r = records[k] = {"id": max(x["id"] for x in records.values()) + 1, "name": name, "url": url, "missing": 0}
                ways[r["id"], place] = "new"
                for f, (v, q, g) in facts.items():
                    ev[r["id"], f] = [v if g else None, q if g else None, g, url, place]
                seen.add(r["id"])
                continue
            i = r["id"]
            seen.add(i)
            r["missing"] = 0
            ways[i, place] = "own" if r["url"] == url else "elsewhere"
            if r["url"] != url:
                for f, (v, q, g) in facts.items():
                    if g and f != "name" and not ev.get((i, f), [0, 0, False])[2]:
                        ev[i, f] = [v, q, True, url, place]
                continue
            for f, (v, q, g) in facts.items():
                old = ev.get((i, f), [None, None, False, None, 0])
                was, now = old[0] if old[2] else None, v if g else None
                still = there(old[1], text)
                if f == "name" or was is None and now is None:
                    continue
                if was is None:
                    note = "LATE_FILL" if there(q, before) else "newly stated on the official page"
                elif now is None:
                    note = None if still else "no longer stated on the official page"
                elif f == "close_date":
                    note = "date changed" if was != now else None
                else:
                    digits = lambda x: "".join(c for c in x if c.isdigit())
                    same = digits(was) == digits(now) if f == "amount" else was == now
                    note = None if still or same else "value changed"
                if note is None:
                    if g and old[2] and old[3] == url and not still:
                        old[1], old[4] = q, place
                    continue
                if old[3] not in (None, url) and was is not None and now is None:
                    continue
                if note != "LATE_FILL":
                    log.append((i, f, was, now, q if now else old[1], note))
                ev[i, f] = [now, q if g else None, g, url, place]
            for (j, f), e in ev.items():
                if j == i and e[3] == url and e[2]:
                    e[4] = place
        for r in records.values():
            if r["url"] == url and r["id"] not in seen:
                quote = ev[r["id"], "name"][1] if (r["id"], "name") in ev else r["name"]
                r["missing"] = 0 if there(quote, text) else r["missing"] + 1
    return ways, {(r["id"], r["name"], r["url"], r["missing"]) for r in records.values()}, {(*k, *v) for k, v in ev.items()}, sorted(log, key=str)


def tables(spark, pages=PAGES, schemes=SCHEMES):
    records = spark.createDataFrame(RECORDS, "id long, name string, official_url string, missing_runs int").withColumn("key", T.dedup_key(F.col("name"), F.col("official_url")))
    evidence = spark.createDataFrame([(*e, 0) for e in EVIDENCE], "id long, field string, value string, quote string, grounded boolean, source_url string, snapshot long")
    read = spark.createDataFrame(pages, "place long, url string, text string, before string").withColumn("snapshot", F.col("place"))
    found = spark.createDataFrame(schemes, "url string, pos long, name string, open_date string, close_date string")
    return records, evidence, read, found, spark.createDataFrame(FACTS, "url string, pos long, field string, value string, quote string, grounded boolean")


def test_refresh(spark):
    got = N.refresh(*tables(spark))
    ways, records, evidence, log = brute()
    assert {(r.id, r.place): r.way for r in got.offers.collect()} == ways
    assert {(r.id, r.name, r.official_url, r.missing_runs) for r in got.records.collect()} == records
    assert {(r.id, r.field, r.value, r.quote, bool(r.grounded), r.source_url, r.snapshot) for r in got.evidence.collect()} == evidence
    assert sorted(((r.id, r.field, r.old_value, r.new_value, r.evidence, r.note) for r in got.log.collect()), key=str) == log and log


def test_refresh_of_no_pages_changes_nothing(spark):
    got = N.refresh(*tables(spark, pages=[], schemes=[]))
    assert got.offers.count() == got.log.count() == 0
    assert {(r.id, r.missing_runs) for r in got.records.collect()} == {(r[0], r[3]) for r in RECORDS}
    assert got.evidence.count() == len(EVIDENCE)
