"""The frontier against a queue in plain Python, and the similarity join against all pairs."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy
from factloom.operators import crawl as C
from factloom.operators import verification as V
from factloom.operators.ordering import placed
from factloom.operators.similarity import similar_keys

PROFILE = V.Profile(third_party=("list.example.com",), government=(".gov.in",), university=(".ac.in",), known={}, portals=())


def web(rng, n):
    """Pages of four hosts: html, links by page, text by page; shared menus, copies, links to nowhere and to test hosts."""
    hosts = ["www.a.gov.in", "b.ac.in", "c.example.org", "list.example.com"]
    urls = [f"https://{hosts[i % 4]}/grant/{i}" for i in range(n)]
    pages, links, texts = [], {}, {}
    for i, u in enumerate(urls):
        host = u.split("/")[2]
        menu = [f"https://{host}/grant/m{j}" for j in range(6)]
        mine = menu[: rng.randint(0, 6)] + [rng.choice(urls) for _ in range(rng.randint(0, 8))] + rng.choice([[], [f"https://{host}/grant/none{i}", f"https://{host}/about", f"https://{host}/grant/x.jpg"]])
        rng.shuffle(mine)
        texts[u] = f"text {rng.randint(0, n)} on grants and grants for students, fees and dates 12"
        links[u] = mine
        tags = "".join(f'<a href="{h}">more</a>' for h in mine)
        pages.append((u, f"<html><body><p>{texts[u]}</p>{tags}</body></html>"))
    return urls, pages, links


def queue(seeds, links, kinds, hashes, depth, budget, per_page):
    """The same crawl with one queue."""
    todo, seen, first, out = deque(), set(), {}, []
    for u in seeds:
        if u not in seen:
            seen.add(u)
            todo.append((u, None, 0))
    while todo and len(out) < budget:
        u, via, d = todo.popleft()
        if u not in hashes:
            out.append((u, d, via, "failed", None))
            continue
        if hashes[u] in first:
            out.append((u, d, via, "duplicate", first[hashes[u]]))
            continue
        first[hashes[u]] = u
        kind, official, relevant = kinds[u]
        state = "listing" if kind == "aggregator" else "kept" if official and relevant else "seen"
        out.append((u, d, via, state, None))
        if state == "listing" or d >= depth or not (official or d == 0):
            continue
        added = 0
        for h in links[u]:
            if added >= per_page:
                break
            if h not in seen:
                seen.add(h)
                todo.append((h, u, d + 1))
                added += 1
    return out


@pytest.mark.parametrize("shape", [(1, 3, 2, 1000), (2, 3, 3, 60), (3, 2, 2, 17)])
def test_crawl_is_a_queue(spark, shape):
    """Shared menus with few links a page make pages wait for one another; the budget cuts inside a level."""
    seed, per_page, depth, budget = shape
    urls, pages, _ = web(random.Random(seed), 60)
    table = spark.createDataFrame([*pages, (urls[0] + "#top", pages[0][1] + "zz")], "url string, html string")
    rules = C.Rules(PROFILE, "(?i)grant", "(?i)student|fees", "[0-9]", depth, budget, per_page)
    lean = C.read_pages(table, rules).collect()
    assert {r.url for r in lean} == set(urls)
    links = {r.url: [x.href for x in r.links] for r in lean}
    host = lambda u: u.split("/")[2].removeprefix("www.")
    assert all(host(h) == host(u) and not h.endswith(".jpg") for u, some in links.items() for h in some)
    start = [urls[i] for i in (0, 1, 2, 3, 4, 5, 0)]
    want = queue(start, links, {r.url: (r.kind, r.official, r.relevant) for r in lean}, {r.url: r.hash for r in lean}, depth, budget, per_page)
    seeds = spark.createDataFrame(list(enumerate(start)), "pos long, url string")
    got = C.crawl(seeds, table, rules).orderBy("place").collect()
    assert [(r.url, r.level, r.via, r.state, r.duplicate_of) for r in got] == want
    assert [r.place for r in got] == list(range(len(want))) and len(want) > 10
    assert {r.state for r in got} >= {"kept", "listing"}
    assert C.crawl(seeds.limit(0), table, rules).count() == 0


def test_accepted_links(spark):
    """Against one page after the other; void links take places."""
    rng = random.Random(9)
    rows = [(p, i, f"h{rng.randint(0, 25)}", False) for p in range(30) for i in range(12)] + [(p, 20 + p % 3, "void", True) for p in range(0, 30, 2)]
    rows = [(p, rng.random() * 100 // 1, h, v) for p, _, h, v in rows]
    df = spark.createDataFrame([(p, int(i), h, v) for p, i, h, v in rows], "place long, pos long, href string, void boolean")
    taken, want = set(), set()
    for p in range(30):
        mine = {}
        for q, i, h, v in rows:
            if q == p and h not in taken:
                mine[h] = (min(int(i), mine[h][0]) if h in mine else int(i), v)
        for h, (i, v) in sorted(mine.items(), key=lambda x: (x[1][0], x[0]))[:4]:
            if not v:
                taken.add(h)
                want.add((p, i, h))
    assert {(r.place, r.pos, r.href) for r in C.accepted(df, 4).collect()} == want


def test_places(spark):
    rows = [(i * 7919 % 1000, "x" * (i % 5)) for i in range(1000)]
    got = placed(spark.createDataFrame(rows, "k long, t string"), [F.col("k").desc()], "at").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.at)] == sorted((k for k, _ in rows), reverse=True) and {r.at for r in got} == set(range(1000))


@pytest.mark.parametrize("floor", [80.0, 90.0])
def test_similar_keys(spark, floor):
    """Against all pairs: short, repetitive and altered keys; repeated, empty and null ones."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(60)] + ["national", "aid"]
    keys = {"a", "ab", "abc", "aab", "aabb", "ababab", "bababa", "é", "éa"}
    while len(keys) < 400:
        k = " ".join(sorted(rng.choice(words) for _ in range(rng.randint(1, 4))))
        i = rng.randrange(len(k))
        keys |= {k, k[:i] + rng.choice("xyz") + k[i + rng.randint(0, 1) :]}
    want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if fuzzy.ratio(a, b) >= floor}
    df = spark.createDataFrame([(k,) for k in [*keys, *keys, "", None]], "key string")
    got = similar_keys(df, floor).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 50
    assert all(abs(r.score - fuzzy.ratio(r.a, r.b)) < 1e-9 for r in got)


def test_twin_summary(spark):
    """Groups of equal values give what pairs of records give."""
    rng = random.Random(3)
    names = ["Aid for weavers 2025-26", "Weavers, aid for (2026)", "Aid for weaver", "Something else", "", "2026"]
    rows = [(i, rng.choice(names), rng.choice([None, "2026-10-01", "2026-11-01"]), rng.choice([None, "Rs. 5", "5 or 6", "none", "7"]), rng.choice([True, False])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, d string, a string, owns boolean")
    known = df.select("id", "name", F.map_from_entries(F.array_compact(F.array(F.when(F.col("d").isNotNull(), F.struct(F.lit("close_date").alias("k"), F.col("d").alias("v"))), F.when(F.col("a").isNotNull(), F.struct(F.lit("amount").alias("k"), F.col("a").alias("v")))))).alias("g"), F.struct("owns").alias("own"))
    pairs = V.same_key_pairs(df)
    told = V.twin_agreement(known, pairs).groupBy("id").agg(F.count_if("agrees").alias("n_agree"), F.count_if("conflict").alias("n_conflict"), F.min(F.when(F.col("owns_other"), F.col("other"))).alias("official_twin"))
    want = {tuple(r) for r in told.collect()}
    got = {(r.id, r.n_agree, r.n_conflict, r.official_twin) for r in V.twin_summary(known).collect()}
    assert got == want and len(want) > 20
