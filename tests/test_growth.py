"""What grew faster than the tables: sides told again for every pair, tables derived again for every use, quotes aligned where no stretch can reach the floor."""

from __future__ import annotations

import glob
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy
from factloom.functions import rules as R
from factloom.operators import archive, crawl, discovery, enrichment, refresh
from factloom.operators import verification as V
from factloom.operators.record_queries import PROFILE
from factloom.plans import relational

SF = "/root/testdata/sf0.001"


def test_links_meet_records_when_both_are_told(spark):
    records = spark.createDataFrame([(1, "Pragati Award", "https://lace.ac.in/a", "Ministry", False, None)], "id long, name string, official_url string, provider string, single boolean, app_url string")
    links = spark.createDataFrame([("https://lace.ac.in/a", 1, "https://lace.ac.in/pragati", "More"), ("https://lace.ac.in/a", 2, "https://lace.ac.in/xpragati", "More"), ("https://lace.ac.in/a", 3, "https://gone.net/pragati", "")], "url string, pos long, href string, anchor string")
    got = discovery.candidate_links(records, links, PROFILE)
    assert [tuple(r) for r in got.collect()] == [(1, 1, "https://lace.ac.in/pragati", "More")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert not any("regexp_" in line for line in plan[at - 1 : at + 1])


@pytest.mark.parametrize("module,whole,query", [(enrichment, "enrichment_run", "enrichment_run_calls"), (archive, "archive_run", "archive_run_pages"), (refresh, "refresh", "refresh_offers")])
def test_first_steps_do_not_run_the_rest(spark, monkeypatch, module, whole, query):
    want = sorted(map(str, module.queries()[query](spark, SF).collect()))
    monkeypatch.setattr(module, whole, None)
    assert sorted(map(str, module.queries()[query](spark, SF).collect())) == want


def test_tables_of_a_run_are_derived_once(spark):
    made = enrichment._tables(spark, SF)
    for name in ("evidence", "answers", "schemes", "facts", "offered", "criteria", "log"):
        plan = made[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "o_orderkey" not in plan, name


@pytest.mark.parametrize("keep", [crawl._kept, archive._kept])
def test_rows_that_are_kept_leave_no_shuffle_files(spark, keep):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    there = lambda: set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*"))
    before, made, until = there(), keep(spark.range(999).groupBy((F.col("id") % 5).alias("k")).count()), time.time() + 20
    while there() - before and time.time() < until:
        time.sleep(0.2)
    assert not there() - before
    made.groupBy("count").count().collect()
    assert there() - before  # elsewhere the setting is as it was


def test_lines_are_moved_twice_for_links(spark, monkeypatch):
    """By order, where they meet orders that know their customers, and by part."""
    monkeypatch.setattr(enrichment, "_kept", lambda df: df)
    for name in ("orders", "customer", "part"):  # tables of another folder
        spark.catalog.dropTempView(name)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links, _ = enrichment._base(spark, SF)
        plan = links._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = [line for line in plan if "Exchange hashpartitioning" in line]
    assert len(moved) == 6 and sum("partkey" in line for line in moved) == 2 and sum("l_orderkey" in line for line in moved) == 1


def test_answers_are_moved_once(spark):
    links = enrichment._tables(spark, SF)["answers"].groupBy("url").agg(F.min("hash"))
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_facts_are_derived_for_pages_that_are_read(spark, monkeypatch):
    met, plain = [], enrichment.filled
    monkeypatch.setattr(enrichment, "filled", lambda need, calls, ran, *a: met.append((ran, a[3:6])) or plain(need, calls, ran, *a))
    assert enrichment.enrichment_run_fields(spark, SF).count()
    read = {r.href for r in met[0][0].filter("outcome = 'read'").collect()}
    for given in met[0][1]:
        assert {r.url for r in given.select("url").collect()} <= read


def test_copies_and_their_log_are_derived_for_pages_compared(spark, monkeypatch):
    met, plain = [], archive.compare
    monkeypatch.setattr(archive, "compare", lambda *a: met.append(a) or plain(*a))
    assert archive.archive_run_changes(spark, SF).count()
    pages, mine, _, _, schemes, facts, log = met[0]
    fetched = {(r.url, r.stamp) for r in pages.filter("outcome = 'compared'").collect()}
    assert {(r.url, r.stamp) for r in schemes.collect()} <= fetched
    stated, page = {(r.url, r.value) for r in facts.filter("field = 'amount'").collect()}, {r.id: r.official_url for r in mine.collect()}
    whole = [tuple(r) for r in relational.run(spark, SF, archive._LOG).collect()]
    want = {r for r in whole if (page.get(r[0]), r[2]) in stated}
    assert {tuple(r) for r in log.collect()} == want and 0 < len(want) < len(whole)


def test_reaching_the_floor_is_what_the_ratio_says(spark):
    rng = random.Random(3)
    rows = [(None, "a page"), ("a quote", None), ("abc", "abc"), ("", "")]
    for k in range(300):
        page = "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 160)))
        at = rng.randrange(len(page))
        quote = "".join(c if rng.random() > (k % 8) * 0.05 else rng.choice(["", "x", c + "y"]) for c in page[at : at + rng.randint(3, 60)])
        rows.append((quote, page))
    told = spark.createDataFrame(rows, "q string, p string").select(R.quote_reaches(F.col("q"), F.col("p")).alias("got"), (R.quote_in_page(F.col("q"), F.col("p")) >= R.QUOTE_FLOOR).alias("want"))
    rows = told.collect()
    assert [r.got for r in rows] == [r.want for r in rows] and len({r.want for r in rows}) == 2


def test_pages_are_brought_into_normal_form_once(spark):
    side = spark.createDataFrame([(1, "amount", "Rs. 5", "five rupees a month", True, "u")], "id long, field string, value string, quote string, grounded boolean, source_url string")
    pages = spark.createDataFrame([(1, "u", "Five  Rupees a month", None)], "id long, url string, text string, before string")
    got = V.compared(side, side.withColumn("value", F.lit("Rs. 6")), pages)
    assert [(r.still, r.note) for r in got.collect()] == [(True, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("coalesce(text#") == 1


def test_quotes_of_one_piece_are_looked_up_by_all_cores(spark):
    x = spark.createDataFrame([(k, "A name", "A name that is not there", "a page", 0) for k in range(64)], "id long, name string, quote string, text string, missing_runs int").coalesce(1)
    got = discovery.route(x, x.select("id").limit(0))
    assert {r.way for r in got.collect()} == {"missing"} and got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def _few_syllables(seed):
    """Texts and quotes of few syllables, so that their short stretches are everywhere; each quote is an altered part of one text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(30)]
    parts = [rng.choice(texts).split() for _ in range(20)]
    return texts, [" ".join(w if i % 20 else "zq" for i, w in enumerate(p[a : a + 45])) for p in parts for a in [rng.randrange(200)]]


def test_quotes_are_aligned_only_where_they_may_stand(monkeypatch):
    texts, quotes = _few_syllables(3)
    aligned, plain = [], fuzzy.partial_ratio
    monkeypatch.setattr(fuzzy, "partial_ratio", lambda q, t, *a: aligned.append(q) or plain(q, t, *a))
    found = [(i, j) for j, t in enumerate(texts) for i, _ in fuzzy.quotes_found(quotes, t, 90.0)]
    assert {i for i, _ in found} == set(range(len(quotes))) and len(aligned) < len(quotes) * len(texts) // 5


def test_a_quote_still_there_takes_few_alignments(spark, monkeypatch):
    texts, quotes = _few_syllables(4)
    steps, plain = [], fuzzy._lcs
    monkeypatch.setattr(fuzzy, "_lcs", lambda *a: steps.append(1) or plain(*a))
    there = [[bool(fuzzy.quotes_found([q], t, 90.0, True)) for q in quotes] for t in texts]
    assert there == [[fuzzy.partial_ratio(q, t) >= 90 for q in quotes] for t in texts] and any(map(any, there))
    steps.clear()
    assert [fuzzy.quotes_found([q], t, 90.0, True) for q in quotes for t in texts if q.split()[1] in t] and len(steps) < 12 * len(quotes) * len(texts)
    row = spark.range(1).select(R.quote_still_there([F.lit(quotes[0]), F.lit(None).cast("string")], F.lit(texts[0])).alias("a"), R.quote_still_there([], F.lit("x")).alias("b"))
    assert tuple(row.first()) == (False, False)
