"""The enrichment run: from records that lack fields to what the pages they link to fill in, in one plan and under a quota of readings."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.relational import run
from . import archive, discovery, records
from . import record_queries as Q
from . import verification as V
from .crawl import _kept
from .evidence import alike_sql
from .ordering import placed

# Lengths in the notes of the log.
ANCHOR, MATCHED = 60, 60


class EnrichmentRun(NamedTuple):
    """calls: every link of every record and its outcome; fields, criteria: what is filled; log: rows to append; sources: pages met; counts: one row."""

    calls: DataFrame
    fields: DataFrame
    criteria: DataFrame
    log: DataFrame
    sources: DataFrame
    counts: DataFrame


def wanted(records_: DataFrame, evidence: DataFrame) -> DataFrame:
    """The owned ones of records_ (id, name, official_url, owned, provider) that lack fields, with single (the page's only record) and app_url.

    evidence: (id, field, value, grounded).  Of repeated grounded values the least counts.  Records of any owner count for single.
    """
    app = F.when(F.col("field") == "application_url", F.col("value")).alias("app_url")  # of the other fields it counts only that they are there
    told = evidence.filter("grounded AND value IS NOT NULL").select("id", "field", app).groupBy("id").agg(F.collect_set("field").alias("has"), F.min("app_url").alias("app_url"))
    known = records_.filter("owned").join(told, "id", "left")
    has = F.coalesce("has", F.array().cast("array<string>"))
    alone = records_.groupBy("official_url").agg((F.count(F.lit(1)) == 1).alias("single"))
    needy = known.filter(F.size(discovery.lacks(F.map_from_arrays(has, has))) > 0).join(alone, "official_url", "left")
    return needy.select("id", "name", "official_url", "provider", F.coalesce("single", F.lit(False)).alias("single"), "app_url")


def due_calls(links: DataFrame, answers: DataFrame, log: DataFrame, quota: int) -> DataFrame:
    """links (id, place, href, anchor) with hash, call and outcome as far as it is known before a page is read.

    answers: (url, ok, hash, busy), what fetching gave; log: (id, url, hash) of readings past.  In the order of id and place a link is not fetched, done before
    (same content for the same record), or due.  A due page whose reader is busy ends its record; quota due pages are read in this run, the next
    one stops it.  call is the number of a due page over all records, so the quota cuts the same prefix however rows are spread.
    """
    past = log.dropna().groupBy("id").agg(F.collect_set(F.struct("url", "hash")).alias("past"))
    seen = F.transform(F.filter("past", lambda x: x["url"] == F.col("href")), lambda x: x["hash"])
    asked = _kept(links.join(past, "id", "left").withColumn("seen", seen).drop("past"))
    got = answers.groupBy(F.col("url").alias("href")).agg(F.min_by(F.struct("ok", "hash", "busy"), "hash").alias("a"))
    x = asked.join(got, "href", "left").select("id", "place", "href", "anchor", "seen", F.coalesce("a.ok", F.lit(False)).alias("ok"), "a.hash", F.coalesce("a.busy", F.lit(False)).alias("busy"))
    x = _kept(x.withColumn("due", F.col("ok") & ~F.coalesce(F.array_contains("seen", F.col("hash")), F.lit(False))).drop("seen"))
    # places are found without the addresses, which meet them once
    end = F.min(F.when(F.col("due") & F.col("busy"), F.col("place"))).over(Window.partitionBy("id"))  # discovery.LINKS rows at most
    steps = x.select("id", "place", "due", "busy").withColumn("end", end).select("id", "place", "due", F.coalesce(F.col("place") > F.col("end"), F.lit(False)).alias("beyond"))
    order = [F.col("id"), F.col("place")]
    numbered = _kept(placed(steps.filter("due AND NOT beyond").select("id", "place"), order, "call"))
    stop = numbered.filter(F.col("call") == quota).first()
    after = F.lit(False) if stop is None else (F.col("id") > stop["id"]) | (F.col("id") == stop["id"]) & (F.col("place") > stop["place"])
    outcome = F.when(F.col("beyond") | after, "not reached").when(~F.col("ok"), "not fetched").when(~F.col("due"), "done before").when(F.col("call") == quota, "quota").when(F.col("busy"), "busy").otherwise("read")
    steps = steps.select("id", "place", "beyond").join(numbered, ["id", "place"], "left")
    return x.join(steps, ["id", "place"]).select("id", "place", "href", "anchor", "hash", F.when(outcome != "not reached", F.col("call")).alias("call"), outcome.alias("outcome"))


def filled_first(offers: DataFrame, known: DataFrame, by: str, *carried: str) -> DataFrame:
    """offers (id, place, by, ...) whose by known (id, by) lacks for the id: those of the least place, ties to the least carried columns."""
    new = offers.join(known.select("id", by).distinct(), ["id", by], "left_anti")
    return new.groupBy("id", by).agg(F.min(F.struct("place", *carried)).alias("o")).select("id", by, "o.*")


def called(records_: DataFrame, evidence: DataFrame, home: DataFrame, links: DataFrame, answers: DataFrame, log: DataFrame, profile: V.Profile, quota: int) -> tuple[DataFrame, DataFrame]:
    """(need, calls): the records that lack fields, and every link of theirs with its outcome; inputs as enrichment_run has them."""
    need = _kept(wanted(records_, evidence))
    up = home.filter("ok").select("url").distinct()
    asked = need.join(up.withColumnRenamed("url", "official_url"), "official_url", "left_semi")
    return need, due_calls(discovery.candidate_links(asked, links.join(up, "url", "left_semi"), profile), answers, log, quota)


def enrichment_run(records_: DataFrame, evidence: DataFrame, criteria: DataFrame, home: DataFrame, links: DataFrame, answers: DataFrame, schemes: DataFrame, facts: DataFrame, offered: DataFrame, log: DataFrame, profile: V.Profile, quota: int) -> EnrichmentRun:
    """Fill what owned records lack from the pages that their own page links to.

    records_: (id, name, official_url, owned, provider), ids unique; evidence: (id, field, value, grounded); criteria: (id, key, value); home: (url, ok), the records' pages, and
    links: (url, pos, href, anchor) on them; answers: (url, ok, hash, busy, text); schemes: (url, pos, name), facts: (url, pos, field, value, quote, grounded) and offered: (url, pos, key, value),
    what reading a page gives; log: (id, url, hash).  Links are chosen by candidate_links and cut by due_calls; of a page the scheme whose name is most like
    the record's counts, each distinct pair of names compared once.  Grounded facts other than the name fill fields without grounded evidence, criteria fill
    missing keys, and of several pages the first wins.  A record ended by a busy reader or by the quota keeps what it got and isn't counted as filled;
    records behind the quota aren't counted.  Empty tables give empty results and counts of zero; nulls in ok, owned or grounded count as false.
    """
    need, calls = called(records_, evidence, home, links, answers, log, profile, quota)
    return filled(need, calls, reached(need, calls), evidence, criteria, answers, schemes, facts, offered, profile)


def reached(need: DataFrame, calls: DataFrame) -> DataFrame:
    """Those of calls that the run came to and whose pages answered (quota and a row at most), with name and official_url of the record."""
    return _kept(calls.filter("outcome IN ('read', 'busy', 'quota')").join(need.select("id", "name", "official_url"), "id"))


def filled(need: DataFrame, calls: DataFrame, ran: DataFrame, evidence: DataFrame, criteria: DataFrame, answers: DataFrame, schemes: DataFrame, facts: DataFrame, offered: DataFrame, profile: V.Profile) -> EnrichmentRun:
    """What calls fill in; need and calls are those of called, ran those of reached.  Of schemes, facts and offered only rows of pages that ran read count, so others may be left out."""
    read = ran.filter("outcome = 'read'").drop("official_url")
    here = _kept(schemes.join(read.select(F.col("href").alias("url")).distinct(), "url", "left_semi"))
    offers = here.groupBy("url", F.col("name").alias("offer")).agg(F.min("pos").alias("pos"))
    names = read.select(F.struct("href", "name").alias("id"), "name").distinct()
    met = names.withColumn("url", F.col("id.href")).join(offers, "url").select("id", "pos", "offer")
    best = records.best_match(names, met).select("id.href", "id.name", "offer")
    matched = _kept(read.join(best, ["href", "name"]).join(offers.withColumnRenamed("url", "href"), ["href", "offer"]).select("id", "place", "call", "href", "pos", "offer"))

    told = matched.join(facts.filter("grounded AND field <> 'name'").withColumnRenamed("url", "href"), ["href", "pos"])
    fields = _kept(filled_first(told, evidence.filter("grounded"), "field", "value", "quote", "href"))
    keys = matched.join(offered.withColumnRenamed("url", "href"), ["href", "pos"]).select("id", "place", "key", "value")
    filled_keys = filled_first(keys, criteria, "key", "value").select("id", "key", "value")

    wrote = fields.groupBy("id", "place").agg(F.to_json(F.array_sort(F.collect_list("field"))).alias("filled"))
    size = here.groupBy(F.col("url").alias("href")).agg(F.count(F.lit(1)).alias("n"))
    x = read.join(matched.select("id", "place", "offer"), ["id", "place"], "left").join(wrote, ["id", "place"], "left").join(size, "href", "left")
    said = F.when(F.col("offer").isNotNull(), F.concat(F.lit("matched '"), F.substring("offer", 1, MATCHED), F.lit("'"))).otherwise(F.concat(F.lit("scheme not found among "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" extracted")))
    note = F.concat(F.lit("anchor '"), F.substring(F.coalesce("anchor", F.lit("")), 1, ANCHOR), F.lit("'; "), said)
    rows = x.select("id", F.col("href").alias("url"), "hash", F.coalesce("filled", F.lit("[]")).alias("filled"), note.alias("note"))

    first = ran.groupBy(F.col("href").alias("url")).agg(F.min_by("official_url", "call").alias("by")).join(answers.groupBy("url").agg(F.min_by("text", "hash").alias("text")), "url")
    kind = V.classify(F.col("url"), F.col("text"), profile)
    sources = first.select("url", T.domain(F.col("url")).alias("domain"), kind["kind"].alias("kind"), kind["official"].alias("official"), F.concat(F.lit("enrich:"), "by").alias("via"), F.lit(1).alias("depth"))

    stop = ran.filter("outcome = 'quota'").select("id").first()  # one row at most
    within = F.lit(True) if stop is None else F.col("id") <= stop["id"]
    ended = ran.filter("outcome IN ('busy', 'quota')").select("id").distinct()
    whole = fields.join(ended, "id", "left_anti").agg(F.countDistinct("id").alias("filled_records"), F.count(F.lit(1)).alias("fields_filled"))
    counts = need.filter(within).agg(F.count(F.lit(1)).alias("records")).join(F.broadcast(whole)).withColumn("stopped", F.lit(stop is not None))
    return EnrichmentRun(calls, fields.select("id", "field", "value", "quote", F.col("href").alias("source_url")), filled_keys, rows, sources, counts)


# Tables of the queries, in SQL that both engines read: a customer's site has a page of its orders' schemes (named after their first part) and links a page for each line.
_SITE = "concat('https://', lower(c_mktsegment), CAST(c_custkey AS VARCHAR(20)), '.example.com')"
_LINES = "SELECT l_orderkey AS orderkey, l_linenumber AS line, min(l_partkey) AS partkey, max(l_shipdate) AS day, max(l_extendedprice) AS price, max(l_quantity) AS quantity, max(l_discount) AS discount, max(l_tax) AS tax, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey, l_linenumber"
_LINK = f"""SELECT concat({_SITE}, '/aid') AS url, orderkey * 100 + line AS pos, concat(CASE WHEN tax > 0.075 THEN 'https://nowhere.net' ELSE {_SITE} END, '/', split_part(p_name, ' ', 1), CASE p_size % 5 WHEN 0 THEN '/apply' WHEN 1 THEN '_guideline' WHEN 2 THEN '/result' WHEN 3 THEN '%20details' ELSE '/notice' END,
    CASE WHEN flag = 'A' THEN concat('-', CAST(year(day) + 25 AS VARCHAR(20))) ELSE '' END) AS href, split_part(p_name, ' ', 2) AS anchor, p_name, p_brand, p_size, day, price, quantity, discount, flag, status
    FROM"""
_LINKS = f"{_LINK} ({_LINES}) l JOIN part ON p_partkey = partkey JOIN orders ON o_orderkey = orderkey JOIN customer ON c_custkey = o_custkey"
#: The same rows; orders find their customers first, so that lines are moved twice.
_LINKS_DEALT = f"{_LINK} ({_LINES}) l JOIN (orders JOIN customer ON c_custkey = o_custkey) ON o_orderkey = orderkey JOIN part ON p_partkey = partkey"
_RECORDS = f"""SELECT o_orderkey AS id, p_name AS name, concat({_SITE}, '/aid') AS official_url, o_orderstatus <> 'P' AS owned, c_name AS provider, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS day, {_SITE} AS site
    FROM (SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem GROUP BY l_orderkey) l JOIN part ON p_partkey = partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"""
_EVIDENCE = f"""SELECT id, 'close_date' AS field, day AS value, priority = '5-LOW' AS grounded FROM ({_RECORDS}) a UNION ALL SELECT id, 'amount', CAST(CAST(floor(price) AS BIGINT) AS VARCHAR(20)), price > 250000 FROM ({_RECORDS}) b
    UNION ALL SELECT id, 'application_url', concat(site, '/apply'), priority IN ('1-URGENT', '5-LOW') FROM ({_RECORDS}) c UNION ALL SELECT id, 'income_limit', '2.5 lakh', status = 'F' FROM ({_RECORDS}) d
    UNION ALL SELECT id, 'age_limit', '25 years', price > 150000 FROM ({_RECORDS}) e UNION ALL SELECT id, 'category', 'SC', priority <> '2-HIGH' FROM ({_RECORDS}) f"""
_ANSWERED = f"SELECT href AS url, min(discount) < 0.08 AS ok, md5(href) AS hash, max(quantity) > 49 AS busy, 'Read on' AS text FROM ({_LINKS}) l GROUP BY href UNION ALL"
_ANSWERS = f"{_ANSWERED} SELECT DISTINCT concat(site, '/apply'), true, md5(concat(site, '/apply')), false, 'Apply here' FROM ({_RECORDS}) r"
#: The same rows, both parts dealt by address.
_ANSWERS_DEALT = f"{_ANSWERED} SELECT url, true, md5(url), false, 'Apply here' FROM (SELECT DISTINCT concat(site, '/apply') AS url FROM ({_RECORDS}) r) d"
_SCHEMES = f"SELECT href AS url, pos, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS name FROM ({_LINKS}) l"
_FACTS = f"""SELECT url, pos, field, value, concat('It says ', value) AS quote, grounded FROM (SELECT href AS url, pos, 'close_date' AS field, CAST(CAST(day AS DATE) AS VARCHAR(20)) AS value, flag <> 'R' AS grounded FROM ({_LINKS}) a UNION ALL SELECT href, pos, 'amount', CAST(CAST(floor(price) AS BIGINT) AS VARCHAR(20)), quantity > 20 FROM ({_LINKS}) b
    UNION ALL SELECT href, pos, 'income_limit', concat(CAST(CAST(quantity AS BIGINT) AS VARCHAR(20)), ' lakh'), status = 'O' FROM ({_LINKS}) c UNION ALL SELECT href, pos, 'name', p_name, true FROM ({_LINKS}) d) f"""
_OFFERED = f"SELECT href AS url, pos, 'max_age' AS key, CAST(p_size AS VARCHAR(20)) AS value FROM ({_LINKS}) l UNION ALL SELECT href, pos, 'brand', p_brand FROM ({_LINKS}) m WHERE status = 'F'"
_CRITERIA = f"SELECT id, 'max_age' AS key, '30' AS value FROM ({_RECORDS}) r WHERE price > 200000"
_LOG = f"SELECT id, concat(site, '/', split_part(name, ' ', 1), '_guideline') AS url, md5(concat(CASE WHEN priority = '3-MEDIUM' THEN '' ELSE 'old' END, site, '/', split_part(name, ' ', 1), '_guideline')) AS hash FROM ({_RECORDS}) r WHERE priority IN ('3-MEDIUM', '2-HIGH')"
_QUOTA = "SELECT 4 * count(*) AS n FROM customer"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of _LINES, dealt by order, as the orders that they meet are."""
    dealt = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"))
    most = dict(day="l_shipdate", price="l_extendedprice", quantity="l_quantity", discount="l_discount", tax="l_tax")
    least = dict(partkey="l_partkey", flag="l_returnflag", status="l_linestatus")
    return dealt.agg(*[F.max(c).alias(k) for k, c in most.items()], *[F.min(c).alias(k) for k, c in least.items()])


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(links, records), from which all tables of a run are derived."""
    links = _kept(run(spark, sf_dir, _LINKS_DEALT, {_LINES: _lines(spark, sf_dir)}))  # takes most disk, so nothing is kept before
    return links, _kept(run(spark, sf_dir, _RECORDS))


#: What is derived from links and records.
_DERIVED = dict(evidence=_EVIDENCE, answers=_ANSWERS_DEALT, schemes=_SCHEMES, facts=_FACTS, offered=_OFFERED, criteria=_CRITERIA, log=_LOG)


def _derived(spark: SparkSession, sf_dir: str, links: DataFrame, mine: DataFrame, *names: str) -> dict[str, DataFrame]:
    return {name: run(spark, sf_dir, _DERIVED[name], {_LINKS: links, _RECORDS: mine}) for name in names}


def _tables(spark: SparkSession, sf_dir: str, base: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of a run, derived from links and records, which are made once."""
    links, mine = base or _base(spark, sf_dir)
    home = mine.select(F.col("official_url").alias("url"), (F.substring("official_url", 9, 1) != "m").alias("ok")).distinct()
    return _derived(spark, sf_dir, links, mine, *_DERIVED) | dict(records_=mine, home=home, links=links.select("url", "pos", "href", "anchor"))


def _called(spark: SparkSession, sf_dir: str, t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    asked = {name: t[name] for name in ("records_", "evidence", "home", "links", "answers", "log")}
    return called(**asked, profile=Q.PROFILE, quota=run(spark, sf_dir, _QUOTA).first()[0])


def _run(spark: SparkSession, sf_dir: str) -> EnrichmentRun:
    """The steps of enrichment_run; what pages give is derived for those alone that are read."""
    links, mine = _base(spark, sf_dir)
    t = _tables(spark, sf_dir, (links, mine))
    need, calls = _called(spark, sf_dir, t)
    ran = reached(need, calls)
    here = _kept(links.drop("url", "anchor").join(ran.filter("outcome = 'read'").select("href").distinct(), "href", "left_semi"))
    t |= _derived(spark, sf_dir, here, mine, "schemes", "facts", "offered")
    return filled(need, calls, ran, t["evidence"], t["criteria"], t["answers"], t["schemes"], t["facts"], t["offered"], Q.PROFILE)


def enrichment_run_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of records that lack fields: whether it is read within a quota of four readings for each customer."""
    _, calls = _called(spark, sf_dir, _tables(spark, sf_dir))
    return calls.select("id", "place", F.col("href").alias("url"), "call", "outcome")


def enrichment_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the run appends to its log."""
    return _run(spark, sf_dir).log


def enrichment_run_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields and criteria that the run fills in."""
    done = _run(spark, sf_dir)
    return done.fields.unionByName(done.criteria.select("id", F.concat(F.lit("criteria."), "key").alias("field"), "value"), allowMissingColumns=True)


def enrichment_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (enrichment_run_calls, enrichment_run_log, enrichment_run_fields, enrichment_run_counts)}


# No name of part is a word of a site, and no site but the customer's own is allowed.
_RUN = f"""WITH RECURSIVE {alike_sql(archive.NAME_WORDS, 80)},
  {archive.SCORED_SQL}
  l AS MATERIALIZED ({_LINKS}), r AS MATERIALIZED ({_RECORDS}), e AS MATERIALIZED ({_EVIDENCE}), a AS MATERIALIZED ({_ANSWERS}), s AS MATERIALIZED ({_SCHEMES}), f AS MATERIALIZED ({_FACTS}),
  has AS (SELECT id, list(field) AS g FROM e WHERE grounded GROUP BY id),
  need AS MATERIALIZED (SELECT r.*, coalesce(g, []) AS g, count(*) OVER (PARTITION BY official_url) = 1 AS single FROM r LEFT JOIN has USING (id)),
  want AS MATERIALIZED (SELECT * FROM need WHERE owned AND (NOT list_has_all(g, ['close_date', 'amount', 'application_url']) OR len(list_intersect(g, ['income_limit', 'age_limit', 'category'])) < 3)),
  hay AS (SELECT url, pos, href, anchor, translate(replace(lower(concat(regexp_replace(href, '^https?://[^/]+', ''), ' ', anchor)), '%20', ' '), '_-', '  ') AS h FROM l WHERE href NOT LIKE 'https://nowhere.net%'),
  fit AS (SELECT *, string_split_regex(h, '[^a-z]+') AS w, regexp_matches(h, 'apply|guideline|details') AS useful, regexp_matches(h, 'apply|guideline') AS explicit FROM hay
    WHERE NOT contains(h, 'result') AND len(list_filter(regexp_extract_all(h, '[0-9]+'), lambda x: length(x) = 4 AND x BETWEEN '1900' AND '2023')) = 0),
  pts AS (SELECT want.id, pos, href, anchor, CASE WHEN list_has_any(w, list_filter(string_split(name, ' '), lambda t: length(t) >= 4)) THEN 2 + CAST(useful AS INTEGER) WHEN single AND explicit THEN 1 END AS points FROM want JOIN fit ON url = official_url
    UNION ALL SELECT id, 0, concat(site, '/apply'), 'application link stated on the source page', 9 FROM want WHERE list_contains(g, 'application_url')),
  one AS (SELECT p.* FROM pts p JOIN want USING (id) WHERE points IS NOT NULL AND substr(official_url, 9, 1) <> 'm' QUALIFY row_number() OVER (PARTITION BY p.id, href ORDER BY points DESC, pos) = 1),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, pos, href) AS place FROM one) t WHERE place <= 3),
  ans AS MATERIALIZED (SELECT t.id, t.place, t.href, t.anchor, a.hash, coalesce(a.ok, false) AS ok, coalesce(a.busy, false) AS busy, coalesce(a.ok, false) AND g.id IS NULL AS due FROM top t LEFT JOIN a ON a.url = t.href LEFT JOIN (SELECT DISTINCT * FROM ({_LOG}) g0) g ON g.id = t.id AND g.url = t.href AND g.hash = a.hash),
  cut AS (SELECT *, coalesce(place > min(place) FILTER (due AND busy) OVER (PARTITION BY id), false) AS beyond FROM ans),
  num AS (SELECT *, CASE WHEN due AND NOT beyond THEN count(*) FILTER (due AND NOT beyond) OVER (ORDER BY id, place) - 1 END AS k FROM cut),
  q AS (SELECT n, (SELECT id FROM num WHERE k = n) AS qid, (SELECT place FROM num WHERE k = n) AS qplace FROM ({_QUOTA}) q0),
  calls AS MATERIALIZED (SELECT id, place, href, anchor, hash, k, CASE WHEN beyond OR coalesce((id, place) > (qid, qplace), false) THEN 'not reached' WHEN NOT ok THEN 'not fetched' WHEN NOT due THEN 'done before' WHEN k = n THEN 'quota' WHEN busy THEN 'busy' ELSE 'read' END AS outcome FROM num, q),
  rd AS (SELECT c.*, name FROM calls c JOIN r USING (id) WHERE outcome = 'read'),
  m AS MATERIALIZED (SELECT rd.id, rd.place, rd.href, s.pos, s.name AS offer FROM rd JOIN s ON s.url = rd.href JOIN scored z ON z.a = rd.name AND z.b = s.name WHERE z.score >= 80 QUALIFY row_number() OVER (PARTITION BY rd.id, rd.place ORDER BY z.score DESC, s.pos) = 1),
  fill AS MATERIALIZED (SELECT m.id, m.place, f.field, f.value, f.quote, m.href FROM m JOIN f ON f.url = m.href AND f.pos = m.pos WHERE f.grounded AND f.field <> 'name' AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = m.id AND e.field = f.field AND e.grounded) QUALIFY row_number() OVER (PARTITION BY m.id, f.field ORDER BY m.place) = 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "enrichment_run_calls": f"{_RUN} SELECT id, place, href AS url, CASE WHEN outcome <> 'not reached' THEN k END AS call, outcome FROM calls",
        "enrichment_run_log": f"""{_RUN} SELECT rd.id, rd.href AS url, rd.hash, coalesce((SELECT '["' || string_agg(field, '","' ORDER BY field) || '"]' FROM fill WHERE fill.id = rd.id AND fill.place = rd.place), '[]') AS filled,
            concat('anchor ''', rd.anchor, '''; ', CASE WHEN m.offer IS NOT NULL THEN concat('matched ''', m.offer, '''') ELSE concat('scheme not found among ', (SELECT count(*) FROM s WHERE s.url = rd.href), ' extracted') END) AS note FROM rd LEFT JOIN m ON m.id = rd.id AND m.place = rd.place""",
        "enrichment_run_fields": f"""{_RUN} SELECT id, field, value, quote, href AS source_url FROM fill UNION ALL
            SELECT id, concat('criteria.', key), value, NULL, NULL FROM (SELECT m.id, o.key, o.value FROM m JOIN ({_OFFERED}) o ON o.url = m.href AND o.pos = m.pos WHERE (m.id, o.key) NOT IN (SELECT id, key FROM ({_CRITERIA}) c) QUALIFY row_number() OVER (PARTITION BY m.id, o.key ORDER BY m.place) = 1) k""",
        "enrichment_run_counts": f"""{_RUN} SELECT (SELECT count(*) FROM want, q WHERE coalesce(id <= qid, true)) AS records, count(DISTINCT id) AS filled_records, count(*) AS fields_filled, (SELECT qid IS NOT NULL FROM q) AS stopped
            FROM fill WHERE id NOT IN (SELECT id FROM calls WHERE outcome IN ('busy', 'quota'))""",
    }
