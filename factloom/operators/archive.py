"""The archive run: from pages worth comparing to the rows of the change log, in one plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relational import run
from ..sources import files
from . import discovery, records
from .evidence import alike_sql

# Ages in days of an archived version, what makes a page worth comparing, what is compared, lengths and addresses in the log.
MIN_AGE, MAX_AGE, TARGET_AGE = 60, 1000, 365
WORTH = ["close_date", "amount", "income_limit"]
COMPARED = ["close_date", "open_date", "amount", "income_limit", "academic_req", "age_limit"]
ARCHIVE, LABEL, QUOTED = "https://web.archive.org/web/", "baseline:", 300

_kept = files.kept


class ArchiveRun(NamedTuple):
    """pages: (url, n, stamp, outcome) of every candidate; changes: the rows to append to the change log."""

    pages: DataFrame
    changes: DataFrame


def candidates(records: DataFrame, evidence: DataFrame, most: int | None = None) -> DataFrame:
    """(url, n): pages whose own records state WORTH fields on them, n facts; not PDF, and of a provider (the page's first record says so).

    records: (id, official_url, owned); evidence: (id, field, source_url, grounded).  most keeps the pages of most facts, ties by address.
    """
    first = records.groupBy("official_url").agg(F.min_by("owned", "id").alias("owned")).filter("owned")
    facts = evidence.filter(F.col("grounded") & F.col("field").isin(WORTH)).select("id", "source_url")
    told = facts.join(records.select("id", "official_url"), "id").filter("source_url = official_url").groupBy("official_url").agg(F.count(F.lit(1)).alias("n"))
    out = told.filter(~F.lower("official_url").endswith(".pdf")).join(first, "official_url", "left_semi").withColumnRenamed("official_url", "url")
    return out if most is None else out.orderBy(F.col("n").desc(), "url").limit(most)


def compared_before(snapshots: DataFrame) -> DataFrame:
    """(url): pages that snapshots (url, label) hold an archived copy of; the page's address is what follows the copy's time, so the join is on equal addresses."""
    kept = snapshots.filter(F.col("url").startswith(ARCHIVE) & F.col("label").startswith(LABEL))
    return kept.select(F.regexp_extract("url", r"^https://web\.archive\.org/web/[^/]*/(.+)$", 1).alias("url")).filter("url <> ''").distinct()


def nearest_versions(wanted: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """(url, stamp): for each of wanted (url) that of versions (url, pos, stamp) whose age is nearest to TARGET_AGE, MIN_AGE to MAX_AGE days; ties to the first pos.

    Stamps that start with no date are passed over.  The choice is an aggregation, so versions of one page are reduced before they are shuffled.
    """
    age = F.datediff(as_of, F.try_to_timestamp(F.substring("stamp", 1, 8), F.lit("yyyyMMdd")).cast("date"))
    fit = versions.withColumn("age", age).filter(F.col("age").between(MIN_AGE, MAX_AGE))
    best = fit.groupBy("url").agg(F.min(F.struct(F.abs(F.col("age") - TARGET_AGE).alias("gap"), "pos", "stamp")).alias("b"))
    return best.join(wanted.select("url").distinct(), "url", "left_semi").select("url", "b.stamp")


def outcomes(records_: DataFrame, evidence: DataFrame, versions: DataFrame, copies: DataFrame, snapshots: DataFrame, as_of: Column, most: int | None = None) -> DataFrame:
    """(url, n, stamp, outcome) of every candidate; inputs as archive_run has them."""
    wanted = candidates(records_, evidence, most)
    done = compared_before(snapshots).withColumn("done", F.lit(True))
    new = _kept(wanted.join(done, "url", "left"))
    picked = nearest_versions(new.filter("done IS NULL"), versions, as_of).join(copies.select("url", "stamp", "ok"), ["url", "stamp"], "left")
    outcome = F.when(F.col("done"), "compared before").when(F.col("stamp").isNull(), "no version").when(F.coalesce("ok", F.lit(False)), "compared").otherwise("not fetched")
    return new.join(picked, "url", "left").select("url", "n", "stamp", outcome.alias("outcome"))


def archive_run(records_: DataFrame, evidence: DataFrame, texts: DataFrame, versions: DataFrame, copies: DataFrame, schemes: DataFrame, facts: DataFrame, snapshots: DataFrame, log: DataFrame, as_of: Column, most: int | None = None) -> ArchiveRun:
    """Compare today's records with the nearest archived copy of their own page.

    records_: (id, name, official_url, owned); evidence: (id, field, value, quote, source_url, grounded); texts: (url, text), pages today; versions: (url, pos, stamp);
    copies: (url, stamp, ok), what fetching gave; schemes: (url, stamp, pos, name) and facts: (url, stamp, pos, field, value, quote, grounded), what copies state; snapshots: (url, label);
    log: (id, field, old_value, new_value, note).  A record meets the scheme of its page's copy whose name is most like its own; names are compared
    once for each page.  Rows of changes: id, field, old_value, new_value, source_url, evidence, note.  What a baseline has logged is not logged again.
    A copy that was not fetched, and a page without a fit version, give nothing; a page without a text today has lost all old quotes.
    """
    pages = _kept(outcomes(records_, evidence, versions, copies, snapshots, as_of, most))
    return compare(pages, records_, evidence, texts, schemes, facts, log)


def compare(pages: DataFrame, records_: DataFrame, evidence: DataFrame, texts: DataFrame, schemes: DataFrame, facts: DataFrame, log: DataFrame) -> ArchiveRun:
    """What pages, the rows of outcomes, lead to.  Only copies that were compared count of schemes and facts, and of log only old values that these copies state, so other rows may be left out."""
    fetched = pages.filter("outcome = 'compared'").select("url", "stamp")
    mine = records_.select("id", "name", F.col("official_url").alias("url"))
    offers = _kept(schemes.join(fetched, ["url", "stamp"]).groupBy("url", "stamp", F.col("name").alias("offer")).agg(F.min("pos").alias("pos")))
    asked = mine.select(F.struct("url", "name").alias("id"), "name").distinct()
    met = asked.withColumn("url", F.col("id.url")).join(offers, "url").select("id", "pos", "offer")
    found = records.best_match(asked, met).select("id.url", "id.name", "offer")
    matched = _kept(mine.join(found, ["url", "name"]).join(offers, ["url", "offer"]).select("id", "url", "stamp", "pos"))
    stated = facts.filter(F.col("grounded") & F.col("field").isin(COMPARED)).select("url", "stamp", "pos", "field", "value", "quote")
    old = matched.join(stated, ["url", "stamp", "pos"])
    at = matched.select("id", "url", "stamp").join(texts, "url", "left").withColumn("text", F.coalesce("text", F.lit("")))
    changed = discovery.archive_changes(old.select("id", "field", "value", "quote"), evidence, at.select("id", "url", "text"))
    known = log.filter(F.col("note").startswith(LABEL)).select("id", "field", "old_value", "new_value")
    fresh = changed.join(known, ["id", "field", "old_value", "new_value"], "left_anti").join(at.select("id", "url", "stamp"), "id")
    said = [F.substring(F.coalesce(q, F.lit("")), 1, QUOTED) for q in ("old_quote", "new_quote")]
    told = F.concat(F.lit("OLD ("), F.lit(ARCHIVE), "stamp", F.lit("id_/"), "url", F.lit('): "'), said[0], F.lit('" | NEW (official page): "'), said[1], F.lit('"'))
    day = F.concat_ws("-", F.substring("stamp", 1, 4), F.substring("stamp", 5, 2), F.substring("stamp", 7, 2))
    note = F.concat(F.lit(f"{LABEL} web.archive.org snapshot dated "), day)
    return ArchiveRun(pages, fresh.select("id", "field", "old_value", "new_value", F.col("url").alias("source_url"), told.alias("evidence"), note.alias("note")))


# Tables of the queries, in SQL that both engines read: a customer has a page, each of its orders is the page on that day, an order's parts are the page's
# schemes and its lines their facts.  Quotes are digests of what is stated, so two quotes are equal or far apart.
AS_OF = "2001-06-30"
_URL = "concat('https://', lower(c_mktsegment), CAST(c_custkey AS VARCHAR(20)), '.example.com/aid', CASE WHEN c_acctbal < 0 THEN '.PDF' ELSE '' END)"
_VERSIONS = f"SELECT {_URL} AS url, o_orderkey AS pos, concat(replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), '-', ''), '120000') AS stamp, o_orderpriority <> '1-URGENT' AS ok, c_acctbal, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey"
_SCHEMES = f"""SELECT v.url, v.stamp, v.pos * 10000000 + l_partkey AS pos, v.pos AS version, p_name AS name, max(l_shipdate) AS day, max(l_extendedprice) AS price, max(l_quantity) AS quantity, max(p_size) AS size, min(l_returnflag) AS flag, min(l_linestatus) AS line, max(v.c_acctbal) AS balance
    FROM ({_VERSIONS}) v JOIN lineitem ON l_orderkey = v.pos JOIN part ON p_partkey = l_partkey GROUP BY v.url, v.stamp, v.pos, l_partkey, p_name"""
_FACTS = f"""SELECT url, stamp, pos, version, name, field, value, md5(concat(field, value)) AS quote, grounded, elsewhere FROM (
    SELECT url, stamp, pos, version, name, 'close_date' AS field, CAST(CAST(day AS DATE) AS VARCHAR(20)) AS value, true AS grounded, line = 'O' AND quantity > 25 AS elsewhere FROM ({_SCHEMES}) a
    UNION ALL SELECT url, stamp, pos, version, name, 'amount', concat('Rs. ', CAST(CAST(floor(price) AS BIGINT) AS VARCHAR(20))), flag <> 'A', false FROM ({_SCHEMES}) b
    UNION ALL SELECT url, stamp, pos, version, name, 'age_limit', concat(CAST(size AS VARCHAR(20)), ' years'), size > 5, false FROM ({_SCHEMES}) c
    UNION ALL SELECT url, stamp, pos, version, name, 'documents', concat(CAST(CAST(quantity AS BIGINT) AS VARCHAR(20)), ' papers'), true, false FROM ({_SCHEMES}) d) f"""
_TODAY = f"SELECT url, max(pos) AS version FROM (SELECT url, pos, row_number() OVER (PARTITION BY url ORDER BY o_orderdate DESC, pos DESC) AS r FROM ({_VERSIONS}) v WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}') t WHERE r = 1 GROUP BY url"
_RECORDS = f"SELECT s.pos AS id, s.name, s.url AS official_url, s.balance < 9000 AS owned FROM ({_SCHEMES}) s JOIN ({_TODAY}) t ON t.version = s.version"
_EVIDENCE = f"SELECT f.pos AS id, f.field, f.value, f.quote, CASE WHEN f.elsewhere THEN 'https://other.example.org' ELSE f.url END AS source_url, f.grounded FROM ({_FACTS}) f JOIN ({_TODAY}) t ON t.version = f.version"
_SNAPSHOTS = f"SELECT concat('{ARCHIVE}20000101000000id_/', {_URL}) AS url, CASE WHEN c_acctbal > 5000 THEN 'baseline: earlier' ELSE 'crawl' END AS label FROM customer WHERE c_mktsegment = 'MACHINERY'"
_LOG = f"SELECT n.pos AS id, n.field, o.value AS old_value, n.value AS new_value, CASE WHEN n.elsewhere THEN 'crawl' ELSE 'baseline: earlier' END AS note FROM ({_FACTS}) n JOIN ({_TODAY}) t ON t.version = n.version JOIN ({_FACTS}) o ON o.url = n.url AND o.name = n.name AND o.field = n.field WHERE o.pos <> n.pos AND n.field = 'amount'"


def _today(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """(versions, now, mine, evidence, copies, snapshots): now are the facts of the pages' last versions; both engines' tables, each made from one kept table."""
    versions = _kept(run(spark, sf_dir, _VERSIONS))
    today, snapshots = run(spark, sf_dir, _TODAY, {_VERSIONS: versions}), run(spark, sf_dir, _SNAPSHOTS)
    last = _kept(run(spark, sf_dir, _SCHEMES, {_VERSIONS: versions.join(today.select(F.col("version").alias("pos")), "pos", "left_semi")}))
    mine = last.select(F.col("pos").alias("id"), "name", F.col("url").alias("official_url"), (F.col("balance") < 9000).alias("owned"))
    now = run(spark, sf_dir, _FACTS, {_SCHEMES: last}).withColumn("id", F.col("pos"))
    evidence = now.select("id", "field", "value", "quote", F.when(F.col("elsewhere"), "https://other.example.org").otherwise(F.col("url")).alias("source_url"), "grounded")
    copies = versions.groupBy("url", "stamp").agg(F.bool_and("ok").alias("ok"))
    return versions, now, mine, evidence, copies, snapshots


def _amounts(spark: SparkSession, sf_dir: str, versions: DataFrame, stated: DataFrame) -> DataFrame:
    """(url, name, other, old_value): of the amounts of all versions those that stated (url, value) has for their page; lines are dealt by order and looked through there."""
    asked = stated.groupBy("url").agg(F.collect_set("value").alias("asked"))  # a copy's amounts
    at = versions.join(asked, "url").select(F.col("pos").alias("l_orderkey"), "url", "asked")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.floor(F.max("l_extendedprice")).cast("long").alias("price"))
    met = lines.withColumn("old_value", F.concat(F.lit("Rs. "), F.col("price").cast("string"))).join(at, "l_orderkey").filter(F.array_contains("asked", F.col("old_value")))
    named = met.join(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey")
    return named.select("url", "name", (F.col("l_orderkey") * 10000000 + F.col("l_partkey")).alias("other"), "old_value")


def _logged(now: DataFrame, amounts: DataFrame) -> DataFrame:
    """The rows of _LOG that amounts (url, name, other, old_value) lead to."""
    log = now.filter("field = 'amount'").join(amounts, ["url", "name"]).filter("other <> pos")
    return log.select("id", "field", "old_value", F.col("value").alias("new_value"), F.when(F.col("elsewhere"), "crawl").otherwise("baseline: earlier").alias("note"))


def _run(spark: SparkSession, sf_dir: str) -> ArchiveRun:
    """The steps of archive_run; what copies state is derived for those alone that are compared, and so is the log for what they state."""
    versions, now, mine, evidence, copies, snapshots = _today(spark, sf_dir)
    pages = _kept(outcomes(mine, evidence, versions, copies, snapshots, F.lit(AS_OF).cast("date")))
    fetched = pages.filter("outcome = 'compared'").select("url", "stamp")
    schemes = _kept(run(spark, sf_dir, _SCHEMES, {_VERSIONS: versions.join(fetched, ["url", "stamp"], "left_semi")}))
    facts = run(spark, sf_dir, _FACTS, {_SCHEMES: schemes})
    texts = now.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("quote")), "\n").alias("text"))
    log = _kept(_logged(now, _amounts(spark, sf_dir, versions, facts.filter("field = 'amount'").select("url", "value"))))
    return compare(pages, mine, evidence, texts, schemes, facts, log)


def archive_run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).changes


def archive_run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, _, mine, evidence, copies, snapshots = _today(spark, sf_dir)
    return outcomes(mine, evidence, versions, copies, snapshots, F.lit(AS_OF).cast("date"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (archive_run_changes, archive_run_pages)}


# Names of two words in the oracle: the ratios of their arrangements and of single words come from common subsequences.
_PICKED = f"""v AS MATERIALIZED ({_VERSIONS}), s AS MATERIALIZED ({_SCHEMES}), f AS MATERIALIZED ({_FACTS}), r AS MATERIALIZED ({_RECORDS}), e AS MATERIALIZED ({_EVIDENCE}),
  owner AS (SELECT official_url AS url FROM r GROUP BY 1 HAVING arg_min(owned, id)),
  cand AS (SELECT r.official_url AS url, count(*) AS n FROM e JOIN r USING (id) WHERE e.grounded AND e.field IN ('close_date', 'amount', 'income_limit') AND e.source_url = r.official_url AND NOT suffix(lower(r.official_url), '.pdf')
    AND r.official_url IN (SELECT url FROM owner) GROUP BY 1),
  past AS (SELECT DISTINCT c.url FROM cand c JOIN ({_SNAPSHOTS}) k ON k.url LIKE '{ARCHIVE}%' AND suffix(k.url, '/' || c.url) AND k.label LIKE 'baseline:%'),
  aged AS (SELECT url, pos, stamp, abs(datediff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') - {TARGET_AGE}) AS gap FROM v WHERE datediff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN {MIN_AGE} AND {MAX_AGE}),
  near AS (SELECT a.url, a.stamp FROM aged a WHERE a.url IN (SELECT url FROM cand) AND a.url NOT IN (SELECT url FROM past) QUALIFY row_number() OVER (PARTITION BY a.url ORDER BY a.gap, a.pos) = 1),
  got AS (SELECT n.url, n.stamp, (SELECT bool_and(ok) FROM v WHERE v.url = n.url AND v.stamp = n.stamp) AS ok FROM near n)"""
NAME_WORDS = "SELECT p_name AS key FROM part UNION SELECT concat(string_split(p_name, ' ')[2], ' ', string_split(p_name, ' ')[1]) FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part"
#: CTEs after alike_sql(NAME_WORDS, 80) that end in scored (a, b, score): every two distinct names of part.
SCORED_SQL = """sim AS (SELECT a, b, score FROM alike UNION ALL SELECT b, a, score FROM alike UNION ALL SELECT key, key, 100.0 FROM ks),
  two AS (SELECT DISTINCT p_name AS name, list_sort(string_split(p_name, ' ')) AS w FROM part),
  both_ AS (SELECT x.name AS a, y.name AS b, x.w AS p, y.w AS q, list_intersect(x.w, y.w) AS c FROM two x CROSS JOIN two y),
  arranged AS (SELECT a, b, p, q, c[1] AS c, CASE WHEN p[1] = c[1] THEN p[2] ELSE p[1] END AS x, CASE WHEN q[1] = c[1] THEN q[2] ELSE q[1] END AS y, len(c) AS k FROM both_),
  scored AS (SELECT a, b, greatest(CASE WHEN len(list_filter(p, lambda t: length(t) >= 4 AND contains(b, t))) > 0 THEN 85.0 ELSE 0.0 END, CASE k WHEN 2 THEN 100.0
      WHEN 1 THEN greatest(coalesce((SELECT max(score) FROM sim z WHERE z.a = concat(m.c, ' ', m.x) AND z.b = concat(m.c, ' ', m.y)), 0), coalesce((SELECT max(score) FROM sim z WHERE z.a = m.c AND z.b IN (concat(m.c, ' ', m.x), concat(m.c, ' ', m.y))), 0))
      ELSE coalesce((SELECT max(score) FROM sim z WHERE z.a = concat(m.p[1], ' ', m.p[2]) AND z.b = concat(m.q[1], ' ', m.q[2])), 0) END) AS score FROM arranged m),"""


def oracle_sql() -> dict[str, str]:
    return {
        "archive_run_pages": f"WITH {_PICKED} SELECT c.url, c.n, g.stamp, CASE WHEN p.url IS NOT NULL THEN 'compared before' WHEN g.stamp IS NULL THEN 'no version' WHEN g.ok THEN 'compared' ELSE 'not fetched' END AS outcome FROM cand c LEFT JOIN past p ON p.url = c.url LEFT JOIN got g ON g.url = c.url",
        "archive_run_changes": f"""WITH RECURSIVE {alike_sql(NAME_WORDS, 80)}, {_PICKED},
  {SCORED_SQL}
  paired AS (SELECT r.id, r.official_url AS url, s.stamp, s.pos FROM r JOIN got g ON g.url = r.official_url AND g.ok JOIN s ON s.url = g.url AND s.stamp = g.stamp JOIN scored c ON c.a = r.name AND c.b = s.name WHERE c.score >= 80
    QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY c.score DESC, s.pos) = 1),
  quoted AS (SELECT r.official_url AS url, e.quote FROM e JOIN r USING (id)),
  diff AS (SELECT p.id, f.field, f.value AS old_value, e.value AS new_value, p.url, p.stamp, f.quote AS oq, e.quote AS nq FROM paired p JOIN f ON f.url = p.url AND f.stamp = p.stamp AND f.pos = p.pos AND f.grounded AND f.field IN ('close_date', 'amount', 'age_limit')
    JOIN e ON e.id = p.id AND e.field = f.field AND e.grounded AND e.source_url = p.url
    WHERE CASE WHEN f.field = 'close_date' THEN f.value <> e.value ELSE f.value <> e.value AND NOT EXISTS (SELECT 1 FROM quoted q WHERE q.url = p.url AND q.quote = f.quote) END),
  logged AS (SELECT * FROM ({_LOG}) l WHERE note LIKE 'baseline:%')
SELECT d.id, d.field, d.old_value, d.new_value, d.url AS source_url, concat('OLD ({ARCHIVE}', d.stamp, 'id_/', d.url, '): "', d.oq, '" | NEW (official page): "', d.nq, '"') AS evidence,
  concat('baseline: web.archive.org snapshot dated ', substr(d.stamp, 1, 4), '-', substr(d.stamp, 5, 2), '-', substr(d.stamp, 7, 2)) AS note
FROM diff d WHERE NOT EXISTS (SELECT 1 FROM logged l WHERE l.id = d.id AND l.field = d.field AND l.old_value = d.old_value AND l.new_value = d.new_value)""",
    }
