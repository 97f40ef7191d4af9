"""The pages of a run into the records: schemes that are new, known from this page or from another one, and records that their page no longer names."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.relational import run
from . import discovery
from . import verification as V
from .crawl import _kept
from .enrichment import filled_first
from .ordering import placed

EVIDENCE = ["id", "field", "value", "quote", "grounded", "source_url", "snapshot"]


class Refresh(NamedTuple):
    """offers: each scheme of a page, its record and its way; records: all of them afterwards; evidence: all of it; log: rows of the change log."""

    offers: DataFrame
    records: DataFrame
    evidence: DataFrame
    log: DataFrame


def offered(records: DataFrame, pages: DataFrame, schemes: DataFrame) -> DataFrame:
    """(id, place, url, pos, key, name, way, snapshot): for each page and key the newest cycle, and whether it is new, the record's own page, or elsewhere.

    Of a key that no record has the first page in the order of place makes the record, later ones are elsewhere; new ids follow the largest
    known one in the order of place and of the key's first pos, numbered by ranges.  Rows of other pages than these are passed over.
    """
    x = schemes.join(pages.select("url", "place", "snapshot"), "url").withColumn("key", T.dedup_key(F.coalesce("name", F.lit("")), F.col("url")))
    cycle = T.cycle_year(F.coalesce("name", F.lit("")), F.coalesce("open_date", F.lit("")), F.coalesce("close_date", F.lit("")))
    best = x.groupBy("url", "place", "snapshot", "key").agg(F.max(F.struct(cycle.alias("cycle"), (-F.col("pos")).alias("back"), "name")).alias("b"), F.min("pos").alias("at"))
    best = _kept(best.select("url", "place", "snapshot", "key", (-F.col("b.back")).alias("pos"), "b.name", "at"))
    known = records.select("key", "id", "official_url")
    first = best.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct("place", "at", "url")).alias("f")).select("key", "f.*")
    top = records.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = placed(first, [F.col("place").asc(), F.col("at").asc(), F.col("key").asc()], "n").select("key", (F.col("n") + 1 + top).cast("long").alias("id"), F.col("url").alias("official_url"), F.lit(True).alias("new"))
    both = _kept(known.withColumn("new", F.lit(False)).unionByName(new))
    own = F.col("url") == F.col("official_url")
    way = F.when(own & F.col("new"), "new").when(own, "own").otherwise("elsewhere")
    return best.join(both, "key").select("id", "place", "url", "pos", "key", "name", way.alias("way"), "snapshot")


def _with(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """old evidence with rows of fresh in place of those of the same id and field."""
    return old.join(fresh.select("id", "field"), ["id", "field"], "left_anti").select(*EVIDENCE).unionByName(fresh.select(*EVIDENCE))


def _gaps(told: DataFrame, evidence: DataFrame, when: Column) -> DataFrame:
    """Evidence with what pages elsewhere say (told, where when holds) on fields without a grounded value; the first page wins."""
    says = told.filter(when & F.col("grounded") & (F.col("field") != "name"))
    fresh = filled_first(says, evidence.filter("grounded"), "field", "value", "quote", "url", "snapshot")
    return _with(evidence, fresh.withColumns({"grounded": F.lit(True), "source_url": F.col("url")}))


def refresh(records: DataFrame, evidence: DataFrame, pages: DataFrame, schemes: DataFrame, facts: DataFrame) -> Refresh:
    """What pages read in one run, in the order of place, do to records and their evidence.

    records: (id, key, name, official_url, missing_runs), ids and keys unique; evidence: (id, field, value, quote, grounded, source_url, snapshot), a row for an id and field; pages: (place, url, text, before, snapshot),
    addresses and places unique; schemes: (url, pos, name, open_date, close_date); facts: (url, pos, field, value, quote, grounded), a row for a field.  A page elsewhere fills only fields that lack a grounded
    value, before or after the record's own page as their places say.  The own page changes fields as V.apply_changes has it; where nothing changed but the
    old quote is gone, evidence points to the new quote; grounded evidence of this page takes its snapshot.  A record that its page neither
    states nor names is missing once more, any page that states it sets the count to zero, in the order of place.  Records of pages not read stay.  Null texts hold no quote.
    """
    offers = _kept(offered(records, pages, schemes))
    home = pages.select(F.col("url").alias("official_url"), F.col("place").alias("home"))
    told = _kept(offers.select("id", "place", "url", "pos", "way", "snapshot").join(facts, ["url", "pos"]).withColumn("grounded", F.coalesce("grounded", F.lit(False))))
    elsewhere = told.filter("way = 'elsewhere'").join(records.select("id", "official_url"), "id", "left").join(home, "official_url", "left").drop("official_url")
    later = F.coalesce(F.col("home") < F.col("place"), F.lit(False))
    sure = lambda name: F.when(F.col("grounded"), F.col(name))
    fresh = told.filter("way = 'new'").withColumns({"value": sure("value"), "quote": sure("quote"), "source_url": F.col("url")})
    made = offers.filter("way = 'new'").select("id", "place")
    elsewhere = _kept(elsewhere.join(made.select("id", F.lit(True).alias("made")), "id", "left").withColumn("later", later | F.col("made").isNotNull()))
    before = _kept(_gaps(elsewhere, evidence, ~F.col("later")))

    own = offers.filter("way = 'own'").select("id", "url", "snapshot")
    at = own.join(pages.select("url", F.coalesce("text", F.lit("")).alias("text"), "before"), "url").withColumnRenamed("snapshot", "shot")
    said = told.filter("way = 'own'").withColumn("source_url", F.col("url")).select(*EVIDENCE)
    diff = V.compared(before.join(own.select("id"), "id", "left_semi"), said, at, "snapshot").withColumn("gone", ~F.col("still"))
    diff = _kept(diff.drop("still"))
    was, now = F.when(F.col("old.grounded"), F.col("old.value")), F.when(F.col("new.grounded"), F.col("new.value"))
    proof = F.when(now.isNotNull(), F.col("new.quote")).otherwise(F.col("old.quote"))
    log = diff.filter("changed AND note <> 'LATE_FILL'").select("id", "field", was.alias("old_value"), now.alias("new_value"), F.col("url").alias("source_url"), proof.alias("evidence"), "note")
    moved = F.col("new.grounded") & F.col("old.grounded") & (F.col("old.source_url") == F.col("url")) & F.col("gone")
    put = lambda value, otherwise: F.when(F.col("changed"), value).otherwise(otherwise)
    after = diff.filter("changed OR old IS NOT NULL").select(
        "id", "field", put(now, F.col("old.value")).alias("value"), put(F.when(F.col("new.grounded"), F.col("new.quote")), F.when(moved, F.col("new.quote")).otherwise(F.col("old.quote"))).alias("quote"),
        F.coalesce(put(F.col("new.grounded"), F.col("old.grounded")), F.lit(False)).alias("grounded"), F.when(F.col("changed"), F.col("url")).otherwise(F.col("old.source_url")).alias("source_url"),
        F.when(F.col("changed") | F.coalesce(moved, F.lit(False)), F.col("shot")).otherwise(F.col("old.snapshot")).alias("snapshot"),
    )
    confirmed = _with(before, after).join(own.select("id", F.col("url").alias("u"), F.col("snapshot").alias("shot")), "id", "left")
    confirmed = confirmed.withColumn("snapshot", F.when(F.col("grounded") & (F.col("source_url") == F.col("u")), F.col("shot")).otherwise(F.col("snapshot"))).select(*EVIDENCE)
    final = _gaps(elsewhere, _kept(confirmed.unionByName(fresh.select(*EVIDENCE))), F.col("later"))

    stated = offers.groupBy("id").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.max(F.col("way") != "elsewhere").alias("by_own"))
    names = evidence.filter("field = 'name'").select("id", F.col("quote").alias("name_quote"), F.lit(True).alias("has"))
    x = records.join(home, "official_url", "left").join(stated, "id", "left")
    asked = x.filter("home IS NOT NULL AND NOT coalesce(by_own, false)").select("id", "official_url", "name", F.lit(0).alias("missing_runs")).join(names, "id", "left")
    asked = asked.join(pages.select(F.col("url").alias("official_url"), F.coalesce("text", F.lit("")).alias("text")), "official_url").withColumn("quote", F.when(F.col("has"), F.coalesce("name_quote", F.lit(""))).otherwise(F.col("name")))
    lost = discovery.route(asked, asked.select("id").limit(0)).filter("way = 'missing'").select("id", F.lit(True).alias("lost"))
    named = x.join(lost, "id", "left")
    base = F.when(F.coalesce(F.col("first") < F.col("home"), F.lit(False)), 0).otherwise(F.col("missing_runs"))
    quiet = F.col("home").isNull() & F.col("first").isNull()
    runs = F.when(quiet, F.col("missing_runs")).when(F.col("lost") & ~F.coalesce(F.col("last") > F.col("home"), F.lit(False)), base + 1).otherwise(0)
    old = named.select("id", "key", "name", "official_url", runs.cast("int").alias("missing_runs"))
    new = offers.filter("way = 'new'").select("id", "key", "name", F.col("url").alias("official_url"), F.lit(0).alias("missing_runs"))
    return Refresh(offers, old.unionByName(new), final, log)


# Tables of the queries, in SQL that both engines read: an order is a scheme of its customer's page for orders of its status; orders before a day are records, later ones are what pages
# state now.  Quotes are digests of what is stated, so two quotes are equal or far apart.
_DAY = "CAST(o_orderdate AS DATE) < DATE '1998-01-01'"
_SITE = "concat(lower(c_mktsegment), CAST(c_custkey AS VARCHAR(20)), '.example.com')"
_ALL = f"""SELECT o_orderkey AS pos, concat(split_part(p_name, ' ', 1), ' merit aid ', CAST(year(o_orderdate) + 25 AS VARCHAR(20))) AS name, concat(split_part(p_name, ' ', 1), ' merit aid|', {_SITE}) AS key, concat('https://', {_SITE}, '/', lower(o_orderstatus)) AS url,
    c_custkey * 3 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS place, {_DAY} AS past, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS day, o_totalprice AS price, o_orderpriority AS priority
    FROM (SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem GROUP BY l_orderkey) l JOIN part ON p_partkey = partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"""
_STATED = f"""SELECT pos, url, place, past, field, value, md5(concat(field, value)) AS quote, grounded, price, priority FROM (SELECT pos, url, place, past, price, priority, 'close_date' AS field, day AS value, true AS grounded FROM ({_ALL}) a
    UNION ALL SELECT pos, url, place, past, price, priority, 'amount', concat('Rs. ', CAST(CAST(floor(price / 50000) * 50000 AS BIGINT) AS VARCHAR(20))), priority <> '1-URGENT' FROM ({_ALL}) b
    UNION ALL SELECT pos, url, place, past, price, priority, 'selection', lower(priority), price > 100000 FROM ({_ALL}) c UNION ALL SELECT pos, url, place, past, price, priority, 'name', name, true FROM ({_ALL}) d) f"""
_RECORDS = f"SELECT pos AS id, key, name, url AS official_url, CASE WHEN priority = '5-LOW' THEN 2 ELSE 0 END AS missing_runs FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM ({_ALL}) a WHERE past) x WHERE r = 1"
_EVIDENCE = f"SELECT id, field, value, quote, grounded, CASE WHEN priority = '2-HIGH' AND field <> 'name' THEN 'https://elsewhere.example.org' ELSE url END AS source_url, CAST(0 AS BIGINT) AS snapshot FROM ({_STATED}) f JOIN ({_RECORDS}) r ON r.id = f.pos"
_STANDS = f"SELECT DISTINCT url, quote FROM ({_STATED}) f WHERE NOT past AND grounded AND field <> 'name' OR past AND field = 'name' AND price > 150000"
_STOOD = f"SELECT DISTINCT url, quote FROM ({_STATED}) f WHERE past AND grounded"


def _everything(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every scheme, made once, and those that pages state now."""
    everything = _kept(run(spark, sf_dir, _ALL))
    return everything, everything.filter("NOT past")


def _schemes(now: DataFrame) -> DataFrame:
    return now.select("url", "pos", "name", F.lit(None).cast("string").alias("open_date"), F.lit(None).cast("string").alias("close_date"))


def _run(spark: SparkSession, sf_dir: str) -> Refresh:
    everything, now = _everything(spark, sf_dir)
    mine = _kept(run(spark, sf_dir, _RECORDS, {_ALL: everything}))
    stated = run(spark, sf_dir, _STATED, {_ALL: everything})
    evidence = _kept(run(spark, sf_dir, _EVIDENCE, {_STATED: stated, _RECORDS: mine}))
    lines = lambda sql, name: run(spark, sf_dir, sql, {_STATED: stated}).groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("quote")), "\n").alias(name))
    pages = now.select("place", "url").distinct().join(lines(_STANDS, "text"), "url", "left").join(lines(_STOOD, "before"), "url", "left").withColumn("snapshot", F.col("place"))
    return refresh(mine, evidence, _kept(pages), _schemes(now), stated.filter("NOT past").select("url", "pos", "field", "value", "quote", "grounded"))


def refresh_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's schemes are to the records: new, of this page, or known from elsewhere."""
    everything, now = _everything(spark, sf_dir)
    mine = _kept(run(spark, sf_dir, _RECORDS, {_ALL: everything}))
    pages = now.select("place", "url", F.col("place").alias("snapshot")).distinct()
    return offered(mine, pages, _schemes(now)).select("id", "place", "pos", "name", "way")


def refresh_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).records


def refresh_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).evidence


def refresh_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).log


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (refresh_offers, refresh_records, refresh_evidence, refresh_log)}


_STEPS = f"""WITH o AS MATERIALIZED ({_ALL}), f AS MATERIALIZED ({_STATED}), rec AS MATERIALIZED ({_RECORDS}), ev AS MATERIALIZED ({_EVIDENCE}), stands AS MATERIALIZED ({_STANDS}), stood AS MATERIALIZED ({_STOOD}),
  pg AS (SELECT DISTINCT url, place FROM o WHERE NOT past),
  best AS MATERIALIZED (SELECT *, min(pos) OVER (PARTITION BY url, key) AS fp FROM o WHERE NOT past QUALIFY row_number() OVER (PARTITION BY url, key ORDER BY right(name, 4) DESC, pos) = 1),
  fst AS (SELECT key, url, place, fp FROM best WHERE key NOT IN (SELECT key FROM rec) QUALIFY row_number() OVER (PARTITION BY key ORDER BY place, fp) = 1),
  who AS (SELECT key, id, official_url AS home, false AS made FROM rec UNION ALL SELECT key, (SELECT max(id) FROM rec) + row_number() OVER (ORDER BY place, fp, key), url, true FROM fst),
  off AS MATERIALIZED (SELECT w.id, b.place, b.url, b.pos, b.key, b.name, CASE WHEN b.url <> w.home THEN 'elsewhere' WHEN made THEN 'new' ELSE 'own' END AS way, made OR coalesce(p.place < b.place, false) AS later FROM best b JOIN who w USING (key) LEFT JOIN pg p ON p.url = w.home),
  told AS MATERIALIZED (SELECT off.*, f.field, f.value, f.quote, f.grounded FROM off JOIN f USING (pos)),
  g1 AS (SELECT id, field, value, quote, url, place FROM told WHERE way = 'elsewhere' AND NOT later AND grounded AND field <> 'name' AND (id, field) NOT IN (SELECT id, field FROM ev WHERE grounded) QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY place) = 1),
  e1 AS MATERIALIZED (SELECT id, field, value, quote, grounded, source_url, snapshot FROM ev WHERE (id, field) NOT IN (SELECT id, field FROM g1) UNION ALL SELECT id, field, value, quote, true, url, place FROM g1),
  cmp AS (SELECT t.id, t.field, t.url, t.place, t.value AS nv, t.quote AS nq, t.grounded AS ng, e.id IS NOT NULL AS had, e.value AS ov, e.quote AS oq, coalesce(e.grounded, false) AS og, e.source_url AS os, e.snapshot AS osnap, (t.url, e.quote) IN (SELECT url, quote FROM stands) AS still, (t.url, t.quote) IN (SELECT url, quote FROM stood) AS late
    FROM told t LEFT JOIN e1 e ON e.id = t.id AND e.field = t.field WHERE t.way = 'own' AND t.field <> 'name'),
  noted AS (SELECT *, CASE WHEN NOT og AND NOT ng THEN NULL WHEN NOT og THEN CASE WHEN late THEN 'LATE_FILL' ELSE 'newly stated on the official page' END WHEN NOT ng THEN CASE WHEN NOT still THEN 'no longer stated on the official page' END
    WHEN field = 'close_date' THEN CASE WHEN ov <> nv THEN 'date changed' END WHEN NOT still AND ov <> nv THEN 'value changed' END AS note FROM cmp),
  diff AS MATERIALIZED (SELECT *, note IS NOT NULL AND NOT (os <> url AND og AND NOT ng) AS changed FROM noted),
  e2 AS (SELECT id, field, CASE WHEN NOT changed THEN ov WHEN ng THEN nv END AS value, CASE WHEN changed THEN CASE WHEN ng THEN nq END WHEN ng AND og AND os = url AND NOT still THEN nq ELSE oq END AS quote, CASE WHEN changed THEN ng ELSE og END AS grounded,
      CASE WHEN changed THEN url ELSE os END AS source_url, CASE WHEN changed OR og AND os = url THEN place ELSE osnap END AS snapshot FROM diff WHERE changed OR had
    UNION ALL SELECT e.id, e.field, e.value, e.quote, e.grounded, e.source_url, CASE WHEN e.grounded AND e.source_url = w.url THEN w.place ELSE e.snapshot END FROM e1 e LEFT JOIN off w ON w.id = e.id AND w.way = 'own' WHERE (e.id, e.field) NOT IN (SELECT id, field FROM diff)
    UNION ALL SELECT id, field, CASE WHEN grounded THEN value END, CASE WHEN grounded THEN quote END, grounded, url, place FROM told WHERE way = 'new'),
  e2m AS MATERIALIZED (SELECT * FROM e2),
  g2 AS (SELECT id, field, value, quote, url, place FROM told WHERE way = 'elsewhere' AND later AND grounded AND field <> 'name' AND (id, field) NOT IN (SELECT id, field FROM e2m WHERE grounded) QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY place) = 1),
  seen AS (SELECT id, min(place) AS first, max(place) AS last, bool_or(way <> 'elsewhere') AS own FROM off GROUP BY id),
  state AS (SELECT r.*, p.place AS home, s.first, s.last, p.place IS NOT NULL AND NOT coalesce(s.own, false) AND NOT EXISTS (SELECT 1 FROM f n JOIN stands k ON k.url = r.official_url AND k.quote = n.quote WHERE n.pos = r.id AND n.field = 'name') AS lost FROM rec r LEFT JOIN pg p ON p.url = r.official_url LEFT JOIN seen s ON s.id = r.id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "refresh_offers": f"{_STEPS} SELECT id, place, pos, name, way FROM off",
        "refresh_records": f"""{_STEPS} SELECT id, key, name, official_url, CASE WHEN home IS NULL AND first IS NULL THEN missing_runs WHEN lost AND NOT coalesce(last > home, false) THEN CASE WHEN coalesce(first < home, false) THEN 0 ELSE missing_runs END + 1 ELSE 0 END AS missing_runs FROM state
            UNION ALL SELECT id, key, name, url, 0 FROM off WHERE way = 'new'""",
        "refresh_evidence": f"{_STEPS} SELECT id, field, value, quote, grounded, source_url, snapshot FROM e2m WHERE (id, field) NOT IN (SELECT id, field FROM g2) UNION ALL SELECT id, field, value, quote, true, url, place FROM g2",
        "refresh_log": f"{_STEPS} SELECT id, field, CASE WHEN og THEN ov END AS old_value, CASE WHEN ng THEN nv END AS new_value, url AS source_url, CASE WHEN ng THEN nq ELSE oq END AS evidence, note FROM diff WHERE changed AND note <> 'LATE_FILL'",
    }
