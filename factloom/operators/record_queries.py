"""Queries of the rules over records on synthetic tables, and their SQL.

Inputs (records, evidence, sources, texts, claims) are made from part by SQL that both engines read; the rules are the library's functions here
and cases written by themselves in the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.relational import run
from . import verification as V
from .evidence import alike_sql

AS_OF = "2026-10-02"
PROFILE = V.Profile(third_party=("listing.example.com",), government=(".gov.in", ".gov"), university=(".ac.in", ".edu"), known={"bluetrust.org": "foundation_trust"}, portals=("portal.example.com",))

_URL = """concat(CASE p_partkey % 8 WHEN 0 THEN 'https://colour.gov.in/scheme' WHEN 1 THEN 'https://lace.ac.in/news/today' WHEN 2 THEN 'https://lace.ac.in/aid' WHEN 3 THEN 'https://www.bluetrust.org/apply'
    WHEN 4 THEN 'https://a.listing.example.com/top' WHEN 5 THEN 'https://loomfoundation.example.org/home' WHEN 6 THEN 'https://weave.example.net/csr/aid' ELSE 'https://blog.example.net/x' END, '/', CAST(p_partkey AS VARCHAR(20)))"""
RECORDS = f"""SELECT p_partkey AS id, concat(p_name, ' ', p_brand) AS topic, concat(p_name, ' ', p_brand, CASE p_partkey % 7 WHEN 0 THEN ' national scholarship' WHEN 1 THEN ' scholarship 2020-21' WHEN 2 THEN ' post-matric scholarship 2026-27'
    WHEN 3 THEN ' fellowship' WHEN 4 THEN ' grants' WHEN 5 THEN ' award' ELSE ' national institute award' END) AS name, {_URL} AS official_url,
    CASE p_partkey % 6 WHEN 0 THEN '2026-09-01' WHEN 1 THEN '2026-10-02' WHEN 2 THEN '2026-10-17' WHEN 3 THEN '2026-10-18' WHEN 4 THEN 'soon' END AS close_date,
    CASE WHEN p_partkey % 4 = 0 THEN 'REVIEW_REQUIRED' ELSE 'VERIFIED' END AS verification_status, CASE WHEN p_partkey % 4 = 0 THEN 40.0 ELSE 95.0 END AS confidence, CASE p_partkey % 13 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS missing_runs FROM part"""
TEXTS = f"""SELECT {_URL} AS url, CASE p_partkey % 3 WHEN 0 THEN 'The Loom and Weave houses take applications on a rolling basis' WHEN 1 THEN 'Last date 31.10.2026' ELSE 'No more is said' END AS text, CASE WHEN p_partkey % 4 >= 2 THEN 2 ELSE 1 END AS runs FROM part"""
SOURCES = f"""SELECT {_URL} AS url, CASE WHEN p_partkey % 17 = 0 THEN 404 WHEN p_partkey % 17 = 1 THEN 410 ELSE 200 END AS http_status, CASE p_partkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS fail_count FROM part WHERE p_partkey % 23 <> 0"""
EVIDENCE = f"""SELECT id, field, value, CASE WHEN value IS NOT NULL THEN concat('It says ', value) END AS quote, official_url AS source_url, (id * 7 + k * 3) % 5 <> 0 AND (id + k) % 11 <> 0 AND value IS NOT NULL AS grounded, CASE WHEN (id + k) % 11 <> 0 THEN value END AS raw_value
    FROM (SELECT id, field, k, official_url, CASE field WHEN 'name' THEN name WHEN 'provider' THEN CASE id % 5 WHEN 0 THEN 'Ministry of Colour' WHEN 1 THEN 'Blue Trust' WHEN 2 THEN 'State University' WHEN 3 THEN 'Lace University' END
        WHEN 'application_url' THEN CASE id % 4 WHEN 0 THEN 'https://www.colour.gov.in/apply' WHEN 1 THEN 'apply.portal.example.com/x' WHEN 2 THEN 'https://elsewhere.org/a' ELSE concat(official_url, '/apply') END
        WHEN 'amount' THEN concat('Rs. ', CAST(1000 * (id % 3 + 1) AS VARCHAR(20))) WHEN 'close_date' THEN concat('2026-11-1', CAST(id % 2 AS VARCHAR(20))) WHEN 'income_limit' THEN concat(CAST(id % 2 + 2 AS VARCHAR(20)), '.5 lakh')
        WHEN 'category' THEN 'SC' WHEN 'gender' THEN 'Female' ELSE '25 years' END AS value
      FROM ({RECORDS}) r CROSS JOIN (VALUES ('name', 1), ('provider', 2), ('application_url', 3), ('amount', 4), ('close_date', 5), ('income_limit', 6), ('category', 7), ('gender', 8), ('age_limit', 9)) f(field, k)) v"""
PAIRS = f"""SELECT a.id, b.id AS other FROM ({RECORDS}) a JOIN ({RECORDS}) b ON a.topic = b.topic AND a.id <> b.id"""
_CLAIM = {
    "field": "CASE id % 12 WHEN 0 THEN 'close_date' WHEN 1 THEN 'close_date' WHEN 2 THEN 'income_limit' WHEN 3 THEN 'income_limit' WHEN 4 THEN 'income_limit' WHEN 5 THEN 'gender' WHEN 6 THEN 'gender' WHEN 7 THEN 'name' WHEN 8 THEN 'amount' WHEN 9 THEN 'age_limit' WHEN 10 THEN 'application_url' ELSE 'close_date' END",
    "value": "CASE id % 12 WHEN 0 THEN '2026-10-31' WHEN 1 THEN '2026-11-30' WHEN 2 THEN 'Rs. 2,50,000 per annum' WHEN 3 THEN 'Rs. 5,00,000 per annum' WHEN 4 THEN 'Rs. 2,50,000' WHEN 5 THEN 'Female' WHEN 6 THEN 'Male' WHEN 7 THEN 'Post Matric Scholarship for SC Students' WHEN 8 THEN 'Rs. 10,000' WHEN 10 THEN 'https://scholarships.gov.in' WHEN 11 THEN 'open throughout the year' END",
    "quote": "CASE WHEN id % 12 IN (0, 1) THEN 'Last date of application: 31.10.2026' WHEN id % 12 IN (2, 3) THEN 'Parental income should not exceed Rs. 2,50,000 per annum' WHEN id % 12 = 4 THEN 'Family income must be below Rs 2.5 lakh' WHEN id % 12 IN (5, 6, 11) THEN 'Only girl students are eligible.' WHEN id % 12 = 7 THEN 'Post Matric Scholarship for Scheduled Caste Students' END",
    "page": "concat('Post Matric Scholarship for Scheduled Caste Students 2026-27. Of ', topic, '. Parental income should not exceed Rs. 2,50,000 per annum. Last date of application: 31.10.2026. Only girl students are eligible. Apply online at scholarships.gov.in')",
}
CLAIMS = f"SELECT id, {', '.join(f'{sql} AS {name}' for name, sql in _CLAIM.items())} FROM ({RECORDS}) r"
# Ten ways in which a field can change or not, for fields of three kinds.
_OLD, _NEW = ("CASE field WHEN 'close_date' THEN '2026-10-31' WHEN 'amount' THEN 'Rs. 1,000 per year' ELSE 'marks card and letter' END", "CASE field WHEN 'close_date' THEN '2026-11-30' WHEN 'amount' THEN 'Rs. 2,000 per year' ELSE 'passport photo only' END")
CHANGES = f"""SELECT id, field, c, CASE WHEN c NOT IN (0, 1, 2) THEN {_OLD} END AS old_value, CASE WHEN c NOT IN (0, 3, 4, 8) THEN CASE WHEN c = 9 THEN {_OLD} WHEN c = 7 THEN CASE field WHEN 'close_date' THEN '2026-10-31' WHEN 'amount' THEN '1000 rupees a year' ELSE 'letter and marks card' END ELSE {_NEW} END END AS new_value,
    CASE WHEN c IN (3, 5) THEN 'Here are the old words of the page.' WHEN c IN (0, 4, 6, 7, 8, 9) THEN 'Entirely different text, 123.' ELSE 'Now there are newer words on it.' END AS text, CASE WHEN c = 1 THEN 'It had the newer words before.' WHEN c = 2 THEN 'Entirely different text, 123.' END AS before, official_url AS url, CASE WHEN c = 8 THEN 'https://other.example.org' ELSE official_url END AS old_url
    FROM (SELECT id, field, official_url, (id + k) % 10 AS c FROM ({RECORDS}) r CROSS JOIN (VALUES ('close_date', 0), ('amount', 1), ('documents', 2)) f(field, k)) x"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    records, evidence, sources, texts = (run(spark, sf_dir, q) for q in (RECORDS, EVIDENCE, SOURCES, TEXTS))
    told = sources.join(texts.select("url", "text"), "url").withColumn("source_type", V.classify(F.col("url"), F.col("text"), PROFILE)["kind"])
    return records, evidence, told, texts


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, evidence, sources, _ = _records(spark, sf_dir)
    return V.facts(records, evidence, sources)


def classify_records(spark, sf_dir):
    """Kind of each record's page, all six rules."""
    told = run(spark, sf_dir, TEXTS).select("url", V.classify(F.col("url"), F.col("text"), PROFILE).alias("c"))
    return told.select("url", "c.kind", "c.official", F.regexp_replace("c.reason", r"^\S+ ", "").alias("reason"))


def provider_owns(spark, sf_dir):
    records, evidence, sources, _ = _records(spark, sf_dir)
    return V.facts(records, evidence, sources).select("id", "own.owns", F.col("own.reason").alias("reason"))


def twin_agreement(spark, sf_dir):
    """Do twins agree on their deadlines, amounts and limits."""
    told = V.agreement_by(_known(spark, sf_dir), "topic")
    return told.select("id", "other", "agrees", F.array_join("clash", ",").alias("clash"), "conflict")


def twin_groups(spark, sf_dir):
    """Twins by alike names, as groups of equal values: the first records of each pair of groups and how many the other one has."""
    return V.twin_groups(_known(spark, sf_dir)).select("id", "other", "n", "agrees", F.array_join("clash", ",").alias("clash"), "conflict")


def confidence_score(spark, sf_dir):
    """All eleven checks of every record."""
    records, evidence, sources, texts = _records(spark, sf_dir)
    told = V.score(records, evidence, sources, texts, PROFILE, F.lit(AS_OF).cast("date"))
    points = F.array_join(F.transform("points", lambda c: F.concat(c["check"], F.lit("="), c["points"].cast("string"))), ";")
    return told.select("id", "confidence", "verification_status", "owns_source", "official_twin", points.alias("points"))


def verification_counts(spark, sf_dir):
    return confidence_score(spark, sf_dir).groupBy("verification_status").agg(F.count(F.lit(1)).alias("n"))


def ground_field(spark, sf_dir):
    """Claims of every kind of field, grounded in a page."""
    claims = V.spread(run(spark, sf_dir, CLAIMS))
    quotes = F.when(F.col("quote").isNotNull(), F.array("quote"))
    told = claims.select("id", V.ground_field(F.col("field"), F.col("value"), quotes, F.col("page"), F.array().cast("array<string>")).alias("g"))
    return told.select("id", "g.value", "g.grounded", "g.reason", "g.raw_value")


def field_changes(spark, sf_dir):
    """Evidence of two runs compared field by field: every rule of a change."""
    x = run(spark, sf_dir, CHANGES)

    def side(value: str, quote: str, url: str) -> DataFrame:
        return x.filter(f"{value} is not null").select("id", "field", F.col(value).alias("value"), F.lit(quote).alias("quote"), F.lit(True).alias("grounded"), F.col(url).alias("source_url"))

    old, new = side("old_value", "the old words of the page", "old_url"), side("new_value", "the newer words", "url")
    pages = x.select("id", "field", "url", "text", "before")
    # A page of its own for each field, so that every case has the page that it needs.
    key = F.concat_ws("/", "id", "field")
    told = V.apply_changes(old.withColumn("id", key), new.withColumn("id", key), pages.withColumn("id", key).drop("field"))
    return told.select("id", "note", "logged", "old_value", "new_value", "evidence", "kept")


def lifecycle_status(spark, sf_dir):
    """Status and reason of every record."""
    joined = run(spark, sf_dir, RECORDS).join(run(spark, sf_dir, SOURCES).withColumnRenamed("url", "official_url"), "official_url", "left")
    told = joined.select("id", V.status(F.lit(AS_OF).cast("date")).alias("s"))
    return told.select("id", "s.status", "s.reason")


_FUNCTIONS = (classify_records, provider_owns, twin_agreement, twin_groups, confidence_score, verification_counts, ground_field, field_changes, lifecycle_status)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _FUNCTIONS}


_KIND = """CASE WHEN u % 8 = 0 THEN 'government' WHEN u % 8 IN (1, 2) THEN 'university' WHEN u % 8 = 3 THEN 'foundation_trust' WHEN u % 8 = 4 THEN 'aggregator' WHEN u % 8 = 5 AND u % 3 = 0 THEN 'foundation_trust' WHEN u % 8 = 6 AND u % 3 = 0 THEN 'corporate_csr' ELSE 'unknown' END"""
# own: rules by the case numbers from which records are made.
_FACTS = f"""WITH r AS ({RECORDS}), e AS ({EVIDENCE}),
  g AS (SELECT id, max(value) FILTER (grounded AND field = 'provider') AS provider, max(value) FILTER (grounded AND field = 'amount') AS amount, max(value) FILTER (grounded AND field = 'close_date') AS close_date, max(value) FILTER (grounded AND field = 'income_limit') AS income_limit,
    max(value) FILTER (grounded AND field = 'application_url') AS app, max(value) FILTER (grounded AND field = 'name') AS gname, count(raw_value) AS claimed, count(*) FILTER (grounded) AS traced, count(*) FILTER (grounded AND field IN ('income_limit', 'category', 'gender', 'age_limit')) AS eligible FROM e GROUP BY id),
  k AS (SELECT r.id, r.topic, r.name, r.official_url, g.* EXCLUDE (id), r.id AS u, CASE WHEN r.id % 23 = 0 THEN 'unknown' ELSE {_KIND.replace("u %", "r.id %")} END AS kind, regexp_extract(r.official_url, '://(?:www\\.)?([^/]+)', 1) AS host,
    CASE g.provider WHEN 'Ministry of Colour' THEN 'government' WHEN 'Blue Trust' THEN 'foundation_trust' WHEN 'State University' THEN 'government' WHEN 'Lace University' THEN 'university' END AS ptype, r.id % 7 IN (0, 2) AS gov FROM r JOIN g USING (id)),
  o AS (SELECT *, CASE WHEN kind IN ('unknown', 'aggregator') THEN 1 WHEN gov AND kind <> 'government' THEN 2 WHEN id % 8 = 1 AND provider IS DISTINCT FROM 'Lace University' THEN 3 WHEN ptype IS NULL AND NOT gov THEN 4
      WHEN kind = coalesce(ptype, 'government') AND kind IN ('government', 'university') THEN 5 WHEN id % 8 = 3 AND provider = 'Blue Trust' THEN 5 ELSE 6 END AS rule FROM k),
  own AS (SELECT *, rule IN (4, 5) AS owns FROM o)"""
_SAME = """CASE WHEN a.close_date IS NULL OR b.close_date IS NULL THEN NULL ELSE a.close_date = b.close_date END AS s1,
    CASE WHEN a.amount IS NULL OR b.amount IS NULL THEN NULL ELSE a.amount = b.amount END AS s2, CASE WHEN a.income_limit IS NULL OR b.income_limit IS NULL THEN NULL ELSE a.income_limit = b.income_limit END AS s3"""
_TWINS = f"""{_FACTS}, pairs AS ({PAIRS}), p AS (SELECT pairs.id, pairs.other, a.owns AS owns_a, b.owns AS owns_b, {_SAME} FROM pairs JOIN own a ON a.id = pairs.id JOIN own b ON b.id = pairs.other),
  tw AS (SELECT *, concat_ws(',', CASE WHEN NOT s1 THEN 'close_date' END, CASE WHEN NOT s2 THEN 'amount' END, CASE WHEN NOT s3 THEN 'income_limit' END) AS clash FROM p)"""
_KEY = """array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(name), '(^|[^a-z0-9_])(19|20)[0-9]{2}(\\s*-\\s*[0-9]{2,4})?($|[^a-z0-9_])', '\\1 \\4', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ')"""
_CLASH = "concat_ws(',', CASE WHEN a.close_date <> b.close_date THEN 'close_date' END, CASE WHEN a.amount <> b.amount THEN 'amount' END, CASE WHEN a.income_limit <> b.income_limit THEN 'income_limit' END)"
# Groups of equal values and keys, and pairs of groups; every group is paired with itself.
_GROUPS = f"""{_FACTS.replace("WITH r AS", "WITH RECURSIVE r AS", 1)}, keyed AS MATERIALIZED (SELECT id, {_KEY} AS key, close_date, amount, income_limit, coalesce(owns, false) AS owns FROM own), {alike_sql("SELECT key FROM keyed", 90)},
  near AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike UNION ALL SELECT key, key FROM ks),
  gs AS MATERIALIZED (SELECT key, close_date, amount, income_limit, owns, count(*) AS n, min(id) AS id, list_sort(list(id))[2] AS second FROM keyed GROUP BY key, close_date, amount, income_limit, owns),
  gp AS MATERIALIZED (SELECT a.id, b.id AS other, b.n, b.second, b.owns AS owns_other, a.owns AS owns_id, {_CLASH} AS clash FROM gs a JOIN near ON near.a = a.key JOIN gs b ON b.key = near.b)"""
_SCORE = f"""{_GROUPS}, gt AS (SELECT id AS g, sum(n - CASE WHEN id = other THEN 1 ELSE 0 END) FILTER (clash = '') AS agree, coalesce(sum(n) FILTER (clash <> '' AND owns_id AND owns_other), 0) AS conflicts, min(other) FILTER (owns_other AND other <> id) AS official FROM gp GROUP BY id),
  t AS (SELECT k.id, gt.agree, gt.conflicts, least(gt.official, CASE WHEN gs.owns THEN CASE WHEN gs.id = k.id THEN gs.second ELSE gs.id END END) AS official_twin
    FROM keyed k JOIN gs ON gs.key = k.key AND gs.close_date IS NOT DISTINCT FROM k.close_date AND gs.amount IS NOT DISTINCT FROM k.amount AND gs.income_limit IS NOT DISTINCT FROM k.income_limit AND gs.owns = k.owns JOIN gt ON gt.g = gs.id),
  c AS (SELECT own.*, coalesce(t.agree, 0) AS agree, coalesce(t.conflicts, 0) AS conflicts, t.official_twin FROM own LEFT JOIN t USING (id)),
  pts AS (SELECT *, CASE WHEN owns THEN 25.0 ELSE 0.0 END AS p1, CASE WHEN gname IS NOT NULL AND id % 23 <> 0 AND id % 9 NOT IN (0, 1) THEN 15.0 ELSE 0.0 END AS p2,
      CASE WHEN app IS NULL THEN 0.0 WHEN id % 8 = 0 OR id % 4 IN (1, 3) THEN 10.0 ELSE 5.0 END AS p3, 5.0 * least(eligible, 3) AS p4, CASE WHEN close_date IS NOT NULL OR id % 3 = 0 THEN 10.0 ELSE 0.0 END AS p5,
      CASE WHEN amount IS NOT NULL THEN 5.0 ELSE 0.0 END AS p6, CASE WHEN id % 7 = 1 THEN 0.0 WHEN close_date IS NOT NULL OR (gname IS NOT NULL AND id % 7 = 2) THEN 10.0 WHEN id % 3 = 1 THEN 5.0 ELSE 0.0 END AS p7,
      CASE WHEN agree > 0 OR id % 4 >= 2 THEN 5.0 ELSE 0.0 END AS p8, CASE WHEN claimed > 0 THEN round(CAST(5 * traced AS DOUBLE) / claimed, 2) ELSE 0.0 END AS p9 FROM c),
  f AS (SELECT *, round(greatest(0.0, least(100.0, CAST(p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 AS DOUBLE) + CAST(p9 AS DOUBLE) - CASE WHEN conflicts > 0 THEN 15.0 ELSE 0.0 END - CASE WHEN owns THEN 0.0 ELSE 30.0 END)), 1) AS confidence FROM pts)"""
_D = "CAST({} AS DOUBLE)"
_POINTS = "concat_ws(';', " + ", ".join(f"concat('{k}=', {_D.format(f'p{i}')})" for i, k in enumerate(V.POINTS, 1)) + ", CASE WHEN conflicts > 0 THEN 'conflicting_official_source=-15.0' END, CASE WHEN NOT owns THEN 'aggregator_only=-30.0' END)"
_NOTE = """CASE WHEN c = 1 THEN 'LATE_FILL' WHEN c = 2 THEN 'newly stated on the official page' WHEN c = 4 THEN 'no longer stated on the official page' WHEN c IN (5, 6) AND field = 'close_date' THEN 'date changed' WHEN c = 6 THEN 'value changed' END"""


def oracle_sql() -> dict[str, str]:
    return {
        "classify_records": f"""SELECT url, kind, kind NOT IN ('aggregator', 'unknown') AS official, CASE WHEN u % 8 = 0 THEN 'is a government domain' WHEN u % 8 IN (1, 2) THEN 'is an academic domain' WHEN u % 8 = 3 THEN 'is a known provider domain' WHEN u % 8 = 4 THEN 'is a known aggregator/news/social site'
            WHEN kind = 'foundation_trust' THEN 'is a foundation/trust site that names itself' WHEN kind = 'corporate_csr' THEN 'hosts a CSR section and names itself' ELSE 'could not be confirmed as an official provider' END AS reason
            FROM (SELECT url, u, {_KIND} AS kind FROM (SELECT {_URL} AS url, p_partkey AS u FROM part) a) b""",
        "provider_owns": f"""{_FACTS} SELECT id, owns, CASE rule WHEN 1 THEN concat(host, ' is a ', kind, ' site, not an official provider') WHEN 2 THEN concat('scheme name marks a government scheme; ', host, ' (', kind, ') only relays it - third-party page')
            WHEN 3 THEN concat(host, ' page is a blog/news/list article about the scheme, not its provider - third-party page') WHEN 4 THEN concat('provider not named separately; scheme is published on official ', kind, ' site ', host)
            WHEN 5 THEN concat('provider ''', said, ''' (', coalesce(ptype, 'government'), ') runs the ', kind, ' site ', host) ELSE concat('provider ''', said, ''' (', coalesce(ptype, 'government'), ') does not own ', host, ' (', kind, ') - third-party page') END AS reason
            FROM (SELECT *, coalesce(provider, '(inferred from scheme name) government') AS said FROM own) z""",
        "twin_agreement": f"{_TWINS} SELECT id, other, clash = '' AS agrees, clash, owns_a AND owns_b AND clash <> '' AS conflict FROM tw",
        "twin_groups": f"{_GROUPS} SELECT id, other, n, clash = '' AS agrees, clash, owns_id AND owns_other AND clash <> '' AS conflict FROM gp",
        "confidence_score": f"{_SCORE} SELECT id, confidence, CASE WHEN confidence >= 95 THEN 'VERIFIED' ELSE 'REVIEW_REQUIRED' END AS verification_status, owns AS owns_source, official_twin, {_POINTS} AS points FROM f",
        "verification_counts": f"{_SCORE} SELECT CASE WHEN confidence >= 95 THEN 'VERIFIED' ELSE 'REVIEW_REQUIRED' END AS verification_status, count(*) AS n FROM f GROUP BY 1",
        "ground_field": f"""SELECT id, CASE WHEN ok THEN value END AS value, ok AS grounded, CASE id % 12 WHEN 0 THEN 'date found in quote' WHEN 1 THEN 'quote found but date not present in quote' WHEN 2 THEN '100% of value words in quote' WHEN 3 THEN 'quote found but value contains a number not in the quote' WHEN 4 THEN 'quote not found on page (match 54)'
            WHEN 5 THEN 'gender term for ''female'' in quote' WHEN 6 THEN 'quote found but gender not stated in quote' WHEN 7 THEN 'name match 87' WHEN 8 THEN 'no evidence quote given -> rejected' WHEN 9 THEN 'not stated on page' WHEN 10 THEN 'URL found on page' ELSE 'quote found but value is not an ISO date and not in quote' END AS reason, value AS raw_value
            FROM (SELECT id, value, id % 12 IN (0, 2, 5, 7, 10) AS ok FROM ({CLAIMS}) c) z""",
        "field_changes": f"""SELECT concat(id, '/', field) AS id, {_NOTE} AS note, c IN (2, 4, 6) OR (c = 5 AND field = 'close_date') AS logged, old_value, new_value, CASE WHEN new_value IS NOT NULL THEN 'the newer words' ELSE 'the old words of the page' END AS evidence,
            CASE WHEN {_NOTE} IS NOT NULL THEN new_value ELSE old_value END AS kept FROM ({CHANGES}) x WHERE c <> 0""",
        "lifecycle_status": f"""SELECT id, status, CASE WHEN status = 'ACTIVE' THEN concat('verified', CASE WHEN close_date IS NULL OR close_date = 'soon' THEN ', no closing date stated' ELSE ', open until ' || close_date END) WHEN status = 'EXPIRING_SOON' THEN concat('closes on ', close_date, ' (within 15 days)')
              WHEN status = 'REVIEW_REQUIRED' THEN 'confidence 40.0 is below 95.0' WHEN status = 'EXPIRED' THEN concat('closing date ', close_date, ' has passed') WHEN http IN (404, 410) THEN concat('official page returned HTTP ', http) WHEN fails >= 2 THEN 'official page failed to load in 2 consecutive runs' ELSE 'scheme not found on its official page in 2 consecutive runs' END AS reason
            FROM (SELECT r.id, r.close_date, s.http_status AS http, s.fail_count AS fails, CASE WHEN s.http_status <> 200 OR s.fail_count = 2 OR r.missing_runs = 2 THEN 'NO_LONGER_VERIFIABLE' WHEN r.id % 6 = 0 THEN 'EXPIRED' WHEN r.id % 4 = 0 THEN 'REVIEW_REQUIRED' WHEN r.id % 6 IN (1, 2) THEN 'EXPIRING_SOON' ELSE 'ACTIVE' END AS status
              FROM ({RECORDS}) r LEFT JOIN ({SOURCES}) s ON s.url = r.official_url) z""",
    }
