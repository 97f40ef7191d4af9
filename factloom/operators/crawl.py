"""The whole frontier: a breadth-first crawl of pages at hand as an iterative join with state carried from level to level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources import files
from . import evidence as E
from . import records as O
from . import verification as V
from .ordering import placed

#: What fits the synthetic pages.
PROFILE = V.Profile(third_party=tuple(E.PROFILE["aggregator"]), government=tuple(E.PROFILE["government"]), university=tuple(E.PROFILE["university"]), known={}, portals=())


@dataclass(frozen=True)
class Rules:
    """Limits of a crawl and the patterns of what is sought."""

    profile: V.Profile
    keywords: str
    details: str
    concrete: str
    depth: int = 2
    budget: int = 250
    per_page: int = 25


_kept = files.kept


def read_pages(pages: DataFrame, rules: Rules) -> DataFrame:
    """One row per address of pages (url, html): url in normal form, hash, kind, official, relevant, links (pos, href, fit, void).

    Of rows with one address the one with the least html stays.  A link fits if it stays on the page's host and looks relevant;
    void ones, on non-production hosts, take a place among a page's links but are never visited.
    """
    x = pages.select(T.normalize_url(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).groupBy("url").agg(F.min("html").alias("html"))
    x = x.withColumn("text", T.html_lines(F.col("html")))
    told, gate = V.classify(F.col("url"), F.col("text"), rules.profile), O.relevance(F.col("text"), rules.keywords, rules.details, rules.concrete)
    here = T.domain(F.col("url"))
    fit = F.filter(R.link_parts(F.col("html"), F.col("url")), lambda link: (T.domain(link["href"]) == here) & R.link_looks_relevant(link["href"], link["anchor"], rules.keywords))
    links = F.transform(fit, lambda link: F.struct(link["pos"].alias("pos"), link["href"].alias("href"), T.domain(link["href"]).rlike(R.TEST_HOSTS).alias("void")))
    return x.select("url", F.sha2("text", 256).alias("hash"), told["kind"].alias("kind"), told["official"].alias("official"), gate["relevant"].alias("relevant"), links.alias("links"))


def accepted(links: DataFrame, per_page: int) -> DataFrame:
    """(place, pos, href) that pages in the order of place take of links (place, pos, href, void): each its first per_page that no page before it took.

    A page is settled once none of those is in the list of an unsettled page before it; all pages that can be are settled in one round, at
    least the first of those that share a link.  Void links count but are taken by nobody.
    """
    spark = links.sparkSession
    left = links.groupBy("place", "href").agg(F.min("pos").alias("pos"), F.first("void").alias("void"))
    done: DataFrame | None = None
    while True:
        left = _kept(left)
        if left.isEmpty():
            return done if done is not None else spark.createDataFrame([], "place long, pos long, href string")
        first = left.filter("NOT void").groupBy("href").agg(F.min("place").alias("first"))
        order = F.row_number().over(Window.partitionBy("place").orderBy("pos", "href"))
        top = left.withColumn("r", order).filter(F.col("r") <= per_page).join(first, "href", "left")
        free = top.groupBy("place").agg(F.max(F.coalesce(F.col("first") < F.col("place"), F.lit(False))).alias("waits")).filter("NOT waits").select("place")
        free = _kept(free)
        took = _kept(top.join(free, "place").filter("NOT void").select("place", "pos", "href"))
        done = took if done is None else done.unionByName(took)
        left = left.join(free, "place", "left_anti").join(took.select("href"), "href", "left_anti")


def crawl(seeds: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """(place, url, level, via, state, kind, official, relevant, duplicate_of): the addresses visited, in their order.

    seeds: (pos, url); pages: (url, html), what an address gives; others fail.  As with a queue: seeds by pos, then the links of each page
    in turn, every address once; budget addresses at most; a page whose text an earlier one has is a duplicate; official pages, and any
    seed, give their first per_page new links unless they are listings or as deep as allowed.  Each level costs joins and aggregations, and its state is tables.
    """
    spark = pages.sparkSession
    lean = _kept(read_pages(pages, rules))
    wanted = ~F.col("url").rlike(R.SKIPPED_FILES) & ~T.domain(F.col("url")).rlike(R.TEST_HOSTS)
    level = seeds.select(T.normalize_url(F.col("url")).alias("url"), "pos").filter(wanted).groupBy("url").agg(F.min("pos").alias("pos"))
    level = level.select("url", F.lit(0).cast("long").alias("before"), "pos", F.lit(None).cast("string").alias("via"))
    seen, hashes, out, start = None, None, None, 0
    for d in range(rules.depth + 1):
        level = _kept(placed(level, [F.col("before"), F.col("pos"), F.col("url")], "r"))
        n = level.count()
        if not n or start >= rules.budget:
            break
        seen = level.select("url") if seen is None else seen.unionByName(level.select("url"))
        now = level.withColumn("place", F.col("r") + start).filter(F.col("place") < rules.budget).select("place", "url", "via").join(lean, "url", "left")
        mine = now.filter("hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct("place", "url")).alias("first"))
        known = mine if hashes is None else mine.join(hashes.withColumnRenamed("first", "old"), "hash", "left").select("hash", F.coalesce("old", "first").alias("first"))
        now = now.join(known, "hash", "left")
        state = F.when(F.col("hash").isNull(), "failed").when(F.col("first.place") != F.col("place"), "duplicate").when(F.col("kind") == "aggregator", "listing").when(F.col("relevant") & F.col("official"), "kept").otherwise("seen")
        now = _kept(now.withColumns({"state": state, "level": F.lit(d), "duplicate_of": F.when(F.col("first.place") != F.col("place"), F.col("first.url"))}))
        shown = now.select("place", "url", "level", "via", "state", "kind", "official", "relevant", "duplicate_of")
        out = shown if out is None else out.unionByName(shown)
        fresh = now.filter("state IN ('listing', 'kept', 'seen')").select("hash", F.struct("place", "url").alias("first"))
        hashes = fresh if hashes is None else hashes.unionByName(fresh)
        start += n
        if d == rules.depth or start >= rules.budget:
            break
        follow = now.filter((F.col("official") | F.lit(d == 0)) & F.col("state").isin("kept", "seen"))
        links = follow.select("place", F.explode("links").alias("link")).select("place", "link.pos", "link.href", "link.void")
        new = links.join(seen.select(F.col("url").alias("href")).distinct(), "href", "left_anti")
        took = accepted(new, rules.per_page)
        level = took.join(now.select("place", F.col("url").alias("via")), "place").select(F.col("href").alias("url"), F.col("place").alias("before"), "pos", "via")
    if out is None:
        return spark.createDataFrame([], "place long, url string, level int, via string, state string, kind string, official boolean, relevant boolean, duplicate_of string")
    return out


def frontier_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of all pages in the order of their ids and of what their html links to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = Rules(PROFILE, O.KEYWORDS, "(?i)that|with|from", "[a-z]", depth=2, budget=100_000_000, per_page=O.PER_PAGE)
    return crawl(pages.select(F.col("page_id").alias("pos"), "url"), pages, rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"frontier_whole": frontier_whole}


# The links of the given pages lead to no other page and are fewer than a page may give, so a crawl has two levels.
_WHOLE = f"""WITH p AS (SELECT page_id, {O._NORMAL} AS url, html FROM (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS h FROM pages) a),
  u AS (SELECT url, min(page_id) AS pos, arg_min(page_id, html) AS page_id, min(html) AS html FROM p GROUP BY url),
  t AS MATERIALIZED (SELECT *, {E._HOST} AS h FROM ({E.page_text_sql("SELECT * FROM u")}) b),
  g AS (SELECT *, {O._PROSE.replace("split(t,", "split(text,")} AS prose FROM t),
  j AS (SELECT url, page_id, h, text, row_number() OVER (ORDER BY pos) - 1 AS place, CASE WHEN {E._KIND.split("CASE WHEN ", 1)[1].split(" WHEN contains", 1)[0]} ELSE 'unknown' END AS kind,
    len(regexp_extract_all(text, '(?i)the|and')) >= 2 AND regexp_matches(prose, '(?i)the|and') AND len(list_distinct(list_transform(regexp_extract_all(prose, '(?i)that|with|from'), lambda x: lower(x)))) >= 2 AND regexp_matches(text, '[a-z]') AS relevant FROM g),
  f AS (SELECT *, first_value(place) OVER w AS first, first_value(url) OVER w AS twin, kind IN ('government', 'university') AS official FROM j WINDOW w AS (PARTITION BY text ORDER BY place)),
  s AS MATERIALIZED (SELECT *, CASE WHEN first <> place THEN 'duplicate' WHEN kind = 'aggregator' THEN 'listing' WHEN relevant AND official THEN 'kept' ELSE 'seen' END AS state FROM f),
  l AS (SELECT s.place, s.url AS via, l.pos, l.href FROM s JOIN {O._LINKS} l ON l.page_id = s.page_id WHERE s.state IN ('kept', 'seen') AND {O._RELEVANT} AND {O._HOST.format("l.href")} = s.h AND l.href NOT IN (SELECT url FROM s)),
  o AS (SELECT DISTINCT ON (href) href, place, via, pos FROM l ORDER BY href, place, pos)
  SELECT place, url, 0 AS level, NULL AS via, state, kind, official, relevant, CASE WHEN first <> place THEN twin END AS duplicate_of FROM s
  UNION ALL SELECT (SELECT count(*) FROM s) + row_number() OVER (ORDER BY place, pos) - 1, href, 1, via, 'failed', NULL, NULL, NULL, NULL FROM o"""


def oracle_sql() -> dict[str, str]:
    return {"frontier_whole": _WHOLE}
