"""Operators over records, links and claims, and their queries on the synthetic tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import rules as R
from ..functions import text as T
from .evidence import _HOST as _PAGE_HOST
from .evidence import _KIND, PROFILE, classify

#: Keywords, limits and dates that fit the synthetic tables.
KEYWORDS, CONTEXT_CHARS, PER_PAGE, AS_OF = "(?i)the|and", 2000, 25, "1998-06-30"
#: Quotes that are looked up together in one reading of a text.
QUOTE_GROUP = 256
#: Letters of texts that meet a group of quotes together.
BUNDLE = 1 << 18
#: Letters by which a quote of few words is looked up; bytes of quotes up to which they are broadcast.
RUN_LETTERS, LIGHT = 6, 32 << 20


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(pages: DataFrame) -> DataFrame:
    """One row per link of pages (page_id, url, html): page_id, url, pos, href, anchor."""
    return pages.select("page_id", "url", F.inline(R.link_parts(F.col("html"), F.col("url"))))


def frontier(found: DataFrame, seen: DataFrame, keywords: str, per_page: int) -> DataFrame:
    """The next addresses to visit: relevant links on production hosts, the first per_page of each page, each address once, none of seen (url)."""
    fit = found.filter(R.link_looks_relevant(F.col("href"), F.col("anchor"), keywords) & ~T.domain(F.col("href")).rlike(R.TEST_HOSTS))
    new = fit.join(seen.select(T.normalize_url(F.col("url")).alias("href")).distinct(), "href", "left_anti")
    once = new.groupBy("href").agg(F.min(F.struct("page_id", "pos")).alias("at")).select("href", "at.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return once.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= per_page)


def context(docs: DataFrame, keywords: str, most: int, ahead: int = 24, behind: int = 8) -> DataFrame:
    """doc_id and text: whole texts of most characters at most; of others the lines around keyword lines, up to the first that does not fit."""
    lines = docs.filter(F.length("text") > most).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    near = lines.withColumn("near", F.max(F.col("line").rlike(keywords)).over(order.rowsBetween(-ahead, behind))).filter("near")
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.max(before + F.length("line") > most).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = near.withColumn("over", over).filter(~F.col("over")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))
    whole = docs.select("doc_id", F.length("text").alias("n"), "text")
    short = whole.filter(f"n <= {most} or n is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return short.union(whole.filter(f"n > {most}").select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def relevance(text: Column, keywords: str, details: str, concrete: str) -> Column:
    """(relevant, hits, kinds): at least two keywords, one of them in prose, two kinds of details in prose and a concrete value."""
    prose = F.array_join(F.filter(F.split(text, "\n"), lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) >= 6), "\n")
    hits = F.regexp_count(text, F.lit(keywords))
    kinds = F.size(F.array_distinct(F.transform(F.regexp_extract_all(prose, F.lit(details), F.lit(0)), F.lower)))
    ok = (hits >= 2) & (F.regexp_count(prose, F.lit(keywords)) >= 1) & (kinds >= 2) & text.rlike(concrete)
    return F.struct(ok.alias("relevant"), hits.cast("long").alias("hits"), kinds.cast("long").alias("kinds"))


def best_match(names: DataFrame, offers: DataFrame, floor: float = 80.0) -> DataFrame:
    """For each of names (id, name) its best of offers (id, pos, offer): set ratio of name keys, 85 at least if a distinctive token is in the offer.

    Ties go to the first offer; names without one that reaches floor are left out.  Each distinct pair of texts is scored once.
    """
    pairs = names.join(offers, "id")
    texts = pairs.select("name", "offer").distinct()
    named = F.exists(R.distinctive_tokens(F.col("name")), lambda t: F.contains(F.lower("offer"), t))
    score = fuzzy.token_set(T.name_key(F.col("name")), T.name_key(F.col("offer")))
    scored = texts.withColumn("score", score).withColumn("score", F.when(named, F.greatest("score", F.lit(85.0))).otherwise(F.col("score")))
    best = pairs.join(scored, ["name", "offer"]).groupBy("id").agg(F.max(F.struct("score", -F.col("pos"), "offer")).alias("b"))
    return best.filter(F.col("b.score") >= floor).select("id", "b.offer", "b.score")


def html_links(spark, sf_dir):
    return links(_t(spark, sf_dir, "pages")).select("page_id", "pos", "href", "anchor")


def link_filter(spark, sf_dir):
    found = links(_t(spark, sf_dir, "pages"))
    return found.select("page_id", "pos", R.link_looks_relevant(F.col("href"), F.col("anchor"), KEYWORDS).alias("relevant"), T.domain(F.col("href")).rlike(R.TEST_HOSTS).alias("non_production"))


def frontier_step(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return frontier(links(pages), pages, KEYWORDS, PER_PAGE)


def context_window(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return context(docs, "(?i)license", CONTEXT_CHARS).select("doc_id", F.sha2("text", 256).alias("sha"))


def relevance_gate(spark, sf_dir):
    told = relevance(F.coalesce("text", F.lit("")), "(?i)the|and", "(?i)license|token|that", "[0-9]{2}")
    return _t(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(told)))


def extract_names(spark, sf_dir):
    said = F.concat(F.lit("here is "), F.initcap("p_name"), F.lit(" National Fellowship Scheme, or Which Is The Scholarship"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(R.names_in(said), ";").alias("names"))


def distinctive_tokens(spark, sf_dir):
    name = F.concat("p_name", F.lit(" Scholarship Scheme ("), F.substring("p_type", 1, 3), F.lit(") html"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(R.distinctive_tokens(name), ",").alias("tokens"))


def dedup_key(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.dedup_key(F.concat("p_name", F.lit(" 2024-25 ("), "p_brand", F.lit(")")), F.lit("https://www.Example.org/a")).alias("key"))


_ENDINGS = ["Trust", "State University", "University", "Ministry", "Bank", "Shop"]


def provider_type(spark, sf_dir):
    name = F.concat("s_name", F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in _ENDINGS]), (F.col("s_suppkey") % 6 + 1).cast("int")))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", R.provider_type(name).alias("kind"))


def name_filter(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " grants").when(F.col("p_partkey") % 3 == 1, " scheme").otherwise(" course"))
    return _t(spark, sf_dir, "part").select("p_partkey", R.is_funding(name, F.col("p_partkey") % 2 == 0).alias("funding"))


def numbers_supported(spark, sf_dir):
    value, quote = F.concat(F.lit("Rs. "), F.col("l_linenumber").cast("string")), F.concat_ws(" and ", F.lit("3"), F.lit("4,0"), F.lit("5.0"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.numbers_supported(value, quote).alias("supported"))


def quotes_in_texts(quotes: DataFrame, docs: DataFrame, floor: float = R.QUOTE_FLOOR) -> DataFrame:
    """item_id, doc_id and score for all of quotes (item_id, text) and docs (doc_id, text) whose quote reaches floor somewhere in the whole text.

    Quotes go in groups of QUOTE_GROUP and meet bundles of texts of BUNDLE letters or so, so that a group is moved once for a bundle and indexed
    once, and each text is read once for a group.
    """
    groups = max(1, -(-quotes.count() // QUOTE_GROUP))
    asked = quotes.select("item_id", T.norm(F.col("text")).alias("q"), (F.monotonically_increasing_id() % groups).alias("group"))
    asked = asked.groupBy("group").agg(F.collect_list(F.struct("item_id", "q")).alias("asks")).select("asks")
    light = (quotes.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) <= LIGHT
    spread = docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)  # aligning costs far more than reading
    texts = spread.select("doc_id", T.norm(F.col("text")).alias("t")).filter("t <> ''")
    doc_id, item_id = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (quotes, "item_id")))

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.cumsum(pc.utf8_length(batch["t"]).to_numpy()) // BUNDLE
            starts = np.flatnonzero(np.concatenate(([True], cuts[1:] != cuts[:-1]))) if len(batch) else np.zeros(0, int)
            rows = pa.StructArray.from_arrays([batch["doc_id"], batch["t"]], names=["doc_id", "t"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([*starts, len(batch)], pa.int32()), rows)], names=["docs"])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            kinds = kinds or [batch[c].type.value_type.field(0).type for c in ("asks", "docs")]
            for many, asks in zip(batch["docs"], batch["asks"], strict=True):
                items, quoted = (asks.values.field(i).to_pylist() for i in (0, 1))
                ids, found = many.values.field(0).to_pylist(), []
                for doc, text in zip(ids, many.values.field(1).to_pylist(), strict=True):
                    found += [(items[i], doc, score) for i, score in fuzzy.quotes_found(quoted, text, floor)]
                cols = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, pa.float64()], strict=True)], names=["item_id", "doc_id", "score"])

    bundles = texts.mapInArrow(bundled, f"docs array<struct<doc_id: {doc_id}, t: string>>")
    return bundles.crossJoin(F.broadcast(asked) if light else asked).mapInArrow(looked_up, f"item_id {item_id}, doc_id {doc_id}, score double")


def _runs(units: Column, width: int) -> Column:
    """Hashes of all stretches of width neighbours in an array, by the place of the first; null where the array ends."""

    def joined(w: Column) -> Column:
        out = w
        for i in range(1, width):
            out = F.zip_with(out, F.slice(w, F.lit(i + 1), F.size(w)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        return out

    return F.get(F.transform(F.array(F.transform(units, lambda u: F.xxhash64(u))), joined), 0)


def quotes_verbatim(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id and doc_id for all of quotes (item_id, text) and docs (doc_id, text) whose quote stands in the whole text, letter for letter.

    The words between spaces inside a quote are whole words of every text that it stands in, so three of them meet the texts' own
    threes in a join on equal keys; a quote of fewer than five words meets them by its first RUN_LETTERS letters.  Pairs that
    meet are looked up in the whole text.  Null texts are in nothing; an empty quote stands in every text; repeated rows count each.
    """
    asked = quotes.filter("text IS NOT NULL").select(F.col("text").alias("q")).distinct()
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    words, letters = F.split("q", " "), F.split("q", "")
    kind = F.when(F.col("q") == "", 0).when(F.size(words) >= 5, -1).otherwise(F.least(F.size(letters), F.lit(RUN_LETTERS)))
    light = (asked.agg(F.sum(F.octet_length("q") + 64)).first()[0] or 0) <= LIGHT
    met = []
    for k in sorted(r[0] for r in asked.select(kind).distinct().collect()):  # RUN_LETTERS + 2 at most
        mine = asked.filter(kind == k)
        if not k:
            met.append(texts.select("doc_id", F.lit("").alias("q")).distinct())
            continue
        at = F.get(_runs(words, 3), F.floor((F.size(words) - 3) / 2).cast("int")) if k < 0 else F.get(_runs(letters, k), 0)
        keys = mine.select("q", at.alias("run"))
        held = _runs(F.split("text", " "), 3) if k < 0 else _runs(F.split("text", ""), k)
        runs = texts.select("doc_id", F.explode(F.array_distinct(held)).alias("run"))
        met.append(runs.join(F.broadcast(keys) if light else keys, "run").select("doc_id", "q").distinct())
    near = functools.reduce(DataFrame.union, met, texts.select("doc_id", F.col("text").alias("q")).limit(0)).withColumnRenamed("doc_id", "id")
    there = texts.join(near, F.col("doc_id").eqNullSafe(F.col("id"))).filter(F.contains("text", "q")).select("doc_id", "q")
    return there.join(quotes.select("item_id", F.col("text").alias("q")), "q").select("item_id", "doc_id")


def quote_still_present(spark, sf_dir):
    """Three stretches of each text, from its start, middle and end, joined as a quote and looked up in the text without its line ends and every eleventh word."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    stretches = [F.substring("text", F.greatest(at, F.lit(1)), F.lit(120)) for at in (F.lit(1), (size / 2).cast("int") - 60, size - 119)]
    today = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("")), r"((?:\S+ +){10})\S+ +", "$1")
    return docs.select("doc_id", R.quote_still_there(stretches, today).alias("present"))


def quote_exact(spark, sf_dir):
    return quotes_verbatim(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"))


def quote_fuzzy(spark, sf_dir):
    """Passages of benchmark with every twentieth word changed and line ends for the spaces after full stops, looked up in the whole texts of all documents."""
    changed = F.regexp_replace(F.regexp_replace("text", r"((?:\S+\s+){19})\S+", "$1zq"), r"\. ", ".\n")
    quotes = _t(spark, sf_dir, "benchmark").select("item_id", changed.alias("text"))
    return quotes_in_texts(quotes, _t(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def ground_url(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    hrefs = F.transform(R.link_parts(F.col("html"), F.col("url")), lambda x: x.href)
    first = F.get(hrefs, 0)
    return pages.select("page_id", R.url_on_page(F.when(F.col("page_id") % 2 == 0, F.concat(first, F.lit("/"))).otherwise(F.lit("https://nowhere.invalid/x")), F.lit(""), hrefs).alias("found"))


def fuzzy_best_match(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" 2024")).alias("name"))
    offers = part.select(F.col("p_partkey").alias("id"), F.posexplode(F.array(F.lit("qq qq"), F.concat(F.lit("the "), "p_name"), "p_type")).alias("pos", "offer"))
    return best_match(names, offers).select("id", "offer", F.round("score", 6).alias("score"))


def order_by_field_list(spark, sf_dir):
    order = F.array(*[F.lit(x) for x in ("P", "O", "F")])
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.array_position(order, F.col("o_orderstatus")), "o_orderkey"))
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rank.cast("long").alias("place"))


def freshness(spark, sf_dir):
    """Ten points for a date from 360 days before the day of the run to 540 days after it."""
    day, as_of = F.col("o_orderdate").cast("date"), F.lit(AS_OF).cast("date")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.when(day.between(F.date_sub(as_of, 360), F.date_add(as_of, 540)), 10).otherwise(0).cast("long").alias("points"))


def json_guard(spark, sf_dir):
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("{"), F.col("props")))
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(broken, "$.k"), F.lit("unreadable")).alias("k"))


def source_kinds_by_host(spark, sf_dir):
    kind = classify(T.domain(F.col("url")), F.lower("url"), PROFILE)
    return _t(spark, sf_dir, "pages").groupBy(T.domain(F.col("url")).alias("host")).agg(F.min(kind).alias("kind"), F.count(F.lit(1)).alias("n"))


_FUNCTIONS = (html_links, link_filter, frontier_step, context_window, relevance_gate, extract_names, distinctive_tokens, dedup_key, provider_type, name_filter, numbers_supported, quote_still_present, quote_exact, quote_fuzzy, ground_url, fuzzy_best_match, order_by_field_list, freshness, json_guard, source_kinds_by_host)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _FUNCTIONS}


_LINKS = r"""(SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos,
    CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]') THEN regexp_replace(h, '/+$', '') ELSE h END AS href, substr(anchor, 1, 200) AS anchor
    FROM (SELECT page_id, i, regexp_replace(CASE WHEN raw LIKE '/%' THEN base || raw ELSE raw END, '#.*$', '') AS h, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS anchor
      FROM (SELECT page_id, base, i, tag, regexp_extract(tag, '(?is)href="([^"]*)"', 1) AS raw
        FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i
          FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS tags FROM pages) t0) t1) t2
      WHERE raw <> '' AND NOT regexp_matches(raw, '(?i)^(mailto:|tel:|javascript:|#)')) t3 WHERE h LIKE 'http%')"""
_RELEVANT = r"NOT regexp_matches(href, '(?i)\.(jpg|jpeg|png|gif|svg|zip|rar|docx?|xlsx?|pptx?|mp4|mp3)$') AND (regexp_matches(anchor, '(?i)the|and') OR regexp_matches(translate(href, '-_', '  '), '(?i)the|and'))"
_PROSE = r"array_to_string(list_filter(string_split(t, chr(10)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 6), chr(10))"
_NORMAL = r"CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]') THEN regexp_replace(h, '/+$', '') ELSE h END"
_HOST = r"regexp_replace(regexp_extract(lower({0}), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1), '^www\.', '')"
_TEST_HOST = r"'(?i)^(uat|test|testing|staging|stage|demo|dev|beta|sandbox)[.\-\d]'"


def oracle_sql() -> dict[str, str]:
    host = _HOST.format("href")
    return {
        "html_links": f"SELECT page_id, pos, href, anchor FROM {_LINKS} l",
        "link_filter": f"SELECT page_id, pos, {_RELEVANT} AS relevant, regexp_matches({host}, {_TEST_HOST}) AS non_production FROM {_LINKS} l",
        "frontier_step": f"""SELECT * FROM (SELECT href, page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM (
            SELECT href, page_id, pos, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS k FROM {_LINKS} l
            WHERE {_RELEVANT} AND NOT regexp_matches({host}, {_TEST_HOST}) AND href NOT IN (SELECT {_NORMAL} FROM (SELECT regexp_replace(trim(url), '#.*$', '') AS h FROM pages) p)) t WHERE k = 1) u WHERE rank <= {PER_PAGE}""",
        "context_window": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM d WHERE length(text) > {CONTEXT_CHARS}),
            l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM s),
            k AS (SELECT *, max(CAST(regexp_matches(line, '(?i)license') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 8 FOLLOWING) AS near FROM l),
            z AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) > {CONTEXT_CHARS} AS big FROM k WHERE near = 1),
            o AS (SELECT *, max(CAST(big AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS over FROM z),
            g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM o WHERE over = 0 GROUP BY doc_id)
            SELECT d.doc_id, sha256(CASE WHEN length(d.text) <= {CONTEXT_CHARS} THEN d.text ELSE coalesce(g.text, '') END) AS sha FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
        "relevance_gate": f"""SELECT doc_id, hits >= 2 AND len(regexp_extract_all(p, '(?i)the|and')) >= 1 AND kinds >= 2 AND regexp_matches(t, '[0-9]{{2}}') AS relevant, CAST(hits AS BIGINT) AS hits, CAST(kinds AS BIGINT) AS kinds
            FROM (SELECT doc_id, t, p, len(regexp_extract_all(t, '(?i)the|and')) AS hits, len(list_distinct(list_transform(regexp_extract_all(p, '(?i)license|token|that'), lambda x: lower(x)))) AS kinds
            FROM (SELECT doc_id, t, {_PROSE} AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) a) b) c""",
        "distinctive_tokens": "SELECT p_partkey, concat_ws(',', lower(substr(p_type, 1, 3)), nullif(array_to_string(list_filter(regexp_extract_all(p_name, '[a-z]{4,}'), lambda x: x <> lower(substr(p_type, 1, 3))), ','), '')) AS tokens FROM part",
        "dedup_key": r"SELECT p_partkey, concat(trim(regexp_replace(lower(concat(p_name, ' ', p_brand)), '[^a-z0-9]+', ' ', 'g')), '|example.org') AS key FROM part",
        "provider_type": "SELECT s_suppkey, ['foundation_trust', 'government', 'university', 'government', 'corporate_csr', NULL][CAST(s_suppkey % 6 + 1 AS INT)] AS kind FROM supplier",
        "name_filter": "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND p_partkey % 2 = 0 AS funding FROM part",
        "numbers_supported": "SELECT l_orderkey, l_linenumber, l_linenumber IN (3, 5) AS supported FROM lineitem",
        "order_by_field_list": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['P', 'O', 'F'], o_orderstatus), o_orderkey) AS place FROM orders",
        "freshness": f"SELECT o_orderkey, CAST(CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '{AS_OF}' - 360 AND DATE '{AS_OF}' + 540 THEN 10 ELSE 0 END AS BIGINT) AS points FROM orders",
        "source_kinds_by_host": f"SELECT h AS host, min(kind) AS kind, count(*) AS n FROM (SELECT h, {_KIND} AS kind FROM (SELECT url, {_PAGE_HOST} AS h FROM pages) t) u GROUP BY h",
        "json_guard": "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END, 'unreadable') AS k FROM events",
    }
