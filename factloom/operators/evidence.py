"""Record operators as DataFrame functions: pages to text, classification, grounding, fuzzy twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .similarity import similar_keys


def classify(host: Column, path: Column, profile: dict[str, Sequence[str]]) -> Column:
    """Kind of a source, first rule that holds: aggregator domains, government suffixes, university suffixes, else unknown."""

    def under(domains: Sequence[str]) -> Column:
        out = F.lit(False)
        for d in domains:
            out = out | (host == d) | host.endswith("." + d)
        return out

    def ends(suffixes: Sequence[str]) -> Column:
        out = F.lit(False)
        for s in suffixes:
            out = out | host.endswith(s)
        return out

    kind = F.when(under(profile["aggregator"]), "aggregator").when(ends(profile["government"]), "government").when(ends(profile["university"]), "university")
    return kind.when(path.rlike("/csr"), "corporate_csr").otherwise("unknown")


#: Domains and suffixes that fit the synthetic pages.
PROFILE = {"aggregator": ("spam-farm.example.com", "cheap-pills.example.com"), "government": (".example.org",), "university": (".example.net",)}


def twins(names: DataFrame, floor: float = 90.0) -> DataFrame:
    """Pairs (a, b, score) of keys of names (key) whose sorted tokens are alike to floor per cent: see similarity.similar_keys."""
    return similar_keys(names.select(F.array_join(F.array_sort(F.split("key", " ")), " ").alias("key")), floor)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_lines(F.col("text")), 256).alias("sha"))


def html_title(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


def url_functions(spark, sf_dir):
    host = T.domain(F.col("url"))
    return _t(spark, sf_dir, "pages").select("page_id", host.alias("host"), T.normalize_url(F.col("url")).alias("url"), T.url_root(host).alias("root"))


def classify_source(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", classify(T.domain(F.col("url")), F.lower("url"), PROFILE).alias("kind"))


def source_report(spark, sf_dir):
    """Pages to clean text, first page of each content, kind of source, gate by words, counts by kind."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", T.html_lines(F.col("html")).alias("text"))
    firsts = pages.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min_by(F.struct("url", "text"), "page_id").alias("p"))
    words = F.regexp_count(F.lower("p.text"), F.lit("[a-z]+"))
    told = firsts.select(classify(T.domain(F.col("p.url")), F.lower("p.url"), PROFILE).alias("kind"), (words >= 50).alias("relevant"))
    return told.groupBy("kind").agg(F.count(F.lit(1)).alias("urls"), F.count_if("relevant").alias("relevant"), F.count_if(F.col("kind").isin("government", "university")).alias("official"))


def norm_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.norm(F.col("text")), 256).alias("sha"))


def content_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(T.content_words(F.col("text"))).cast("long").alias("n"))


def numbers_in(spark, sf_dir):
    said = F.concat(F.lit("fee Rs. "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" or "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(".5 lakh"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.transform(T.numbers_in(said), lambda x: x.cast("long")).alias("found"))


def find_dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp")
    said = F.concat(F.lit("due "), F.date_format(d, "dd.MM.yyyy"), F.lit(" or 31.02.2020"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.get(T.find_dates(said), 0).alias("due"), F.size(T.find_dates(said)).cast("long").alias("n"))


def name_key(spark, sf_dir):
    name = F.concat("p_name", F.lit(" 2024-25 ("), "p_brand", F.lit(")"))
    return _t(spark, sf_dir, "part").select("p_partkey", T.name_key(name).alias("key"))


def prose_lines(spark, sf_dir):
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != "")) >= 6)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n"))


def keyword_counts(spark, sf_dir):
    low = F.lower("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_count(low, F.lit("license|token|the")).cast("long").alias("hits"), F.size(F.array_distinct(F.regexp_extract_all(low, F.lit("license|token|the"), F.lit(0)))).cast("long").alias("kinds"))


def fuzzy_twins(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.name_key(F.col("p_name")).alias("key"))
    return twins(names).select("a", "b", F.round("score", 6).alias("score"))


def parse_iso(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.parse_iso(F.col("o_orderdate").cast("date").cast("string")).alias("day"))


def academic_years(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.academic_years(F.col("o_orderdate")), ",").alias("years"))


def json_field(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_FUNCTIONS = (clean_text, html_title, url_functions, classify_source, source_report, norm_text, content_words, numbers_in, find_dates, name_key, prose_lines, keyword_counts, fuzzy_twins, parse_iso, academic_years, json_field)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _FUNCTIONS}


_HOST = r"regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1), '^www\.', '')"
_KIND = """CASE WHEN h IN ('spam-farm.example.com', 'cheap-pills.example.com') OR h LIKE '%.spam-farm.example.com' OR h LIKE '%.cheap-pills.example.com' THEN 'aggregator'
  WHEN h LIKE '%.example.org' THEN 'government' WHEN h LIKE '%.example.net' THEN 'university' WHEN contains(lower(url), '/csr') THEN 'corporate_csr' ELSE 'unknown' END"""
_NORM = r"""trim(regexp_replace(regexp_replace(lower(replace(translate(coalesce({0}, ''), '‘’“”–—−' || chr(160) || '|', '''''""---  '), '₹', ' rs ')), '(^|[^a-z0-9_])rs\s*\.', '\1rs ', 'g'), '\s+', ' ', 'g'))"""


# A line stays if it is not empty and not equal to the line before it.
_CLEAN = r"""SELECT doc_id, sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(ls, list_concat([NULL], ls[:-2])), lambda x: x[1] <> '' AND x[1] IS DISTINCT FROM x[2]), lambda x: x[1]), chr(10)), '')) AS sha
  FROM (SELECT doc_id, list_transform(string_split(regexp_replace(replace(replace(replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) AS ls FROM documents) t"""


_GONE = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "svg", "iframe", "form", "nav", "footer", "header", "title"))
_DECODED = "regexp_replace(regexp_replace(coalesce(html, ''), '" + _GONE + "', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
for _ref, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_ref}', '{_char}')"


def page_text_sql(pages: str) -> str:
    """SELECT of all columns of pages (with html) and text, the visible lines of a page."""
    lines = rf"list_transform(string_split(regexp_replace(replace(replace(replace(replace(replace({_DECODED}, chr(160), ' '), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g')))"
    kept = "list_transform(list_filter(list_zip(ls, list_concat([NULL], ls[:-2])), lambda x: x[1] <> '' AND x[1] IS DISTINCT FROM x[2]), lambda x: x[1])"
    return f"SELECT * EXCLUDE (ls), coalesce(array_to_string({kept}, chr(10)), '') AS text FROM (SELECT *, {lines} AS ls FROM ({pages}) p0) p1"


def alike_sql(keys: str, floor: int) -> str:
    """CTEs that end in alike (a, b, score): pairs of the distinct key of keys whose longest common subsequence, by bits of sums in HUGEINT, reaches floor; keys of up to 120 characters."""
    return f"""ks AS MATERIALIZED (SELECT DISTINCT key, length(key) AS n FROM ({keys}) k0 WHERE key <> ''),
  letters AS MATERIALIZED (SELECT key, n, i, substr(key, i, 1) AS ch FROM (SELECT key, n, unnest(range(1, n + 1)) AS i FROM ks) u),
  masks AS MATERIALIZED (SELECT key, ch, bit_or(1::HUGEINT << (i - 1)::INTEGER) AS mask, count(*) AS k FROM letters GROUP BY key, ch),
  able AS MATERIALIZED (SELECT a.key AS a, b.key AS b, any_value(p.n) AS m, any_value(q.n) AS n FROM masks a JOIN masks b ON a.ch = b.ch AND a.key < b.key JOIN ks p ON p.key = a.key JOIN ks q ON q.key = b.key
    GROUP BY a.key, b.key HAVING 200 * sum(least(a.k, b.k)) >= {floor} * (any_value(p.n) + any_value(q.n))),
  steps AS (
    SELECT a, b, m, n, 0 AS i, (1::HUGEINT << m::INTEGER) - 1 AS v FROM able
    UNION ALL SELECT s.a, s.b, s.m, s.n, s.i + 1, ((s.v + (s.v & coalesce(k.mask, 0::HUGEINT))) | (s.v - (s.v & coalesce(k.mask, 0::HUGEINT)))) & ((1::HUGEINT << s.m::INTEGER) - 1)
    FROM steps s JOIN letters l ON l.key = s.b AND l.i = s.i + 1 LEFT JOIN masks k ON k.key = s.a AND k.ch = l.ch
  ), alike AS MATERIALIZED (SELECT a, b, 200.0::DOUBLE * (m - bit_count(v)) / (m + n) AS score FROM steps WHERE i = n AND 200 * (m - bit_count(v)) >= {floor} * (m + n))"""


def oracle_sql() -> dict[str, str]:
    norm = _NORM.format("text")
    return {
        "clean_text": _CLEAN,
        "content_words": f"""SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all({norm}, '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.STOP_WORDS)}], w)))) AS BIGINT) AS n FROM documents""",
        "html_title": r"SELECT page_id, substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 300) AS title FROM pages",
        "url_functions": f"""SELECT page_id, h AS host, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]') THEN regexp_replace(u, '/+$', '') ELSE u END AS url,
            array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS root FROM (SELECT page_id, {_HOST} AS h, regexp_replace(trim(url), '#.*$', '') AS u FROM pages) t""",
        "classify_source": f"SELECT page_id, {_KIND} AS kind FROM (SELECT page_id, url, {_HOST} AS h FROM pages) t",
        "norm_text": f"SELECT doc_id, sha256({norm}) AS sha FROM documents",
        "numbers_in": "SELECT o_orderkey, list_sort(list_distinct([CAST(floor(o_totalprice) AS BIGINT), CAST(o_orderkey % 9 + 1 AS BIGINT), CAST((o_orderkey % 9 + 1.5) * 100000 AS BIGINT)])) AS found FROM orders",
        "find_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due, CAST(1 AS BIGINT) AS n FROM orders",
        "name_key": r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM part",
        "source_report": f"""SELECT kind, count(*) AS urls, count(*) FILTER (words >= 50) AS relevant, count(*) FILTER (kind IN ('government', 'university')) AS official FROM (
            SELECT {_KIND} AS kind, words FROM (SELECT url, {_HOST} AS h, len(regexp_extract_all(lower(text), '[a-z]+')) AS words FROM ({page_text_sql("SELECT * FROM pages")}) t QUALIFY row_number() OVER (PARTITION BY text ORDER BY page_id) = 1) u) v GROUP BY kind""",
        "fuzzy_twins": f"""WITH RECURSIVE {alike_sql("SELECT array_to_string(list_sort(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS key FROM part", 90)} SELECT a, b, round(score, 6) AS score FROM alike""",
        "prose_lines": r"SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len(list_filter(string_split(x, ' '), lambda w: w <> '')) >= 6)) AS BIGINT) AS n FROM documents",
        "keyword_counts": "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'license|token|the')) AS BIGINT) AS hits, CAST(len(list_distinct(regexp_extract_all(lower(text), 'license|token|the'))) AS BIGINT) AS kinds FROM documents",
        "parse_iso": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
        "academic_years": """SELECT o_orderkey, array_to_string(list_transform([s - 1, s, s + 1], lambda y: concat(y, '-', substr(CAST(y + 1 AS VARCHAR), 3, 2), ',', y, '-', y + 1, ',', y, '–', substr(CAST(y + 1 AS VARCHAR), 3, 2))), ',') AS years
            FROM (SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS s FROM orders) t""",
        "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    }
