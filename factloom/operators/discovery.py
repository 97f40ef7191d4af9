"""Enrichment links, the frontier, cycles, archive comparison, structured criteria and updates of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..plans.relational import run
from ..sources import files
from . import record_queries as Q
from . import verification as V
from .ordering import placed

# Fields that enrichment seeks, links of a record, patterns of links.
TARGETS, LINKS = ["close_date", "application_url", "amount"], 3
SKIP_LINK = r"batch|merit[ _%-]?list|user[ _%-]?man|result|selected|sanction|list of|archive|faculty|tender|recruit|vacanc|screen-reader|login|gazette"
USEFUL_LINK = r"general[-_ ]?instruction|guideline|guidlines|advertisement|apply|application|faq|eligib|details|read more|know more|scheme[-_ ]document|brochure|notification"
SINGLE_LINK = r"guideline|guidlines|apply|application|faq|eligib|brochure|advertisement"
OLD_YEAR = r"(?<!\d)(19\d{2}|20[01]\d|202[0-3])(?!\d)"
CATEGORIES = {"SC": ["scheduled caste", "sc"], "ST": ["scheduled tribe", "st"], "OBC": ["obc", "backward class"], "EBC": ["ebc", "extremely backward", "economically backward"], "DNT": ["dnt", "de-notified", "denotified"], "EWS": ["ews", "economically weaker"], "MINORITY": ["minorit"], "PWD": ["disab", "pwd", "divyang"], "GENERAL": ["general"]}
LEVELS = ["SCHOOL", "CLASS_11_12", "DIPLOMA", "UG", "PG", "PHD", "POSTDOC"]


def lacks(g: Column) -> Column:
    """The fields that enrichment seeks for a record whose grounded values are the map g."""
    eligible = F.size(F.filter(F.array(*[F.when(g[f].isNotNull(), F.lit(f)) for f in V.ELIGIBILITY]), lambda f: f.isNotNull()))
    return F.array_compact(F.array(*[F.when(g[f].isNull(), F.lit(f)) for f in TARGETS], F.when(eligible < 3, F.lit("eligibility"))))


def lacking(known: DataFrame) -> DataFrame:
    """id and the fields that enrichment seeks for it (known: as verification.facts gives it); records that lack nothing are left out."""
    return known.select("id", lacks(F.col("g")).alias("lacking")).filter(F.size("lacking") > 0)


def link_allowed(href: Column, url: Column, provider: Column, profile: V.Profile) -> Column:
    """Whether a link stays with the provider: the same site, an official site of the same kind, or a domain with the provider's name."""
    d, own = T.domain(href), T.domain(url)
    return _stays(_place(href, d, profile), _place(url, own, profile), _site_tokens(provider, own))


def _place(url: Column, host: Column, profile: V.Profile) -> Column:
    """What link_allowed asks of one address: (root, site, kind, official)."""
    told = V.classify(url, F.lit(None).cast("string"), profile, host)
    return F.struct(T.url_root(host).alias("root"), F.translate(host, ".-", "").alias("site"), told["kind"].alias("kind"), told["official"].alias("official"))


def _site_tokens(provider: Column, host: Column) -> Column:
    """Words by which a domain shows that it is the provider's; host: the provider's own."""
    tokens = F.array_append(V._tokens(provider, 4, V.GENERIC_PROVIDER), F.split_part(T.url_root(host), F.lit("."), F.lit(1)))
    return F.filter(tokens, lambda t: F.length(t) >= 4)


def _stays(there: Column, here: Column, tokens: Column) -> Column:
    return (there["root"] == here["root"]) | (there["official"] & (there["kind"] == here["kind"])) | F.exists(tokens, lambda t: F.contains(there["site"], t))


def candidate_links(records: DataFrame, links: DataFrame, profile: V.Profile) -> DataFrame:
    """(id, place, href, anchor): the LINKS best links for each of records (id, name, official_url, provider, single, app_url).

    links: (url, pos, href, anchor) of source pages.  A stated application link comes first, then links that name the scheme, useful ones
    before others; a page with a single scheme may also give explicit guideline or application links.  Ties go by place on the page.
    """
    # a page's records meet all its links, so all that depends on one side alone is told before they meet
    path = F.regexp_replace("href", "^https?://[^/]+", "")
    hay = F.translate(F.replace(F.lower(F.concat_ws(" ", path, F.coalesce("anchor", F.lit("")))), F.lit("%20"), F.lit(" ")), "_-", "  ")
    there = links.withColumn("hay", hay).filter(~F.col("hay").rlike(SKIP_LINK) & ~F.col("hay").rlike(OLD_YEAR)).withColumn("host", T.domain(F.col("href")))
    there = there.select("url", "pos", "href", "anchor", "hay", T.normalize_url(F.col("href")).alias("goes"), F.col("hay").rlike(USEFUL_LINK).cast("int").alias("useful"), F.col("hay").rlike(SINGLE_LINK).alias("explicit"), _place(F.col("href"), F.col("host"), profile).alias("there"))
    asked = records.withColumn("host", T.domain(F.col("official_url"))).withColumn("site", F.translate("host", ".-", "  "))
    tokens = F.filter(R.distinctive_tokens(F.col("name")), lambda t: ~(F.contains("site", t) & T.has_word(t, F.col("site"))))
    asked = asked.select("id", "official_url", "single", T.normalize_url(F.col("official_url")).alias("stands"), tokens.alias("tokens"), _place(F.col("official_url"), F.col("host"), profile).alias("here"), _site_tokens(F.col("provider"), F.col("host")).alias("said"))
    # the letters are looked for before the word: patterns that differ from row to row are made anew for each
    named = F.exists("tokens", lambda t: F.contains("hay", t) & T.has_word(t, F.col("hay")))
    x = asked.join(there, F.col("official_url") == F.col("url")).filter((F.col("goes") != F.col("stands")) & (named | F.col("single") & F.col("explicit")))
    points = F.when(named, 2 + F.col("useful")).when(F.col("single") & F.col("explicit"), 1)
    found = x.filter(_stays(F.col("there"), F.col("here"), F.col("said"))).select("id", points.alias("points"), "pos", "href", "anchor")
    app = F.col("app_url")
    stated = records.filter(app.isNotNull() & link_allowed(app, F.col("official_url"), F.col("provider"), profile))
    stated = stated.select("id", F.lit(9).alias("points"), F.lit(0).cast("long").alias("pos"), F.when(app.contains("://"), app).otherwise(F.concat(F.lit("https://"), app)).alias("href"), F.lit("application link stated on the source page").alias("anchor"))
    best = stated.unionByName(found).repartition("id").groupBy("id", "href").agg(F.max(F.struct("points", -F.col("pos"), "anchor")).alias("b"))
    order = Window.partitionBy("id").orderBy(F.col("b.points").desc(), F.col("b.col2").desc(), "href")
    return best.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= LINKS).select("id", "place", "href", "b.anchor")


def crawl_order(seeds: DataFrame, links: DataFrame, depth: int, budget: int, per_page: int = 25) -> DataFrame:
    """(url, level, via): the addresses that a breadth-first crawl visits, at most budget of them.

    seeds: (url); links: (url, pos, href), those of each page that may be followed.  An address is visited at its first level, from the first page
    there by (url, pos) that links to it; a page gives at most per_page new addresses.  Work per level is one join and one aggregation.
    """
    spark, root = seeds.sparkSession, files.work_dir(seeds.sparkSession)
    level = seeds.select("url", F.lit(0).alias("level"), F.lit(None).cast("string").alias("via"), F.lit("").alias("key")).dropDuplicates(["url"])
    for d in range(depth + 1):
        path = f"{root}/{d}"
        level.write.parquet(path)
        seen = spark.read.parquet(*[f"{root}/{i}" for i in range(d + 1)])
        level = spark.read.parquet(path)
        if d == depth or seen.count() >= budget or level.isEmpty():
            break
        new = level.select("url").join(links, "url").join(seen.select(F.col("url").alias("href")), "href", "left_anti")
        first = new.groupBy("href").agg(F.min(F.struct("url", "pos")).alias("f")).select("href", "f.url", "f.pos")
        rank = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
        level = first.withColumn("r", rank).filter(F.col("r") <= per_page).select(F.col("href").alias("url"), F.lit(d + 1).alias("level"), F.col("url").alias("via"), F.concat_ws("/", "url", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("key"))
    return seen.orderBy("level", "key", "url").limit(budget).select("url", "level", "via")


def newest_cycles(schemes: DataFrame) -> DataFrame:
    """Of schemes (id, key, name, open_date, close_date) with one key the one of the latest cycle, of equal ones the first id."""
    year = T.cycle_year(F.coalesce("name", F.lit("")), F.coalesce("open_date", F.lit("")), F.coalesce("close_date", F.lit("")))
    return V.first_of(schemes.withColumn("cycle", year), ["key"], F.col("cycle").desc(), F.col("id"))


def merge_missing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, field, value, filled): grounded values of new fill fields that old lacks; grounded old values and names are never replaced."""
    a, b = old.filter("grounded").select("id", "field", F.col("value").alias("old")), new.filter("grounded AND field <> 'name'").select("id", "field", F.col("value").alias("new"))
    both = a.join(b, ["id", "field"], "full")
    return both.select("id", "field", F.coalesce("old", "new").alias("value"), F.col("old").isNull().alias("filled"))


def merge_maps(first: Column, second: Column) -> Column:
    """Entries of both maps; of a key in both the first map's value stays."""
    return F.map_concat(F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)), first)


def structured(claims: Column, g: Column, quotes: Column) -> Column:
    """Structured criteria (a struct) that the grounded quotes of their own fields support; g and quotes are maps by field."""
    income, pct, age = claims["max_family_income_inr"], claims["min_percentage"], claims["max_age"]

    def near(field: str, value: Column, within: float) -> Column:
        return F.coalesce(F.exists(T.numbers_in(quotes[field]), lambda n: F.abs(n - value) < within), F.lit(False))

    category, place = T.norm(quotes["category"]), T.norm(quotes["domicile"])
    terms = F.create_map(*[F.lit(x) for k, ts in CATEGORIES.items() for x in (k, r"\b(" + "|".join(ts) + ")")])
    kept = F.filter(claims["categories"], lambda c: F.coalesce(F.regexp_like(category, terms[c]), F.lit(False)))
    return F.struct(
        F.when(near("income_limit", income, 1.0), income.cast("long")).alias("max_family_income_inr"),
        F.when(near("academic_req", pct, 1e-9), pct).alias("min_percentage"),
        F.when(near("age_limit", age, 1e-9), age.cast("long")).alias("max_age"),
        F.when(claims["gender"].isin("female", "male") & g["gender"].isNotNull(), claims["gender"]).alias("gender"),
        F.when(F.size(kept) > 0, kept).alias("categories"),
        F.when(g["education_level"].isNotNull(), F.nullif(F.array_intersect(claims["levels"], F.array(*[F.lit(x) for x in LEVELS])), F.array().cast("array<string>"))).alias("levels"),
        F.nullif(F.filter(claims["domicile_states"], lambda s: F.contains(place, T.norm(s))), F.array().cast("array<string>")).alias("domicile_states"),
    )


def archive_changes(old: DataFrame, now: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, field, old_value, new_value, old_quote, new_quote): facts of an archived copy that the same page states otherwise today.

    old: (id, field, value, quote), grounded facts of the copy; now: (id, field, value, quote, source_url, grounded); pages: (id, url, text).
    Dates differ by value; others by numbers, and only if the old quotes are gone from the page.
    """
    both = old.join(now.filter("grounded").select("id", "field", F.col("value").alias("new_value"), F.col("quote").alias("new_quote"), "source_url"), ["id", "field"])
    both = both.join(pages.withColumn("text", T.norm(F.col("text"))), "id").filter("source_url = url")
    dated = F.col("field").endswith("_date")
    both = both.filter(F.when(dated, F.col("value") != F.col("new_value")).otherwise(T.numbers_in(F.col("value")) != T.numbers_in(F.col("new_value"))))
    # aligning quotes costs far more than moving the few rows left, so they are spread over all cores; dates ask for no quote
    conf = both.sparkSession.conf.get("spark.sql.shuffle.partitions")
    both = both.repartition(max(int(conf), 4 * both.sparkSession.sparkContext.defaultParallelism))
    parts = F.split(F.when(~dated, F.col("quote")), f"\\Q{R.QUOTE_JOIN}\\E")
    other = F.lit(True)
    for i in range(R.QUOTES):
        other = other & F.coalesce(~R.quote_in_norm(F.get(parts, i), F.col("text")), F.lit(True))
    return both.filter(other).select("id", "field", F.col("value").alias("old_value"), "new_value", F.col("quote").alias("old_quote"), "new_quote")


def recheck(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """sources (url, content_hash, extracted_hash, fail_count) after fetched (url, ok, status, hash): new columns and action.

    A failed page keeps its hash and counts one more failure; a page whose content was already extracted is confirmed; others are extracted.
    """
    x = sources.join(fetched, "url", "left")
    action = F.when(F.col("ok").isNull(), "skip").when(~F.col("ok"), "failed").when(F.col("hash") == F.col("extracted_hash"), "confirm").otherwise("extract")
    return x.select("url", F.when(F.col("ok"), F.col("hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("ok"), 0).when(~F.col("ok"), F.col("fail_count") + 1).otherwise(F.col("fail_count")).cast("int").alias("fail_count"), action.alias("action"))


def route(records: DataFrame, seen: DataFrame) -> DataFrame:
    """records (id, name, quote, text, missing_runs) after their page was read: found in seen (id), quoted on the page still, or missing once more."""
    x = V.spread(records.join(seen.select("id", F.lit(True).alias("here")).distinct(), "id", "left"))
    asked = F.when(F.col("here").isNull(), F.coalesce("quote", "name"))
    kept = F.col("here") | R.quote_reaches(asked, F.col("text"))
    way = F.when(F.col("here"), "extracted").when(kept, "still named").otherwise("missing")
    return x.select("id", way.alias("way"), F.when(way == "missing", F.col("missing_runs") + 1).otherwise(0).cast("int").alias("missing_runs"))


def _facts(spark, sf_dir):
    records, evidence, sources, _ = Q._records(spark, sf_dir)
    return records, evidence, V.facts(records, evidence, sources)


def needs_enrichment(spark, sf_dir):
    """Fields that official records lack."""
    return lacking(_facts(spark, sf_dir)[2]).select("id", F.array_join("lacking", ",").alias("lacking"))


_LINKS = """SELECT url, pos, CASE pos WHEN 1 THEN concat(root, '/', word, '-apply') WHEN 2 THEN concat(root, '/', word) WHEN 3 THEN concat(root, '/guideline') WHEN 4 THEN concat(root, '/', word, '-result') WHEN 5 THEN concat(root, '/', word, '-2019') WHEN 6 THEN concat('https://nowhere.net/', word) ELSE url END AS href, 'see more' AS anchor
    FROM (SELECT official_url AS url, concat('https://', regexp_extract(official_url, '://([^/]+)', 1)) AS root, split_part(topic, ' ', 1) AS word FROM ({0}) r) l CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) p(pos)"""


def enrichment_links(spark, sf_dir):
    """The best links of every record's page."""
    records, _, known = _facts(spark, sf_dir)
    links = run(spark, sf_dir, _LINKS.format(Q.RECORDS)).withColumn("pos", F.col("pos").cast("long"))
    asked = known.select("id", "name", "official_url", F.col("g")["provider"].alias("provider"), (F.col("id") % 2 == 0).alias("single"), F.when(F.col("id") % 5 == 0, F.col("g")["application_url"]).alias("app_url"))
    return candidate_links(asked, links, Q.PROFILE).select("id", "place", "href")


def frontier_crawl(spark, sf_dir):
    """A crawl of three levels from page 0 with a budget, where page n links to 3 n + 1 to 3 n + 3, to itself and to page 0."""
    ids = run(spark, sf_dir, "SELECT page_id FROM pages")
    page = lambda n: F.concat(F.lit("p"), F.lpad(n.cast("string"), 9, "0"))
    n = F.col("page_id")
    links = ids.select(page(n).alias("url"), F.posexplode(F.array(n, F.lit(0).cast("long"), n * 3 + 1, n * 3 + 2, n * 3 + 3)).alias("pos", "to")).select("url", "pos", page(F.col("to")).alias("href"))
    return crawl_order(ids.filter("page_id = 0").select(page(n).alias("url")), links, depth=3, budget=30)


def newest_cycle(spark, sf_dir):
    """One scheme of each customer's: that of the latest cycle in its name or dates."""
    x = run(spark, sf_dir, "SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders")
    y = F.col("y")
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Aid "), (y + 8).cast("string"), F.lit("-"), F.substring((y + 9).cast("string"), 3, 2))).when(F.col("id") % 3 == 1, F.concat(F.lit("Aid "), (y + 9).cast("string"))).otherwise(F.lit("Aid"))
    schemes = x.select("id", F.col("o_custkey").alias("key"), name.alias("name"), F.lit(None).cast("string").alias("open_date"), F.when(F.col("id") % 2 == 0, F.date_add("d", 3653).cast("string")).alias("close_date"))
    return newest_cycles(schemes).select(F.col("key").alias("o_custkey"), F.col("id").alias("o_orderkey"), "cycle")


def merge_missing_fields(spark, sf_dir):
    """Evidence of a linked page fills what records lack."""
    evidence = run(spark, sf_dir, Q.EVIDENCE)
    new = evidence.select("id", "field", F.concat(F.lit("new "), F.coalesce("value", F.lit("x"))).alias("value"), (F.col("id") % 2 == 0).alias("grounded"))
    return merge_missing(evidence, new)


def merge_eligibility(spark, sf_dir):
    """Maps of criteria merged, existing values first."""
    x = run(spark, sf_dir, Q.RECORDS)
    a = F.create_map(F.lit("max_age"), (F.col("id") % 30).cast("string"), F.lit("gender"), F.lit("female"))
    b = F.create_map(F.lit("gender"), F.lit("male"), F.lit("level"), F.concat(F.lit("L"), (F.col("id") % 5).cast("string")))
    merged = merge_maps(a, b)
    return x.select("id", F.size(merged).cast("long").alias("n"), merged["gender"].alias("gender"), merged["level"].alias("level"), merged["max_age"].alias("max_age"))


def structured_criteria(spark, sf_dir):
    """Structured criteria held against the quotes of their fields, in twelve cases."""
    x = run(spark, sf_dir, Q.RECORDS)
    k = F.col("id") % 4
    claims = F.struct((F.lit(250000.0) + k).alias("max_family_income_inr"), (k * 10.0 + 50).alias("min_percentage"), (k + 25.0).alias("max_age"), F.when(k < 2, "female").otherwise("any").alias("gender"), F.array(F.lit("SC"), F.lit("OBC"), F.lit("XX")).alias("categories"), F.array(F.lit("UG"), F.lit("LAW")).alias("levels"), F.array(F.lit("Kerala"), F.lit("Goa")).alias("domicile_states"))
    quotes = F.create_map(F.lit("income_limit"), F.lit("income up to Rs. 2.5 lakh"), F.lit("academic_req"), F.lit("60 per cent"), F.lit("age_limit"), F.lit("not over 27 years"), F.lit("category"), F.when(F.col("id") % 3 == 0, "Scheduled Caste students").when(F.col("id") % 3 == 1, "students of the OBC and SC lists").otherwise("all"), F.lit("domicile"), F.lit("domicile of KERALA"))
    g = F.create_map(F.lit("gender"), F.when(F.col("id") % 3 != 2, "Female"), F.lit("education_level"), F.when(F.col("id") % 3 != 1, "UG"))
    s = structured(claims, g, quotes)
    return x.select("id", s.alias("s")).select("id", "s.max_family_income_inr", "s.min_percentage", "s.max_age", "s.gender", F.array_join("s.categories", ",").alias("categories"), F.array_join("s.levels", ",").alias("levels"), F.array_join("s.domicile_states", ",").alias("states"))


def archive_comparison(spark, sf_dir):
    """Facts of last year's copies against today's evidence, all cases."""
    x = run(spark, sf_dir, Q.CHANGES).filter("old_value is not null and new_value is not null")
    key = F.concat_ws("/", "id", "field").alias("id")
    old = x.select(key, "field", F.col("old_value").alias("value"), F.lit("the old words of the page").alias("quote"))
    now = x.select(key, "field", F.col("new_value").alias("value"), F.lit(None).cast("string").alias("quote"), F.col("url").alias("source_url"), (F.col("id") % 7 != 0).alias("grounded"))
    return archive_changes(old, now, x.select(key, "url", "text")).drop("old_quote", "new_quote")


def archive_candidates(spark, sf_dir):
    """The pages with most grounded facts of their own records: official, not PDF, the first 40."""
    _, evidence, known = _facts(spark, sf_dir)
    facts = evidence.filter("grounded AND field IN ('close_date', 'amount', 'income_limit')").join(known.select("id", "official_url", "own.owns"), "id").filter("source_url = official_url AND owns AND NOT lower(official_url) LIKE '%.pdf'")
    return facts.groupBy("official_url").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "official_url").limit(40)


def already_baselined(spark, sf_dir):
    """Archive addresses (a prefix) of pages (a suffix)."""
    pages = run(spark, sf_dir, "SELECT page_id, url FROM pages")
    stamped = pages.withColumn("archived", F.concat(F.when(F.col("page_id") % 3 == 0, "https://web.archive.org/web/2025/").otherwise("https://other.org/web/2025/"), "url"))
    return stamped.filter(F.col("archived").like("https://web.archive.org/web/%") & F.col("archived").endswith(F.concat(F.lit("/"), F.col("url")))).select("page_id")


def recheck_pages(spark, sf_dir):
    """Known pages fetched again: failed, confirmed or to be extracted."""
    pages = run(spark, sf_dir, "SELECT page_id, url FROM pages")
    k = F.col("page_id")
    sources = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).select("url", F.concat(F.lit("h"), k.cast("string")).alias("content_hash"), F.when(k % 4 != 3, F.concat(F.lit("h"), k.cast("string"))).alias("extracted_hash"), (k % 3).cast("int").alias("fail_count"), "page_id")
    fetched = sources.filter("page_id % 10 <> 9").select("url", (k % 5 != 0).alias("ok"), F.lit(200).alias("status"), F.concat(F.lit("h"), F.when(k % 7 == 0, k + 1).otherwise(k).cast("string")).alias("hash"))
    return recheck(sources.drop("page_id"), fetched)


def page_routing(spark, sf_dir):
    """Records of a page that was read again."""
    x = run(spark, sf_dir, Q.RECORDS)
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("On this page is "), "name", F.lit(" still."))).otherwise(F.lit("0123456789 %%% ###"))
    records = x.select("id", "name", F.when(F.col("id") % 2 == 0, F.col("name")).alias("quote"), text.alias("text"), "missing_runs")
    return route(records, x.filter("id % 5 = 0"))


def export_csv(spark, sf_dir):
    """Records with their sources' kinds as CSV, written and read back."""
    path = files.work_dir(spark)
    x = run(spark, sf_dir, Q.RECORDS).select("id", F.concat("name", F.lit(', "so called"\nof '), "topic").alias("name"), "close_date", "confidence", "missing_runs")
    files.write_csv(x, path)
    return files.read_csv(spark, path, "id long, name string, close_date string, confidence double, missing_runs int")


def export_nested(spark, sf_dir):
    """Records as JSON with evidence by field and history, written and read back."""
    path = files.work_dir(spark)
    records, evidence = run(spark, sf_dir, Q.RECORDS), run(spark, sf_dir, Q.EVIDENCE)
    history = records.filter("id % 2 = 0").select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("change_id"), F.lit("amount").alias("field"), F.lit(None).cast("string").alias("old_value"), "topic").withColumn("new_value", F.concat("topic", F.lit(" "), F.col("change_id").cast("string"))).withColumn("note", F.lit("value changed")).drop("topic")
    files.write_json(files.nested(records, evidence, history), path)
    back = spark.read.schema("id long, name string, evidence map<string,struct<value:string,quote:string,source_url:string,grounded:boolean>>, change_history array<struct<change_id:int,new_value:string>>").json(path)
    e = F.col("evidence")
    return back.select("id", "name", F.size("evidence").cast("long").alias("fields"), e["amount"]["value"].alias("amount"), e["gender"]["grounded"].alias("gender_grounded"), F.array_join(F.transform("change_history", lambda c: c["new_value"]), ";").alias("history"))


def param_sql(spark, sf_dir):
    """A query with bound parameters."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = :segment AND c_acctbal > :least", args={"segment": "BUILDING", "least": 1000})


def set_intersect_words(spark, sf_dir):
    """Words that names of parts and texts of benchmark share."""
    word = lambda c: F.explode(T.content_words(F.col(c))).alias("word")
    return run(spark, sf_dir, "SELECT lower(p_name) AS t FROM part").select(word("t")).intersect(run(spark, sf_dir, "SELECT text AS t FROM documents").select(word("t")))


def upsert_evidence(spark, sf_dir):
    """New evidence over old by (id, field): values replace, a missing quote keeps the old one, other fields stay."""
    old = run(spark, sf_dir, Q.EVIDENCE)
    new = old.filter("id % 3 = 0").select("id", "field", F.concat(F.lit("v2 "), F.coalesce("value", F.lit(""))).alias("new_value"), F.when(F.col("id") % 2 == 0, "fresh quote").alias("new_quote"), F.lit(True).alias("hit"))
    both = old.join(new, ["id", "field"], "left")
    return both.select("id", "field", F.when(F.col("hit"), F.col("new_value")).otherwise(F.col("value")).alias("value"), F.coalesce("new_quote", "quote").alias("quote"))


def source_updates(spark, sf_dir):
    """Set-based updates: a counter one higher, a tag appended, for the sources that are duplicates."""
    x = run(spark, sf_dir, Q.SOURCES)
    twin = F.col("http_status") == 404
    return x.select("url", F.when(twin, F.col("fail_count") + 1).otherwise(F.col("fail_count")).cast("int").alias("fail_count"), F.concat(F.lit("link"), F.when(twin, " [duplicate]").otherwise("")).alias("discovered_via"))


def new_record_ids(spark, sf_dir):
    """Ids for new records: after the largest one known, in the order of their keys; known keys are ignored."""
    known, found = run(spark, sf_dir, "SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0"), run(spark, sf_dir, "SELECT DISTINCT o_custkey AS k FROM orders")
    new = placed(found.join(known, "k", "left_anti"), [F.col("k").asc()], "place")
    top = F.broadcast(known.agg(F.coalesce(F.max("k"), F.lit(0)).alias("top")))
    return new.join(top).select("k", (F.col("top") + F.col("place") + 1).cast("long").alias("id"))


def field_map(spark, sf_dir):
    """Evidence as a map from field to value, looked up and filtered by membership; the latest day with a default."""
    told = run(spark, sf_dir, Q.EVIDENCE).filter("grounded").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("g"))
    x = run(spark, sf_dir, Q.RECORDS).select("id").join(told, "id", "left")
    kept = F.map_filter("g", lambda k, _: k.isin("amount", "close_date", "gender"))
    return x.select("id", F.col("g")["amount"].alias("amount"), F.coalesce(F.size(kept), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_max(F.map_values(F.map_filter("g", lambda k, _: k == "close_date"))), F.lit("none")).alias("latest"))


def archive_days(spark, sf_dir):
    """Days of archive time stamps, some of them broken."""
    d = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")
    stamp = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("2025"), F.lit("1399000000"))).otherwise(F.concat(d, F.lit("120000")))
    return run(spark, sf_dir, "SELECT o_orderkey, o_orderdate FROM orders").select("o_orderkey", T.archive_day(stamp).alias("day"))


_FUNCTIONS = (needs_enrichment, enrichment_links, frontier_crawl, newest_cycle, merge_missing_fields, merge_eligibility, structured_criteria, archive_comparison, archive_candidates, already_baselined, recheck_pages, page_routing, export_csv, export_nested, param_sql, set_intersect_words, upsert_evidence, source_updates, new_record_ids, field_map, archive_days)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _FUNCTIONS}




def oracle_sql() -> dict[str, str]:
    words = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{1}], w)))"
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return {
        "needs_enrichment": f"""{Q._FACTS} SELECT id, concat_ws(',', CASE WHEN close_date IS NULL THEN 'close_date' END, CASE WHEN app IS NULL THEN 'application_url' END, CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN eligible < 3 THEN 'eligibility' END) AS lacking
            FROM own WHERE close_date IS NULL OR app IS NULL OR amount IS NULL OR eligible < 3""",
        "frontier_crawl": """SELECT url, level, via FROM (SELECT concat('p', lpad(CAST(n AS VARCHAR), 9, '0')) AS url, CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 1 WHEN n <= 12 THEN 2 ELSE 3 END AS level, CASE WHEN n > 0 THEN concat('p', lpad(CAST((n - 1) // 3 AS VARCHAR), 9, '0')) END AS via
            FROM range(30) r(n)) t WHERE via IS NULL OR CAST(substr(via, 2) AS BIGINT) IN (SELECT page_id FROM pages)""",
        "newest_cycle": """SELECT o_custkey, o_orderkey, cycle FROM (SELECT o_custkey, o_orderkey, cycle, row_number() OVER (PARTITION BY o_custkey ORDER BY cycle DESC, o_orderkey) AS r
            FROM (SELECT o_custkey, o_orderkey, CAST(greatest(CASE WHEN o_orderkey % 3 = 2 THEN 0 WHEN year(o_orderdate) + 9 >= 2000 THEN year(o_orderdate) + 9 ELSE 0 END, CASE WHEN o_orderkey % 2 = 0 THEN greatest(year(CAST(o_orderdate AS DATE) + 3653), 2000 + month(CAST(o_orderdate AS DATE) + 3653)) ELSE 0 END) AS INT) AS cycle FROM orders) a) b WHERE r = 1""",
        "merge_missing_fields": f"""SELECT id, field, CASE WHEN grounded THEN value ELSE concat('new ', coalesce(value, 'x')) END AS value, NOT grounded AS filled FROM ({Q.EVIDENCE}) e WHERE grounded OR (id % 2 = 0 AND field <> 'name')""",
        "merge_eligibility": f"SELECT id, CAST(3 AS BIGINT) AS n, 'female' AS gender, concat('L', id % 5) AS level, CAST(id % 30 AS VARCHAR) AS max_age FROM ({Q.RECORDS}) r",
        "structured_criteria": f"""SELECT id, CASE WHEN id % 4 = 0 THEN CAST(250000 AS BIGINT) END AS max_family_income_inr, CASE WHEN id % 4 = 1 THEN CAST(60 AS DOUBLE) END AS min_percentage, CASE WHEN id % 4 = 2 THEN CAST(27 AS BIGINT) END AS max_age,
            CASE WHEN id % 4 < 2 AND id % 3 <> 2 THEN 'female' END AS gender, CASE id % 3 WHEN 0 THEN 'SC' WHEN 1 THEN 'SC,OBC' END AS categories, CASE WHEN id % 3 <> 1 THEN 'UG' END AS levels, 'Kerala' AS states FROM ({Q.RECORDS}) r""",
        "archive_comparison": f"""SELECT concat(id, '/', field) AS id, field, old_value, new_value FROM ({Q.CHANGES}) x WHERE id % 7 <> 0 AND (c = 6 AND field <> 'documents' OR c = 5 AND field = 'close_date')""",
        "archive_candidates": f"""{Q._FACTS} SELECT official_url, n FROM (SELECT official_url, owns, CAST((close_date IS NOT NULL)::INT + (amount IS NOT NULL)::INT + (income_limit IS NOT NULL)::INT AS BIGINT) AS n FROM own) z WHERE owns AND n > 0 ORDER BY n DESC, official_url LIMIT 40""",
        "already_baselined": "SELECT page_id FROM pages WHERE page_id % 3 = 0",
        "recheck_pages": """SELECT url, CASE WHEN k % 10 <> 9 AND k % 5 <> 0 AND k % 7 = 0 THEN concat('h', k + 1) ELSE concat('h', k) END AS content_hash, CAST(CASE WHEN k % 10 = 9 THEN k % 3 WHEN k % 5 = 0 THEN k % 3 + 1 ELSE 0 END AS INT) AS fail_count,
            CASE WHEN k % 10 = 9 THEN 'skip' WHEN k % 5 = 0 THEN 'failed' WHEN k % 7 <> 0 AND k % 4 <> 3 THEN 'confirm' ELSE 'extract' END AS action FROM (SELECT url, min(page_id) AS k FROM pages GROUP BY url) t""",
        "page_routing": f"SELECT id, CASE WHEN id % 5 = 0 THEN 'extracted' WHEN id % 3 = 0 THEN 'still named' ELSE 'missing' END AS way, CAST(CASE WHEN id % 5 <> 0 AND id % 3 <> 0 THEN missing_runs + 1 ELSE 0 END AS INT) AS missing_runs FROM ({Q.RECORDS}) r",
        "export_csv": f"SELECT id, concat(name, ', \"so called\"', chr(10), 'of ', topic) AS name, close_date, CAST(confidence AS DOUBLE) AS confidence, missing_runs FROM ({Q.RECORDS}) r",
        "export_nested": f"""SELECT r.id, r.name, CAST(9 AS BIGINT) AS fields, e.amount, e.gender_grounded, CASE WHEN r.id % 2 = 0 THEN concat(r.topic, ' 1;', r.topic, ' 2;', r.topic, ' 3') END AS history FROM ({Q.RECORDS}) r
            JOIN (SELECT id, max(value) FILTER (field = 'amount') AS amount, bool_or(grounded) FILTER (field = 'gender') AS gender_grounded FROM ({Q.EVIDENCE}) x GROUP BY id) e ON e.id = r.id""",
        "param_sql": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000",
        "set_intersect_words": f"SELECT unnest({words.format('p_name', stop)}) AS word FROM part INTERSECT SELECT unnest({words.format('text', stop)}) AS word FROM documents WHERE text IS NOT NULL",
        "upsert_evidence": f"SELECT id, field, CASE WHEN id % 3 = 0 THEN concat('v2 ', coalesce(value, '')) ELSE value END AS value, CASE WHEN id % 6 = 0 THEN 'fresh quote' ELSE quote END AS quote FROM ({Q.EVIDENCE}) e",
        "source_updates": f"SELECT url, CAST(fail_count + CASE WHEN http_status = 404 THEN 1 ELSE 0 END AS INT) AS fail_count, CASE WHEN http_status = 404 THEN 'link [duplicate]' ELSE 'link' END AS discovered_via FROM ({Q.SOURCES}) s",
        "new_record_ids": "SELECT k, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (ORDER BY k) AS id FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) t",
        "field_map": f"""SELECT r.id, max(e.value) FILTER (e.grounded AND field = 'amount') AS amount, count(*) FILTER (e.grounded AND field IN ('amount', 'close_date', 'gender')) AS n, coalesce(max(e.value) FILTER (e.grounded AND field = 'close_date'), 'none') AS latest
            FROM ({Q.RECORDS}) r LEFT JOIN ({Q.EVIDENCE}) e ON e.id = r.id GROUP BY r.id""",
        "archive_days": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    }
