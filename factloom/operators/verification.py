"""Rules over records and their evidence as DataFrame functions: sources, ownership, grounding by field, changes, status and score.

Tables: records (id, name, official_url, close_date, confidence, verification_status, missing_runs), evidence (id, field, value, quote, source_url,
grounded, raw_value), sources (url, source_type, http_status, fail_count, content_hash), texts (url, text, runs).  Everything a rule
compares with the day of the run takes that day as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import rules as R
from ..functions import text as T

# Points of the checks, penalties, thresholds, days, fields.
POINTS = {"official_source": 25.0, "present_on_official_page": 15.0, "application_url": 10.0, "eligibility_grounded": 15.0, "deadline_grounded": 10.0, "amount_grounded": 5.0, "freshness": 10.0, "extraction_consistency": 5.0, "field_traceability": 5.0}
PENALTIES = {"conflicting_official_source": -15.0, "aggregator_only": -30.0}
VERIFIED_FROM, EXPIRING_DAYS, STALE_RUNS, FRESH_BEFORE, FRESH_AFTER, TWIN_FLOOR = 95.0, 15, 2, 360, 540, 90.0
ELIGIBILITY = ["income_limit", "category", "education_level", "academic_req", "gender", "age_limit", "domicile", "institution_req", "courses", "disability", "eligibility_summary"]
COMPARED, DATE_FIELDS, NUMERIC_FIELDS = ["close_date", "amount", "income_limit"], ["open_date", "close_date"], ["amount", "income_limit", "age_limit", "academic_req"]
OFFICIAL = ["government", "university", "corporate_csr", "foundation_trust"]
# Words and patterns of the rules.
FOUNDATION_LABEL = r"foundation|trust|charitable|educationalsociety|fund"
CSR_PATH = r"/(csr|corporate-social-responsibility|sustainability)\b"
GENERIC_PROVIDER = "foundation trust group limited education educational india indian companies company implemented along with the private ltd and for society charitable national bank".split()
GENERIC_SITE = GENERIC_PROVIDER + "university institute college global".split()
GOVERNMENT_NAME = r"(?i)\b(national(?! institute)|central sector|pre[- ]?matric|post[- ]?matric|pm|pradhan mantri|prime minister'?s?|ministry|nmms|government|govt|top class education|yasasvi|yashasvi|ugc|aicte|icmr|icar|dst|csir|inspire|ishan uday)\b"
COMMENTARY_PATH = r"(?i)/(blogs?|news|articles?|examinfo|posts?)/|/(top|best)[-_]\d+[-_]|list[-_]of[-_]"
ROLLING = r"(?i)(open throughout the year|throughout the year|rolling basis|all round the year|no last date|applications? (are|is) accepted (at )?any ?time)"
GENDERS = {"female": ["girl", "girls", "women", "woman", "female", "daughter", "lady"], "male": ["boy", "boys", "men", "male"], "any": ["all students", "boys and girls", "both", "any gender", "all genders"]}


@dataclass(frozen=True)
class Profile:
    """What is known of sites: third-party ones, suffixes of governments and universities, providers' domains and their kinds, portals."""

    third_party: tuple[str, ...] = ()
    government: tuple[str, ...] = ()
    university: tuple[str, ...] = ()
    known: dict[str, str] = field(default_factory=dict)
    portals: tuple[str, ...] = ()


def _under(host: Column, domains: tuple[str, ...] | list[str]) -> Column:
    """Whether a host is one of domains or below one: the endings of the host, label by label, are looked up."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.arrays_overlap(tails, F.array(*[F.lit(d) for d in domains])) if domains else F.lit(False)


def _ends(host: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | host.endswith(s)
    return out


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)


def names_itself(host: Column, text: Column) -> Column:
    """Whether the first label of a host, without its generic ending, is in the beginning of a page's text, signs and spaces aside."""
    label = F.split_part(host, F.lit("."), F.lit(1))
    core = F.regexp_replace(label, "(foundation|trust|india|org)$", "")
    core = F.when(core == "", label).otherwise(core)
    said = F.regexp_replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 20000)), "[^a-z0-9]", "")
    return (F.length(core) >= 4) & F.contains(said, core)


def classify(url: Column, text: Column, profile: Profile, host: Column | None = None) -> Column:
    """(kind, official, reason) of a source, first rule that holds; the page must name its site for rules that go by words.  host: the address's domain, where it is told already."""
    host = T.domain(url) if host is None else host
    named = names_itself(host, text)
    told = F.lit("unknown"), F.lit("could not be confirmed as an official provider")
    kinds = F.lit(None).cast("string")
    for d, kind in sorted(profile.known.items(), key=lambda x: -len(x[0])):
        kinds = F.coalesce(kinds, F.when(_under(host, [d]), kind))
    steps = [
        (_under(host, profile.third_party), F.lit("aggregator"), "is a known aggregator/news/social site"),
        (_ends(host, profile.government), F.lit("government"), "is a government domain"),
        (_ends(host, profile.university), F.lit("university"), "is an academic domain"),
        (kinds.isNotNull(), kinds, "is a known provider domain"),
        (F.split_part(host, F.lit("."), F.lit(1)).rlike(FOUNDATION_LABEL) & named, F.lit("foundation_trust"), "is a foundation/trust site that names itself"),
        (F.lower(path_of(url)).rlike(CSR_PATH) & named, F.lit("corporate_csr"), "hosts a CSR section and names itself"),
    ]
    kind, why = told
    for holds, k, reason in reversed(steps):
        kind, why = F.when(holds, k).otherwise(kind), F.when(holds, reason).otherwise(why)
    return F.struct(kind.alias("kind"), kind.isin(*OFFICIAL).alias("official"), F.concat(host, F.lit(" "), why).alias("reason"))


def _tokens(text: Column, least: int, without: list[str]) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0)), F.array(*[F.lit(w) for w in without]))


def inferred_type(name: Column) -> Column:
    return F.when(name.rlike(GOVERNMENT_NAME), "government")


def provider_names_site(provider: Column, url: Column) -> Column:
    site = F.translate(T.domain(url), ".-", "")
    return F.exists(_tokens(provider, 3, GENERIC_SITE), lambda t: F.contains(site, t))


def owns(provider: Column, kind: Column, url: Column, name: Column) -> Column:
    """(owns, reason): whether the site of a record belongs to whoever runs the scheme; rules in order, the first that holds decides."""
    host, told = T.domain(url), R.provider_type(provider)
    inferred = inferred_type(name)
    given = F.coalesce(told, inferred)
    said = F.when(told.isNull(), F.concat(F.lit("(inferred from scheme name) "), given)).otherwise(provider)
    site = F.replace(host, F.lit("."), F.lit(""))
    mine = F.when(kind.isin("government", "university"), given == kind).otherwise(F.exists(_tokens(said, 4, GENERIC_PROVIDER), lambda t: F.contains(site, t)))
    head = F.concat(F.lit("provider '"), F.substring(said, 1, 60), F.lit("' ("), given, F.lit(")"))
    steps = [
        (~kind.isin(*OFFICIAL), False, F.concat(host, F.lit(" is a "), kind, F.lit(" site, not an official provider"))),
        (inferred.isNotNull() & (kind != "government"), False, F.concat(F.lit("scheme name marks a government scheme; "), host, F.lit(" ("), kind, F.lit(") only relays it - third-party page"))),
        ((kind != "government") & path_of(url).rlike(COMMENTARY_PATH) & ~provider_names_site(provider, url), False, F.concat(host, F.lit(" page is a blog/news/list article about the scheme, not its provider - third-party page"))),
        (given.isNull(), True, F.concat(F.lit("provider not named separately; scheme is published on official "), kind, F.lit(" site "), host)),
        (mine, True, F.concat(head, F.lit(" runs the "), kind, F.lit(" site "), host)),
    ]
    ok, why = F.lit(False), F.concat(head, F.lit(" does not own "), host, F.lit(" ("), kind, F.lit(") - third-party page"))
    for holds, value, reason in reversed(steps):
        holds = F.coalesce(holds, F.lit(False))
        ok, why = F.when(holds, value).otherwise(ok), F.when(holds, reason).otherwise(why)
    return F.struct(ok.alias("owns"), why.alias("reason"))


def _has_any(text: Column, terms: list[str]) -> Column:
    return text.rlike(r"\b(" + "|".join(terms) + r")\b")


def supported(name: Column, value: Column, quotes: Column, page: Column, links: Column) -> Column:
    """(ok, reason): whether quotes (an array) state a value, by the rule of the field called name."""
    whole = F.array_join(quotes, "\n")
    nq, nv, day = T.norm(whole), T.norm(value), T.parse_iso(value)
    is_date = F.array_contains(T.find_dates(whole), day)
    verbatim = F.contains(nq, nv)
    date_ok, date_why = F.when(day.isNotNull(), is_date).otherwise(verbatim), F.when(day.isNull(), F.when(verbatim, "non-date value quoted verbatim").otherwise("value is not an ISO date and not in quote")).when(is_date, "date found in quote").otherwise("date not present in quote")
    on_page = R.url_on_page(value, page, links)
    gender_ok, gender_why = F.lit(False), F.lit("unrecognised gender value")
    for g, terms in reversed(GENDERS.items()):
        # "female" holds the letters of "male", so the order of the kinds counts.
        is_g = F.contains(nv, F.lit(g))
        for t in terms:
            is_g = is_g | F.contains(nv, F.lit(t))
        hit = _has_any(nq, terms)
        gender_ok, gender_why = F.when(is_g, hit).otherwise(gender_ok), F.when(is_g, F.when(hit, f"gender term for '{g}' in quote").otherwise("gender not stated in quote")).otherwise(gender_why)
    is_name = name == "name"
    alike = F.when(F.contains(nq, nv) & is_name, 100.0).otherwise(fuzzy.partial(F.when(is_name, nv), F.when(is_name, nq)))
    share = R.overlap(value, whole)
    free_ok, free_why = F.coalesce(share >= 0.6, F.lit(False)), F.when(share.isNull(), "empty value").otherwise(F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("% of value words in quote")))
    numbers = T.numbers_supported(value, whole)
    ok = F.when(name.isin(*DATE_FIELDS), date_ok).when(name == "application_url", on_page).when(~numbers, False).when(name == "gender", gender_ok).when(is_name, alike >= 85).otherwise(free_ok)
    why = F.when(name.isin(*DATE_FIELDS), date_why).when(name == "application_url", F.when(on_page, "URL found on page").otherwise("URL not found on page")).when(~numbers, "value contains a number not in the quote").when(name == "gender", gender_why)
    why = why.when(is_name, F.concat(F.lit("name match "), F.round(alike).cast("int").cast("string"))).otherwise(free_why)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), why.alias("reason"))


def ground_field(name: Column, value: Column, quotes: Column, page: Column, links: Column) -> Column:
    """A claim as (value, quote, grounded, score, reason, raw_value): each of its first quotes must be on the page, and together they must support it."""
    v = F.trim(value)
    absent = value.isNull() | value.isin(R.NOT_STATED) | F.lower(v).isin("not specified", "n/a", "na")
    said = F.slice(F.filter(F.transform(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != "")), 1, R.QUOTES)
    is_url = name == "application_url"
    scores = [F.when(F.get(said, i).isNotNull() & ~is_url & ~absent, R.quote_in_page(F.get(said, i), page)) for i in range(R.QUOTES)]
    weakest = F.least(*scores)
    told = supported(name, v, said, page, links)
    ok = ~absent & told["ok"] & (is_url | (weakest >= R.QUOTE_FLOOR))
    ok = F.coalesce(ok, F.lit(False))
    joined = F.nullif(F.array_join(said, R.QUOTE_JOIN), F.lit(""))
    score = F.when(absent, 0.0).when(is_url, F.when(ok, 100.0).otherwise(0.0)).otherwise(F.coalesce(weakest, F.lit(0.0)))
    why = F.when(absent, "not stated on page").when(is_url, told["reason"]).when(F.size(said) == 0, "no evidence quote given -> rejected").when(weakest < R.QUOTE_FLOOR, F.concat(F.lit("quote not found on page (match "), F.round(weakest).cast("int").cast("string"), F.lit(")")))
    why = why.when(~told["ok"], F.concat(F.lit("quote found but "), told["reason"])).otherwise(told["reason"])
    quote = F.when(absent, F.lit(None)).when(is_url, F.coalesce(joined, v)).otherwise(joined)
    return F.struct(F.when(ok, v).alias("value"), quote.alias("quote"), ok.alias("grounded"), score.alias("score"), why.alias("reason"), F.when(~absent, v).alias("raw_value"))


def quote_there(quote: Column, page: Column) -> Column:
    """Whether every part of a joined quote reaches the floor on a page, given in normal form (T.norm); false without a quote."""
    parts = F.split(quote, f"\\Q{R.QUOTE_JOIN}\\E")
    there = [F.when(F.get(parts, i).isNotNull(), R.quote_in_norm(F.get(parts, i), page)) for i in range(R.QUOTES)]
    return F.coalesce(F.when(F.coalesce(quote, F.lit("")) != "", F.least(*there)), F.lit(False))


def diff_field(name: Column, old: Column, new: Column, still: Column, before: Column) -> Column:
    """What became of a field: a note, LATE_FILL for a value that the page had before too, or null for no change.

    old and new are structs (value, quote, grounded); still: whether the old quote is on the page; before: the page's text at the earlier snapshot, in normal form (null: none).
    A change needs changed evidence: while the old quote is still on the page, other words for it are no change.
    """
    old_value, new_value = F.when(old["grounded"], old["value"]), F.when(new["grounded"], new["value"])
    numbers = T.numbers_in(old_value) == T.numbers_in(new_value)
    alike = fuzzy.token_set(T.norm(old_value), T.norm(new_value)) >= 90
    return (
        F.when(old_value.isNull() & new_value.isNull(), F.lit(None).cast("string"))
        .when(old_value.isNull(), F.when(F.coalesce(before, F.lit("")).__ne__("") & quote_there(new["quote"], before), "LATE_FILL").otherwise("newly stated on the official page"))
        .when(new_value.isNull(), F.when(~still, "no longer stated on the official page"))
        .when(name.isin(*DATE_FIELDS), F.when(old_value != new_value, "date changed"))
        .when(still, F.lit(None).cast("string"))
        .when(name.isin(*NUMERIC_FIELDS), F.when(~numbers, "value changed"))
        .otherwise(F.when(~alike, "value changed"))
    )


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores: aligning quotes costs far more than moving them, and a table may come in few pieces."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def compared(old: DataFrame, new: DataFrame, pages: DataFrame, *kept: str) -> DataFrame:
    """One row per (id, field) of evidence old or new with both as structs (kept: further columns of them), still (the old quote is on the page), note and changed, and the page's columns but for its texts; inputs as apply_changes has them."""
    parts = ["value", "quote", "grounded", "source_url", *kept]
    a = old.filter("field <> 'name'").select("id", "field", F.struct(*parts).alias("old"))
    b = new.filter("field <> 'name'").select("id", "field", F.struct(*parts).alias("new"))
    # texts are brought into normal form once a page, not for every quote that is looked up
    read = pages.withColumns({"text": T.norm(F.col("text")), "before": T.norm(F.col("before"))})
    both = a.join(b, ["id", "field"], "full").join(read, "id")
    both = spread(both).withColumn("still", quote_there(F.col("old.quote"), F.col("text")))
    both = both.withColumn("note", diff_field(F.col("field"), F.col("old"), F.col("new"), F.col("still"), F.col("before"))).drop("text", "before")
    was, now = F.when(F.col("old.grounded"), F.col("old.value")), F.when(F.col("new.grounded"), F.col("new.value"))
    foreign = F.coalesce(F.col("old.source_url") != F.col("url"), F.lit(False)) & was.isNotNull() & now.isNull()
    return both.withColumn("changed", F.col("note").isNotNull() & ~foreign)


def apply_changes(old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per (id, field) of evidence old or new: note, logged, old_value, new_value, evidence (the quote to log), kept value.

    old and new: (id, field, value, quote, grounded, source_url); pages: (id, url, text, before), the records' own pages.  Names are not
    compared.  A value that came from another page is not lost because this one lacks it; late fills change the record but aren't logged.
    """
    was, now = F.when(F.col("old.grounded"), F.col("old.value")), F.when(F.col("new.grounded"), F.col("new.value"))
    both, changed = compared(old, new, pages), F.col("changed")
    logged = changed & (F.col("note") != "LATE_FILL")
    return both.select("id", "field", F.when(changed, F.col("note")).alias("note"), F.coalesce(logged, F.lit(False)).alias("logged"), was.alias("old_value"), now.alias("new_value"), F.when(now.isNotNull(), F.col("new.quote")).otherwise(F.col("old.quote")).alias("evidence"), F.when(changed, now).otherwise(was).alias("kept"))


def status(as_of: Column) -> Column:
    """(status, reason) of a record joined to its source: columns http_status, fail_count, missing_runs, close_date, verification_status, confidence."""
    close = F.when(F.col("close_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("close_date").try_cast("date"))
    fails, missing = F.coalesce("fail_count", F.lit(0)), F.coalesce("missing_runs", F.lit(0))
    day = close.cast("string")
    steps = [
        (F.col("http_status").isin(404, 410), "NO_LONGER_VERIFIABLE", F.concat(F.lit("official page returned HTTP "), F.col("http_status").cast("string"))),
        (fails >= STALE_RUNS, "NO_LONGER_VERIFIABLE", F.concat(F.lit("official page failed to load in "), fails.cast("string"), F.lit(" consecutive runs"))),
        (missing >= STALE_RUNS, "NO_LONGER_VERIFIABLE", F.concat(F.lit("scheme not found on its official page in "), missing.cast("string"), F.lit(" consecutive runs"))),
        (close < as_of, "EXPIRED", F.concat(F.lit("closing date "), day, F.lit(" has passed"))),
        (F.coalesce(F.col("verification_status") != "VERIFIED", F.lit(True)), "REVIEW_REQUIRED", F.concat(F.lit("confidence "), F.coalesce(F.col("confidence").cast("string"), F.lit("None")), F.lit(f" is below {VERIFIED_FROM}"))),
        (close <= F.date_add(as_of, EXPIRING_DAYS), "EXPIRING_SOON", F.concat(F.lit("closes on "), day, F.lit(f" (within {EXPIRING_DAYS} days)"))),
    ]
    name, why = F.lit("ACTIVE"), F.when(close.isNotNull(), F.concat(F.lit("verified, open until "), day)).otherwise(F.lit("verified, no closing date stated"))
    for holds, value, reason in reversed(steps):
        holds = F.coalesce(holds, F.lit(False))
        name, why = F.when(holds, value).otherwise(name), F.when(holds, reason).otherwise(why)
    return F.struct(name.alias("status"), why.alias("reason"))


def same_values(name: str, a: Column, b: Column) -> Column:
    """Whether two grounded values of a field agree; null if they can't be compared.  Dates by their text, others by a number in common."""
    if name.endswith("_date"):
        return a == b
    x, y = T.numbers_in(a), T.numbers_in(b)
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y))


def facts(records: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per record: its grounded values as a map, counts of claims, its source and whether this is the provider's own."""
    grounded = F.filter(F.collect_list(F.when(F.col("grounded"), F.struct("field", "value"))), lambda x: x.isNotNull())
    said = F.array_join(F.array_sort(F.collect_list(F.when(F.col("grounded"), F.concat_ws(" ", F.coalesce("quote", F.lit("")), F.coalesce("value", F.lit("")))))), " ")
    told = evidence.groupBy("id").agg(F.map_from_entries(grounded).alias("g"), F.count("raw_value").alias("claimed"), F.count_if(F.col("raw_value").isNotNull() & F.col("grounded")).alias("traced"), said.alias("said"))
    known = sources.select(F.col("url").alias("official_url"), "source_type", "http_status", "fail_count", F.lit(True).alias("known"))
    out = records.join(told, "id", "left").join(known, "official_url", "left")
    out = out.withColumn("kind", F.coalesce("source_type", F.lit("unknown"))).withColumn("g", F.coalesce("g", F.create_map().cast("map<string,string>")))
    return out.withColumn("own", owns(F.col("g")["provider"], F.col("kind"), F.col("official_url"), F.col("name")))


def stated(g: Column) -> Column:
    """The values by which twins agree, read out of a record's grounded ones once: dates as text, others as sorted distinct numbers."""
    return F.struct(*[(g[f] if f in DATE_FIELDS else F.array_sort(F.array_distinct(T.numbers_in(g[f])))).alias(f) for f in COMPARED])


def clashing(x: Column, y: Column) -> Column:
    """Fields in which two structs of stated values disagree, as same_values has it; one of eight constant lists, so no list is built for a pair."""
    sized = lambda f: (F.size(x[f]) > 0) & (F.size(y[f]) > 0)
    clash = [F.coalesce(x[f] != y[f] if f in DATE_FIELDS else sized(f) & ~F.arrays_overlap(x[f], y[f]), F.lit(False)) for f in COMPARED]

    def lists(i: int, found: list[str]) -> Column:
        if i == len(COMPARED):
            return F.array(*[F.lit(f) for f in found]).cast("array<string>")
        return F.when(clash[i], lists(i + 1, [*found, COMPARED[i]])).otherwise(lists(i + 1, found))

    return lists(0, [])


def _judged(pairs: DataFrame, *kept: str) -> DataFrame:
    """kept of pairs (x, y: stated values; owns_id, owns_other) with agrees, clash, owns_other and conflict."""
    pairs = pairs.withColumn("clash", clashing(F.col("x"), F.col("y")))
    agrees = F.size("clash") == 0
    return pairs.select(*kept, agrees.alias("agrees"), "clash", "owns_other", (F.col("owns_id") & F.col("owns_other") & ~agrees).alias("conflict"))


def twin_agreement(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (id, other) of records that describe one scheme: agrees, fields in conflict, and whether both are the providers' own pages."""
    sides = known.select("id", stated(F.col("g")).alias("x"), F.col("own.owns").alias("owns_id"))
    return _judged(pairs.join(sides, "id").join(sides.toDF("other", "y", "owns_other"), "other"), "id", "other")


def agreement_by(known: DataFrame, key: str) -> DataFrame:
    """twin_agreement of all pairs, both ways, of records equal in a column of known.  Records move once, by that column; pairs never do."""
    sides = known.select(F.col(key).alias("k"), "id", stated(F.col("g")).alias("x"), F.col("own.owns").alias("owns_id"))
    return _judged(sides.join(sides.toDF("k", "other", "y", "owns_other"), "k").filter("id <> other"), "id", "other")


def twin_key(name: Column) -> Column:
    """The tokens of a name key in order, by which records of one scheme are found."""
    return F.array_join(F.array_sort(F.split(T.name_key(F.coalesce(name, F.lit(""))), " ")), " ")


def _alike_groups(known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, groups, links): members (id, key, gid, owns) of groups with equal name keys, stated values and owns; groups (gid, key, x, owns, n, first, second) with
    their two smallest ids; links (a, b), both ways, of keys that are alike, and of each key with itself.  Records without a key are in no link."""
    from .similarity import similar_keys

    group = F.struct(twin_key(F.col("name")).alias("key"), stated(F.col("g")).alias("x"), F.col("own.owns").alias("owns"))
    members = known.select("id", group.alias("group")).withColumn("gid", F.md5(F.to_json("group"))).select("id", "gid", "group.*")
    rank = F.row_number().over(Window.partitionBy("gid").orderBy("id"))
    least = members.select("gid", "id").withColumn("r", rank).filter("r <= 2").groupBy("gid").agg(F.min("id").alias("first"), F.max(F.when(F.col("r") == 2, F.col("id"))).alias("second"))
    groups = members.groupBy("gid").agg(F.first(F.struct("key", "x", "owns")).alias("group"), F.count(F.lit(1)).alias("n")).select("gid", "group.*", "n").join(least, "gid")
    keys = members.select("key").filter("key <> ''").distinct()
    near = similar_keys(keys, TWIN_FLOOR).select("a", "b")
    return members.select("id", "key", "gid", "owns"), groups, near.union(near.select("b", "a")).union(keys.select("key", "key").toDF("a", "b"))


def twin_groups(known: DataFrame) -> DataFrame:
    """Pairs (id, other: the smallest ids of two groups of records, both ways and of each group with itself) whose name keys are equal or alike, with n and second of the
    other group, agrees, clash, owns_other and conflict.  A group is moved once for each key that is alike; pairs of groups are never moved."""
    _, groups, links = _alike_groups(known)
    one = groups.select(F.col("key").alias("a"), F.col("first").alias("id"), "x", F.col("owns").alias("owns_id"))
    two = groups.select(F.col("key").alias("b"), F.col("first").alias("other"), F.col("x").alias("y"), F.col("owns").alias("owns_other"), "n", "second")
    return _judged(one.join(links, "a").drop("a").join(two, "b"), "id", "other", "n", "second")


def twin_summary(known: DataFrame) -> DataFrame:
    """For each record with twins: agree (the first ids of groups that agree with it), conflicts (other, clash: the first ids of those that do not, both being the
    providers' own pages), n_agree, n_conflict and official_twin (smallest id of a twin that is the provider's own page).

    The groups of all keys alike to a key are first put together by their values; a group then meets each set of values once, so work goes with
    the different values stated for a scheme and names like it.  The lists are as long as the groups they name; counts do without them.
    """
    members, groups, links = _alike_groups(known)
    around = groups.select(F.col("key").alias("b"), "x", "owns", "n", "first").join(links, "b").groupBy("a", F.col("x").alias("y"), F.col("owns").alias("owns_other"))
    around = around.agg(F.sum("n").alias("n"), F.collect_list("first").alias("firsts"))
    met = _judged(groups.select(F.col("key").alias("a"), "gid", "x", F.col("owns").alias("owns_id")).join(around, "a"), "gid", "n", "firsts")
    found = met.groupBy("gid").agg(
        F.flatten(F.collect_list(F.when(F.col("agrees"), F.col("firsts")))).alias("others"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("conflict"), F.transform("firsts", lambda f: F.struct(f.alias("other"), F.col("clash").alias("clash"))))))).alias("conflicts"),
        (F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(0)) - 1).alias("n_agree"),  # all but the record itself
        F.sum(F.when(F.col("conflict"), F.col("n")).otherwise(0)).alias("n_conflict"),
        F.sum("n").alias("all"),
    )
    # of a key the two smallest ids of providers' own pages are enough: one of them is not the record
    two = lambda rows, key: rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter("r <= 2").select(key, "id")
    best = two(two(members.filter("owns").select("key", "id"), "key").join(links.withColumnRenamed("b", "key"), "key").select("a", "id"), "a")
    best = best.groupBy(F.col("a").alias("key")).agg(F.min("id").alias("o1"), F.max("id").alias("o2"))
    x = members.join(groups.select("gid", "first", "second").join(found.filter(F.col("all") > 1), "gid"), "gid").join(best, "key", "left")
    own = F.when(F.col("first") == F.col("id"), F.col("second")).otherwise(F.col("first"))
    agree = F.sort_array(F.array_compact(F.array_append(F.array_remove("others", F.col("first")), own)))
    official = F.nullif(F.when(F.col("o1") == F.col("id"), F.col("o2")).otherwise(F.col("o1")), F.col("id"))
    return x.select("id", agree.alias("agree"), "conflicts", "n_agree", "n_conflict", official.alias("official_twin"))


def score(records: DataFrame, evidence: DataFrame, sources: DataFrame, texts: DataFrame, profile: Profile, as_of: Column) -> DataFrame:
    """confidence, checks (check, points, max, reason), points (check, points), owns_source, official_twin and conflicts for each record, from eleven checks.

    texts: (url, text, runs), the latest text of a page and the number of runs that confirmed it.  Twins are records whose name keys are alike; reasons name
    the first record of each group of twins with the same values.
    """
    known = facts(records, evidence, sources)
    twins = twin_summary(known)
    x = known.join(texts.select(F.col("url").alias("official_url"), F.coalesce("text", F.lit("")).alias("page"), "runs"), "official_url", "left").join(twins, "id", "left")
    x = x.withColumn("page", F.coalesce("page", F.lit("")))
    g, owned = F.col("g"), F.col("own.owns")
    app, site = T.domain(g["application_url"]), T.domain(F.col("official_url"))
    fails, named = F.coalesce("fail_count", F.lit(0)), g["name"].isNotNull()
    present = named & F.coalesce("known", F.lit(False)) & (fails == 0)
    same, portal, gov = T.url_root(app) == T.url_root(site), _under(app, profile.portals), (F.col("kind") == "government") & _ends(app, profile.government)
    has_app = g["application_url"].isNotNull()
    eligible = F.filter(F.array(*[F.when(g[f].isNotNull(), F.lit(f)) for f in ELIGIBILITY]), lambda f: f.isNotNull())
    years = T.academic_years(as_of)
    lo, hi = F.date_sub(as_of, FRESH_BEFORE), F.date_add(as_of, FRESH_AFTER)

    def current(text: Column) -> Column:
        return F.exists(T.find_dates(text), lambda d: d.between(lo, hi)) | F.exists(years, lambda y: F.contains(text, y))

    first_year = F.regexp_extract(F.coalesce("name", F.lit("")), r"\b(20\d{2})(?:\s*[-–]\s*\d{2,4})?\b", 1)
    stale = (first_year != "") & (first_year.try_cast("int") < F.substring(F.get(years, 0), 1, 4).cast("int"))
    said = F.coalesce("said", F.lit(""))
    agree, agreed, conflicts = F.col("agree"), F.coalesce("n_agree", F.lit(0)) > 0, F.coalesce("n_conflict", F.lit(0))
    runs, claimed, traced = F.coalesce("runs", F.lit(0)), F.coalesce("claimed", F.lit(0)), F.coalesce("traced", F.lit(0))
    rolling = F.col("page").rlike(ROLLING)
    n = F.size(eligible)
    half = F.lit(0.5)

    def check(key: str, share: Column, reason: Column, given: Column | None = None) -> tuple[Column, Column]:
        most = POINTS.get(key, 0.0)
        points = F.round(share * F.lit(POINTS.get(key, PENALTIES.get(key))), 2).alias("points")
        both = F.struct(F.lit(key).alias("check"), points), F.struct(F.lit(key).alias("check"), points, F.lit(most).alias("max"), reason.alias("reason"))
        return both if given is None else tuple(F.when(given, c) for c in both)

    def yes(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    app_why = F.when(~has_app, "no application URL stated on the page").otherwise(F.concat(F.lit("apply link "), app, F.when(same, " is on the provider's domain").when(portal, " is a known scholarship portal").when(gov, " is a government portal").otherwise(" is on another domain (half points)")))
    fresh = F.when(stale, 0.0).when(current(said), 1.0).when(current(F.col("page")), 0.5).otherwise(0.0)
    checks = [
        check("official_source", yes(owned), F.col("own.reason")),
        check("present_on_official_page", yes(present), F.when(present, "scheme name found in latest snapshot of the source page").when(fails > 0, "source page failed to load in the latest crawl").otherwise("name not grounded")),
        check("application_url", F.when(~has_app, 0.0).when(same | portal | gov, 1.0).otherwise(half), app_why),
        check("eligibility_grounded", F.least(n, F.lit(3)) / 3.0, F.concat(n.cast("string"), F.lit(" eligibility fields grounded ("), F.coalesce(F.nullif(F.array_join(eligible, ", "), F.lit("")), F.lit("none")), F.lit("); 3 needed for full points"))),
        check("deadline_grounded", yes(g["close_date"].isNotNull() | rolling), F.when(g["close_date"].isNotNull(), F.concat(F.lit("closing date "), g["close_date"], F.lit(" quoted from page"))).when(rolling, "page states applications are open throughout / rolling").otherwise("no closing date stated on the page")),
        check("amount_grounded", yes(g["amount"].isNotNull()), F.when(g["amount"].isNotNull(), "benefit amount quoted from page").otherwise("benefit amount not stated")),
        check("freshness", fresh, F.when(stale, F.concat(F.lit("scheme is named for an old year ("), first_year, F.lit(")"))).when(fresh == 1.0, "scheme's own evidence has a current date/academic year").when(fresh == 0.5, "only the page (not the scheme text) shows a current date/year").otherwise("no current date or academic year found")),
        check("extraction_consistency", yes(agreed | (runs >= 2)), F.when(agreed, F.concat(F.lit("same scheme also found in record(s) ["), F.array_join(F.transform(agree, lambda i: i.cast("string")), ", "), F.lit("] with no conflicting key values"))).when(runs >= 2, F.concat(F.lit("same page content re-confirmed in "), runs.cast("string"), F.lit(" crawl runs"))).otherwise("seen in one source and one run so far - not yet corroborated")),
        check("field_traceability", F.when(claimed > 0, traced / claimed).otherwise(0.0), F.concat(traced.cast("string"), F.lit("/"), claimed.cast("string"), F.lit(" extracted values traced to quotes"))),
        check("conflicting_official_source", F.lit(1.0), F.concat(F.lit("another official source disagrees: "), F.array_join(F.transform("conflicts", lambda c: F.concat(F.lit("#"), c["other"].cast("string"), F.lit(" on "), F.array_join(c["clash"], ", "))), "; ")), conflicts > 0),
        check("aggregator_only", F.lit(1.0), F.concat(F.lit("evidence comes only from a third-party page"), F.when(F.col("official_twin").isNotNull(), F.concat(F.lit("; official record is #"), F.col("official_twin").cast("string"))).otherwise("; no official provider page found yet")), ~owned),
    ]
    # points stand by themselves, so that whoever asks for no reasons has no lists of twins built
    points, whole = ([c[i] for c in checks] for i in (0, 1))
    x = x.select("id", F.array_compact(F.array(*whole)).alias("checks"), F.array_compact(F.array(*points)).alias("points"), owned.alias("owns_source"), "official_twin", "conflicts")
    total = F.aggregate("points", F.lit(0.0), lambda s, c: s + c["points"])
    return x.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1)).withColumn("verification_status", F.when(F.col("confidence") >= VERIFIED_FROM, "VERIFIED").otherwise("REVIEW_REQUIRED"))


def same_key_pairs(records: DataFrame) -> DataFrame:
    """(id, other), both ways: records whose name keys have equal or alike sorted tokens.  All pairs of a group: for single schemes; twin_summary does without."""
    from .evidence import twins

    keyed = records.select("id", twin_key(F.col("name")).alias("key")).filter("key <> ''")
    near = twins(keyed, TWIN_FLOOR).select("a", "b")
    links = near.union(near.select("b", "a")).union(keyed.select("key", "key").distinct().toDF("a", "b"))
    other = keyed.select(F.col("key").alias("b"), F.col("id").alias("other"))
    return keyed.select("id", F.col("key").alias("a")).join(links, "a").join(other, "b").filter("id <> other").select("id", "other")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
