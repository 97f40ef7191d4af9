"""Rules over names, links, providers and quotes as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fuzzy
from . import text as T

# Words and patterns that results depend on.
GENERIC_NAME_WORDS = """aicte ugc scholarship scholarships scheme schemes fellowship fellowships the for of and
in to students student national central sector india indian govt government ministry special programme program
award awards grant financial assistance higher education young merit means cum pg ug post pre matric metric
academic initiative initiatives skill skills holistic venture achievers research assets social service services
basis performance activities activity state board based other university institute college ideas category
union territories scheduled caste undergraduate postgraduate graduate doctoral girls women wards abled specially
students college universities support development""".split()
FILE_WORDS = "pdf doc docx html php aspx www http https".split()
GOVERNMENT = r"(?i)\b(ministry|department|dept|government|govt|directorate|commission|council|board|aicte|ugc|nta|icssr|icmr|csir|dst|welfare|national testing|state|union|central sector|nsfdc|nbcfdc)\b"
FOUNDATION = r"(?i)\b(foundation|trust|charitable|society|ngo)\b"
CORPORATE = r"(?i)\b(limited|ltd|bank|group|industries|pvt|private|enterprises|companies|company)\b"
UNIVERSITY = r"(?i)\b(university|institute|college|iit|nit|iiit|iisc|iiser|vidyalaya|vishwavidyalaya)\b"
FUNDING = r"(?i)scholarship|fellowship|financial (assistance|aid|support)|freeship|fee (waiver|concession|reimbursement)|tuition waiver|\bgrants?\b|\baward\b|bursary|stipend|chhatravritti|chhatravriti"
SKIPPED_FILES = r"(?i)\.(jpg|jpeg|png|gif|svg|zip|rar|docx?|xlsx?|pptx?|mp4|mp3)$"
TEST_HOSTS = r"(?i)^(uat|test|testing|staging|stage|demo|dev|beta|sandbox)[.\-\d]"
NOT_A_NAME = r"(?i)^(is|are|what|how|can|who|when|where|why|does|do|will|which|the|a|an|my|our|your|apply|check|get|top|best|list|latest|about|for|this|these|all)\b"
NAMES = r"\b([A-Z][\w&.'-]*(?:\s+[A-Za-z][\w&.'-]*){0,8}\s+(?:Scholarship|Fellowship)(?:\s+(?:Scheme|Programme|Program))?)\b"
NOT_STATED = ["", "[]", "null", "None"]
QUOTE_JOIN, QUOTES, QUOTE_FLOOR = " … ", 4, 90.0


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def distinctive_tokens(name: Column) -> Column:
    """Acronyms in brackets, then long words, that tell one name from others; in order, each once."""
    name = F.coalesce(name, F.lit(""))
    short = F.transform(F.regexp_extract_all(name, F.lit(r"\(([A-Za-z]{2,10})\)"), F.lit(1)), F.lower)
    words = F.concat(short, F.regexp_extract_all(F.lower(name), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(words, _words(GENERIC_NAME_WORDS + FILE_WORDS))


def names_in(text: Column, most: int = 8) -> Column:
    """Names of schemes in running text: title case up to the closing term, three to eight words, no questions; the first ones."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAMES), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    fit = F.filter(found, lambda x: F.size(F.split(x, " ")).between(3, 8) & ~x.rlike(NOT_A_NAME) & ~F.contains(x, F.lit("?")))
    return F.slice(F.array_distinct(fit), 1, most)


def provider_type(name: Column) -> Column:
    """Kind of a provider by its name, first rule that holds; null if none does."""
    gov = name.rlike(GOVERNMENT)
    kind = F.when(name.rlike(FOUNDATION), "foundation_trust").when(name.rlike(UNIVERSITY) & ~gov, "university")
    return kind.when(gov, "government").when(name.rlike(CORPORATE), "corporate_csr")


def is_funding(name: Column, amount_grounded: Column) -> Column:
    """Whether a name is that of an offer of money; the word scheme alone needs a grounded amount."""
    name = F.coalesce(name, F.lit(""))
    return name.rlike(FUNDING) | (name.rlike(r"(?i)\bscheme\b") & F.coalesce(amount_grounded, F.lit(False)))


def resolve(href: Column, url: Column) -> Column:
    """The address that href names on the page at url; steps . and .. are taken in the path of one that names no host."""
    page, base = F.regexp_replace(url, "[?#].*$", ""), F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)
    whole = F.when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(base, href)).when(href.startswith("?"), F.concat(page, href))
    whole = whole.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).otherwise(F.concat(F.regexp_replace(page, "([^/:])/[^/]*$", "$1"), F.lit("/"), href))
    head, tail = F.regexp_extract(whole, "^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(whole, r"([?#].*)$", 1)
    path = F.regexp_extract(whole, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    steps = F.split(F.regexp_replace(path, r"(/\.{1,2})$", "$1/"), "/")
    taken = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.array_append(done, s)))
    return F.when(~href.rlike("(?i)^([a-z][a-z0-9+.-]*:|//)") & path.rlike(r"/\.{1,2}(/|$)"), F.concat(head, F.array_join(taken, "/"), tail)).otherwise(whole)


# Attributes in double, single or no quotes.
_HREF = r"""(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def link_parts(html: Column, url: Column) -> Column:
    """Links of a page in order as (pos, href, anchor): absolute by the page's address, without fragments, http only."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<a\s{_HREF}[^>]*>.*?</a>"), F.lit(0))

    def one(tag: Column) -> Column:
        href = F.concat(*[F.regexp_extract(tag, rf"(?is)^<a\s{_HREF}", i) for i in (1, 2, 3)])
        href = F.replace(F.regexp_replace(href, r"^\s+|\s+$", ""), F.lit("&amp;"), F.lit("&"))
        anchor = F.trim(F.regexp_replace(F.regexp_replace(tag, r"(?s)<[^>]*>", " "), r"\s+", " "))
        return F.struct(href.alias("raw"), T.normalize_url(resolve(href, url)).alias("href"), F.substring(anchor, 1, 200).alias("anchor"))

    kept = F.filter(F.transform(tags, one), lambda x: ~x.raw.rlike("(?i)^(mailto:|tel:|javascript:|#)") & (x.raw != "") & x.href.startswith("http"))
    return F.transform(kept, lambda x, i: F.struct((i + 1).cast("long").alias("pos"), x.href.alias("href"), x.anchor.alias("anchor")))


def link_looks_relevant(href: Column, anchor: Column, keywords: str) -> Column:
    """A keyword in the anchor or in the address with - and _ as spaces, and no skipped kind of file."""
    return ~href.rlike(SKIPPED_FILES) & (anchor.rlike(keywords) | F.translate(href, "-_", "  ").rlike(keywords))


def quote_in_page(quote: Column, page: Column) -> Column:
    """0 to 100: how well a quote occurs in a page.  Only quotes that do not occur literally reach the fuzzy ratio."""
    q, p = T.norm(quote), T.norm(page)
    literal = F.contains(p, q)
    residue = ~literal & F.length(q).between(4, 600)
    fuzzy_score = fuzzy.partial(F.when(residue, q), F.when(residue, p))
    return F.when(F.length(q) < 4, 0.0).when(literal, 100.0).when(residue, fuzzy_score).otherwise(0.0)


def quote_reaches(quote: Column, page: Column) -> Column:
    """Whether quote_in_page reaches QUOTE_FLOOR; stretches of the page that keep too little of the quote aren't aligned."""
    return quote_in_norm(quote, T.norm(page))


def quote_in_norm(quote: Column, p: Column) -> Column:
    """quote_reaches for a page that is in normal form (T.norm) already, as where many quotes meet one page."""
    q = T.norm(quote)
    literal = F.contains(p, q)
    residue = ~literal & F.length(q).between(4, 600)
    return F.when(F.length(q) < 4, False).when(literal, True).when(residue, fuzzy.reaches(F.when(residue, q), F.when(residue, p), QUOTE_FLOOR)).otherwise(False)


def quote_still_there(parts: list[Column], page: Column) -> Column:
    """Whether every part of a quote reaches the floor on a page; false without parts."""
    return fuzzy.all_reach(F.array(*[T.norm(part) for part in parts]), T.norm(page), QUOTE_FLOOR) if parts else F.lit(False)


def overlap(value: Column, quote: Column) -> Column:
    """Share of the value's content words that the quote has; null without content words."""
    v = T.content_words(value)
    return F.size(F.array_intersect(v, T.content_words(quote))) / F.nullif(F.size(v), F.lit(0))


def value_supported(value: Column, quote: Column) -> Column:
    """Free-text values: every number is one of the quote's and at least 60 per cent of the content words are."""
    return T.numbers_supported(value, quote) & F.coalesce(overlap(value, quote) >= 0.6, F.lit(False))


def url_on_page(address: Column, page: Column, links: Column) -> Column:
    """Whether an address is written in a page's text or is one of its links; scheme, www. and trailing slashes do not count."""

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.rtrim(T.norm(x), F.lit("/")), "https?://", ""), r"^www\.", "")

    u = bare(address)
    written = (u != "") & F.contains(F.regexp_replace(T.norm(page), "https?://", ""), u)
    return written | F.exists(links, lambda x: bare(x) == u)


def ground(value: Column, quotes: Column, page: Column) -> Column:
    """A free-text claim as (value, grounded, score): each of its first quotes must be on the page, and together they must support it."""
    v = F.trim(value)
    absent = value.isNull() | value.isin(NOT_STATED) | F.lower(v).isin("not specified", "n/a", "na")
    said = F.slice(F.filter(F.transform(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != "")), 1, QUOTES)
    scores = [F.when(F.get(said, i).isNotNull(), quote_in_page(F.get(said, i), page)) for i in range(QUOTES)]
    weakest = F.coalesce(F.least(*scores), F.lit(0.0))
    ok = ~absent & (F.size(said) > 0) & (weakest >= QUOTE_FLOOR) & value_supported(v, F.array_join(said, "\n"))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, v).alias("value"), ok.alias("grounded"), F.when(absent, 0.0).otherwise(weakest).alias("score"))
