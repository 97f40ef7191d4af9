"""Column functions over text: normalisation, words, dates, numbers, addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content of their own.
STOP_WORDS = "the a an of and or for to in on by with is are be at as from any this that who which per".split()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once: for values that a lambda inside use looks at again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def norm(text: Column) -> Column:
    """Lower case, plain quotes and dashes, single spaces; null becomes empty."""
    t = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—− |", "''\"\"---  ")
    t = F.lower(F.replace(t, F.lit("₹"), F.lit(" rs ")))
    t = F.regexp_replace(t, r"(^|[^a-z0-9_])rs\s*\.", "$1rs ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_lines(text: Column) -> Column:
    """Spaces collapsed in each line; empty lines and lines equal to the line just before them (empty ones included) go."""
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " ​‌‍﻿", " "), r"\r\n?", "\n")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return bound(lines, lambda all_lines: F.array_join(F.filter(all_lines, lambda x, i: (x != "") & ((i == 0) | (x != F.get(all_lines, i - 1)))), "\n"))


def name_key(name: Column) -> Column:
    """A name without years, year ranges, brackets and signs, in normal form."""
    t = F.regexp_replace(norm(name), r"(^|[^a-z0-9_])(19|20)[0-9]{2}(\s*-\s*[0-9]{2,4})?($|[^a-z0-9_])", "$1 $4")
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def dedup_key(name: Column, url: Column) -> Column:
    """Like name_key, brackets kept, with the domain of url: the key by which records are one."""
    t = F.regexp_replace(norm(name), r"(^|[^a-z0-9_])(19|20)[0-9]{2}(\s*-\s*[0-9]{2,4})?($|[^a-z0-9_])", "$1 $4")
    return F.concat(F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " ")), F.lit("|"), domain(url))


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(norm(text), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


# How numbers and their units are written.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
UNITS = {"lakh|lakhs|lac|lacs": 1e5, "crore|crores|cr": 1e7}


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text; one followed by lakh or crore counts both plain and multiplied (to two places)."""
    t = norm(text)

    def number(x: Column) -> Column:
        return F.replace(x, F.lit(","), F.lit("")).cast("double")

    def scaled(unit: str, times: float) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"({NUMBER})\s*(?:{unit})\b"), F.lit(1))
        return F.transform(found, lambda x: F.round(number(x) * F.lit(times), 2))

    plain = F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), number)
    return F.array_sort(F.array_distinct(F.concat(plain, *[scaled(unit, times) for unit, times in UNITS.items()])))


def numbers_supported(value: Column, quote: Column) -> Column:
    """Whether each number of value is a number of quote; true without numbers."""
    return bound(numbers_in(quote), lambda have: F.forall(numbers_in(value), lambda a: F.exists(have, lambda b: F.abs(a - b) < 1e-6)))


# Beginnings of the months' names, in order.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# The four ways in which dates are written (M: a month's name), each with the places of year, month and day.
DATES = [
    (r"\b([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})\b", (3, 2, 1)),
    (r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b", (1, 2, 3)),
    (r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?(M)\.?,?\s+([0-9]{4})\b", (3, 2, 1)),
    (r"\b(M)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})\b", (3, 1, 2)),
]


def find_dates(text: Column) -> Column:
    """Distinct dates: day-first with . / -, year-first with -, and with month names; impossible ones are skipped."""
    t = F.lower(F.coalesce(text, F.lit("")))
    month = "(?:" + "|".join(MONTHS) + ")[a-z]*"

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    def month_no(x: Column) -> Column:
        return (F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(x, 1, 3))).cast("string")

    def parts(pattern: str, order: tuple[int, int, int], named: bool) -> Column:
        whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

        def one(x: Column) -> Column:
            y, m, d = (F.regexp_extract(x, pattern, i) for i in order)
            return date(y, month_no(m) if named else m, d)

        return F.transform(whole, one)

    found = F.concat(*[parts(pattern.replace("M", month), order, "M" in pattern) for pattern, order in DATES])
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def parse_iso(text: Column) -> Column:
    """The date that the first ten characters spell as yyyy-mm-dd, else null."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), head.try_cast("date"))


def domain(url: Column) -> Column:
    """The host in lower case without a leading www.; empty if there is none."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(F.lower(u), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """Trimmed, without fragment, without trailing slashes unless the path is empty or a slash; the query stays."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    has_path = u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]")
    return F.when(has_path, F.regexp_replace(u, "/+$", "")).otherwise(u)


def url_root(host: Column) -> Column:
    """The registered part of a host: its last three labels under a two-label public suffix of .in, else its last two."""
    parts = F.split(host, r"\.")
    n = F.when(host.rlike(r"\.(gov|nic|ac|edu|co|org|res|ernet)\.in$"), 3).otherwise(2)
    return F.when(F.size(parts) <= n, host).otherwise(F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def html_lines(html: Column) -> Column:
    """Visible text of a page: scripts, styles and page furniture go, tags end lines, common references are decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript|svg|iframe|form|nav|footer|header|title)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    return clean_lines(t)


def html_title(html: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), 1, 300)


def lcs_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (length a + length b): longest common subsequence by dynamic programming in higher-order functions."""

    def lcs(cells_b: Column) -> Column:
        def step(row: Column, x: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                best = F.when(F.get(cells_b, j) == x, F.coalesce(F.get(row, j - 1), F.lit(0)) + 1).otherwise(F.greatest(F.get(row, j), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))
                return F.array_append(acc, best)

            return F.aggregate(F.sequence(F.lit(0), F.size(cells_b) - 1), F.array().cast("array<int>"), cell)

        return F.coalesce(F.try_element_at(F.aggregate(F.split(a, ""), F.transform(cells_b, lambda _: F.lit(0)), step), F.lit(-1)), F.lit(0))

    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(bound(F.split(b, ""), lcs) * F.lit(200.0) / total)


def academic_years(day: Column) -> Column:
    """The years of teaching before, at and after a day, each as 2026-27, 2026-2027 and 2026–27; they begin in April."""
    start = F.when(F.month(day) >= 4, F.year(day)).otherwise(F.year(day) - 1)

    def spelled(y: Column) -> Column:
        a, b = y.cast("string"), (y + 1).cast("string")
        short = F.substring(b, 3, 2)
        return F.array(F.concat(a, F.lit("-"), short), F.concat(a, F.lit("-"), b), F.concat(a, F.lit("–"), short))

    return F.flatten(F.transform(F.sequence(start - 1, start + 1), spelled))


def has_word(token: Column, text: Column) -> Column:
    """Whether a token stands in a lower-cased text with no letter on either side."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![a-z])\Q"), token, F.lit(r"\E(?![a-z])")))


def cycle_year(*texts: Column) -> Column:
    """The latest year 20yy that texts name; 0 without one.  20yy-zz names 20zz as well, in a date just as in 2025-26."""
    whole = F.concat_ws(" ", *texts)
    plain = F.transform(F.regexp_extract_all(whole, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    ends = F.transform(F.regexp_extract_all(whole, F.lit(r"\b20[0-9]{2}\s*[-–]\s*([0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int") + 2000)
    return F.coalesce(F.array_max(F.concat(plain, ends)), F.lit(0))


def archive_day(stamp: Column) -> Column:
    """The day of an archive's fourteen-digit time stamp, null if it is none."""
    return F.try_to_timestamp(F.substring(stamp, 1, 8), F.lit("yyyyMMdd")).cast("date")
