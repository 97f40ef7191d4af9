"""License scan by ordered signature rules (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

#: A word of lower-cased text: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Families of licenses, each: label, keyword that every text with it holds, pattern of its name in words, its versions.
# Patterns are matched against words joined by single spaces.
_FAMILIES = [
    ("apache", "apache", "apache", ["1 0", "1 1", "2 0"]),
    ("mit", "mit", "mit", [""]),
    ("bsd", "bsd", "bsd", ["2 clause", "3 clause", "4 clause", "0 clause"]),
    ("gpl", "gnu", "gnu general public", ["1", "2", "3"]),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", ["2 1", "3"]),
    ("lgpl", "library", "(?:gnu )?library general public", ["2"]),
    ("agpl", "affero", "(?:gnu )?affero general public", ["1", "3"]),
    ("gfdl", "documentation", "(?:gnu )?free documentation", ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", "mozilla public", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", "eclipse public", ["1 0", "2 0"]),
    ("edl", "eclipse", "eclipse distribution", ["1 0"]),
    ("cddl", "common development", "common development and distribution", ["1 0", "1 1"]),
    ("cpl", "common public", "common public", ["1 0"]),
    ("ipl", "ibm", "ibm public", ["1 0"]),
    ("apsl", "apple", "apple public source", ["1 0", "1 1", "1 2", "2 0"]),
    ("afl", "academic", "academic free", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("osl", "open software", "open software", ["1 0", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic", "artistic", ["1 0", "2 0"]),
    ("boost", "boost", "boost software", ["1 0"]),
    ("isc", "isc", "isc", [""]),
    ("zlib", "zlib", "zlib", [""]),
    ("unlicense", "unlicense", "unlicense", [""]),
    ("wtfpl", "what the", "do what the fuck you want to public", ["2"]),
    ("eupl", "european", "european union public", ["1 0", "1 1", "1 2"]),
    ("cecill", "cecill", "cecill", ["1 0", "1 1", "2 0", "2 1"]),
    ("ofl", "open font", "(?:sil )?open font", ["1 0", "1 1"]),
    ("odbl", "open database", "open database", ["1 0"]),
    ("odc-by", "open data commons", "open data commons attribution", ["1 0"]),
    ("pddl", "public domain dedication", "public domain dedication and", ["1 0"]),
    ("python", "python", "python software foundation", ["2"]),
    ("php", "php", "php", ["3 0", "3 01"]),
    ("ruby", "ruby", "ruby", [""]),
    ("postgresql", "postgresql", "postgresql", [""]),
    ("openssl", "openssl", "openssl", [""]),
    ("ms-pl", "microsoft", "microsoft public", [""]),
    ("ms-rl", "microsoft", "microsoft reciprocal", [""]),
    ("sleepycat", "sleepycat", "sleepycat", [""]),
    ("bsl", "business source", "business source", ["1 0", "1 1"]),
    ("sspl", "server side", "server side public", ["1"]),
    ("elastic", "elastic", "elastic", ["1 0", "2 0"]),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source", [""]),
    ("vsl", "vovida", "vovida software", ["1 0"]),
    ("zpl", "zope", "zope public", ["1 1", "2 0", "2 1"]),
    ("w3c", "w3c", "w3c software(?: notice and)?", [""]),
    ("qpl", "q public", "q public", ["1 0"]),
    ("lppl", "latex", "latex project public", ["1 0", "1 1", "1 2", "1 3"]),
]
# Creative Commons: label, words after "by" in the short form, words after "attribution" in the long form; versions.
_CC = [("cc-by", "", ""), ("cc-by-sa", " sa", " share ?alike"), ("cc-by-nd", " nd", " no ?deriv(?:atives|s)"), ("cc-by-nc", " nc", " non ?commercial"), ("cc-by-nc-sa", " nc sa", " non ?commercial share ?alike"), ("cc-by-nc-nd", " nc nd", " non ?commercial no ?deriv(?:atives|s)")]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Rules that stand by themselves: label, keyword, pattern.
_SINGLE = [
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "(?:copyright (?:c )?(?:[0-9]{4} )?)?all rights reserved"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "no rights reserved", "no rights reserved"),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the software is provided as is", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "the software is provided as is and the author", "the software is provided as is and the author disclaims all warranties"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "endorse or promote products", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("apache", "you may not use this file except in compliance", "you may not use this file except in compliance with the license"),
    ("apache", "apache org licenses", "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("mpl", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl", "lesser general public", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc-by", "creative commons", "this work is licensed under a creative commons attribution"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost", "distributed under the boost software license version 1 0"),
    ("zlib", "provided as is without any", "this software is provided as is without any express or implied warranty"),
    ("gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution) (?:of this (?:file|work) )?(?:is )?(?:strictly )?prohibited"),
    ("copyright", "copyright", "copyright (?:c )?[0-9]{4}"),
]
# Short names in identifiers: label, keyword, short name in words.
_SHORT = [("gpl", "gpl", "gpl"), ("lgpl", "lgpl", "lgpl"), ("agpl", "agpl", "agpl"), ("mpl", "mpl", "mpl"), ("epl", "epl", "epl"), ("cddl", "cddl", "cddl"), ("apache", "apache", "apache"), ("bsd", "bsd", "bsd"), ("mit", "mit", "mit"), ("eupl", "eupl", "eupl"), ("ofl", "ofl", "ofl"), ("afl", "afl", "afl"), ("osl", "osl", "osl")]


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern), best first: full notices, then names with a version, names, and bare mentions."""
    notice, versioned, named, bare = [], [], [], []
    for label, word, name, versions in _FAMILIES:
        full = f"(?:the )?{name}(?: license| licence)"
        notice.append((label, word, f"licensed under (?:the terms of )?{full}"))
        notice.append((label, word, f"(?:released|distributed|available|published) under (?:the terms of )?{full}"))
        for v in versions:
            if v:
                versioned.append((label, word, f"{name}(?: license| licence)?(?: version| v)? ?{v}"))
                versioned.append((label, word, f"licensed under (?:the )?{name}(?: license| licence)?(?: version| v)? ?{v}"))
        named.append((label, word, full))
    for label, short, long in _CC:
        versioned += [(label, "cc by" + short, f"cc by{short} {v}") for v in _CC_VERSIONS]
        versioned += [(label, "creative commons", f"creative commons attribution{long}(?: (?:international|unported|generic))? (?:license )?{v}") for v in _CC_VERSIONS]
        named += [(label, "cc by" + short, f"cc by{short}"), (label, "creative commons", f"creative commons attribution{long}")]
    for label, word, short in _SHORT:
        notice.append((label, word, f"spdx license identifier {short}(?: [0-9]+)*(?: only| or later)?"))
        bare.append((label, word, f"{short} (?:license|licence|v?[0-9](?: [0-9])?)"))
    return [(i, *r) for i, r in enumerate([*notice, *versioned, *named, *_SINGLE, *bare])]


def _words(text: Column) -> Column:
    """The words of the lower-cased (A-Z) text joined by single spaces, with a space on either side."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def scan(docs: DataFrame, table: list[tuple[int, str, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, detections): documents has the result columns of licensed(); detections those that stand: __rid, label, priority, start, stop (in words text).

    A union of all keywords selects texts; each rule runs only on texts that hold its keyword.  Rules are tried in order of
    priority: a detection stands unless it overlaps, contains or is contained in one that stands already; of the same rule the one that
    starts first does.  So one that falls to a better detection suppresses nothing itself.
    """
    table = rules() if table is None else table
    spark = docs.sparkSession
    keywords = sorted({r[2] for r in table} | set(BASE))
    extra = [c for c in docs.columns if c not in ("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    kept = [F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)]  # names of docs cannot meet the names used here
    rows = numbered(docs.select(*kept, F.coalesce("text", F.lit("")).alias("__t")), "__rid")
    # Words joined by single spaces; a text has as many words as it has spaces then, less one.
    rows = rows.withColumn("__w", F.concat(F.lit(" "), F.trim(_words(F.col("__t"))), F.lit(" "))).drop("__t")
    n_words = F.when(F.col("__w") == "  ", 0).otherwise(F.length("__w") - F.length(F.replace("__w", F.lit(" "))) - 1).cast("long")
    gate = F.lit(False)
    for k in keywords:
        gate = gate | F.contains("__w", F.lit(k))
    rows = cut(rows.withColumn("__n", n_words).withColumn("__w", F.when(gate, F.col("__w"))))  # texts without a keyword are not in it
    held = rows.filter(F.col("__w").isNotNull()).select("__rid", "__w")

    # Base places: each phrase's starts in words.  A place starts after a space, so overlaps with the next one are found too.
    def places(phrase: str) -> Column:
        parts = F.split(F.col("__w"), f"(?<=\\x20)(?={phrase.replace(' ', chr(92) + 'x20')}\\x20)", -1)
        words = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "))))
        return words

    found = {label: F.when(F.contains("__w", F.lit(f" {phrase} ")), places(phrase)) for phrase, label in BASE.items()}
    base = held.select("__rid", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), c.alias("steps")) for label, c in found.items()])).alias("b")).filter("b.steps IS NOT NULL")
    base = base.select("__rid", "b.label", F.posexplode("b.steps").alias("i", "step"))
    along = Window.partitionBy("__rid", "label").orderBy("i")
    base = base.select("__rid", "label", (F.sum("step").over(along) - 1).cast("long").alias("at"))
    base = base.groupBy("__rid").agg(F.count(F.lit(1)).alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"), F.array_sort(F.collect_set("label")).alias("__base"))

    rule = F.broadcast(spark.createDataFrame(table, "priority int, label string, keyword string, pattern string"))  # a fixed list
    asked = F.filter(F.array(*[F.lit(k) for k in sorted({r[2] for r in table})]), lambda k: F.contains(F.col("__w"), k))
    tried = held.select("__rid", "__w", F.explode(asked).alias("keyword")).join(rule, "keyword")
    whole = "concat('(?<=\\\\x20)', pattern, '(?=\\\\x20)')"
    hits = tried.withColumn("m", F.expr(f"regexp_extract_all(__w, {whole}, 0)")).filter(F.size("m") > 0)
    hits = hits.select("__rid", "label", "priority", F.length("__w").alias("of"), F.posexplode(F.arrays_zip("m", F.expr(f"split(__w, {whole}, -1)").alias("p"))).alias("i", "s")).filter("s.m IS NOT NULL")
    # Where a match ends: what lies in front of it and all matches up to it.
    ends = F.sum(F.length("s.p") + F.length("s.m")).over(Window.partitionBy("__rid", "priority").orderBy("i"))
    spans = hits.select("__rid", "label", "priority", "of", (ends - F.length("s.m")).cast("int").alias("start"), ends.cast("int").alias("stop"))

    # Overlapping detections form islands; each is settled by itself, in order of priority.
    before = F.max("stop").over(Window.partitionBy("__rid").orderBy("start", "stop", "priority").rowsBetween(Window.unboundedPreceding, -1))
    order = Window.partitionBy("__rid").orderBy("start", "stop", "priority")
    spans = spans.withColumn("new", F.coalesce(before <= F.col("start"), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    spot = F.struct("priority", "start", "stop", "label")
    islands = spans.groupBy("__rid", "island").agg(F.first("of").alias("of"), F.array_sort(F.collect_set(spot)).alias("all"))
    none = F.array().cast("array<struct<priority:int,start:int,stop:int,label:string>>")

    def settle(stand: Column, x: Column) -> Column:
        free = ~F.exists(stand, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
        return F.when(free, F.array_append(stand, x)).otherwise(stand)

    stand = islands.select("__rid", "of", F.explode(F.aggregate("all", none, settle)).alias("s"))
    detections = cut(stand.select("__rid", "of", "s.label", "s.priority", "s.start", "s.stop"))
    summed = detections.groupBy("__rid").agg(F.collect_set("label").alias("__found"), F.sum(F.col("stop") - F.col("start")).alias("__covered"), F.first("of").alias("__of"))
    empty = F.array().cast("array<string>")
    joined = rows.drop("__w").join(base, "__rid", "left").join(summed, "__rid", "left")
    labels = F.array_sort(F.array_union(F.coalesce("__base", empty), F.coalesce("__found", empty)))
    # One half for any detection, the other half for the part of the text that detections cover.
    value = F.when(F.size(labels) > 0, F.lit(0.5) + F.lit(0.5) * F.least(F.lit(1.0), F.coalesce(F.col("__covered") / F.col("__of"), F.lit(0.0)))).otherwise(F.lit(0.0))
    out = joined.select(
        *[F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)], F.col("__n").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("__base", empty), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), value.alias("score"),
    )
    return out, detections


def licensed(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs (its other columns stay, the text goes).

    Null and empty texts have no words and no labels and score 0.  Rows are independent: repeated rows, nulls in other columns and ties
    change nothing; an empty table gives an empty result; columns of docs with names of added columns give way.
    """
    return scan(docs)[0]
