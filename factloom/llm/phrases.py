"""Phrase mining by hashed level-wise counting: buckets of the next length are counted during each pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Words of a phrase, at most; least frequency of a phrase; rows of each language in the result.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits of a bucket's number: bitmaps have 2^BITS bits (1 MB), counters of a task as many bytes.
BITS = 23
#: Counters that travel together.
CHUNK = 8192
#: Bytes of text that are counted together in a worker.
SLICE = 4 << 20
#: What ends a piece becomes a full stop of its own; tabs become spaces.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"........." + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _SPREAD
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Counter:
    """N-grams of one slice of text: ids of words (0 between pieces), hashes, and counts of those that the bitmaps let through."""

    def __init__(self, lang: str, tokens: list[bytes], old: int) -> None:
        vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
        vocabulary[b"."]
        self.ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
        self.words = list(vocabulary)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.word_hash = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)
        self.hashes = [self.word_hash[self.ids]]
        self.alive = [self.ids > 0]
        self.old = old  # tokens that only give the context of the rest

    def longer(self, keep: np.ndarray | None) -> None:
        """The next length: alive where both parts are (Apriori) and, if keep is given, the bucket's bit is set.  An n-gram is known by its last word's place."""
        h, k = self.hashes[-1], len(self.alive)
        longer = np.zeros_like(h)
        longer[k:] = h[k - 1 : -1] * _MIX + self.hashes[0][k:] if len(h) > k else 0
        alive = np.zeros(len(h), bool)
        alive[1:] = self.alive[-1][1:] & self.alive[-1][:-1]
        self.hashes.append(longer)
        self.alive.append(alive)
        self.kept(keep)

    def kept(self, keep: np.ndarray | None) -> None:
        """Only n-grams of the last length whose bit is set stay alive."""
        if keep is not None:
            at = np.flatnonzero(self.alive[-1])
            b = _buckets(self.hashes[-1][at], len(keep).bit_length() + 2)
            self.alive[-1][at] = (keep[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1

    def counted(self, bits: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(phrase, bucket, count) of the living n-grams of the last length, told apart by their words."""
        k = len(self.alive)
        at = np.flatnonzero(self.alive[-1])
        at = at[at >= self.old]
        code = self.ids[at - (k - 1)]
        for j in range(k - 2, -1, -1):
            if int(code.max(initial=0)) >= (1 << 62) // len(self.words):
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            code = code * len(self.words) + self.ids[at - j]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        spot = at[first]
        columns = [self.ids[spot - j].tolist() for j in range(k - 1, -1, -1)]
        return [b" ".join([self.words[i] for i in row]) for row in zip(*columns, strict=True)], _buckets(self.hashes[-1][spot], bits), counts

    def next_buckets(self, bits: int) -> np.ndarray:
        """Buckets of the n-grams one longer whose two parts live."""
        self.longer(None)
        at = np.flatnonzero(self.alive[-1])
        return _buckets(self.hashes[-1][at[at >= self.old]], bits)


def _slices(texts: Iterator[tuple[str, str | None]]) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, tokens, old) of at least SLICE bytes each where there are so many; the last words of a piece cut between two slices come again as old tokens."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)

    def tokens(raw: bytes) -> list[bytes]:
        return raw.lower().translate(_ENDS).replace(b".", b" . ").split()

    for lang, text in texts:
        raw = (text or "").encode()
        if len(raw) <= SLICE:
            held[lang].append(raw)
            size[lang] += len(raw) + 1
            if size[lang] >= SLICE:
                yield lang, tokens(b".".join(held.pop(lang))), 0
                size[lang] = 0
            continue
        start, before = 0, []
        while start < len(raw):
            stop = start + SLICE
            while stop < len(raw) and raw[stop] not in b" \t.,;:!?\n\x0b\x0c\r":
                stop += 1
            now = tokens(raw[start:stop])
            yield lang, before + now, len(before)
            before = (before + now)[-(LONGEST):]
            start = stop
    for lang, raws in held.items():
        yield lang, tokens(b".".join(raws)), 0


_PASS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int32()), ("f", pa.int64()), ("chunk", pa.int32()), ("counters", pa.binary())])


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _PASS], schema=_PASS)


def _pass(docs: DataFrame, k: int, exact: list, candidate, least: int, longest: int, bits: int) -> DataFrame:
    """Pass k over the texts: rows (lang, phrase, bucket, f) count living k-grams of a slice, rows (lang, f) the words of a slice in pass 1,
    rows (chunk, counters) the (k+1)-grams of each bucket (no further than least).

    exact: broadcast bitmaps of the frequent n-grams of lengths below k; candidate: of the frequent buckets of length k (None where k is 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << bits, np.uint8) if k < longest else None
        texts = ((lang, text) for b in batches for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True))
        for lang, tokens, old in _slices(texts):
            if len(tokens) <= old:
                continue
            c = Counter(lang, tokens, old)
            if k == 1:
                yield _rows(1, lang=pa.array([lang]), f=pa.array([int((c.ids[old:] > 0).sum())], pa.int64()))
            else:
                c.kept(exact[0].value)
                for j in range(2, k):
                    c.longer(exact[j - 1].value)
                c.longer(candidate.value)
            phrases, buckets, counts = c.counted(bits)
            for i in range(0, len(phrases), 20_000):
                some = slice(i, i + 20_000)
                n = len(phrases[some])
                yield _rows(n, lang=pa.array([lang] * n), phrase=pa.array(phrases[some], pa.binary()).cast(pa.string()), bucket=pa.array(buckets[some].astype(np.int32)), f=pa.array(counts[some].astype(np.int64)))
            if totals is not None:
                at, many = np.unique(c.next_buckets(bits), return_counts=True)
                totals[at] = np.minimum(totals[at] + np.minimum(many, least), least)
        if totals is not None:
            for i in range(0, 1 << bits, CHUNK):
                part = totals[i : i + CHUNK]
                if part.any():
                    yield _rows(1, chunk=pa.array([i // CHUNK], pa.int32()), counters=pa.array([part.tobytes()], pa.binary()))

    return docs.mapInArrow(run, "lang string, phrase string, bucket int, f long, chunk int, counters binary")


def _candidates(spark: SparkSession, counters: DataFrame, least: int, bits: int):
    """Broadcast bitmap of the buckets that were hit least times or more; the driver gets the bitmap alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, some in zip(batch["chunk"].to_pylist(), batch["counters"].to_pylist(), strict=True):
                part = np.frombuffer(some, np.uint8)
                held[chunk] = np.minimum(held[chunk] + np.minimum(part, least), least).astype(np.int16) if chunk in held else part.astype(np.int16)
        for chunk, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(part >= least, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    held = np.zeros(1 << (bits - 3), np.uint8)
    for row in counters.repartition("chunk").mapInArrow(run, "chunk int, bits binary").toLocalIterator():
        held[row.chunk * (CHUNK // 8) : (row.chunk + 1) * (CHUNK // 8)] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(held)


def _bitmap(spark: SparkSession, buckets: DataFrame, bits: int):
    """Broadcast bitmap of a column bucket; what reaches the driver is at most one word for each 64 bits."""
    words = buckets.groupBy(F.shiftright("bucket", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("word"))
    held = np.zeros(1 << (bits - 6), np.int64)
    for row in words.collect():
        held[row["at"]] = row["word"]
    return spark.sparkContext.broadcast(held.view(np.uint8))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(langs, phrases): lang and its number of words n; lang, phrase, k (its words) and f of every phrase of 1 to longest words with f >= least.

    docs: lang, text.  Null texts are empty, null langs und.  Each pass counts exactly what the bitmaps let through.  Bitmaps may let too much through
    but hold nothing back, so every phrase with f >= least has its whole count.
    """
    if not 1 <= longest <= LONGEST or not 0 < least <= 255 or bits < 13:
        raise ValueError(f"phrases of up to {LONGEST} words, least counts of up to 255, 13 bits or more")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    exact, candidate, out, langs = [], None, None, None
    for k in range(1, longest + 1):
        seen = cut(_pass(docs, k, exact, candidate, least, longest, bits))
        if k == 1:
            langs = seen.filter("phrase IS NULL AND lang IS NOT NULL").groupBy("lang").agg(F.sum("f").alias("n"))
        often = cut(seen.filter("phrase IS NOT NULL").groupBy("lang", "phrase", "bucket").agg(F.sum("f").alias("f")).filter(F.col("f") >= least))
        if k < longest:
            exact.append(_bitmap(spark, often, bits))
            candidate = _candidates(spark, seen.filter("chunk IS NOT NULL").select("chunk", "counters"), least, bits)
        found = often.select("lang", "phrase", F.lit(k).alias("k"), "f")
        out = found if out is None else out.unionByName(found)
    return langs, out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """Each lang's first top phrases of 2 to longest words: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut; score is floor(1000 * a * n / (l * r)) in decimals of 38 digits.  A phrase goes if
    a phrase one word longer that holds it has the same count (a phrase that is longer by more has such a phrase inside).  Ties: score, a descending, phrase by its UTF-8 bytes.
    A lang without candidates, and an empty table, give no rows; repeated rows count each.
    """
    langs, counts = frequent(docs, least, longest, bits)
    words = F.split("phrase", " ")
    candidates = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rest"))
    one = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    other = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(one, ["lang", "head"]).join(other, ["lang", "rest"]).join(langs, "lang")
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {big('a')} * CAST(n AS DECIMAL(15, 0))) div ({big('l')} * {big('r')})")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("best"))
    inner = candidates.filter("k > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("best.a")))
    kept = kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
