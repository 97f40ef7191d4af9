"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Toxic and clean labelled documents that the model is fitted on at most, clean and toxic ones that the
#: chain itself is fitted on, and the largest of them in bytes; hashed weights; passes; threshold.
SAMPLE, SAMPLE_CLEAN, CHAIN, SAMPLE_BYTES, WEIGHTS, PASSES, THRESHOLD = 1500, 3500, (2400, 800), 8192, 1 << 18, 24, 0.7
#: Documents scored side by side hold about so many tokens; words whose odds are kept.
TOKENS, KEPT = 200_000, 250_000

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SIGNS = ".,;:!?\"'()-"
#: Checksums of the names that features begin with; the rest of a name goes on from them.
_W, _S3, _BEGUN = zlib.crc32(b"w="), zlib.crc32(b"s3="), [(k, zlib.crc32(b"p%d=" % k)) for k in (3, 4, 5, 6)]


def _features(word: str) -> list[int]:
    """Hashed features of a token: itself, its beginnings and its end, without case and without signs around it."""
    w = word.lower()
    if not w.isalpha() and not (w := w.strip(_SIGNS)).isalpha():
        w = _EDGE.sub("", w)
    if not w:
        return [zlib.crc32(b"none") % WEIGHTS]
    crc, n = zlib.crc32, len(w)
    out = [crc(w.encode(), _W) % WEIGHTS, crc(w[-3:].encode(), _S3) % WEIGHTS]
    for k, begun in _BEGUN:
        if n < k:
            break
        out.append(crc(w[:k].encode(), begun) % WEIGHTS)
    return out


@dataclass
class Chain:
    """Two labels (0 clean, 1 toxic): unary weights of label 1, a bias, transition weights and the calibration of document scores."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray  # 2 x 2
    scale: tuple[float, float, float]

    def odds(self, word: str) -> float:
        """exp of the unary score of label 1 against label 0."""
        weights, total = memoryview(self.weights), 0.0
        for i in _features(word):
            total += weights[i]
        return math.exp(max(-12.0, min(12.0, self.bias + total)))

    def score(self, peak: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a + b * peak + c * np.log1p(mass), -30, 30)))


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(label 1) of each token by forward-backward over sequences laid end to end; with pairs also expected transition counts.

    Sequences are worked on side by side, token by token, in odds form, which is exact for two labels.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    (m00, m01), (m10, m11) = np.exp(moves).tolist()
    steps = int(n[0]) if len(n) else 0
    # Tokens by step, longest sequences first: what a step takes lies side by side.
    active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")
    begun = np.concatenate(([0], np.cumsum(active)))
    at = starts[order][np.arange(len(odds)) - np.repeat(begun[:-1], active)] + np.repeat(np.arange(steps), active)
    x, low, high = odds[at], 1e-12, 1e12
    ahead, back = np.empty(len(odds)), np.empty(len(odds))
    bounds = begun.tolist()
    u = np.zeros(0)
    for t in range(steps):
        lo, hi = bounds[t], bounds[t + 1]
        now = ahead[lo:hi]
        if t:
            u = u[: hi - lo]
            np.multiply(x[lo:hi], m01 + u * m11, out=now)
            now /= m00 + u * m10
        else:
            now[:] = x[lo:hi]
        np.maximum(now, low, out=now)
        u = np.minimum(now, high, out=now)
    v = np.zeros(0)
    for t in range(steps - 1, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        now = back[lo:hi]
        j = len(v)
        now[j:] = 1
        if j:
            y = x[hi : hi + j] * v
            part = np.divide(m10 + m11 * y, m00 + m01 * y, out=now[:j])
            np.maximum(part, low, out=part)
            np.minimum(part, high, out=part)
        v = now
    m = np.exp(moves)
    fwd, bwd = np.empty(len(odds)), np.empty(len(odds))
    fwd[at], bwd[at] = ahead, back
    z = fwd * bwd
    p = z / (1 + z)
    if not pairs:
        return p
    inner = np.ones(len(odds), bool)
    inner[(starts + lengths - 1)[lengths > 0]] = False
    i = np.flatnonzero(inner)
    x = odds[i + 1] * bwd[i + 1]
    f = fwd[i]
    whole = m[0, 0] + m[0, 1] * x + m[1, 0] * f + m[1, 1] * f * x
    return p, m * np.array([[(1 / whole).sum(), (x / whole).sum()], [(f / whole).sum(), (f * x / whole).sum()]])


class _Corpus:
    """Documents as arrays of word numbers; words without case and without signs around them have numbers of their own."""

    def __init__(self, texts: list[str]):
        vocab: dict[str, int] = {}
        self.docs = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in t.split()), np.int32) for t in texts]
        self.words = list(vocab)
        plain: dict[str, int] = {}
        self.plain_of = np.fromiter((plain.setdefault(_EDGE.sub("", w.lower()), len(plain)) for w in vocab), np.int32, len(vocab))
        self.plain = list(plain)


def _lexicon(corpus: _Corpus, which: np.ndarray, toxic: np.ndarray, chance: float = 0.01) -> np.ndarray:
    """For each plain word whether it, or a beginning of it, sets toxic documents apart from clean ones beyond what chance gives.

    A word counts once for each document, near copies of a document count as one, and a log-likelihood ratio must exceed
    what the best of so many words would reach by chance.
    """
    words = corpus.plain
    begins: dict[str, int] = {}
    stems = np.full((len(words), 3), -1, np.int32)
    in_toxic = np.zeros(len(words), bool)
    for d in which[toxic[which] == 1]:
        in_toxic[corpus.plain_of[corpus.docs[d]]] = True
    # Beginnings of words in toxic documents, at first; then the other words that have them.
    for some in (np.flatnonzero(in_toxic), np.flatnonzero(~in_toxic)):
        for i in some:
            w = words[i]
            for j, k in enumerate((4, 5, 6)):
                if len(w) > k:
                    stems[i, j] = begins.setdefault(w[:k], len(begins)) if in_toxic[i] else begins.get(w[:k], -1)
    mark = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    seen: set[tuple[int, int, int]] = set()
    n = [1, 1]
    of_word, of_stem = np.zeros((2, len(words))), np.zeros((2, len(begins)))
    for d in which:
        y, ids = int(toxic[d]), corpus.plain_of[corpus.docs[d]]
        h = mark[ids]
        k = min(5, len(h))
        if not k:
            continue
        with np.errstate(over="ignore"):
            run = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                run = run * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
            marks = {(y, i, int((run * np.uint64(f)).min())) for i, f in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))}
        if marks & seen:
            continue
        seen |= marks
        n[y] += 1
        own = np.unique(ids)
        of_word[y, own] += 1
        begun = np.unique(stems[own])
        of_stem[y, begun[begun >= 0]] += 1
    share = n[1] / (n[0] + n[1])
    bar = 2 * math.log(max(2, len(words) + len(begins)) / chance)

    def stands_out(c: np.ndarray) -> np.ndarray:
        both = np.maximum(c.sum(0), 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(c[1] > 0, c[1] * np.log(c[1] / (both * share)), 0) + np.where(c[0] > 0, c[0] * np.log(c[0] / (both * (1 - share))), 0)
        return (c[1] >= 3) & (c[1] / n[1] >= 20 * c[0] / n[0]) & (2 * gain > bar)

    # A beginning says more than its words only if several words of toxic documents share it.
    held = stems[of_word[1] > of_word[0]].ravel()
    good = stands_out(of_stem) & (np.bincount(held[held >= 0], minlength=len(begins)) >= 3)
    out = stands_out(of_word) | ((stems >= 0) & good[stems] if len(begins) else np.zeros((len(words), 3), bool)).any(1)
    return out & np.fromiter((bool(w) for w in words), bool, len(words))


def _token_labels(corpus: _Corpus, toxic: np.ndarray) -> list[np.ndarray]:
    """Token labels from document labels: in toxic documents, the words that set these apart from clean ones."""
    marked = _lexicon(corpus, np.arange(len(toxic)), toxic)
    hit = np.array([bool(marked[corpus.plain_of[d]].any()) for d in corpus.docs])
    # Toxic documents in which nothing stands out are compared with the clean ones once more, by themselves.
    marked = marked | _lexicon(corpus, np.flatnonzero((toxic == 0) | ~hit), toxic, 1.0)
    return [(marked[corpus.plain_of[d]] & bool(y)).astype(np.int64) for d, y in zip(corpus.docs, toxic, strict=True)]


def fit(texts: list[str], toxic: list[int], passes: int = PASSES, seed: int = 0) -> Chain:
    """Train the chain by gradient ascent on the conditional likelihood of token labels, then calibrate document scores.

    Token labels come from all texts; the chain is fitted on the first CHAIN of either class.  Without texts, or without words in
    them, the weights stay as they start: such a model finds no word toxic and scores every document as one without evidence.
    """
    y_doc = np.array(toxic, np.int64)
    corpus = _Corpus(texts)
    model = Chain(np.zeros(WEIGHTS), -4.0, np.zeros((2, 2)), (-5.0, 5.0, 3.0))
    if not corpus.plain:
        return model
    told_labels = _token_labels(corpus, y_doc)
    use_docs = np.sort(np.concatenate([np.flatnonzero(y_doc == c)[: CHAIN[c]] for c in (0, 1)]))
    y_doc = y_doc[use_docs]
    none = [np.zeros(0, np.int64)]
    lengths = np.array([len(corpus.docs[d]) for d in use_docs], np.int64)
    y = np.concatenate([told_labels[d] for d in use_docs] or none)
    raw = np.concatenate([corpus.docs[d] for d in use_docs] or none)
    del told_labels
    used, token = np.unique(raw, return_inverse=True)
    token = token.astype(np.int32)
    del raw
    ids, many = array("i"), array("i")
    for i in used:
        f = _features(corpus.words[i])
        ids.extend(f)
        many.append(len(f))
    del corpus
    flat, many = np.array(ids, np.int32), np.array(many, np.int32)
    of = np.repeat(np.arange(len(many), dtype=np.int32), many)
    is_word = np.zeros(len(flat), bool)
    is_word[np.cumsum(many) - many] = True
    rng = np.random.default_rng(seed)
    squares, b_sq, m_sq = np.full(WEIGHTS, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    inner = np.ones(len(y), bool)
    inner[(np.cumsum(lengths) - 1)[lengths > 0]] = False
    i = np.flatnonzero(inner)
    told = np.array([[np.sum((y[i] == a) & (y[i + 1] == b)) for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(passes):
        # Whole words are left out at random, so that beginnings learn to carry words never seen.
        use = np.where(is_word, rng.random(len(flat)) < 0.6, rng.random(len(flat)) < 0.8)
        unary = model.bias + np.bincount(of, model.weights[flat] * use, len(used))
        p, pairs = marginals(np.exp(np.clip(unary, -12, 12))[token], lengths, model.moves, pairs=True)
        rest = np.bincount(token, y - p, len(used))
        g = np.bincount(flat, rest[of] * use, WEIGHTS) - 0.05 * model.weights
        squares += g * g
        model.weights += 0.7 * g / np.sqrt(squares)
        gb = float((y - p).sum())
        b_sq += gb * gb
        model.bias += 0.5 * gb / math.sqrt(b_sq)
        gm = told - pairs - 0.1 * model.moves
        m_sq += gm * gm
        model.moves += 0.2 * gm / np.sqrt(m_sq)
    unary = model.bias + np.bincount(of, model.weights[flat], len(used))
    p = marginals(np.exp(np.clip(unary, -12, 12))[token], lengths, model.moves)
    peak, mass = _gathered(p, lengths)
    x = np.column_stack([np.ones(len(peak)), peak, np.log1p(mass)])
    w = np.array(model.scale)
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(3) * 3
        w = w + np.linalg.solve(h, x.T @ (y_doc - q) - 3 * (w - np.array(model.scale)))
    model.scale = tuple(float(v) for v in w)
    return model


def _gathered(p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest marginal and the sum of the marginals of each document; 0 for documents without tokens."""
    peak, mass = np.zeros(len(lengths)), np.zeros(len(lengths))
    some = lengths > 0
    at = (np.cumsum(lengths) - lengths)[some]
    if len(at):
        peak[some], mass[some] = np.maximum.reduceat(p, at), np.add.reduceat(np.where(p > 0.05, p, 0), at)
    return peak, mass


class _Odds(dict):
    """word -> odds, kept while there is room."""

    def __init__(self, model: Chain):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        v = self[word] = self.model.odds(word)
        return v


#: The odds of the model that a worker used last, kept from task to task.
_KNOWN: list[_Odds] = []


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_clean: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Fit on labelled documents whose crc32(doc_id as text) mod 3 is not 1: the sample toxic and sample_clean clean ones of least
    id hash, among texts of sample_bytes bytes at most (these bounds hold for fitting alone).

    A document that labels calls both toxic and clean is toxic.  Labels other than 0 and 1, null ids, and labels of no document are left
    out; repeated labels count once, repeated documents each time.  Other columns of docs and labels are not read.  Without any labelled
    document the model is that of fit() without texts.
    """
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashed = F.xxhash64("doc_id")
    # Twice as many ids as documents, as some have long texts.
    ids = known.filter("toxic = 1").orderBy(hashed, "doc_id").limit(2 * sample).union(known.filter("toxic = 0").orderBy(hashed, "doc_id").limit(2 * sample_clean))
    found = docs.select("doc_id", "text").filter(F.octet_length("text") <= sample_bytes).join(F.broadcast(ids), "doc_id")
    got = [found.filter(F.col("toxic") == y).orderBy(hashed, "doc_id", "text").limit(most).select("text", "toxic") for y, most in ((0, sample_clean), (1, sample))]
    rows = got[0].union(got[1]).toArrow()  # so many texts of sample_bytes at most
    return fit(rows["text"].to_pylist(), rows["toxic"].to_pylist())


def score(docs: DataFrame, model: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Add score, predicted (1 from the threshold on), n_spans, and spans (start, end in code points, p) to docs.

    Every whole text is tagged; runs of tokens whose marginal is above one half are the offending spans.
    Null and empty texts have no tokens and get the score of no evidence.  Rows are independent, so nulls in other columns and repeated rows
    change nothing; columns of docs with names of added columns give way.
    """
    spark = docs.sparkSession
    rows = docs.drop("score", "predicted", "n_spans", "spans")
    shared = spark.sparkContext.broadcast(model)
    span = "array<struct<start:int,end:int,p:double>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", score double, predicted int, n_spans int, spans {span}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if not _KNOWN or _KNOWN[0].model is not m:
            _KNOWN[:] = [_Odds(m)]
        odds = _KNOWN[0]
        for batch in batches:
            size = np.array([0, *np.cumsum([len(t) // 6 + 1 if (t := x.as_py()) else 1 for x in batch["text"]])])
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + TOKENS, side="right")) - 1)
                part = batch.slice(lo, hi - lo)
                yield _scored(part, m, odds)
                lo = hi

    def _scored(part: pa.RecordBatch, m: Chain, odds: _Odds) -> pa.RecordBatch:
        texts = [x.as_py() or "" for x in part["text"]]
        values = [np.fromiter(map(odds.__getitem__, t.split()), float) for t in texts]
        lengths = np.array([len(v) for v in values], np.int64)
        p = marginals(np.concatenate(values), lengths, m.moves)
        peak, mass = _gathered(p, lengths)
        s = m.score(peak, mass)
        ends = np.cumsum(lengths)
        spans = [_spans(t, p[e - n : e]) if top > 0.5 else [] for t, e, n, top in zip(texts, ends, lengths, peak, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        cols = [*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([len(x) for x in spans], pa.int32()), pa.array(spans, kind)]
        return pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, "score", "predicted", "n_spans", "spans"])

    return rows.mapInArrow(run, schema)


def _spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    out: list[list] = []
    last = -2
    for i, found in enumerate(re.finditer(r"[^\s\x1c-\x1f\x85]+", text)):
        if p[i] > 0.5:
            if i == last + 1:
                out[-1][1], out[-1][2] = found.end(), max(out[-1][2], float(p[i]))
            else:
                out.append([found.start(), found.end(), float(p[i])])
            last = i
    return [tuple(x) for x in out]
