"""Exact Jaccard self-join of word-shingle sets and its connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, small

#: Words in a shingle; similarity in per cent; min-hashes of a set, and which of them make up each of its keys; most
#: tokens held as common ones; tokens that a partition counts at a time; postings of an index bucket; words whose hashes are kept.
WORDS, PER_CENT, HASHES, KEYS, COMMON, CHUNK, POSTINGS, KEPT = 5, 80, 8, ((0, 1), (2, 3), (4, 5), (6, 7), (0, 2, 4, 6), (1, 3, 5, 7)), 1 << 18, 1 << 19, 300_000, 60_000
#: Rows that a broadcast join may hold.
SMALL = 500_000
#: Sets from which on a crowd is a cluster; per cent of similarity that its links have at least; members that meet one copy of its core.
CROWD, LOOSE, MEMBERS = 64, 50, 1024

#: Odd multipliers of 64 bits, from the fractional part of the golden ratio by a fixed rule.
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1) for i in range(64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Words(dict):
    """word -> 64-bit hash, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: bytes, words: _Words, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; with fewer words, of the whole sequence; empty without words."""
    seq = text.lower().split()  # of bytes: A-Z only, and space and \t\n\v\f\r only
    if not seq:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, seq), np.uint64, len(seq))
    k = min(width, len(h))
    m = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = h[:m] + np.uint64(k)
        for i in range(1, k):
            out *= _ODD[1]
            out += h[i : i + m]
        out = _mixed(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])] if m > 1 else out


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    col = batch[column]
    return [t or b"" for t in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def _keys(s: np.ndarray) -> np.ndarray:
    """Keys of a set that is not empty: each is made of several min-hashes, so sets that share one are likely to be near copies."""
    with np.errstate(over="ignore"):
        least = [(s * _ODD[2 + i]).min() for i in range(HASHES)]
        out = np.arange(len(KEYS), dtype=np.uint64)
        for k, places in enumerate(KEYS):
            for i in places:
                out[k] = out[k] * _ODD[1] + least[i]
        return _mixed(out)


def _common_tokens(docs: DataFrame, width: int, most: int) -> np.ndarray:
    """Tokens of many documents, commonest last, counted over all documents.

    A partition reports the tokens that several of its documents hold, where documents that share a min-hash key with an earlier one
    are near copies of it and count no more; the most tokens with the largest sums are kept.  They only set the order of tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, kept = _Words(), 0, []
        found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        seen: list[set[int]] = [set() for _ in KEYS]

        def fold() -> None:
            nonlocal found, counts, kept
            t = np.concatenate(kept)
            t.sort()
            heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            c = np.diff(np.append(heads, len(t)))
            t, c = t[heads[c > 1]], c[c > 1]
            merged, at = np.unique(np.concatenate([found, t]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, c]), len(merged)).astype(np.int64)
            found, kept = merged, []

        for text in (t for batch in batches for lo in range(0, len(batch), 500) for t in _texts(batch.slice(lo, 500))):
            s = shingles(text, words, width)
            if not len(s):
                continue
            keys = _keys(s).tolist()
            near = any(k in had for k, had in zip(keys, seen, strict=True))
            for k, had in zip(keys, seen, strict=True):
                had.add(k)
            if near:
                continue
            kept.append(s)
            held += len(s)
            if held > CHUNK:
                fold()
                held = 0
        if kept:
            fold()
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], names=["token", "n"])

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.col("n").desc(), "token").limit(most).select("token").toArrow()["token"]  # bounded by most
    return top.to_numpy()[::-1].view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """A column of lists from arrays of 64-bit integers."""
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64()))


def _profiles(docs: DataFrame, width: int, per_cent: int, common: np.ndarray) -> DataFrame:
    """One row per document: n_shingles, a 128-bit signature of the set, min-hash keys, the prefix of the set and where in the order it ends."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # COMMON tokens at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, order = _Words(), shared.value
        tokens = np.sort(order)
        rank = np.argsort(order)
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                n, sig, keys, prefix, place, hashed = [], [], [], [], [], []
                for text in _texts(part):
                    s = shingles(text, words, width)
                    n.append(len(s))
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if not len(s):
                        keys.append(none)
                        prefix.append(none)
                        place.append(-1)
                        hashed.append(0)
                        continue
                    keys.append(_keys(s))
                    ranks = none
                    # The global order: tokens that are not common by their hash, then the common ones by rank.
                    if len(tokens):
                        at = np.searchsorted(tokens, s)
                        at[at == len(tokens)] = 0
                        is_common = tokens[at] == s
                        if is_common.any():
                            ranks = rank[at[is_common]]
                            by = np.argsort(ranks)
                            s, ranks = np.concatenate([s[~is_common], s[is_common][by]]), ranks[by]
                    prefix.append(s[: len(s) + 1 + -per_cent * len(s) // 100])
                    beyond = len(prefix[-1]) - 1 - (len(s) - len(ranks))
                    place.append(int(ranks[beyond]) if beyond >= 0 else -1)
                    hashed.append(0 if beyond >= 0 else int(prefix[-1][-1]) - 2**63)
                yield pa.RecordBatch.from_arrays(
                    [part["__rid"], part["doc_id"], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), _lists(keys), _lists(prefix), pa.array(place, pa.int32()), pa.array(hashed, pa.int64())],
                    names=["__rid", "doc_id", "n_shingles", "sig", "keys", "prefix", "place", "hash"],
                )

    return docs.select("__rid", "doc_id", "text").mapInArrow(run, "__rid long, doc_id long, n_shingles long, sig binary, keys array<long>, prefix array<long>, place int, hash long")


def _ends(x: str, y: str) -> list[Column]:
    """A pair of ids as columns a and b, the smaller one first."""
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, s): the sets of those rows of docs whose __rid is in wanted, cut as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part["__rid"], _lists([shingles(t, words, width) for t in _texts(part)])], names=["id", "s"])

    return cut(docs.select("__rid", "text").join(small(wanted, SMALL), "__rid").mapInArrow(run, "id long, s array<long>"))


def _compared(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of row ids with na and nb, the sizes of their sets, and how many tokens are in both."""
    pairs = cut(pairs)
    held = _sets(docs, cut(pairs.select(F.col("a").alias("__rid")).union(pairs.select(F.col("b").alias("__rid"))).distinct()), width)
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))


def _similar(compared: DataFrame, per_cent: int) -> DataFrame:
    """Those of compared pairs whose sets are similar enough, with their similarity."""
    union = F.col("na") + F.col("nb") - F.col("both")
    return compared.filter(F.col("both") * 100 >= union * per_cent).select("a", "b", (F.col("both") / union).alias("sim"))


def _verified(docs: DataFrame, pairs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Those of the pairs (a, b) of row ids whose sets are similar enough, with their similarity."""
    return _similar(_compared(docs, pairs, width), per_cent)


def _clusters(docs: DataFrame, compared: DataFrame, width: int, per_cent: int, crowd: int, loose: int) -> DataFrame:
    """(id, cluster, apart, weight, room): how a set differs from the core of its cluster.

    A cluster is a connected component of loosely similar sets, of those compared, if it is a crowd; sets in no cluster are not returned.
    Its core has the tokens that more than half of its members hold: what an origin that the members were copied from would hold, whether
    or not it is among them.  apart has id's tokens that the core lacks, in order, then the core's that id lacks.  Two members share
    |core| - lacking - lacking' + |apart & apart'| tokens, so they are similar enough iff
    (100 + per_cent) * |apart & apart'| >= weight + weight' - room.
    """
    near = compared.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * loose)
    roots = cut(components(near.select("a", "b")))
    large = cut(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= crowd))
    members = cut(roots.join(small(large, SMALL), "root").select(F.col("node").alias("id"), F.col("root").alias("cluster"), "size"))
    held = members.join(_sets(docs, members.select(F.col("id").alias("__rid")), width), "id")
    tokens = held.select("cluster", "size", F.explode("s").alias("token")).groupBy("cluster", "size", "token").agg(F.count(F.lit(1)).alias("k"))
    cores = tokens.filter("2 * k > size").groupBy("cluster", "size").agg(F.collect_list("token").alias("core"))  # twice a mean set at most
    # A core has a copy for every MEMBERS members, so no key of the join has more rows than that.
    copies = F.ceil(F.col("size") / MEMBERS).cast("int")
    cores = cores.select("cluster", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "core")
    met = held.withColumn("copy", F.pmod(F.xxhash64("id"), copies).cast("int")).join(cores, ["cluster", "copy"], "left")
    met = met.select("id", "cluster", "s", F.coalesce("core", F.array().cast("array<bigint>")).alias("core"))
    lacking = F.array_except("core", "s")
    weight = per_cent * F.size("s").cast("long") + (100 + per_cent) * F.size(lacking)
    return met.select("id", "cluster", F.concat(F.array_sort(F.array_except("s", "core")), F.array_sort(lacking)).alias("apart"), weight.alias("weight"), ((100 + per_cent) * F.size("core").cast("long")).alias("room"))


def _surely(members: DataFrame) -> DataFrame:
    """(a, b): links of cluster members to the member that differs least from the core, where the counts alone are enough for a link."""
    least = members.groupBy("cluster").agg(F.min(F.struct("weight", "id")).alias("least"))
    return members.join(small(cut(least), SMALL), "cluster").filter((F.col("weight") + F.col("least.weight") <= F.col("room")) & (F.col("id") != F.col("least.id"))).select(*_ends("id", "least.id"))


def _within(members: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): the links inside clusters between sets of different components; members: as _clusters gives them, and comp.

    A pair that counts alone don't link must share tokens of apart, the first of them where enough of either list is left.  So only the
    beginnings of these lists meet, and members of a cluster's largest component ask nothing.
    """
    sizes = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("k"), F.min("weight").alias("lightest"))
    most = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.min("lightest").alias("lightest"))
    told = cut(members.join(small(cut(most), SMALL), "cluster"))
    need = F.greatest(F.lit(1), F.ceil((F.col("weight") + F.col("lightest") - F.col("room")) / (100 + per_cent))).cast("int")
    begun = F.slice("apart", F.lit(1), F.greatest(F.lit(0), F.size("apart") - need + 1))
    posted = told.select("cluster", "room", "id", "comp", "weight", (F.col("comp") == F.col("most")).alias("quiet"), F.size("apart").alias("size"), F.posexplode(begun).alias("pos", "token"))
    asks = posted.filter("not quiet").select("cluster", "token", "room", *[F.col(c).alias(f"{c}_a") for c in ("id", "comp", "weight", "size", "pos")])
    met = asks.join(posted.select("cluster", "token", "quiet", *[F.col(c).alias(f"{c}_b") for c in ("id", "comp", "weight", "size", "pos")]), ["cluster", "token"])
    enough = (100 + per_cent) * F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= F.col("weight_a") + F.col("weight_b") - F.col("room")
    met = met.filter((F.col("comp_a") != F.col("comp_b")) & (F.col("quiet") | (F.col("id_a") < F.col("id_b"))) & enough)
    pairs = cut(met.select(*_ends("id_a", "id_b")).distinct())
    ends = [told.select(F.col("id").alias(x), F.col("apart").alias(f"apart_{x}"), F.col("weight").alias(f"weight_{x}"), *["room"] * (x == "a")) for x in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    return both.filter((100 + per_cent) * F.size(F.array_intersect("apart_a", "apart_b")) >= F.col("weight_a") + F.col("weight_b") - F.col("room")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of node's connected component, for all nodes of edges (a, b).

    Alternating large-star and small-star steps: every step is a partial-aggregated minimum per node and a join,
    so a node with very many edges is no single task's work; each round is cut as a table.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        after = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = cut(after.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen:
            return after.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, seen = after, mark


def _index_pairs(entries: DataFrame, per_cent: int, buckets: int) -> DataFrame:
    """Candidate pairs (a, b) of sets from inverted lists of prefix tokens; entries: (id, comp, n, cluster, last, prefix).

    Each list gives the pairs of different components and clusters in it; a pair's lists together tell how many tokens c its prefixes
    share.  Of two prefixes, all common tokens up to the end of the one that ends first in the global order are among these, so the
    sets share c plus the rest of that set at most; pairs for which that is too little go.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pack a batch's postings by bucket of their tokens: columns one after the other, documents once per bucket."""
        for batch in batches:
            lists = batch["prefix"]
            sizes = lists.value_lengths().to_numpy()
            tokens = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            docs = np.column_stack([batch[c].to_numpy().view(np.uint64) for c in ("id", "comp", "n", "cluster")])
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            blobs = []
            for a, b in zip(at, [*at[1:], len(order)], strict=True):
                mine = order[a:b]
                used, where = np.unique(row[mine], return_inverse=True)
                head = np.array([len(used), len(mine)], np.uint64)
                blobs.append(b"".join(x.tobytes() for x in (head, docs[used], tokens[mine], where.astype(np.uint32), pos[mine])))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at]), pa.array(blobs, pa.binary())], names=["bucket", "postings"])

    def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        d, m = (int(x) for x in np.frombuffer(blob, np.uint64, 2))
        docs = np.frombuffer(blob, np.uint64, 4 * d, 16).reshape(d, 4)
        at = 16 + 32 * d
        tokens = np.frombuffer(blob, np.uint64, m, at)
        where, pos = np.frombuffer(blob, np.uint32, m, at + 8 * m), np.frombuffer(blob, np.uint32, m, at + 12 * m)
        return tokens, np.column_stack([docs[where], pos.astype(np.uint64)]).view(np.int64)

    def lists(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table["postings"].to_pylist()]
        token, p = np.concatenate([t for t, _ in parts]), np.concatenate([q for _, q in parts])
        del parts
        # Lists by token, in them by set size and then position: blocks of one size and position are adjacent.
        order = np.lexsort((p[:, POS], p[:, 2], token))
        token, p = token[order], p[order]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        # Lists whose members are linked already, or of one cluster, give nothing: their answers are those of their pivot or core.
        mixed = np.logical_and(*(np.maximum.reduceat(p[:, c], starts) != np.minimum.reduceat(p[:, c], starts) for c in (1, 3)))
        short = mixed & (sizes <= SHORT)
        out = [_short_list_pairs(p, np.repeat(np.cumsum(short) * short, sizes), per_cent)]
        out += [_list_pairs(p[a : a + k], per_cent) for a, k in zip(starts[mixed & ~short], sizes[mixed & ~short], strict=True)]
        pairs, counts = np.unique(np.concatenate(out), axis=0, return_counts=True)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "c": pa.array(counts, pa.int64())})

    dealt = entries.select("id", "comp", "n", "cluster", "prefix").mapInArrow(deal, "bucket long, postings binary")
    shared = dealt.groupBy("bucket").applyInArrow(lists, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    ends = [entries.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("last").alias(f"last{x}"), F.size("prefix").alias(f"p{x}")) for x in "ab"]
    told = shared.join(ends[0], "a").join(ends[1], "b")
    rest = F.when(F.col("lasta") < F.col("lastb"), F.col("na") - F.col("pa")).when(F.col("lastb") < F.col("lasta"), F.col("nb") - F.col("pb")).otherwise(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")))
    return told.filter((F.col("c") + rest) * (100 + per_cent) >= (F.col("na") + F.col("nb")) * per_cent).select("a", "b")


#: Lists up to this length are worked on together; the column of positions behind id, component, size and cluster.
SHORT, POS = 48, 4


def _possible(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether sets that share a token at these positions can overlap enough: in front of it and behind it they share what the shorter stretch allows."""
    most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
    return most * (100 + per_cent) >= (n[x] + n[y]) * per_cent


def _asked(p: np.ndarray, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
    """Whether a pair is of two components and of two clusters."""
    return (p[x, 1] != p[y, 1]) & (p[x, 3] != p[y, 3])


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack([np.minimum(a, b), np.maximum(a, b)])


def _short_list_pairs(p: np.ndarray, number: np.ndarray, per_cent: int) -> np.ndarray:
    """Pairs of different components within the same short list; number: the list of each posting, 0 for none."""
    p, number = p[number > 0], number[number > 0]
    n, pos = p[:, 2], p[:, POS]
    out = [np.zeros((0, 2), np.int64)]
    if not len(p):
        return out[0]
    reach = np.searchsorted((number << 32) + n, (number << 32) + 100 * n // per_cent, side="right")
    many = reach - np.arange(len(p)) - 1
    total = np.cumsum(many)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 2_000_000, side="right")))
        k = many[lo:hi]
        x = np.repeat(np.arange(lo, hi), k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        keep = _asked(p, x, y) & _possible(n, pos, x, y, per_cent)
        out.append(_ordered(p[x[keep], 0], p[y[keep], 0]))
        lo = hi
    return np.concatenate(out)


def _list_pairs(p: np.ndarray, per_cent: int) -> np.ndarray:
    """Pairs of different components and clusters in one long list that sizes and positions leave possible.

    The members of the list's largest cluster have no answers among each other and ask nothing: only the others look for partners.
    The list is in blocks of equal size and position.  For each block the sizes that it can match are one stretch of blocks,
    and in it a block is skipped whole if its position leaves too little for the overlap that the sizes ask for.
    """
    n, pos, out = p[:, 2], p[:, POS], [np.zeros((0, 2), np.int64)]
    groups, counts = np.unique(p[:, 3], return_counts=True)
    asks = p[:, 3] != groups[np.argmax(counts)]
    heads = np.flatnonzero(np.append(True, (np.diff(n) != 0) | (np.diff(pos) != 0)))
    tails = np.append(heads[1:], len(p))
    bn, bp = n[heads], pos[heads]
    first, last = np.searchsorted(bn, -(-per_cent * bn // 100), side="left"), np.searchsorted(bn, 100 * bn // per_cent, side="right")
    for i in range(len(heads)):
        mine = heads[i] + np.flatnonzero(asks[heads[i] : tails[i]])
        if not len(mine):
            continue
        j = np.arange(first[i], last[i])
        j = j[_possible(bn, bp, np.full(len(j), i), j, per_cent)]
        k = tails[j] - heads[j]
        other = np.repeat(heads[j] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        for x in mine:
            y = other[~asks[other] | (other > x)]
            y = y[_asked(p, x, y)]
            if len(y):
                out.append(_ordered(np.full(len(y), p[x, 0]), p[y, 0]))
    return np.concatenate(out)


def similar_groups(docs: DataFrame, width: int = WORDS, per_cent: int = PER_CENT, most_common: int = COMMON, crowd: int = CROWD, loose: int = LOOSE) -> DataFrame:
    """n_shingles and component_id for each row of docs (other columns stay): groups linked by Jaccard >= per_cent.

    1. Equal sets are one node, by a 128-bit signature.
    2. Set relations: sets that share min-hash keys are compared with three pivots of each key only, then with the one that is
       most similar to the pivots; those that are similar enough join its component.
    3. Copies of one origin that are too far from it for a link would meet all its other copies.  In such a cluster answers are derived
       from the core that all share: many links follow from the counts of differing tokens, and the others need differences in
       common, so they come from an index of these alone.  crowd and loose say from which size and similarity on this is done;
       results do not depend on them.
    4. An inverted index of prefix tokens (rare tokens first) gives the other candidates.  Its lists are in blocks by set size and
       position, which are skipped whole; a member's pairs inside its component are never looked up again: its answers follow
       from its pivot's.  Candidates between components are verified on the whole sets, and the links joined.
    So every pair of different components that could be similar is verified, and components are exact (up to collisions of
    64-bit shingle hashes).

    Null texts and texts without words have no shingles and are alone.  component_id is the least doc_id of the component; null doc_ids
    take part as rows and are ignored in that minimum (null if there is no other).  Repeated rows are rows of the same group.
    Columns of docs called n_shingles or component_id give way.
    """
    base = numbered(docs.select(*[c for c in docs.columns if c not in ("n_shingles", "component_id")]), "__rid")
    spark = docs.sparkSession
    common = _common_tokens(base, width, most_common)
    rows = cut(_profiles(base, width, per_cent, common))
    full = rows.filter("n_shingles > 0")
    # A set is known by the row id of one of its documents.
    sets = cut(full.groupBy("sig").agg(F.min("__rid").alias("id"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")))

    # A key's pivots are its most copied set and the one that shares its keys with most documents, likely origins of near copies, and
    # one that differs from key to key.
    keyed = sets.select("id", "n", "copies", F.posexplode("keys").alias("i", "key"))
    crowds = keyed.groupBy("i", "key").agg(F.sum("copies").alias("crowd"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    keyed = cut(keyed.join(crowds, ["i", "key"]).select("id", "n", "copies", "i", "key", "crowd", "k"))
    keyed = keyed.join(keyed.groupBy("id").agg(F.sum("crowd").alias("fame")), "id")
    pivot = F.struct("id", "n")
    orders = (F.col("copies"), F.col("fame"), F.xxhash64("i", "id"))
    pivots = keyed.groupBy("i", "key").agg(F.array(*[F.max_by(pivot, F.struct(c, "id")) for c in orders]).alias("p"))
    near = keyed.join(pivots, ["i", "key"]).select("id", "n", F.explode(F.array_distinct("p")).alias("p"))
    near = near.filter((F.col("id") != F.col("p.id")) & (F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * per_cent))
    stars = cut(near.select("id", F.col("p.id").alias("to")).distinct())
    compared = cut(_compared(base, stars.select(*_ends("id", "to")).distinct(), width))
    first = _similar(compared, per_cent)
    roots = cut(components(first.select("a", "b")))

    # The set that is most similar to the pivots in all is likely the origin of its near copies: a second pivot for those that are not
    # yet in its component, and in large crowds for all.
    told = stars.select("id", "to", *_ends("id", "to")).join(first, ["a", "b"])
    total = told.select("id", "sim").union(told.select(F.col("to").alias("id"), F.lit(1.0)).distinct()).groupBy("id").agg(F.sum("sim").alias("total"))
    grouped = cut(keyed.select("id", "n", "i", "key", "k").join(total, "id", "left").join(roots, F.col("id") == roots.node, "left").select("id", "n", "i", "key", "k", "total", F.coalesce("root", "id").alias("root")))
    middles = grouped.filter("total IS NOT NULL").groupBy("i", "key").agg(F.max_by(F.struct("id", "n", "root"), F.struct("total", "id")).alias("p"))
    near = grouped.join(middles, ["i", "key"]).filter(((F.col("root") != F.col("p.root")) | (F.col("k") >= crowd)) & (F.col("id") != F.col("p.id")) & (F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * per_cent))
    again = near.select(*_ends("id", "p.id")).distinct().join(compared, ["a", "b"], "left_anti")
    compared = compared.union(cut(_compared(base, again, width)))
    first = _similar(compared, per_cent).select("a", "b")
    clusters = cut(_clusters(base, compared, width, per_cent, crowd, loose))
    first = first.union(cut(_surely(clusters)))
    roots = cut(components(first))

    entries = full.select(F.col("__rid").alias("id"), F.col("n_shingles").alias("n"), "prefix", F.struct("place", "hash").alias("last")).join(sets.select("id"), "id")
    entries = entries.join(roots, entries.id == roots.node, "left").join(clusters.select("id", "cluster"), "id", "left")
    entries = entries.select("id", F.coalesce("root", "id").alias("comp"), "n", F.coalesce("cluster", "root", "id").alias("cluster"), "prefix", "last")
    postings = full.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // POSTINGS))
    second = _verified(base, _index_pairs(entries, per_cent, buckets), width, per_cent).select("a", "b")
    members = clusters.join(roots, clusters.id == roots.node, "left").select(*clusters.columns, F.coalesce("root", "id").alias("comp"))
    roots = components(first.union(second).union(_within(cut(members), per_cent)))

    named = sets.select("sig", "id", "doc_id").join(roots, sets.id == roots.node, "left").select("sig", "doc_id", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "root").select("sig", "component_id")
    out = full.select("__rid", "sig", "n_shingles").join(found, "sig").select("__rid", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("__rid", "n_shingles", F.col("doc_id").alias("component_id"))
    return base.join(out.unionByName(alone), "__rid").drop("__rid")


def keep_one(docs: DataFrame, width: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs without near duplicates: of each component the rows with its least doc_id stay.

    Rows without doc_id stay unless a row of their component has one.
    """
    ids = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    found = similar_groups(ids, width, per_cent)
    lost = found.filter((F.col("doc_id") != F.col("component_id")) | F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    # A text and its doc_id tell a row from others of its component.
    lost = cut(lost.select("doc_id", "__h", "n_shingles").distinct())
    left = docs.withColumn("__h", F.xxhash64("text")).alias("d").join(small(lost, SMALL).alias("l"), F.expr("d.doc_id <=> l.doc_id AND d.__h = l.__h"), "left_anti")
    return left.drop("__h")
