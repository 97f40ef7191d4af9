"""Removal of repeated passages: columns of pieces that share a core enter an ordered collection, one symbol a piece and round.

Whole texts as strings of the collection would need as many rounds as the longest text has bytes.  Only strings of WIDTH bytes matter,
so texts are first reduced to pieces.  Each WIDTH-byte window belongs to an anchor, the leftmost smallest of the hashed GRAM-byte strings inside it, and
windows at BLOCK neighbouring distances from an anchor share a core of WIDTH - BLOCK + 1 bytes.  Equal windows have equal cores at equal distances, so a
piece (what its windows hold left and right of the core) need only be held against pieces with the same core, and never takes more than 2 (BLOCK - 1) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, small

#: Bytes of a string that must not be repeated, of an anchor's string, distances that share a core.
WIDTH, GRAM, BLOCK = 400, 100, 101
#: Bits of a bitmap's addresses (4 MB).  Bitmaps only spare work.
BITS = 25
#: Bytes that a worker looks at together; pieces that one group may hold; pieces that a worker solves together.
SLICE, GROUP, TOGETHER = 1 << 19, 20_000, 40_000
#: Bits of a bitmap that travel together.
CHUNK = 1 << 15

_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_MAPPED = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(0x165667B19E3779F9)
_UP: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each gram-byte string, from prefix sums in arithmetic modulo 2^64."""
    n = len(data)
    if not _UP or len(_UP[0][0]) < n:
        size = max(n, SLICE + WIDTH)
        _UP[0] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    up, down = _UP[0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_MAPPED[data] * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= _SPREAD
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in each window of x."""
    n = len(x)
    blocks = -(-n // width)
    held = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    held[:n] = x
    table = held.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, valid: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last): each anchor with the valid windows (by their starts, first to last) that belong to it."""
    h = _hashes(data, gram)
    span = width - gram + 1
    low = _least(h, span)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    stop = np.append(first[1:], len(valid))
    ends = np.flatnonzero(valid & ~np.append(valid[1:], False))
    last = np.minimum(stop - 1, ends[np.searchsorted(ends, first)])
    place = np.empty(len(first), np.int64)
    for i in range(0, len(first), 4096):
        place[i : i + 4096] = first[i : i + 4096] + h[first[i : i + 4096, None] + np.arange(span)].argmin(axis=1)
    tied = np.flatnonzero(last > place)
    if not len(tied):
        return place, h[place], first, last
    parts = [np.flatnonzero(last <= place)]
    places, firsts, lasts = [place[parts[0]]], [first[parts[0]]], [last[parts[0]]]
    for i in tied:
        equal = np.flatnonzero(h[first[i] : last[i] + span] == low[first[i]]) + first[i]
        until = np.minimum(equal, last[i])
        since = np.append(first[i], until[:-1] + 1)
        some = since <= until
        places.append(equal[some])
        firsts.append(since[some])
        lasts.append(until[some])
    place, first, last = (np.concatenate(x) for x in (places, firsts, lasts))
    return place, h[place], first, last


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int, int]]]]:
    """(data, valid window starts, [(place in data, row id, place in the text)]) of texts put together, long ones cut with an overlap."""
    held, rows, size = [], [], 0

    def given() -> tuple[bytes, np.ndarray, list[tuple[int, int, int]]]:
        data = b"".join(held)
        valid = np.zeros(len(data) - width + 1, bool)
        for part, (at, _, _) in zip(held, rows, strict=True):
            valid[at : at + len(part) - width + 1] = True
        return data, valid, rows

    for batch in batches:
        for rid, text in zip(batch["__rid"].to_pylist(), batch["text"].to_pylist(), strict=True):
            raw = (text or "").encode()
            for start in range(0, len(raw) - width + 1, SLICE):
                part = raw[start : start + SLICE + width - 1]
                if size and size + len(part) > SLICE + width:
                    yield given()
                    held, rows, size = [], [], 0
                held.append(part)
                rows.append((size, rid, start))
                size += len(part)
    if held:
        yield given()


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _address(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


class Cutter:
    """The pieces of texts: how wide, and which anchors and cores are wanted."""

    def __init__(self, width: int, gram: int, block: int, bits: int, anchors=None, cores=None) -> None:
        if not 1 <= gram <= width or not 1 <= block <= width:
            raise ValueError("an anchor's string and a block must fit into the width")
        self.width, self.gram, self.block, self.bits = width, gram, block, bits
        self.anchors, self.cores = anchors, cores

    def buckets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, many): how often anchors fall into each bucket, no further than 2."""
        for data, valid, _ in _slices(batches, self.width):
            _, h, _, _ = anchors(np.frombuffer(data, np.uint8), valid, self.width, self.gram)
            at, many = np.unique(_address(h, self.bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.minimum(many, 2).astype(np.int64))], names=["bucket", "many"])

    def pieces(self, batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
        """(rid, at, low, high, core, own), own of all bytes, or with left and right for own: windows start low to high bytes before at, where the core starts."""
        block, core = self.block, self.width - self.block + 1
        wanted = self.anchors.value
        cores = self.cores.value if self.cores is not None else None
        digest = xxhash.xxh3_128_digest
        for data, valid, rows in _slices(batches, self.width):
            place, h, first, last = anchors(np.frombuffer(data, np.uint8), valid, self.width, self.gram)
            keep = _set(wanted, _address(h, self.bits))
            place, first, last = place[keep], first[keep], last[keep]
            near, far = (place - last) // block, (place - first) // block
            times = far - near + 1
            which = np.repeat(np.arange(len(place)), times)
            j = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + near[which]
            at = place[which] - j * block
            low, high = np.maximum(0, at - last[which]), np.minimum(block - 1, at - first[which])
            starts = np.array([r[0] for r in rows])
            row = np.searchsorted(starts, first[which], side="right") - 1
            keys = [digest(data[a : a + core]) for a in at.tolist()]
            if cores is not None:
                heads = np.frombuffer(b"".join(keys), np.uint64)[::2] if keys else np.zeros(0, np.uint64)
                some = np.flatnonzero(_set(cores, _address(heads, self.bits)))
                at, low, high, row, keys = at[some], low[some], high[some], row[some], [keys[i] for i in some]
            rids, bases = np.array([r[1] for r in rows], np.int64)[row], np.array([r[2] - r[0] for r in rows], np.int64)[row]
            a, lo, hi = at.tolist(), low.tolist(), high.tolist()
            if with_bytes:
                left = [data[x - y : x] for x, y in zip(a, hi, strict=True)]
                right = [data[x + core : x + self.width - y] for x, y in zip(a, lo, strict=True)]
                own = [pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            else:
                own = [pa.array([digest(data[x - y : x + self.width - z], z * block + y) for x, y, z in zip(a, hi, lo, strict=True)], pa.binary())]
            columns = [pa.array(rids), pa.array(at + bases), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), pa.array(keys, pa.binary()), *own]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "at", "low", "high", "core", *(["left", "right"] if with_bytes else ["own"])])


def bitmap(buckets: DataFrame, least: int, bits: int):
    """Broadcast bitmap of the buckets whose many sum to least or more; the driver gets the bitmap alone, whose size is fixed."""
    spark = buckets.sparkSession
    often = buckets.groupBy("bucket").agg(F.sum("many").alias("many")).filter(F.col("many") >= least)
    words = often.groupBy(F.expr("shiftright(bucket, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("word"))
    held = np.zeros(1 << (bits - 6), np.int64)
    chunks = words.groupBy(F.expr(f"shiftright(at, {CHUNK.bit_length() - 7})").alias("chunk")).agg(F.collect_list(F.struct("at", "word")).alias("words"))
    for row in chunks.toLocalIterator():
        held[[w["at"] for w in row.words]] = [w["word"] for w in row.words]
    return spark.sparkContext.broadcast(held.view(np.uint8))


class Collection:
    """Pieces of many groups in the order of their suffixes, with the common prefixes of neighbours.

    Columns enter from the right end to the left: a round puts one symbol before each piece's suffix.  Sorting by it, in the order of the round before,
    gives the order of the longer suffixes; the symbols read in the old order are the round's column of the collection's transform.  shared[i] is how many symbols
    right of the core the pieces i - 1 and i of the order have in common, or -1 where they differ before.
    """

    def __init__(self, group: np.ndarray) -> None:
        self.order = np.argsort(group, kind="stable")
        self.group = group
        self.shared = np.zeros(len(group), np.int64)
        g = group[self.order]
        self.shared[np.append(True, g[1:] != g[:-1])] = -1

    def insert(self, column: np.ndarray, right: bool) -> None:
        """Put column[i] before the suffix of piece i; 0 stands for no symbol."""
        symbols = column[self.order].astype(np.int64)
        keyed = self.group[self.order] * 512 + symbols
        moved = np.argsort(keyed, kind="stable")
        keyed = keyed[moved]
        same = np.append(False, keyed[1:] == keyed[:-1])
        to = np.flatnonzero(same)
        shared = np.full(len(moved), -1, np.int64)
        if right:
            g = self.group[self.order[moved]]
            shared[1:][g[1:] == g[:-1]] = 0
        shared[to] = _range_least(self.shared, moved[to - 1], moved[to]) + (1 if right else 0)
        self.order, self.shared = self.order[moved], shared

    def longest(self) -> np.ndarray:
        """For each place of the order the symbols right of the core shared with the better neighbour."""
        return np.maximum(self.shared, np.append(self.shared[1:], -1))

    def drop_single(self) -> None:
        """Pieces that share their core and all symbols left of it with no other can meet none later."""
        keep = self.longest() >= 0
        if not keep.all():
            self.order, self.shared = self.order[keep], self.shared[keep]


def _range_least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a + 1 .. b]) for each pair."""
    out = x[b].copy()
    far = np.flatnonzero(b - a > 1)
    if len(far):
        length = (b - a)[far]
        level = np.frexp(length.astype(np.float64))[1] - 1
        table = x
        for j in range(int(level.max()) + 1):
            if j:
                table = np.minimum(table[: len(table) - (1 << (j - 1))], table[1 << (j - 1) :])
            now = level == j
            if now.any():
                at = far[now]
                out[at] = np.minimum(table[a[at] + 1], table[b[at] + 1 - (1 << j)])
    return out


def _symbols(parts: list[bytes], width: int) -> np.ndarray:
    """parts as rows of symbols 1 to 256, filled up by 0; a column's symbols lie together."""
    sizes = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), width), np.uint16)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    return np.asfortranarray(out)


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], block: int) -> np.ndarray:
    """For each piece and distance y below block: does the window that starts y bytes before the core occur in another piece of its group?

    A piece has the windows whose bytes it has: y up to the length of left, and from block - 1 less the length of right.
    """
    out = np.zeros((len(group), block), bool)
    held = Collection(group)
    after = _symbols(right, max(1, block - 1))
    for t in range(block - 2, -1, -1):
        held.insert(after[:, t], True)
    out[held.order, 0] = held.longest() >= block - 1
    before = _symbols([p[::-1] for p in left], max(1, block - 1))
    for y in range(1, block):
        held.insert(before[:, y - 1], False)
        held.drop_single()
        if not len(held.order):
            break
        out[held.order, y] = held.longest() >= block - 1 - y
    y = np.arange(block)
    low, high = block - 1 - np.array([len(p) for p in right]), np.array([len(p) for p in left])
    return out & (y >= low[:, None]) & (y <= high[:, None])


def _solve(pieces: DataFrame, width: int) -> DataFrame:
    """(rid, start, stop): what the pieces with n = 1 share with others of their group (core, block)."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for block in {r[1] for r in rows}:
            some = [r for r in rows if r[1] == block]
            groups: dict[bytes, int] = {}
            group = np.array([groups.setdefault(r[0], len(groups)) for r in some], np.int64)
            found = repeated_windows(group, [r[2] for r in some], [r[3] for r in some], block)
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            for i, a, b in zip(*np.nonzero(edge == 1), np.nonzero(edge == -1)[1], strict=True):
                r = some[i]
                if r[4] == 1:
                    out.append((r[5], r[6] - (int(b) - 1), r[6] - int(a) + width))
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("core", "block", "left", "right", "n", "rid", "at")), strict=True):
                if len(rows) >= TOGETHER and row[:2] != rows[-1][:2]:
                    yield solved(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solved(rows)

    dealt = pieces.select("core", "block", "left", "right", "n", "rid", "at").repartition("core").sortWithinPartitions("core", "block")
    return dealt.mapInArrow(run, "rid long, start long, stop long")


def _halved(pieces: DataFrame) -> DataFrame:
    """Pieces of large groups cut into two blocks of half the distances; the bytes that all windows of a half hold join its core."""
    m = F.expr("CAST(block DIV 2 AS INT)")
    part = lambda c, start, length: F.substring(F.col(c), start, F.greatest(length, F.lit(0)))
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    low, high = F.col("block") - 1 - n_right, n_left
    more = F.col("block") - m
    near_left, far_right = F.least(high, m - 1), F.least(n_right, more - 1)
    near = F.struct(
        F.lit(0).alias("side"), m.alias("block"), F.col("at").alias("at"), part("right", F.lit(1), more).alias("joins"),
        part("left", n_left - near_left + 1, near_left).alias("left"), part("right", more + 1, n_right - more).alias("right"), (low <= m - 1).alias("has"),
    )
    far = F.struct(
        F.lit(1).alias("side"), more.alias("block"), (F.col("at") - m).alias("at"), part("left", n_left - m + 1, m).alias("joins"),
        part("left", F.lit(1), n_left - m).alias("left"), part("right", F.lit(1), far_right).alias("right"), (high >= m).alias("has"),
    )
    cut_up = pieces.select("core", "n", "rid", F.explode(F.array(near, far)).alias("h")).filter("h.has")
    # Both halves keep all their bytes: what is no longer beside the core is in its name.
    name = F.unhex(F.md5(F.concat("core", F.col("h.side").cast("string").cast("binary"), "h.joins")))
    return cut_up.select(name.alias("core"), "h.block", "h.left", "h.right", "n", "rid", "h.at")


def passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, group: int = GROUP, bits: int = BITS) -> DataFrame:
    """(rid, start, stop): spans of bytes of docs (__rid, text) that width-byte strings starting anywhere else cover; spans may overlap.

    Copies are found by count: pieces equal in full are all repeated.  Pieces that share a core and differ go, one of each kind, to a
    collection; groups too large for one are halved until they fit or nothing but counting is left.
    """
    block = min(block, width)
    cutter = Cutter(width, gram, block, bits)
    wanted = bitmap(docs.mapInArrow(cutter.buckets, "bucket int, many long"), 2, bits)
    first = Cutter(width, gram, block, bits, wanted)
    kinds = "rid long, at long, low short, high short, core binary"
    rows = cut(docs.mapInArrow(lambda b: first.pieces(b, False), f"{kinds}, own binary"))
    kept = cut(rows.groupBy("core", "own").agg(F.count(F.lit(1)).alias("n")))
    several = kept.filter("n > 1").select("own")  # own is of the core, too
    copies = rows.join(small(several, 200_000), "own", "left_semi")
    marks = copies.select("rid", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + width).alias("stop"))
    mixed = kept.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    cores = bitmap(_core_buckets(mixed, bits), 1, bits)
    second = Cutter(width, gram, block, bits, wanted, cores)
    given = docs.mapInArrow(lambda b: second.pieces(b, True), f"{kinds}, left binary, right binary")
    pieces = given.groupBy("core", "left", "right").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.min("at").alias("at")).withColumn("block", F.lit(block))
    pieces = cut(pieces)
    while True:
        sizes = pieces.groupBy("core", "block").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        sizes = cut(sizes)
        fitting = pieces.join(small(sizes.filter(F.col("kinds") <= group).select("core", "block"), 200_000), ["core", "block"], "left_semi")
        marks = marks.unionByName(_solve(fitting, width))
        large = sizes.filter((F.col("kinds") > group) & (F.col("block") > 1)).select("core", "block")
        if large.isEmpty():
            return marks
        halves = cut(_halved(pieces.join(small(large, 200_000), ["core", "block"], "left_semi")))
        pieces = cut(halves.groupBy("core", "block", "left", "right").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"), F.min("at").alias("at")))
        again = pieces.filter("n > 1").select("core", "block", "left", "right")
        found = halves.filter("n = 1").join(again, ["core", "block", "left", "right"], "left_semi")
        low = F.col("block") - 1 - F.octet_length("right")
        marks = marks.unionByName(found.select("rid", (F.col("at") - F.octet_length("left")).alias("start"), (F.col("at") - low + width).alias("stop")))


def _core_buckets(cores: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["core"].to_pylist()
            at = np.unique(_address(np.frombuffer(b"".join(keys), np.uint64)[::2], bits)) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.ones(len(at), np.int64))], names=["bucket", "many"])

    return cores.select("core").mapInArrow(run, "bucket int, many long")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, group: int = GROUP, bits: int = BITS, with_text: bool = True) -> DataFrame:
    """doc_id, kept (the remaining bytes, if with_text), spans (removed, merged), n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    Each byte that a width-byte string covers which also starts anywhere else, in the same text or another, goes; strings are judged on the input.  Null texts are
    empty; texts below width bytes stay whole; null doc_ids and repeated rows stay as they are (copies remove each other); other columns are not read.
    An empty table gives an empty result.  Equality is that of 128-bit digests of cores and of the bytes beside them.
    """
    rows = numbered(docs.select("doc_id", "text"), "__rid")
    marks = cut(passages(rows.select("__rid", "text"), width, gram, block, group, bits))
    spans = marks.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(spans, "__rid", "left")
    doc = joined.schema["doc_id"].dataType
    kinds = f"doc_id {doc.simpleString()}, {'kept binary, ' * with_text}spans array<struct<start: long, stop: long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                out: list[list] = [[] for _ in range(6)]
                for text, spans in zip(batch["text"], batch["spans"], strict=True):
                    raw = (text.as_py() or "").encode()
                    gone = _merged(spans.as_py() or [])
                    kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in gone)], [*(s[0] for s in gone), len(raw)], strict=True))
                    row = (kept, [{"start": a, "stop": b} for a, b in gone], len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = [pa.binary(), span, pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                names = ["kept", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns[0 if with_text else 1 :]], names=["doc_id", *names[0 if with_text else 1 :]])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, kinds)
