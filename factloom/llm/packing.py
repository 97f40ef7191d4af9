"""Best-fit packing of token sequences by linear grouping."""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_totals

#: Sequence capacity in tokens; id that ends a document; part of the capacity from which a piece is large; groups of large pieces.
CAPACITY, END_ID, LARGE_FROM, GROUPS = 2048, 0, 1 / 8, 512

#: Characters of texts that are encoded together; words whose ids are kept, and the longest of them; new words that are encoded as one text;
#: words whose ids are laid out at once.
TOGETHER, KEPT, LONGEST, JOINED, BLOCK = 1 << 20, 250_000, 64, 256, 1 << 17

_TOKENIZERS: dict[str, tuple[object, bool, np.ndarray, bool]] = {}
_WORDS = re.compile(r"(?= \S)")
#: Words whose pieces before the model are sure: letters and the signs behind them, perhaps with another line's first letters and signs (for Arrow).
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:;=>?@\[-`{}~"
_PIECES = f"^(?P<a> ?[{_LETTERS}]+)(?P<b>[{_SIGNS}]+)(?:(?P<c>\n)(?P<d>[{_LETTERS}]+)(?P<e>[{_SIGNS}]*))?$"


def _tokenizer(path: str) -> tuple[object, bool, np.ndarray, bool]:
    """The tokenizer of a tokenizers JSON file, whether a text's ids are those of its words one after the other, how many bytes each id stands for,
    and whether those of a word are those of its pieces by _PIECES.

    They are where byte-level pre-tokenizing by its usual rule is all that comes before the model: that rule always starts a new piece
    at a space that a character other than white space follows, and between letters and signs; no word of _PIECES has the signs < and | of an added token.
    """
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        spec = json.loads(library.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        whole = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        apart = all("<" in t["content"] or "|" in t["content"] for t in spec["added_tokens"])
        sizes = {i: len(t) for t, i in library.get_vocab().items()} | {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
        n_bytes = np.zeros(max(sizes, default=0) + 1, np.int64)
        n_bytes[list(sizes)] = list(sizes.values())  # a byte is one character of the alphabet that byte-level tokens are written in
        _TOKENIZERS[path] = library, bool(plain and whole), n_bytes, bool(plain and whole and apart)
    return _TOKENIZERS[path]


class Encoder:
    """Ids of texts by the tokenizers library, without special tokens around them; distinct words, or pieces of them, are encoded once, together.

    Words stay Arrow columns and their ids arrays: only words not seen lately become Python strings, for the library.
    """

    def __init__(self, path: str):
        self.library, self.by_words, self.n_bytes, self.by_pieces = _tokenizer(path)
        self.kept = self.older = _Told()  # words used since the last turn, and those of the turn before

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return self._ids(texts)
        words, places, ends = _split(texts)
        if self.by_pieces:
            pieces, parts, n_parts = _pieces(words)
            told = self._known(pieces)
            many = np.bincount(np.repeat(np.arange(len(n_parts)), n_parts), told.many[parts], len(n_parts)).astype(np.int64)
            told = _Told(words, told.of(parts), many)
        else:
            told = self._known(words)
        ids = told.of(places)
        stops = np.concatenate(([0], np.cumsum(told.many[places])))[ends].tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _known(self, words: pa.Array) -> _Told:
        """Distinct words with their ids, which come from those kept or else from the library."""
        if 2 * len(self.kept.words) > KEPT:
            self.kept, self.older = _Told(), self.kept
        parts, at, n = [self.kept, self.older], np.full(len(words), -1), 0
        for had in parts:
            found = pc.index_in(had.words, words).fill_null(-1).to_numpy()
            own = np.flatnonzero(found >= 0)
            at[found[own]] = own + n
            n += len(found)
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(len(new)) + n
        parts.append(_Told(None, *self._words(words.take(pa.array(new)).to_pylist())))
        every = _Told(None, np.concatenate([x.ids for x in parts]), np.concatenate([x.many for x in parts]))
        add = np.flatnonzero((at >= len(self.kept.words)) & (pc.utf8_length(words).to_numpy() <= LONGEST))
        self.kept = _Told(pa.concat_arrays([self.kept.words, words.take(pa.array(add))]), np.concatenate([self.kept.ids, every.of(at[add])]), np.concatenate([self.kept.many, every.many[at[add]]]))
        return _Told(words, every.of(at), every.many[at])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has.

        Words that start at a space before a character go to the library many as one text, whose ids are told apart by the bytes they stand for.
        """
        spaced = [i for i, w in enumerate(words) if w[:1] == " " and w[1:2] and not w[1].isspace()]
        singly = np.ones(len(words), bool)
        singly[spaced] = False
        order, ids, many = [], [], []
        runs = [spaced[lo : lo + JOINED] for lo in range(0, len(spaced), JOINED)]
        for run, told in zip(runs, self._ids(["".join([words[i] for i in run]) for run in runs]), strict=True):
            ends = np.cumsum(self.n_bytes[told])
            want = np.cumsum(pc.binary_length(pa.array([words[i] for i in run])).to_numpy())
            last = np.searchsorted(ends, want)
            if ends[-1] != want[-1] or (ends[last] != want).any():
                singly[run] = True
                continue
            order += run
            ids.append(told)
            many.append(np.diff(last, prepend=-1))
        rest = np.flatnonzero(singly).tolist()
        alone = self._ids([words[i] for i in rest])
        many = np.concatenate([*many, np.array([len(x) for x in alone], np.int64)])
        told = _Told(None, np.concatenate([np.zeros(0, "<u4"), *ids, *alone]), many)
        back = np.argsort(np.array([*order, *rest], np.int64))
        return told.of(back), many[back]


class _Told:
    """Words, the ids of all of them one after the other, and how many each has."""

    def __init__(self, words: pa.Array | None = None, ids: np.ndarray | None = None, many: np.ndarray | None = None):
        self.words = pa.array([], pa.large_string()) if words is None else words
        self.ids = np.zeros(0, "<u4") if ids is None else ids
        self.many = np.zeros(0, np.int64) if many is None else many

    def of(self, number: np.ndarray) -> np.ndarray:
        """The ids of the words of these numbers, one after the other."""
        starts, out = np.cumsum(self.many) - self.many, []
        for lo in range(0, len(number), BLOCK):
            some = number[lo : lo + BLOCK]
            n = self.many[some]
            after = np.cumsum(n)
            out.append(self.ids[np.repeat(starts[some] - after + n, n) + np.arange(after[-1])])
        return np.concatenate(out) if out else self.ids[:0]


def _split(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of the word at each place of all texts, and the place after each text's last.

    A word starts at a text's start and at each space that a character other than white space follows.
    """
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    bare, number, many = coded.dictionary, coded.indices.to_numpy().astype(np.int64), pc.list_value_length(split).to_numpy()
    first = np.cumsum(many) - many
    # No word starts at a space that ends a text or stands before white space: texts that have such are split once more, by the rule itself.
    begin = pc.utf8_slice_codeunits(bare, 0, 1).dictionary_encode()
    none = np.array([not c or c.isspace() for c in begin.dictionary.to_pylist()], bool)[begin.indices.to_numpy()]
    wrong = none[number]
    wrong[first] = False
    again = np.logical_or.reduceat(wrong, first) if len(texts) else np.zeros(0, bool)
    # A text's first word has no space before it.
    begun = np.unique(number[first])
    number[first] = len(bare) + np.searchsorted(begun, number[first])
    words = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), bare, pa.scalar("", pa.large_string())), bare.take(pa.array(begun))])
    if again.any():
        own = [_WORDS.split(texts[t]) for t in np.flatnonzero(again).tolist()]
        coded = pa.concat_arrays([words, pa.array(itertools.chain.from_iterable(own), pa.large_string())]).dictionary_encode()
        code, left = coded.indices.to_numpy().astype(np.int64), number[np.repeat(~again, many)]
        many = many.copy()
        many[again] = [len(x) for x in own]
        here = np.repeat(again, many)
        number = np.empty(len(here), np.int64)
        number[here], number[~here] = code[len(words) :], code[left]
        words = coded.dictionary
    used = np.bincount(number, minlength=len(words)) > 0
    return words.filter(pa.array(used)), (np.cumsum(used) - 1)[number], np.cumsum(many)


def _pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of words, the numbers of the pieces of all words one after the other, and how many each word has."""
    apart = pc.extract_regex(words, _PIECES)
    whole = apart.is_null()
    columns = [pc.if_else(whole, words, apart.field(0)), *(apart.field(i) for i in range(1, apart.type.num_fields))]
    columns[1:] = [pc.if_else(whole, pa.scalar("", pa.large_string()), c) for c in columns[1:]]
    coded = pa.concat_arrays(columns).dictionary_encode()
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    number = coded.indices.to_numpy().astype(np.int64).reshape(len(columns), len(words)).T
    held = ~empty[number]
    return coded.dictionary, number[held], held.sum(1)


#: Encoders by tokenizer file, kept from task to task.
_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut them: (__rid, doc_id, piece, start, length, ids_crc32 and, if asked for, ids).

    A document is its ids followed by end_id.  Only documents longer than capacity are cut, into pieces of capacity
    tokens of which the first may be shorter.  Null texts are empty.
    """
    schema = "__rid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    names = ["__rid", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        for batch in batches:
            size = np.cumsum([len(x) if (x := t.as_py()) else 0 for t in batch["text"]])
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOGETHER, side="right")))
                yield _cut_up(batch.slice(lo, hi - lo), encoder)
                lo = hi
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    def _cut_up(part: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        texts = [t.as_py() or "" for t in part["text"]]
        for rid, doc, told in zip(part["__rid"].to_pylist(), part["doc_id"].to_pylist(), encoder.encode(texts), strict=True):
            ids = np.append(told, np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row = (rid, doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                for column, value in zip(out, (*row, ids[a:b].tolist()) if with_ids else row, strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("__rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_from: float = LARGE_FROM) -> list[tuple[int, int, int, int, int]]:
    """Pack counts[length] pieces of each length: segments (length, first rank, pieces, first sequence, offset, stride 1).

    The piece of rank r of a segment goes to sequence (first sequence + r - first rank) at the segment's offset.
    Linear grouping: large pieces, longest first, are dealt into groups of equal cardinality and
    count as the longest of their group.  Configurations of these few sizes are chosen one after the other, each the
    fullest that the pieces left allow, and used as often as they allow; actual pieces, longest first, take the places of their group.
    Small pieces then go, longest first, to the sequence with the least room that holds them.
    Work and result depend on the number of distinct lengths and groups, not on the number of pieces.
    """
    out: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    n_bins = 0
    if full := counts.get(capacity, 0):
        out.append((capacity, 0, full, 0, 0))
        n_bins = full
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if large_from * capacity <= n < capacity and counts[n]]
    total = sum(c for _, c in large)
    # runs of group members: per group a list of [actual length, pieces left], longest first
    per, grouped = max(1, -(-total // groups)), []
    room = 0
    for n, c in large:
        while c:
            if not room:
                grouped.append([])
                room = per
            k = min(room, c)
            grouped[-1].append([n, k])
            room, c = room - k, c - k
    size = [g[0][0] for g in grouped]
    left = [sum(k for _, k in g) for g in grouped]
    free: dict[int, list[tuple[int, int, int]]] = {}  # room -> runs (first sequence, sequences)

    def place(first: int, many: int, members: list[int]) -> None:
        """Fill a run of sequences with one piece of each group in members, splitting it where actual lengths change."""
        at = [(first, many, 0)]
        for g in members:
            nxt = []
            for b, m, o in at:
                while m:
                    run = grouped[g][0]
                    k = min(m, run[1])
                    out.append((run[0], used[run[0]], k, b, o))
                    used[run[0]] += k
                    nxt.append((b, k, o + run[0]))
                    run[1] -= k
                    if not run[1]:
                        grouped[g].pop(0)
                    b, m = b + k, m - k
            at = nxt
        for b, m, o in at:
            if o < capacity:
                free.setdefault(capacity - o, []).append((b, m))

    lead = 0
    while True:
        while lead < len(left) and not left[lead]:
            lead += 1
        if lead == len(left):
            break
        take = _fullest(size, left, lead, capacity)
        many = min(left[g] // k for g, k in take.items())
        for g, k in take.items():
            left[g] -= many * k
        place(n_bins, many, [g for g in sorted(take) for _ in range(take[g])])
        n_bins += many
    rooms = sorted(free)
    for n in sorted((n for n in counts if n < large_from * capacity and counts[n]), reverse=True):
        c = counts[n]
        while c:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                k = capacity // n
                runs = [(n_bins, -(-c // k))]
                n_bins += runs[0][1]
                r = capacity
            else:
                r = rooms.pop(i)
                runs = free.pop(r)
            while runs and c:
                b, m = runs.pop()
                k = min(r // n, -(-c // m))  # pieces for each sequence of the run, the last of them perhaps for some
                k = max(1, min(k, r // n))
                each = min(m, c // k) or 1
                k = min(k, c)
                if each < m:
                    runs.append((b + each, m - each))
                for j in range(k):
                    out.append((n, used[n], each, b, capacity - r + j * n))
                    used[n] += each
                c -= each * k
                if rest := r - k * n:
                    if rest not in free:
                        free[rest] = []
                        bisect.insort(rooms, rest)
                    free[rest].append((b, each))
            if runs:
                if r not in free:
                    free[r] = []
                    bisect.insort(rooms, r)
                free[r].extend(runs)
    return out


def _fullest(size: list[int], left: list[int], lead: int, capacity: int) -> dict[int, int]:
    """The group lead and those pieces left that fill the rest of a sequence best; of equal fills the one with longer pieces."""
    rest = capacity - size[lead]
    best: list[dict[int, int] | None] = [None] * (rest + 1)
    best[0] = {}
    for g in range(lead, len(size)):
        have = left[g] - (g == lead)
        if have <= 0 or size[g] > rest:
            continue
        for s in range(rest - size[g], -1, -1):
            if best[s] is not None and g not in best[s]:
                for k in range(1, min(have, (rest - s) // size[g]) + 1):
                    if best[s + k * size[g]] is None:
                        best[s + k * size[g]] = best[s] | {g: k}
    top = next(b for b in reversed(best) if b is not None)
    return {**top, lead: top.get(lead, 0) + 1}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens; one row per piece with sequence_id and offset.

    Any number of equal lengths is spread over partitions: pieces are ranked within their length by distributed
    running totals, and only the count of each length (capacity numbers at most) reaches the driver.  Null doc_ids
    and repeated rows are pieces like others; an empty table gives an empty result; columns of docs other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer, capacity, end_id, with_ids))
    counts = {n: c for n, c in rows.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()}
    segments = np.array(sorted(plan(counts, capacity)) or np.zeros((0, 5)), dtype=np.int64)
    ranked = running_totals(rows, ["doc_id", "__rid", "piece"], {}, group=["length"], index="__rank")
    shared = spark.sparkContext.broadcast(segments)  # bounded by lengths and configurations, whatever the number of pieces

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = shared.value
        key = (seg[:, 0] << 48) + seg[:, 1]
        for batch in batches:
            n, rank = (batch[c].to_numpy() for c in ("length", "__rank"))
            s = np.searchsorted(key, (n << 48) + rank, side="right") - 1
            cols = {c: batch[c] for c in batch.schema.names if c not in ("__rank", "__rid")}
            cols |= {"sequence_id": pa.array(seg[s, 3] + rank - seg[s, 1]), "offset": pa.array(seg[s, 4])}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    order = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.select(*order, "__rank").mapInArrow(seat, kinds)
