"""Repair of conversation structure: a forward Viterbi pass per conversation over four grammar states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: White space inside texts: space and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar (s?(ua)+)? as states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
#: The user or assistant row that may follow in each state.
WANTED = {q: next(c for c in to if c != "s") for q, to in NEXT.items()}
ROLE = {"u": "user", "a": "assistant"}
#: Rows after which the strings of a long conversation are put away as a link of a chain.
LINK = 512
#: Conversations of so many rows at most are looked up among those solved already (so many at most).
SHORT, SOLVED = 64, 65_536


def moves(code: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letter) of a row; code is its role's initial (s, u, a or ?) and its fault (b, d, t or -)."""
    initial, fault = code
    found = [(q, q, DELETE, "D") for q in NEXT]
    if fault in "bd":
        return found
    extra = TRUNCATED if fault == "t" else 0
    for q, to in NEXT.items():
        if initial in to:
            found.append((q, to[initial], extra, "K"))
        found.append((q, to[WANTED[q]], REROLE + extra, "R"))
    return found


MOVES = {i + f: moves(i + f) for i in "sua?" for f in "bdt-"}


class Layers:
    """The layers of one conversation, row by row: for each state the least (cost, audit).

    An audit is (rank, tail): links hold the settled beginnings, which end in a row's letter and so are never the
    beginning of one another; their ranks keep their order, so audits of equal cost compare as (rank, tail).
    """

    def __init__(self) -> None:
        self.links: list[tuple] = [(None, "")]
        self.at: dict[int, tuple[int, int, str]] = self._closed({0: (0, 0, "")})
        self.fed = 0

    @staticmethod
    def _closed(layer: dict[int, tuple[int, int, str]]) -> dict[int, tuple[int, int, str]]:
        """The layer with insertions; three in a row reach every state that insertions reach."""
        for _ in range(3):
            for q, (cost, rank, tail) in list(layer.items()):
                to = NEXT[q][WANTED[q]]
                found = (cost + INSERT, rank, tail + "I")
                if to not in layer or found < layer[to]:
                    layer[to] = found
        return layer

    def feed(self, code: str) -> None:
        layer: dict[int, tuple[int, int, str]] = {}
        for q, to, cost, letter in MOVES[code]:
            if q in self.at:
                before, rank, tail = self.at[q]
                found = (before + cost, rank, tail + letter)
                if to not in layer or found < layer[to]:
                    layer[to] = found
        self.at = self._closed(layer)
        self.fed += 1
        if self.fed % LINK == 0:
            self._link()

    def _link(self) -> None:
        """Put the tails up to their last row's letter away."""
        split = {q: (c, (r, t.rstrip("I")), t[len(t.rstrip("I")) :]) for q, (c, r, t) in self.at.items()}
        keys = sorted({k for _, k, _ in split.values()})
        self.links = [(self.links[rank], text) for rank, text in keys]
        self.at = {q: (c, keys.index(k), rest) for q, (c, k, rest) in split.items()}

    def best(self) -> tuple[int, str]:
        cost, rank, tail = min(self.at[q] for q in ENDS if q in self.at)
        parts, link = [tail], self.links[rank]
        while link is not None:
            link, text = link
            parts.append(text)
        return cost, "".join(reversed(parts))


def cheapest(codes: Iterable[str]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ASCII-least among the cheapest."""
    layers = Layers()
    for code in codes:
        layers.feed(code)
    return layers.best()


@lru_cache(SOLVED)
def _known(codes: tuple[str, ...]) -> tuple[int, str]:
    return cheapest(codes)


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by crc32("conv_id:turn") % 20 (nulls as one space): 0 drops the row (it stays here with dropped set), 1 empties the
    text, 2 takes its . ! ? away, 3 repeats the row, 4 makes its role user; null roles and texts become one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind").isin(0, 1), "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("__kind") == 0).alias("dropped"), F.explode(times).alias("__copy"))
    return rows.drop("__copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with __conv (conv_id, null as one space) and __text, by which rows of equal turn and role are ordered."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    return rows.withColumns({"__conv": conv, "__text": F.md5(F.encode("text", "UTF-8"))})


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("__text").asc()]


def reports(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: conv_id, turn, role, text, dropped (such rows only keep their conversation in the result).  Rows go by turn, nulls first, then role
    and md5 of the text.  A row's first fault counts: blank, duplicate (role and text seen earlier), truncated.  Earlier rows are found by
    counts per (conversation, role, text), so only a code for each row goes through the task of its conversation.
    """
    keyed = _keyed(rows)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = keyed.filter(~F.col("dropped")).groupBy("__conv", "role", "__text").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    bare = F.when(F.col("dropped"), "x").when(last == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t")
    lean = keyed.select("__conv", "conv_id", "turn", "role", "__text", bare.alias("__bare"))
    lean = lean.join(again.select("__conv", "role", "__text", "__first"), ["__conv", "role", "__text"], "left")
    later = F.col("__first").isNotNull() & (F.col("__first") < place)
    first = F.substring("role", 1, 1)
    lean = lean.withColumns({"__later": F.coalesce(later, F.lit(False)), "__initial": first})
    lean = lean.repartition("__conv").sortWithinPartitions(F.col("__conv"), *_order())
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: _Conversation | None = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("__conv", "conv_id", "turn", "role", "__text", "__bare", "__later", "__initial")]
            for conv, *row in zip(*columns, strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(conv, row[0])
                now.add(*row[1:])
            if len(out) >= 4096:
                yield _batch(out, kinds, names)
                out = []
        if now is not None:
            out.append(now.close())
        yield _batch(out, kinds, names)

    return lean.select("__conv", "conv_id", "turn", "role", "__text", "__bare", "__later", "__initial").mapInArrow(run, kinds)


def _batch(rows: list[tuple], kinds: str, names: list[str]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k.split()[1]]) for c, k in zip(columns, kinds.split(", "), strict=True)], names=names)


class _Conversation:
    """Counts and codes of one conversation while its rows pass."""

    def __init__(self, conv: str, conv_id: int | None) -> None:
        self.conv, self.conv_id = conv, conv_id
        self.faults = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.last = None
        self.codes: list[str] = []
        self.layers: Layers | None = None

    def add(self, turn: int | None, role: str, text: str, bare: str, later: bool, initial: str) -> None:
        if bare == "x":
            return
        fault = "d" if bare != "b" and (later or self.last is not None and self.last[:3] == (turn, role, text)) else bare
        self.faults[fault] += 1
        if self.last is not None:
            self.illegal += self.last[3] + initial not in ("su", "ua", "au")
        if turn is not None:
            if self.high != turn:
                self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = (turn, role, text, initial)
        code = (initial if initial in ("s", "u", "a") else "?") + fault
        if self.layers is not None:
            self.layers.feed(code)
        else:
            self.codes.append(code)
            if len(self.codes) > SHORT:
                self.layers = Layers()
                for code in self.codes:
                    self.layers.feed(code)

    def close(self) -> tuple:
        cost, audit = self.layers.best() if self.layers is not None else _known(tuple(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, cost, audit


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text, edit (K, R or I); found is what reports(rows) gives.

    A conversation's audit goes before its rows through one task, which follows the audit and holds one row at a time.
    """
    body = _keyed(rows.filter(~F.col("dropped"))).select("__conv", "conv_id", F.lit(1).alias("__part"), "turn", "role", "text", "__text")
    none = F.lit(None)
    head = found.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("__conv"), "conv_id", F.lit(0).alias("__part"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("__text")
    )
    both = head.unionByName(body.withColumn("turn", F.col("turn").cast("long")))
    both = both.repartition("__conv").sortWithinPartitions(F.col("__conv"), F.col("__part"), *_order())
    kinds = "conv_id long, place long, role string, text string, edit string"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, audit, at, state, place = None, "", 0, 0, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                role = ROLE[WANTED[state]]
                state = NEXT[state][WANTED[state]]
                yield conv_id, place, role, "", "I"
                at, place = at + 1, place + 1

        for batch in batches:
            out: list[tuple] = []
            for part, conv, role, text in zip(*(batch[c].to_pylist() for c in ("__part", "conv_id", "role", "text")), strict=True):
                if part == 0:
                    conv_id, audit, at, state, place = conv, text, 0, 0, 0
                    out.extend(inserted())
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    initial = WANTED[state] if edit == "R" else role[0]
                    out.append((conv_id, place, ROLE[initial] if edit == "R" else role, text, edit))
                    state, place = NEXT[state][initial], place + 1
                out.extend(inserted())
            yield _batch(out, kinds, names)

    return both.select("conv_id", "__part", "role", "text").mapInArrow(run, kinds)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired turns) of conversations: conv_id, turn, role, text, dropped, as damage() gives them.

    Null roles and texts must have been replaced; a null conv_id is a conversation of its own, a null turn comes first and counts in no gap.  Conversations
    without rows give zeros, an empty audit and no turns; empty tables give empty results; other columns are ignored.
    """
    found = cut(reports(rows))
    return found, repaired_turns(rows, found)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns in the order of repaired_turns(): sha256 of role:text, joined by newlines."""
    kinds = "conv_id long, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if now is not None:
                        out.append((now[0], now[1].hexdigest()))
                    now = (conv, hashlib.sha256())
                else:
                    now[1].update(b"\n")
                now[1].update(f"{role}:{text}".encode())
            if len(out) >= 4096:
                yield _batch(out, kinds, ["conv_id", "repaired_sha256"])
                out = []
        if now is not None:
            out.append((now[0], now[1].hexdigest()))
        yield _batch(out, kinds, ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, kinds)


def digest(rows: DataFrame) -> DataFrame:
    """reports(rows) with repaired_sha256 (of nothing, where no turn is left)."""
    found, repaired = repair(rows)
    sums = digests(repaired).withColumnRenamed("conv_id", "__id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = found.join(sums, found["conv_id"].eqNullSafe(sums["__id"]), "left").drop("__id")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing))
