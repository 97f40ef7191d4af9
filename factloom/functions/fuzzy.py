"""Fuzzy ratios as Arrow-batched functions: longest common subsequences by bit-parallel sums over Python integers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(a):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def _lcs(masks: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of b and the text of size characters that masks describe."""
    full = (1 << size) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = (state + hit | state - hit) & full
    return size - state.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / (length a + length b)."""
    return 200.0 * _lcs(_masks(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def _grams(text: str, size: int) -> np.ndarray:
    """A number for each stretch of size letters; rare collisions only add to what is found alike."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = np.zeros(max(0, len(c) - size + 1), dtype=np.uint64)
    for i in range(size):
        out = (out << np.uint64(16)) + c[i : i + len(out)]
    return out


def _kept(floor: float) -> tuple[int, float]:
    """(size, share): a stretch of s letters at or above floor, held against a text of m, keeps share * (m + s) - size + 1 of its stretches of size letters.

    A letter that the stretch has in addition destroys size of them at most, one that it lacks size - 1.
    """
    for size in (4, 3):
        share = (2 * size - 1) * floor / 200 - (size - 1)
        if share > 0.1:
            break
    return size, share


def _need(length: int, size: int, share: float, floor: float) -> float:
    """How many stretches of size letters a text of that length keeps at least where it is found: with the shortest counterpart that can reach floor."""
    return 2 * share * length / (2 - floor / 100) - size + 1


def _ends(short: str, long: str, floor: float) -> np.ndarray | None:
    """Ends of the stretches of long that keep enough of short to reach floor; None if all may reach it."""
    size, share = _kept(floor)
    m, n = len(short), len(long)
    if _need(m, size, share, floor) <= 0 or share <= 0:
        return None
    asked, grams = _grams(short, size), _grams(long, size)
    order = np.argsort(asked, kind="stable")
    asked = asked[order]
    first, last = np.searchsorted(asked, grams), np.searchsorted(asked, grams, side="right")
    many = last - first
    sums = np.concatenate(([0], np.cumsum(many > 0)))
    # What is kept lies in a band of diagonals (place in long less place in short) that the stretch's start is one of.
    band = int((2 - floor / 50) * m + 1e-6) + 1
    spot = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
    held = np.bincount(np.repeat(np.arange(len(grams)), many) - order[spot] + m + band, minlength=n + m + 2 * band)
    held = np.concatenate(([0], np.cumsum(held)))
    full = held[band:] - held[:-band] >= _need(m, size, share, floor) - 1e-6  # by a band's first diagonal
    full = np.concatenate(([0], np.cumsum(full)))
    end = np.arange(1, n + m)
    lo, hi = np.minimum(np.maximum(end - m, 0), n), np.minimum(end, n)
    top = len(sums) - 1
    kept = sums[np.clip(hi - size + 1, np.minimum(lo, top), top)] - sums[np.minimum(lo, top)]
    start = lo + m + band
    able = (kept >= share * (m + hi - lo) - size + 1 - 1e-6) & (full[np.minimum(start + 1, len(full) - 1)] > full[np.minimum(start + 1 - band, len(full) - 1)])
    return end[able]


#: Letters of a part that is looked up literally, and places that are tried so.
PART, PLACES = 12, 4


def partial_ratio(a: str, b: str, floor: float = 0.0, enough: bool = False) -> float:
    """Best ratio of the shorter text with a stretch of the longer one that is as long, or shorter at either end; 0 if it is below floor.

    A step to the next stretch adds one at most to the common subsequence, so stretches that can't reach the floor or the best ratio so far are skipped,
    as are those that keep too few short stretches of letters.  With enough, the first ratio that reaches floor is given.
    """
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for short, long in {(a, b), (b, a)} if len(a) == len(b) else {min((a, b), (b, a), key=lambda p: len(p[0]))}:
        m, n = len(short), len(long)
        if short in long:
            return 100.0
        masks = _masks(short)

        def at(end: int, m: int = m, masks: dict = masks, long: str = long) -> tuple[int, int]:
            part = long[max(0, end - m) : end]
            return _lcs(masks, m, part), m + len(part)

        # Where a part of short stands literally is the likeliest place.
        for end in sorted({spot - k + m for k in range(0, m - PART + 1, PART) if (spot := long.find(short[k : k + PART])) >= 0})[:PLACES] if enough else ():
            common, both = at(max(1, end))
            if 200.0 * common / both >= floor:
                return 200.0 * common / both
        told = _ends(short, long, floor)
        if told is not None and not len(told):
            continue
        end = 1
        while end < n + m:
            if told is not None:
                i = int(np.searchsorted(told, end))
                if i == len(told):
                    break
                end = int(told[i])
            common, both = at(end)
            best = max(best, 200.0 * common / both)
            if enough and best >= floor:
                return best
            lacking = max(best, floor) * both / 200 - common
            end += max(1, math.ceil(lacking - 1e-9))
    return best if best >= floor else 0.0


#: Diagonals that are counted together; positions of a text that are looked at together; quotes from which on an index over them is worth its making.
DIAGONALS, STEP, MANY = 8, 1 << 15, 12
#: Letters of a quote that is aligned; longer ones are found literally.
ALIGNED = 600


class Quotes:
    """Quotes with the places of each of their short stretches of letters, to tell at one reading of a text which of them may reach floor there.

    What a stretch of the text keeps of a quote lies on diagonals (place in the text less place in the quote) at most as far apart as letters
    are lacking or added, so a quote may reach floor only if some band of diagonals holds enough equal stretches of letters.
    """

    def __init__(self, quotes: list[str], floor: float):
        self.quotes, self.floor = quotes, floor
        self.size, self.share = _kept(floor)
        length = np.array([len(q) for q in quotes], dtype=np.int64)
        self.literal = np.flatnonzero(length > ALIGNED)
        fit = (length >= 4) & (length <= ALIGNED)
        many = fit & (_need(length, self.size, self.share, floor) > 0) & (self.share > 0)
        self.always, self.asked = np.flatnonzero(fit & ~many), np.flatnonzero(many)
        if not len(self.asked):
            return
        self.length = length[self.asked]
        grams = [_grams(quotes[i], self.size) for i in self.asked]
        self.kinds, kind = np.unique(np.concatenate(grams), return_inverse=True)
        order = np.argsort(kind, kind="stable")
        self.owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.many = np.bincount(kind, minlength=len(self.kinds))
        self.first = np.cumsum(self.many) - self.many

    def near(self, text: str) -> list[int]:
        """Places of the quotes that may reach floor in a text, in order."""
        out = [*self.always.tolist(), *(i for i in self.literal.tolist() if self.quotes[i] in text)]
        if len(self.asked):
            out += self.asked[self._able(text)].tolist()
        return sorted(out)

    def _able(self, text: str) -> np.ndarray:
        n, grams, among = len(text), _grams(text, self.size), len(self.asked)
        need = _need(np.minimum(self.length, n), self.size, self.share, self.floor) - 1e-6
        at = np.minimum(np.searchsorted(self.kinds, grams), len(self.kinds) - 1)
        known = self.kinds[at] == grams
        span = np.floor((2 - self.floor / 50) * np.minimum(self.length, n) + 1e-6).astype(int) // DIAGONALS + 2  # groups of diagonals that a band touches at most
        able = need <= 0
        for lo in range(0, len(grams), STEP):
            place = np.flatnonzero(known[lo : lo + STEP + ALIGNED])
            kind = at[lo + place]
            many = self.many[kind]
            spot = np.arange(many.sum()) + np.repeat(self.first[kind] - (np.cumsum(many) - many), many)
            groups = (min(STEP + ALIGNED, len(grams) - lo) + ALIGNED) // DIAGONALS + 1
            base = self.owner * (groups * DIAGONALS) - self.place + ALIGNED
            hits = np.bincount((base[spot] + np.repeat(place, many)) // DIAGONALS, minlength=among * groups).reshape(among, groups)
            sums = np.zeros((among, groups + 1), dtype=np.int32)
            np.cumsum(hits, axis=1, out=sums[:, 1:])
            for w in np.unique(span):
                mine = np.flatnonzero(span == w)
                most = sums[mine, -1] if groups <= w else (sums[mine, w:] - sums[mine, :-w]).max(axis=1)
                able[mine] |= most >= need[mine]
        return able


_LAST: dict[tuple, Quotes] = {}


def quotes_found(quotes: list[str], text: str, floor: float, enough: bool = False) -> list[tuple[int, float]]:
    """(position, partial ratio) of those quotes that reach floor in a text; a quote that is not there literally has ALIGNED characters at most.

    Quotes of which no stretch of the text keeps enough short stretches of letters are left out unaligned.  With enough, scores are any that reach floor.
    """
    if len(quotes) < MANY:
        near = [i for i, q in enumerate(quotes) if 4 <= len(q) and (len(q) <= ALIGNED or q in text)]
    else:
        key = (floor, *quotes)
        if key not in _LAST:
            _LAST.clear()
            _LAST[key] = Quotes(list(quotes), floor)
        near = _LAST[key].near(text)
    out = []
    for i in near:
        score = partial_ratio(quotes[i], text, floor, enough)
        if score >= floor:
            out.append((i, score))
    return out


def token_set_ratio(a: str, b: str) -> float:
    """Ratio of distinct tokens: those of both texts count once, in front of the others of either; 100 if one has no others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_x and only_y):
        return 100.0
    if not both:
        return ratio(only_x, only_y)
    return max(ratio(f"{both} {only_x}", f"{both} {only_y}"), ratio(both, f"{both} {only_x}"), ratio(both, f"{both} {only_y}"))


def _batched(fn: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pandas_udf(run, DoubleType())


#: Pairs that are aligned together, and the entries of their table of letters at most.
TOGETHER, LETTERS = 4096, 1 << 22


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, lengths) of texts: a row of code points for each position, -1 beyond a text's end."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(int(sizes.max()), 1)), -1, dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out.T, sizes


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio of many pairs: the bits of pairs whose first text has 64 characters at most move together, a character of the second text at a step."""
    out = np.zeros(len(a))
    for at in range(0, len(a), TOGETHER):
        x, y = a[at : at + TOGETHER], b[at : at + TOGETHER]
        (first, m), (second, n) = _codes(x), _codes(y)
        number = np.zeros(int(max(first.max(), second.max())) + 2, dtype=np.int64)
        number[first], number[second], number[-1] = 1, 1, 0
        kinds, number = int(number.sum()) + 1, np.cumsum(number) * number  # kind 0 is no letter
        if m.max() > 64 or len(x) * kinds > LETTERS:
            out[at : at + len(x)] = [ratio(p, q) for p, q in zip(x, y, strict=True)]
            continue
        first, second = number[first], number[second]
        masks, row = np.zeros((len(x), kinds), dtype=np.uint64), np.arange(len(x))
        for i, now in enumerate(first):
            masks[row, now] |= np.uint64(1 << i)
        masks[:, 0] = 0
        state = np.full(len(x), ~np.uint64(0))
        for now in second:
            hit = state & masks[row, now]
            state = (state + hit) | (state - hit)
        # bits beyond the first text's length are never hit and stay
        common = 64 - np.bitwise_count(state).astype(int)
        out[at : at + len(x)] = np.where(m + n > 0, 200.0 * common / np.maximum(m + n, 1), 100.0)
    return out


def _plain(a: pd.Series, b: pd.Series) -> pd.Series:
    out, told = np.full(len(a), np.nan), (a.notna() & b.notna()).to_numpy()
    out[told] = ratios(a[told].tolist(), b[told].tolist())
    return pd.Series(out)


plain = pandas_udf(_plain, DoubleType())
plain_once = pandas_udf(_plain, DoubleType()).asNondeterministic()
partial = _batched(partial_ratio)
token_set = _batched(token_set_ratio)


def reaches(quote: Column, text: Column, floor: float) -> Column:
    """Whether the partial ratio of a quote of 4 to 600 characters and a text is floor or more; null if either is."""

    def run(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or t is None else bool(quotes_found([q], t, floor, True)) for q, t in zip(quotes, texts, strict=True)], dtype=object)

    return pandas_udf(run, "boolean")(quote, text)


def all_reach(quotes: Column, text: Column, floor: float) -> Column:
    """Whether each of an array's quotes reaches floor in a text; null quotes count as not there."""

    def run(many: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([all(q is not None and bool(quotes_found([q], t, floor, True)) for q in qs) for qs, t in zip(many, texts, strict=True)], dtype=bool)

    return pandas_udf(run, "boolean")(quotes, text)
