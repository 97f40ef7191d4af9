"""Approximate nearest neighbours by low-dimensional stable projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Projected dimensions; vectors in a leaf of a task's kd-tree; leaves verified in one step; confidence of the stopping test.
DIMENSIONS, LEAF, STEP, CONFIDENCE = 8, 128, 4, 0.96
#: Vectors that a cell of the global tree is planned for, and most cells; projected vectors that its splits are fitted on; rows, and components, of a
#: block of candidates; rows of a block of queries.
CELL, CELLS, SAMPLE, BLOCK, COMPONENTS, QUERIES = 16_384, 16_384, 131_072, 32_768, 1 << 22, 2048


def chi_square_quantile(p: float, k: int) -> float:
    """The value below which a chi-square variable with k (even) degrees of freedom lies with probability p, by bisection."""

    def above(x: float) -> float:
        term, total = math.exp(-x / 2), 0.0
        for i in range(k // 2):
            total += term
            term *= x / 2 / (i + 1)
        return total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > 1 - p else (lo, mid)
    return hi


def _kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: indices, by median splits of the widest dimension."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        part = points[at]
        d = int(np.argmax(part.max(0) - part.min(0)))
        half = len(at) // 2
        order = np.argpartition(part[:, d], half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores of each row; of equal scores the smaller ids."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    worst = np.take_along_axis(scores, at, 1).min(1)
    for r in np.flatnonzero((scores >= worst[:, None]).sum(1) > k):
        if worst[r] > -np.inf:
            at[r] = np.lexsort((ids[r], -scores[r]))[:k]
    return at


def projected(x: np.ndarray, longest: float | None = None, seed: int = 0) -> np.ndarray:
    """Gaussian (2-stable) projections of vectors to DIMENSIONS numbers.

    Largest inner product becomes least distance by one more coordinate: sqrt(longest^2 - |x|^2) for candidates, 0 for queries (longest is None).
    """
    axes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, DIMENSIONS))
    if longest is None:
        return x @ axes[:-1]
    return np.column_stack([x, np.sqrt(np.maximum(0, longest * longest - (x * x).sum(1)))]) @ axes


def cell_tree(points: np.ndarray, cells: int) -> np.ndarray:
    """Rows (axis, value, left, right) of a kd-tree with at most cells leaves; a leaf has axis -1 and its number in left.  Equal points are in one leaf."""
    nodes, todo, n = [[-1.0, 0.0, 0.0, 0.0]], [(0, np.arange(len(points)), cells)], 0
    while todo:
        node, at, want = todo.pop()
        part = points[at]
        spread = part.max(0) - part.min(0) if want > 1 and len(at) > 1 else np.zeros(1)
        d = int(np.argmax(spread))
        if not spread[d] > 0:
            nodes[node][2] = n
            n += 1
            continue
        x = part[:, d]
        value = np.partition(x, max(0, len(at) * (want // 2) // want - 1))[max(0, len(at) * (want // 2) // want - 1)]
        if value == x.max():
            value = x[x < value].max()
        nodes[node] = [d, value, len(nodes), len(nodes) + 1]
        todo += [(len(nodes) + 1, at[x > value], want - want // 2), (len(nodes), at[x <= value], want // 2)]
        nodes += [[-1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]
    return np.array(nodes)


def route(points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The leaf of cell_tree that each point is in."""
    at = np.zeros(len(points), np.int64)
    while len(i := np.flatnonzero(nodes[at, 0] >= 0)):
        right = points[i, nodes[at[i], 0].astype(np.int64)] > nodes[at[i], 1]
        at[i] = nodes[at[i], np.where(right, 3, 2)].astype(np.int64)
    return nodes[at, 2].astype(np.int64)


def _gaps(pq: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box; 0 where numbers are too large to tell."""
    gap = np.zeros((len(pq), len(low)))
    for d in range(DIMENSIONS):
        gap += np.square(np.maximum(0, np.maximum(low[:, d] - pq[:, d, None], pq[:, d, None] - high[:, d])))
    return np.where(np.isfinite(gap), gap, 0)


def _allowed(q: np.ndarray, floor: np.ndarray, longest: float, reach: float) -> np.ndarray:
    """How far a projected vector may be that is nearer than the k-th best; floor is its inner product, -inf while there are fewer than k."""
    kth = longest * longest + (q * q).sum(1) - 2 * floor  # its squared distance in the enlarged space
    slack = 1e-9 * longest * longest  # equal vectors are met whatever the rounding
    return reach * np.where(np.isnan(kth), np.inf, np.maximum(kth, 0) + slack)


def search_block(x: np.ndarray, px: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, k: int, longest: float, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, positions in x, leaves visited): the k candidates of largest inner product found for each query; -inf and -1 where there are fewer.

    px: projected candidates, in a kd-tree.  Leaves are visited in the order of their projected distance from the
    query, their vectors verified on the originals, and a query stops once the next leaf is so far that, by the chi-square law of projected
    distances, a vector nearer than the k-th best would have been met with the stated confidence.  floor is the score of the
    k-th best that a query brings along (-inf: none).
    """
    leaves = _kd_leaves(px, LEAF)
    width = max(len(at) for at in leaves)
    grid = np.full((len(leaves), width), -1)
    for i, at in enumerate(leaves):
        grid[i, : len(at)] = at
    gap = _gaps(projected(q), np.array([px[at].min(0) for at in leaves]), np.array([px[at].max(0) for at in leaves]))
    order = np.argsort(gap, axis=1, kind="stable")
    reach = chi_square_quantile(confidence, DIMENSIONS)
    best, where, seen = np.full((len(q), k), -np.inf), np.full((len(q), k), -1), np.zeros(len(q), np.int64)
    active, s = np.flatnonzero(gap[np.arange(len(q)), order[:, 0]] <= _allowed(q, floor, longest, reach)), 0
    while len(active) and s < len(leaves):
        step = order[active, s : s + STEP]
        seen[active] += step.shape[1]
        scores = np.full((len(active), step.shape[1] * width), -np.inf)
        places = grid[step].reshape(len(active), -1)
        flat = step.ravel()
        by = np.argsort(flat, kind="stable")
        cuts = np.flatnonzero(np.diff(flat[by], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            at, pairs = leaves[flat[by[a]]], by[a:b]
            r, c = pairs // step.shape[1], pairs % step.shape[1]
            scores[r[:, None], c[:, None] * width + np.arange(len(at))] = np.round(q[active[r]] @ x[at].T, 13)
        scores[rows[places] == q_rows[active][:, None]] = -np.inf
        scores = np.concatenate([best[active], scores], axis=1)
        places = np.concatenate([where[active], places], axis=1)
        at = _top(scores, ids[places], k)
        best[active], where[active] = np.take_along_axis(scores, at, 1), np.take_along_axis(places, at, 1)
        s += STEP
        if s < len(leaves):
            kth = np.maximum(best[active].min(1), floor[active])
            active = active[gap[active, order[active, s]] <= _allowed(q[active], kth, longest, reach)]
    where[best == -np.inf] = -1
    return best, where, seen


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) for each length of the batch's vectors."""
    sizes = pc.binary_length(batch[column]).to_numpy() // 8
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, np.frombuffer(b"".join(batch[column].take(pa.array(at)).to_pylist())).reshape(len(at), dim)


_P = [f"p{d}" for d in range(DIMENSIONS)]
_HIT = "query_row long, query_id long, vec_id long, row long, score double"


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, cell: int = CELL, queries: int = QUERIES, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product found for each query.

    Queries are the rows whose vec_id is divisible by every; candidates all rows but the query's own.

    1. The upper levels of one kd-tree over projected vectors are fitted on about SAMPLE of them; every vector is routed to
       its cell once.  Cells carry the box of all their vectors, so the fit decides the cells' sizes only.
    2. A query goes to its nearest cell, then to the next two, the next four and so on, in the order of projected distance, as long as
       the stopping test holds for the next cell; its k-th best goes along.  In a cell a finer tree is visited in the same way.
    3. A cell of any size is in blocks of candidates and of queries by a hash of the row, and each pair of blocks that has to meet is one
       task's work: bounded memory, also if most vectors are equal.

    Vectors of different length are never compared.  Rows whose vec_id or vector is null, and vectors that are zero or hold null or
    non-finite components, take no part.  Repeated vec_ids are separate rows.  Scores are inner products of the original vectors in
    double precision; ties go to the smaller vec_id.  An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    norm = F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    kept = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), norm.alias("norm"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            raw = pa.array([flat[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], raw, batch["norm"]], names=["row", "vec_id", "v", "norm"])

    rows = cut(kept.mapInArrow(packed, "row long, vec_id long, v binary, norm double"))
    lengths = rows.groupBy((F.octet_length("v") / 8).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()
    longest = {r["dim"]: math.sqrt(r["longest"]) for r in lengths}  # a row for each length of vectors
    total = sum(r["n"] for r in lengths)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _by_length(batch, "v"):
                p = projected(x, longest[dim])
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(p), pa.int32()), *map(pa.array, p.T.copy())], names=["dim", *_P])

    columns = ", ".join(f"{p} double" for p in _P)
    some = rows if total <= SAMPLE else rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < SAMPLE * (1 << 30) // total)
    points = some.select("v").mapInArrow(sampled, f"dim int, {columns}").toArrow()  # SAMPLE rows or so
    of, points = points["dim"].to_numpy(), np.column_stack([points[p].to_numpy() for p in _P]).reshape(-1, DIMENSIONS)
    trees, n_cells = {}, 0
    for r in lengths:
        nodes = cell_tree(points[of == r["dim"]], min(-(-r["n"] // cell), max(1, CELLS * r["n"] // total)))
        nodes[nodes[:, 0] < 0, 2] += n_cells
        trees[r["dim"]] = nodes
        n_cells += int((nodes[:, 0] < 0).sum())
    forest = spark.sparkContext.broadcast(trees)  # CELLS leaves at most, and one for each length

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_length(batch, "v"):
                p = projected(x, longest[dim])
                part = batch.take(pa.array(at))
                told = [pa.array([dim] * len(at), pa.int32()), pa.array(route(p, forest.value[dim]), pa.int32())]
                yield pa.RecordBatch.from_arrays([part["row"], part["vec_id"], part["v"], *told, *map(pa.array, p.T.copy())], names=["row", "vec_id", "v", "dim", "cell", *_P])

    homes = cut(rows.select("row", "vec_id", "v").mapInArrow(placed, f"row long, vec_id long, v binary, dim int, cell int, {columns}"))
    boxes = homes.groupBy("cell", "dim").agg(F.count(F.lit(1)).alias("n"), *[F.min(p).alias(f"low_{p}") for p in _P], *[F.max(p).alias(f"high_{p}") for p in _P]).orderBy("cell").collect()  # n_cells rows
    box_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim in longest:
        mine = [r for r in boxes if r["dim"] == dim]
        box_of[dim] = (np.array([r["cell"] for r in mine], np.int32), *(np.array([[r[f"{side}_{p}"] for p in _P] for r in mine]) for side in ("low", "high")))
    shared = spark.sparkContext.broadcast(box_of)
    reach = chi_square_quantile(confidence, DIMENSIONS)

    def sender(start: int, step: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, q in _by_length(batch, "q"):
                    cells, low, high = shared.value[dim]
                    per = max(1, 2_000_000 // len(cells))
                    for lo in range(0, len(at) if start < len(cells) else 0, per):
                        part, x = batch.take(pa.array(at[lo : lo + per])), q[lo : lo + per]
                        gap = _gaps(projected(x), low, high)
                        order = np.argsort(gap, axis=1, kind="stable")[:, start : start + step]
                        near = np.take_along_axis(gap, order, 1) <= _allowed(x, part["floor"].to_numpy(), longest[dim], reach)[:, None]
                        told = pa.array([cells[o[m]] for o, m in zip(order, near, strict=True)], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([*part.columns, told], names=[*part.schema.names, "cells"])

        return send

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _HIT.split(", ")]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        left, right = left.sort_by([("vec_id", "ascending"), ("row", "ascending")]), right.sort_by([("query_id", "ascending"), ("query_row", "ascending")])
        x, q = (np.frombuffer(b"".join(t[c].to_pylist())).reshape(len(t), -1) for t, c in ((left, "v"), (right, "q")))
        ids, at = left["vec_id"].to_numpy(), left["row"].to_numpy()
        q_ids, q_at, floor = (right[c].to_numpy() for c in ("query_id", "query_row", "floor"))
        _, where, _ = search_block(x, np.column_stack([left[p].to_numpy() for p in _P]), ids, at, q, q_at, floor, k, longest[x.shape[1]], confidence)
        i, c = np.nonzero(where >= 0)
        j = where[i, c]
        score = np.concatenate([(q[i[a : a + 4096]] * x[j[a : a + 4096]]).sum(1) for a in range(0, len(i), 4096)] or [np.zeros(0)])
        i, j, score = (y[score >= floor[i]] for y in (i, j, score))
        return pa.table(dict(zip(names, (q_at[i], q_ids[i], ids[j], at[j], score), strict=True)))

    sizes = spark.createDataFrame([(r["cell"], -(-r["n"] // max(1, min(BLOCK, COMPONENTS // r["dim"])))) for r in boxes], "cell int, nb int")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")

    def dealt(name: str, n: str) -> Column:
        return (F.pmod(F.xxhash64(name), F.lit(1 << 30)) % F.col(n)).cast("int")

    def others(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    found = spark.createDataFrame([], f"{_HIT}, rank int")
    start, step = 0, 1
    while start < max((len(b[0]) for b in box_of.values()), default=0):
        floors = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        now = asked.join(floors, "query_row", "left").select("query_row", "query_id", "q", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
        sent = cut(now.mapInArrow(sender(start, step), "query_row long, query_id long, q binary, floor double, cells array<int>").filter(F.size("cells") > 0))
        visits = sent.select("query_row", "query_id", "q", "floor", F.explode("cells").alias("cell"))
        deal = cut(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("nqb")).join(sizes, "cell"))
        if deal.isEmpty():
            break  # further cells are farther still
        deal = F.broadcast(deal)  # a row for each cell
        candidates = homes.join(deal, "cell").select("cell", dealt("row", "nb").alias("b"), others("nqb").alias("qb"), "row", "vec_id", "v", *_P)
        asks = visits.join(deal, "cell").select(F.col("cell").alias("q_cell"), others("nb").alias("q_b"), dealt("query_row", "nqb").alias("q_qb"), "query_row", "query_id", "q", "floor")
        hits = candidates.groupBy("cell", "b", "qb").cogroup(asks.groupBy("q_cell", "q_b", "q_qb")).applyInArrow(run, _HIT)
        found = cut(found.drop("rank").union(hits).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        start, step = start + step, 2 * step
    return found.select("query_id", "rank", "vec_id", "score")
