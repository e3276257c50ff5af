"""Exact k nearest neighbours by blocks that follow the density of the cloud.

The cloud's cube is split into eight again and again until no block holds more than `most` points, so a far outlier or a
dense spot makes blocks smaller where points are, and no task meets more than a block. Splitting needs counts alone, of
several levels in one aggregate. A point is compared with its own block first, in numpy. Its k-th distance there bounds
the search: only blocks that its ball meets can hold a nearer point, and they are found by equal keys of cells. Points
whose ball lies within their block are settled at once. Of each further block a point brings home k rows at most.

Order of neighbours is (distance, splat_id): ties are settled the same way on every run. Points that share one place may
be more than a block holds; their nearest are the least ids among them. Levels of blocks are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.operators.cut import cut

#: Points of a block, and levels of halving of the cube.
BLOCK = 512
BITS = 30
#: Levels that one aggregate counts.
STEP = 4
#: Cells of a matrix of distances at once.
_CELLS = 1 << 21
XYZ = ("x", "y", "z")
CELL = ("level", "cx", "cy", "cz")

_NEAR = T.ArrayType(
    T.StructType(
        [
            T.StructField("d", T.DoubleType()),
            T.StructField("other", T.LongType()),
            *(T.StructField(f"o{a}", T.DoubleType()) for a in XYZ),
        ]
    )
)
NEAR_SQL = _NEAR.simpleString()
_NEAR_ARROW = pa.list_(pa.struct([("d", pa.float64()), ("other", pa.int64()), *((f"o{a}", pa.float64()) for a in XYZ)]))


def _leaves(points: DataFrame, n: int, most: int) -> DataFrame:
    """(level, cx, cy, cz): the blocks, that partition the cube. points have whole coordinates ix, iy, iz."""
    spark = points.sparkSession
    found = spark.createDataFrame([(0, 0, 0, 0)], "level int, cx long, cy long, cz long")
    if n <= most:
        return found
    found, base = found.limit(0), 0
    dense, pending = spark.createDataFrame([(0, 0, 0)], "cx long, cy long, cz long"), points
    while True:
        top = min(BITS, max(base + STEP, int(np.log2(max(1, n / most)) / 3) + 2 if not base else 0))
        fine = pending.groupBy(*(F.shiftright(f"i{a}", BITS - top).alias(f"c{a}") for a in XYZ)).agg(F.count("*").alias("n"))
        levels = fine.withColumn("level", F.explode(F.sequence(F.lit(base + 1), F.lit(top))))
        counts = levels.groupBy("level", *(F.expr(f"shiftright(c{a}, {top} - level)").alias(f"c{a}") for a in XYZ)).agg(F.sum("n").alias("n"))
        counts = cut(counts)
        inner = counts.filter(F.col("n") > most)
        parents = inner.select("level", "cx", "cy", "cz").unionByName(dense.withColumn("level", F.lit(base)))
        parents = parents.select((F.col("level") + 1).alias("level"), *(F.col(f"c{a}").alias(f"p{a}") for a in XYZ))
        small = counts.filter((F.col("n") <= most) | (F.col("level") == BITS)).withColumns({f"p{a}": F.shiftright(f"c{a}", 1) for a in XYZ})
        found = found.unionByName(small.join(parents, ["level", "px", "py", "pz"]).select(*CELL))
        dense = inner.filter(F.col("level") == top).select("cx", "cy", "cz")
        if top == BITS or dense.isEmpty():
            return found
        pending = pending.withColumns({f"c{a}": F.shiftright(f"i{a}", BITS - top) for a in XYZ}).join(dense, ["cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz")  # fmt: skip # noqa: E501
        base = top


def _nearest(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int, reach: np.ndarray, itself: bool) -> tuple[np.ndarray, ...]:  # fmt: skip # noqa: E501
    """(query's row, distance, point's row) of the k nearest points within reach, by query, distance and point's id.

    Points come by id.
    """
    rows, far, cols = [], [], []
    if not len(p):
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.float64, np.int64))
    for a in range(0, len(q), max(1, _CELLS // len(p))):
        part = slice(a, a + max(1, _CELLS // len(p)))
        e = [q[part, None, j] - p[None, :, j] for j in range(3)]
        d = np.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
        if not itself:
            d[qid[part, None] == pid[None, :]] = np.inf
        limit = reach[part]
        if len(p) > k:
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero((d <= limit[:, None]) & (d < np.inf))
        x = d[r, c]
        order = np.lexsort((c, x, r))
        r, c, x = r[order], c[order], x[order]
        first = np.searchsorted(r, np.arange(len(limit)))
        kept = np.arange(len(r)) - first[r] < k  # ties beyond the k-th go
        rows.append(r[kept] + a)
        far.append(x[kept])
        cols.append(c[kept])
    return np.concatenate(rows), np.concatenate(far), np.concatenate(cols)


def _lists(n: int, rows: np.ndarray, far: np.ndarray, ids: np.ndarray, p: np.ndarray) -> pa.Array:
    """An array of neighbours for each of n queries."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    values = [pa.array(far), pa.array(ids, pa.int64()), *(pa.array(p[:, j]) for j in range(3))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, fields=list(_NEAR_ARROW.value_type)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], Iterator[pa.RecordBatch]]]:
    """Parts of sorted batches by CELL: (cell, batch) in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.stack([batch[n].to_numpy(zero_copy_only=False) for n in CELL])
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(cells, axis=1) != 0).any(axis=0))))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(int(x) for x in cells[:, a]), batch.slice(a, b - a)


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch["splat_id"].to_numpy(zero_copy_only=False), np.stack([batch[a].to_numpy(zero_copy_only=False) for a in XYZ], axis=1)


def _own_pass(k: int, itself: bool, low: list[float], side: float):
    """Each block's points among themselves: neighbours, the reach of the search, and whether it is settled."""

    def settle(cell: tuple[int, ...], parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, p = (np.concatenate(x) for x in zip(*map(_places, parts)))
        order = np.argsort(ids, kind="stable")
        ids, p = ids[order], p[order]
        step = side / 2.0 ** cell[0]
        start = np.array([low[j] + cell[1 + j] * step for j in range(3)])
        inside = np.minimum(p - start, start + step - p).min(axis=1) - side * 1e-12
        piled = len(p) > k + 1 and (p == p[0]).all()
        some = p[: k + 1] if piled else p  # of a pile the least ids are nearest to all
        for a in range(0, len(p), 4096):
            own = slice(a, a + 4096)
            n = len(ids[own])
            rows, far, cols = _nearest(ids[own], p[own], ids[: len(some)], some, k, np.full(n, np.inf), itself)
            count = np.bincount(rows, minlength=n)
            reach = np.full(n, np.sqrt(3.0) * 2 * step * (1 + 1e-9))  # the parent block holds more than k points
            full = count == k
            last = np.searchsorted(rows, np.arange(n), "right") - 1
            reach[full] = np.minimum(reach[full], far[last[full]])
            settled = full & (reach < inside[own]) if cell[0] else np.ones(n, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[own]), *(pa.array(p[own, j]) for j in range(3)), *(pa.array(np.full(n, x), pa.int64()) for x in cell),
                    pa.array(reach), pa.array(settled), _lists(n, rows, far, ids[cols], some[cols]),
                ],
                ["splat_id", *XYZ, *CELL, "reach", "settled", "near"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for cell, part in _groups(batches):
            if cell != key and parts:
                yield from settle(key, parts)
                parts = []
            key = cell
            parts.append(part)
        if parts:
            yield from settle(key, parts)

    return run


def _other_pass(k: int):
    """Queries against the points of other blocks. A block's points come first, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, p = None, [], None, None
        for cell, part in _groups(batches):
            if cell != key:
                key, held, ids = cell, [], None
            asks = part["asks"].to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(asks, 1))
            if first:
                held.append(part.slice(0, first))
            if first < part.num_rows:
                if ids is None:
                    ids, p = (np.concatenate(x) for x in zip(*map(_places, held))) if held else (np.zeros(0, np.int64), np.zeros((0, 3)))
                asking = part.slice(first)
                qid, q = _places(asking)
                rows, far, cols = _nearest(qid, q, ids, p, k, asking["reach"].to_numpy(zero_copy_only=False), True)
                yield pa.RecordBatch.from_arrays([asking["splat_id"], _lists(len(qid), rows, far, ids[cols], p[cols])], ["splat_id", "near"])

    return run


def nearest(points: DataFrame, n: int, low: list[float], extent: float, k: int, itself: bool, most: int = BLOCK) -> DataFrame:
    """(splat_id, x, y, z, near): the k nearest of each point, as an array by distance and id."""
    most, side = max(most, k + 2), extent * (1 + 1e-9)
    whole = lambda v, j, s: F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor((v - F.lit(low[j])) / F.lit(s)))).cast("long")  # noqa: E731, E501
    points = points.select("splat_id", *(F.col(a).cast("double").alias(a) for a in XYZ))
    placed = cut(points.withColumns({f"i{a}": whole(F.col(a), j, side / 2.0**BITS) for j, a in enumerate(XYZ)}))
    leaves = cut(_leaves(placed, n, most))
    levels = sorted(r[0] for r in leaves.select("level").distinct().collect())  # BITS + 1 at most
    each = placed.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns(
        {f"c{a}": F.expr(f"shiftright(i{a}, {BITS} - level)") for a in XYZ}
    )
    blocked = cut(each.join(leaves, list(CELL)).select("splat_id", *XYZ, *(F.col(c).cast("long").alias(c) for c in CELL)))
    schema = T.StructType([*blocked.schema.fields, T.StructField("reach", T.DoubleType()), T.StructField("settled", T.BooleanType()), T.StructField("near", _NEAR)])
    own = cut(blocked.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_own_pass(k, itself, low, side), schema))
    if levels == [0]:
        return own.select("splat_id", *XYZ, "near")
    asking = own.filter("not settled")
    # The finest level whose cells are as wide as the ball: it meets two of them at most on each axis.
    wide = F.greatest(F.lit(0), F.least(F.lit(BITS), F.floor(F.log2(F.lit(side) / (2 * F.col("reach")))))).cast("int")
    balls = cut(asking.select("splat_id", *XYZ, "reach", F.when(F.col("reach") > 0, wide).otherwise(F.lit(BITS)).alias("wide")))  # fmt: skip # noqa: E501
    widths = sorted(r[0] for r in balls.select("wide").distinct().collect())
    # A ball looks for blocks as wide as its cells or wider by their own keys, and for finer ones by their ancestors'.
    kinds = F.array(
        *(F.when(F.col("wide") >= x, F.struct(F.lit(0).alias("fine"), F.lit(x).alias("l"))) for x in levels),
        F.struct(F.lit(1).alias("fine"), F.col("wide").alias("l")),
    )
    keys = balls.withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select("*", "kind.fine", "kind.l")
    slack = F.lit(side * 1e-12)
    for j, a in enumerate(XYZ):
        unit = F.lit(side) / F.pow(F.lit(2.0), F.col("l"))
        most_cell = F.expr("shiftleft(1L, l) - 1")
        at = lambda v: F.least(most_cell, F.greatest(F.lit(0), F.floor((v - F.lit(low[j])) / unit))).cast("long")
        keys = keys.withColumn(f"k{a}", F.explode(F.sequence(at(F.col(a) - F.col("reach") - slack), at(F.col(a) + F.col("reach") + slack))))
    leaf = leaves.select(*(F.col(c).cast("long").alias(c) for c in CELL))
    theirs = leaf.select("*", F.lit(0).alias("fine"), F.col("level").cast("int").alias("l"), *(F.col(f"c{a}").alias(f"k{a}") for a in XYZ))
    up = leaf.withColumn("l", F.explode(F.array(*map(F.lit, widths)))).filter("l < level") if widths else leaf.withColumn("l", F.lit(0)).limit(0)
    above = up.select(*CELL, F.lit(1).alias("fine"), "l", *(F.expr(f"shiftright(c{a}, cast(level - l as int))").alias(f"k{a}") for a in XYZ))
    met = keys.join(theirs.unionByName(above), ["fine", "l", "kx", "ky", "kz"])
    gap = []
    for j, a in enumerate(XYZ):
        unit = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
        start = F.lit(low[j]) + F.col(f"c{a}") * unit
        out = F.greatest(start - F.col(a), F.col(a) - start - unit, F.lit(0.0))
        gap.append(out * out)
    other = F.lit(False)  # a block that isn't the point's own, by the place that dealt it
    for j, a in enumerate(XYZ):
        other = other | (F.call_function("shiftright", whole(F.col(a), j, side / 2.0**BITS), F.lit(BITS) - F.col("level").cast("int")) != F.col(f"c{a}"))
    reached = met.filter(other & (F.sqrt(gap[0] + gap[1] + gap[2]) <= F.col("reach") + 4 * slack))
    asked = reached.select("splat_id", *XYZ, "reach", *CELL, F.lit(1).alias("asks"))
    both = blocked.select("splat_id", *XYZ, F.lit(0.0).alias("reach"), *CELL, F.lit(0).alias("asks")).unionByName(asked)
    sorted_ = both.repartition(*CELL).sortWithinPartitions(*CELL, "asks", "splat_id")
    kind = T.StructType([T.StructField("splat_id", T.LongType()), T.StructField("near", _NEAR)])
    brought = sorted_.mapInArrow(_other_pass(k), kind)
    # Most blocks that a ball meets hold nothing nearer: no row comes of them.
    nearer = brought.filter(F.size("near") > 0).select("splat_id", *(F.lit(None).cast("double").alias(a) for a in XYZ), "near")
    merged = (
        asking.select("splat_id", *XYZ, "near").unionByName(nearer).groupBy("splat_id")
        .agg(*(F.max(a).alias(a) for a in XYZ), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    )
    return own.filter("settled").select("splat_id", *XYZ, "near").unionByName(merged)


#: Queries that one task of the brute search holds, and the blocks that a smaller cloud is dealt to.
HELD, DEALT = 1 << 14, 64
#: Cells of a tile of squared distances: they stay in the processor's cache.
_TILE = 1 << 15


def _brute_pass(k: int, itself: bool):
    """All points stream past each block's queries, that come first; only their k nearest so far are kept."""

    def better(q: np.ndarray, qid: np.ndarray, p: np.ndarray, pid: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query's row, distance, point's row) of the points that aren't farther than reach, and of no others too far."""
        wide = max(1, _TILE // max(1, len(p)))
        q, p = np.ascontiguousarray(q.T), np.ascontiguousarray(p.T)
        room = np.empty((2, wide, p.shape[1]))  # tiles of their own would be paged in again and again
        found = []
        for a in range(0, q.shape[1], wide):
            part = slice(a, a + wide)
            d, e = room[:, : len(reach[part])]
            for j, x in enumerate((d, e, e)):
                np.subtract(q[j, part, None], p[j], out=x)
                x *= x
                if j:
                    d += e
            r, c = np.nonzero(d <= (reach[part] * reach[part] * (1 + 1e-12))[:, None])
            found.append((r + a, np.sqrt(d[r, c]), c))
        r, d, c = (np.concatenate(x) for x in zip(*found))
        fit = d <= reach[r]
        if not itself:
            fit &= qid[r] != pid[c]
        return r[fit], d[fit], c[fit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, q, best = None, [], [], None

        def done() -> pa.RecordBatch:
            rows, far, others, at = best
            return pa.RecordBatch.from_arrays([pa.array(ids), _lists(len(ids), rows, far, others, at)], ["splat_id", "near"])

        for batch in batches:
            blocks = batch["block"].to_numpy(zero_copy_only=False)
            for a, b in zip(starts := [0, *(np.flatnonzero(np.diff(blocks)) + 1)] if len(blocks) else [], [*starts[1:], len(blocks)]):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    if best is not None:
                        yield done()
                    block, ids, q, best = blocks[a], [], [], None
                first = int(np.searchsorted(part["answers"].to_numpy(zero_copy_only=False), 1))
                some, p = _places(part)
                if first:
                    ids.append(some[:first])
                    q.append(p[:first])
                if first == part.num_rows or not len(ids):
                    continue
                if best is None:
                    ids, q = np.concatenate(ids), np.concatenate(q)
                    best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 3)))
                    reach, seen = np.full(len(ids), np.inf), 0
                while first < part.num_rows:  # the first points bound the search of the next, that come in larger parts
                    own = slice(first, first + min(8192, max(64, seen)))
                    pid, x = some[own], p[own]
                    first, seen = first + len(pid), seen + len(pid)
                    r, d, c = better(q, ids, x, pid, reach)
                    if not len(r):
                        continue
                    rows, far, others, at = (np.concatenate(y) for y in zip(best, (r, d, pid[c], x[c])))
                    order = np.lexsort((others, far, rows))
                    order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]
                    best = rows, far, others, at = rows[order], far[order], others[order], at[order]
                    full = np.bincount(rows, minlength=len(ids)) == k
                    reach[full] = far[np.searchsorted(rows, np.flatnonzero(full), "right") - 1]
        if best is not None:
            yield done()

    return run


def brute(queries: DataFrame, points: DataFrame, k: int, itself: bool) -> DataFrame:
    """(splat_id, near) by all pairs: queries are dealt to blocks, and a copy of all points passes each block.

    A task holds HELD queries at most with k neighbours each. No pair is ever written; what is shuffled are the points,
    once a block.
    """
    place = lambda df: df.select("splat_id", *(F.col(a).cast("double").alias(a) for a in XYZ)).filter("splat_id is not null")
    queries, points = place(queries), place(points)
    n = queries.count()
    blocks = max(min(DEALT, n), -(-n // (HELD // 2)), 1)  # half, as a hash isn't even
    block = F.pmod(F.hash("splat_id"), F.lit(blocks)).alias("block")
    asked = queries.select("splat_id", *XYZ, block, F.lit(0).alias("answers"))
    passed = points.select("splat_id", *XYZ, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("answers"))
    dealt = asked.unionByName(passed).repartitionById(blocks, "block").sortWithinPartitions("block", "answers")
    return dealt.mapInArrow(_brute_pass(k, itself), T.StructType([T.StructField("splat_id", T.LongType()), T.StructField("near", _NEAR)]))
