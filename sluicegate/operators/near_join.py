"""Exact self-join of unit vectors by angle, pruned by pivots.

Rows go to the cell of their nearest pivot.  A cell is cut into rings by the
angle to its pivot, rings into units of bounded size.  With a(x, p) the angle of
a row and a pivot, and t the angle of the threshold, rows x and y whose home
cells are h and p can be near only if

    |a(x, p) - a(y, p)| <= t             (triangle inequality), and
    a(x, p) - a(x, h) <= 2 t             (y is nearer to p than to h),

so a row meets only the units that its bounds reach, of two units always the
smaller number, and never a unit that its owner fills alone.  Neighbouring units
lie in one bundle.  A row is sent once to each bundle that holds a unit it
reaches, so what is exchanged grows with the number of bundles, not of units,
however little the bounds prune.  Both sides of a task are bundles: bounded,
whatever one cell holds.  Inside a task each unit meets only the rows that reach
it; they are ordered by angle, or by owner, and products are made only of
stretches that bounds and owners admit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.operators.lineage import cut

#: Rows of a unit, at most; a ring's rows are dealt by hash, so a unit holds three quarters of it on average.
BLOCK_ROWS = 4096
#: There are about so many bundles, of at least a unit's rows each, until one takes BUNDLE_BYTES of vectors; then there are more.
BUNDLES, BUNDLE_BYTES = 8, 32 << 20
#: Pairs of up to so many bundles are broadcast.
TOLD_BUNDLES = 1024
#: Pivots come from this many rows, least hash first; there are at most MOST_PIVOTS, one for CELL_ROWS rows.
SAMPLE_ROWS, MOST_PIVOTS, CELL_ROWS = 4096, 1024, 256
#: Rings of equal width from 0 to pi.
RINGS = 128
#: Slack for rounding in angles, far above it.
SLACK = 1e-6
_PAIRS = "i long, j long, cosine double"
#: Rows of the two sides whose products stand in memory at a time.
TILE, SPAN = 256, 8192


def rows_of(column) -> np.ndarray:
    """Rows of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def spread_out(sample: np.ndarray, number: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < number:
        k = int(nearest.argmin())
        if nearest[k] > 1 - 1e-9:  # all others are copies
            break
        chosen.append(k)
        nearest = np.maximum(nearest, sample @ sample[k])
    return sample[chosen]


@dataclass
class Units:
    """The units that cells and rings are cut into."""

    first: np.ndarray  # cell, ring: number of the first unit
    parts: np.ndarray  # cell, ring: units that share the ring
    cell: np.ndarray  # of each unit
    low: np.ndarray  # least and greatest angle to the pivot
    high: np.ndarray
    owner: np.ndarray  # the one owner of a unit's rows
    alone: np.ndarray  # whether there is one
    bundle: np.ndarray

    @classmethod
    def of(cls, rings: list, cells: int, block_rows: int, bundle_rows: int = 0) -> Units:
        """rings: (cell, ring, n, low, high, least and greatest owner), sorted.  bundle_rows: as ``block_rows`` if less."""
        bundle_rows = max(block_rows, bundle_rows)
        first, parts = np.zeros((cells, RINGS), np.int64), np.ones((cells, RINGS), np.int64)
        units: list[list] = []  # cell, rows, low, high, owners
        splits: list[int] = []
        limit = max(1, block_rows * 3 // 4)
        for cell, ring, n, low, high, a, b in rings:
            last = units[-1] if units else None
            if last and last[0] == cell and splits[-1] == 1 and last[1] + n <= limit:
                last[1], last[3], last[4], last[5] = last[1] + n, high, min(last[4], a), max(last[5], b)
                first[cell, ring] = len(units) - 1
                continue
            k = -(-n // limit)
            first[cell, ring], parts[cell, ring] = len(units), k
            for _ in range(k):
                units.append([cell, -(-n // k), low, high, a, b])
                splits.append(k)
        table = np.array([u[1:4] for u in units], float).reshape(-1, 3)
        owners = np.array([u[4:] for u in units], np.int64).reshape(-1, 2)
        bundle, held, number = [], 0, -1
        for n in table[:, 0]:
            if number < 0 or held + n > bundle_rows:
                number, held = number + 1, 0
            held += n
            bundle.append(number)
        cell = np.array([u[0] for u in units], np.int64)
        return cls(first, parts, cell, table[:, 1], table[:, 2], owners[:, 0], owners[:, 0] == owners[:, 1], np.array(bundle, np.int64))

    def home(self, cell: np.ndarray, angle: np.ndarray, ids: np.ndarray) -> np.ndarray:
        ring = np.minimum((angle * (RINGS / np.pi)).astype(np.int64), RINGS - 1)
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return self.first[cell, ring] + ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % self.parts[cell, ring]

    def admits(self, units: slice, angle: np.ndarray, own: np.ndarray, owner: np.ndarray, unit: np.ndarray, theta: float, cross_owner: bool) -> np.ndarray:
        """Rows x units: whether a unit, smaller than the row's, may hold a near row.  angle: to the units' pivots; own: to the row's."""
        near = angle - own[:, None] <= 2 * theta + SLACK
        near &= (angle >= self.low[units] - theta - SLACK) & (angle <= self.high[units] + theta + SLACK)
        near &= np.arange(units.start, units.stop) < unit[:, None]
        if cross_owner:
            near &= ~(self.alone[units] & (self.owner[units] == owner[:, None]))
        return near

    def reached(self, angle: np.ndarray, own: np.ndarray, owner: np.ndarray, unit: np.ndarray, theta: float, cross_owner: bool) -> np.ndarray:
        """Rows x bundles: whether another bundle than the row's holds a unit that it reaches.  angle: rows x cells."""
        begins = np.flatnonzero(np.r_[True, self.bundle[1:] != self.bundle[:-1]])
        out = np.zeros((len(unit), len(begins)), bool)
        for k in range(0, len(unit), TILE):
            rows = slice(k, k + TILE)
            near = self.admits(slice(0, len(self.cell)), angle[rows][:, self.cell], own[rows], owner[rows], unit[rows], theta, cross_owner)
            out[rows] = np.logical_or.reduceat(near, begins, axis=1)
        out[np.arange(len(unit)), self.bundle[unit]] = False
        return out


def _compare(theta: float, threshold: float, cross_owner: bool, pivots, layout, tally: bool):
    """Near pairs of one bundle's rows with themselves, or of the rows (outer) of a bundle that reach another with that one's own (inner)."""

    def tiles(s: np.ndarray, t: np.ndarray, own: np.ndarray, other: np.ndarray, same: bool):
        """Index arrays of outer and inner rows that are multiplied, of their angles or owners; inside a unit each pair of rows is met once."""
        if cross_owner:  # inner rows of an owner stand together: an outer stretch of one owner leaves them out
            x, y = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
            own, other = own[x], other[y]
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for lo, hi in zip(begins, np.r_[begins[1:], len(own)], strict=True):
                p, q = np.searchsorted(other, own[lo], "left"), np.searchsorted(other, own[lo], "right")
                for k in range(lo, hi, TILE):
                    rows = x[k : min(k + TILE, hi)]
                    if not same and p:
                        yield rows, y[:p]
                    if q < len(y):
                        yield rows, y[q:]
            return
        x, y = np.argsort(s, kind="stable"), np.argsort(t, kind="stable")
        s, t = s[x], t[y]
        for k in range(0, len(x), TILE):
            rows = x[k : k + TILE]
            lo = k if same else np.searchsorted(t, s[k] - theta - SLACK)
            hi = np.searchsorted(t, s[k + len(rows) - 1] + theta + SLACK)
            if hi > lo:
                yield rows, y[lo:hi]

    def meetings(outer: pa.Table, inner: pa.Table, u: np.ndarray, v: np.ndarray, same: bool):
        """Index arrays of rows that are multiplied, unit by unit, and whether they are of one unit."""
        units, cell = layout.value, -1
        own, owner, unit = (outer.column(c).to_numpy() for c in ("own", "owner", "unit"))
        of, other = inner.column("unit").to_numpy(), inner.column("owner").to_numpy()
        order = np.argsort(of, kind="stable")
        begins = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        for lo, hi in zip(begins, np.r_[begins[1:], len(order)], strict=True):
            columns = order[lo:hi]
            k = int(of[columns[0]])
            if units.cell[k] != cell:
                cell = units.cell[k]
                s, t = (angles(m, pivots.value[cell][None])[:, 0] for m in (u, v))
            if same:
                for r, c in tiles(t[columns], t[columns], other[columns], other[columns], True):
                    yield columns[r], columns[c], True
            rows = np.flatnonzero(units.admits(slice(k, k + 1), s[:, None], own, owner, unit, theta, cross_owner)[:, 0])
            for r, c in tiles(s[rows], t[columns], owner[rows], other[columns], False) if len(rows) else ():
                yield rows[r], columns[c], False

    def run(outer: pa.Table, inner: pa.Table | None) -> pa.Table:
        same = inner is None
        inner = outer if same else inner
        i, j = outer.column("ordinal").to_numpy(), inner.column("ordinal").to_numpy()
        found: list[list[np.ndarray]] = [[], [], []]
        made = 0
        if outer.num_rows and inner.num_rows:
            u, v = rows_of(outer.column("u")), rows_of(inner.column("u"))
            for rows, every, one in meetings(outer, inner, u, v, same):
                made += len(rows) * len(every)
                for lo in range(0, len(every), SPAN):
                    columns = every[lo : lo + SPAN]
                    cosine = np.clip(u[rows] @ v[columns].T, -1, 1)
                    ok = cosine > threshold
                    if one and not cross_owner:  # a tile's columns begin with its rows
                        ok &= np.arange(len(rows))[:, None] < np.arange(lo, lo + len(columns))[None]
                    r, c = np.nonzero(ok)
                    p, q = i[rows[r]], j[columns[c]]
                    for col, value in zip(found, (np.minimum(p, q), np.maximum(p, q), cosine[r, c]), strict=True):
                        col.append(value)
        if tally:
            return pa.table([pa.array([0], pa.int64()), pa.array([made], pa.int64()), pa.array([0.0])], ["i", "j", "cosine"])
        joined = [np.concatenate(c) if c else np.zeros(0) for c in found]
        return pa.table([pa.array(c, t) for c, t in zip(joined, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["i", "j", "cosine"])

    return run


def near_pairs(units: DataFrame, threshold: float, cross_owner: bool = False, block_rows: int = BLOCK_ROWS, tally: bool = False) -> DataFrame:
    """``i`` < ``j`` and ``cosine`` of all pairs of rows whose cosine is above ``threshold``; cross_owner: of different owners only.

    units: ``ordinal`` (unique), ``u`` (unit vectors of one length), with
    cross_owner also ``owner``, of which null is one.  tally: instead, one row
    with the number of products that were made, as ``compared``.  Pivots, counts
    of rings and units are all that comes to the driver: cells x rings at most,
    besides units, one for ``block_rows`` rows.  Bundles have ``block_rows`` at least.
    """
    spark = units.sparkSession
    owner = F.xxhash64(F.coalesce(F.col("owner").cast("string"), F.lit("\0"))) if cross_owner else F.lit(0).cast("long")
    rows = cut(units.select(F.col("ordinal").cast("long").alias("ordinal"), "u", owner.alias("owner")))
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("u")), F.max(F.size("u"))).first()
    if least != most:
        raise ValueError(f"embedding dimensions must match: {least} and {most}")
    if not n:
        return spark.createDataFrame([(0,)], "compared long") if tally else spark.createDataFrame([], _PAIRS)
    theta = float(np.arccos(np.clip(threshold, -1, 1)))
    if n <= block_rows:  # one unit, that every row is in
        first = spark.sparkContext.broadcast(rows_of(rows.limit(1).select("u").toArrow().column("u")))
        whole = spark.sparkContext.broadcast(Units.of([(0, 0, n, 0.0, np.pi, 0, 1)], 1, 2 * n))
        run = _compare(theta, threshold, cross_owner, first, whole, tally)
        placed = rows.withColumns({"unit": F.lit(0).cast("long"), "own": F.lit(0.0), "x": F.lit(0).cast("long")})
        return _told(placed.groupBy("x").applyInArrow(lambda own: run(own, None), _PAIRS), tally)
    place = F.pmod(F.xxhash64("ordinal"), F.lit(1 << 30))
    share = min(1.0, 1.2 * SAMPLE_ROWS / n + 64 / n)
    picked = rows.where(place < int(share * (1 << 30))).orderBy(place, "ordinal").select("u").limit(SAMPLE_ROWS).toArrow()
    sample = rows_of(picked.column("u")) if picked.num_rows else np.array([rows.select("u").first()["u"]], float)
    pivots = spread_out(sample, max(1, min(MOST_PIVOTS, n // CELL_ROWS)))
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            a = angles(rows_of(b.column(0)), held.value)
            cell = a.argmin(1)
            angle = a[np.arange(len(a)), cell]
            ring = np.minimum((angle * (RINGS / np.pi)).astype(np.int64), RINGS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ring), pa.array(angle), b.column(1)], ["cell", "ring", "angle", "owner"])

    placed = rows.select("u", "owner").mapInArrow(assign, "cell long, ring long, angle double, owner long")
    per = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)), F.min("angle"), F.max("angle"), F.min("owner"), F.max("owner")).collect()
    layout = Units.of(sorted(map(tuple, per)), len(pivots), block_rows, min(n // BUNDLES, BUNDLE_BYTES // (8 * most)))
    shared = spark.sparkContext.broadcast(layout)

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, own = b.column(0).to_numpy(), b.column(2).to_numpy()
            a = angles(rows_of(b.column(1)), held.value)
            cell = a.argmin(1)
            angle = a[np.arange(len(a)), cell]
            unit = shared.value.home(cell, angle, ids)
            reach = shared.value.reached(a, angle, own, unit, theta, cross_owner)
            ends = np.r_[0, np.cumsum(reach.sum(1))].astype(np.int32)
            to = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(reach)[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit), pa.array(angle), pa.array(shared.value.bundle[unit]), to], [*b.schema.names, "unit", "own", "bundle", "reach"])

    dealt = cut(rows.mapInArrow(route, "ordinal long, u array<double>, owner long, unit long, own double, bundle long, reach array<long>"))
    again = [F.col(c).alias(c) for c in ("ordinal", "u", "owner", "unit", "own")]  # columns of their own, as both sides of the join are one table
    outer = dealt.select(*again, F.explode("reach").alias("x"), F.col("bundle").alias("y"))
    wanted = dealt.select(F.explode("reach").alias("x"), F.col("bundle").alias("y")).distinct()
    if layout.bundle[-1] < TOLD_BUNDLES:
        wanted = F.broadcast(wanted)
    inner = dealt.select("ordinal", "u", "owner", "unit", "own", F.col("bundle").alias("x"))
    run = _compare(theta, threshold, cross_owner, held, shared, tally)
    within = inner.groupBy("x").applyInArrow(lambda own: run(own, None), _PAIRS)
    across = outer.groupBy("x", "y").cogroup(inner.join(wanted, "x").groupBy("x", "y")).applyInArrow(lambda a, b: run(a, b), _PAIRS)
    return _told(within.unionByName(across), tally)


def _told(pairs: DataFrame, tally: bool) -> DataFrame:
    return pairs.agg(F.coalesce(F.sum("j"), F.lit(0)).cast("long").alias("compared")) if tally else pairs
