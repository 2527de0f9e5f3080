"""Exact order statistics without a global sort: prefix sums over range partitions, percentiles by narrowing brackets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.operators.lineage import cut

#: A bracket of so many rows is counted value by value on the driver.
FEW_ROWS = 4096
#: Accuracy of the sketches that brackets come from: their ranks are off by at most 1 / ACCURACY of the rows.
ACCURACY = 4096


def _ranged(points: DataFrame, column: str) -> DataFrame:
    """Points in descending order over range partitions, with the number of each one's partition."""
    dealt = points.repartitionByRange(F.desc(column)).sortWithinPartitions(F.desc(column))
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def best_threshold(points: DataFrame, attacks: int, benigns: int, errors: int, ceiling: float) -> DataFrame:
    """``threshold``, ``tp`` and ``fp`` of the best point whose false-positive rate is within the ceiling, no row if none is.

    points: ``score`` (each once), ``a`` and ``b``, the attacks and benigns of
    that score.  Most attacks found are best, then the larger threshold.  What
    stands above a partition is known from the partitions' totals, of which one
    row each comes to the driver; each partition then gives its one best point.
    """
    placed = _ranged(points.select(F.col("score").cast("double").alias("score"), "a", "b"), "score")
    above, before = {}, (0, 0)
    for r in sorted(placed.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()):
        above[r["part"]] = before
        before = before[0] + r["a"], before[1] + r["b"]

    def best(batches):
        at: dict[int, tuple[int, int]] = {}
        found: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            score, a, b = (batch.column(k).to_numpy() for k in range(3))
            part = batch.column(3)[0].as_py()
            tp, fp = at.get(part, above[part])
            tp, fp = tp + np.cumsum(a), fp + np.cumsum(b)
            at[part] = int(tp[-1]), int(fp[-1])
            fine = np.flatnonzero((fp + errors) / benigns <= ceiling) if benigns else np.arange(len(fp))
            if len(fine):
                k = fine[np.lexsort((-score[fine], -tp[fine]))[0]]
                one = (int(tp[k]), float(score[k]), int(fp[k]))
                found[part] = max(found.get(part, one), one)
        if found:
            tp, score, fp = max(found.values())
            yield pa.RecordBatch.from_arrays([pa.array([score]), pa.array([tp]), pa.array([fp])], ["threshold", "tp", "fp"])

    return placed.mapInArrow(best, "threshold double, tp long, fp long").orderBy(F.desc("tp"), F.desc("threshold")).limit(1)


def nearest_ranks(rows: DataFrame, value: str, shares: list[float]) -> list:
    """The nearest-rank percentile of each share, nulls left out; None of each where no value is left.

    Brackets around each rank come from sketches of bounded size and are checked
    by exact counts; they narrow until few rows or one value is left, so work is
    a few passes and no state grows with the values.
    """
    v = F.col(value)
    rows = rows.where(v.isNotNull()).select(value)
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(v), F.max(v)).first()
    if not n:
        return [None] * len(shares)
    # rank inside the bracket (from 1), its ends, its rows
    state = [(max(1, math.ceil(p * n)), least, most, n) for p in shares]
    while any(low != high and size > FEW_ROWS for _, low, high, size in state):
        inside = [v.between(F.lit(low), F.lit(high)) for _, low, high, _ in state]
        near = [F.array(*(F.lit(min(1.0, max(0.0, rank / size + d / ACCURACY))) for d in (-2, 2))) for rank, _, _, size in state]
        ends = rows.agg(*(F.percentile_approx(F.when(i, v), q, ACCURACY).alias(f"e{k}") for k, (i, q) in enumerate(zip(inside, near, strict=True)))).first()
        counts = rows.agg(*(F.count_if(i & c).alias(f"c{k}_{j}") for k, i in enumerate(inside) for j, c in enumerate((v < F.lit(ends[k][0]), v.between(F.lit(ends[k][0]), F.lit(ends[k][1]))))),
                          *(f.alias(f"g{k}_{j}") for k, i in enumerate(inside) for j, f in enumerate((F.max(F.when(i & (v < F.lit(ends[k][0])), v)), F.min(F.when(i & (v > F.lit(ends[k][1])), v)))))).first()
        narrowed = []
        for k, (rank, low, high, size) in enumerate(state):
            under, held = counts[f"c{k}_0"], counts[f"c{k}_1"]
            if rank <= under:
                narrowed.append((rank, low, counts[f"g{k}_0"], under))
            elif rank <= under + held:
                narrowed.append((rank - under, *ends[k], held))
            else:
                narrowed.append((rank - under - held, counts[f"g{k}_1"], high, size - under - held))
        if narrowed == state:  # a sketch of these rows tells no more: halve by value
            break
        state = narrowed
    out = []
    for rank, low, high, _ in state:
        if low != high:
            per = rows.where(v.between(F.lit(low), F.lit(high))).groupBy(value).count().orderBy(value).toLocalIterator()
            for r in per:
                rank -= r["count"]
                if rank <= 0:
                    low = r[value]
                    break
        out.append(low)
    return out
