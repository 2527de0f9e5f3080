"""What the vector searches share: valid rows, samples, units of lists, merging.

Vectors are dealt to lists by their nearest pivot.  Large lists are cut by a
hash of the id, and small ones may share a unit, so that no unit of work grows
with a list.  Queries are a stated part of the rows; each goes to the units its
list bounds admit, in blocks of bounded size of queries that are near each
other.  A unit's rows are copied only for the blocks that some query of theirs
sends there, and the best of all units are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicegate.llm.common import as_table

#: Bound of the sample that pivots and first bounds come from, in rows.
SAMPLE_ROWS = 4096
#: Bounds of a unit's rows and of a block of queries.
UNIT_ROWS, QUERY_ROWS = 8192, 2048


def valid_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``v`` (array of double) of rows that take part.

    Left out: null ids, vectors that are null, empty or hold null or non-finite
    components, and vectors of another length than most have (ties: the shorter).
    """
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0").where(fine)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def matrix(column) -> np.ndarray:
    """Rows of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def sample(rows: DataFrame, n: int, size: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``size`` rows, least hash first."""
    place = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30))
    got = rows.where(place < int(min(1.0, 1.2 * size / max(n, 1) + 64 / max(n, 1)) * (1 << 30))).orderBy(place, "id").limit(size).collect()
    return np.array([r["id"] for r in got], np.int64), np.array([r["v"] for r in got], np.float64)


def along_a_line(pivots: np.ndarray) -> np.ndarray:
    """Order of pivots by their first principal component: near ones mostly stand near each other."""
    centred = pivots - pivots.mean(0)
    return np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")


@dataclass
class Lists:
    """Rows of each list dealt to units, and its queries to blocks."""

    base: np.ndarray  # first unit of each list
    units: np.ndarray  # units of each list
    counts: np.ndarray
    least: np.ndarray  # distances to the pivot
    most: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray  # blocks of each list's queries

    @classmethod
    def of(cls, assigned: DataFrame, pivots: np.ndarray, n: int, every: int, share_units: bool = False) -> Lists:
        """share_units: lists that are small go to one unit with their neighbours."""
        per = assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("q"), F.min("dist").alias("a"), F.max("dist").alias("b"))
        got = {r["list"]: r for r in per.collect()}
        pick = lambda name, none: np.array([got[k][name] if k in got else none for k in range(len(pivots))])
        counts, line = pick("n", 0).astype(np.int64), along_a_line(pivots)
        limit = min(UNIT_ROWS, max(128, n // 64))
        base, units = cls._dealt(counts, line, limit, share_units)
        first_block, blocks = cls._dealt(pick("q", 0).astype(np.int64), line, QUERY_ROWS, True)
        return cls(base, units, counts, pick("a", np.inf).astype(float), pick("b", -np.inf).astype(float), first_block, blocks)

    @staticmethod
    def _dealt(counts: np.ndarray, line: np.ndarray, limit: int, shared: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each list the first of the bins that its rows go to, and their number; several lists share a bin while they fit."""
        parts = np.maximum(1, -(-counts // limit))
        first, number, held = np.zeros(len(counts), np.int64), 0, limit + 1
        for k in line.tolist():
            if not shared or parts[k] > 1 or held + counts[k] > limit:
                first[k], held = number, counts[k] if parts[k] == 1 else limit + 1
                number += int(parts[k])
            else:
                first[k] = number - 1
                held += counts[k]
        return first, parts

    @staticmethod
    def _pick(values: np.ndarray, at: str) -> Column:
        return F.element_at(F.lit([int(y) for y in values]), F.col(at) + 1)

    def unit(self) -> Column:
        return (self._pick(self.base, "list") + F.pmod(F.xxhash64("id", F.lit(3)), self._pick(self.units, "list").cast("long"))).cast("int")

    def block(self) -> Column:
        return (self._pick(self.first_block, "home") + F.pmod(F.col("qkey"), self._pick(self.blocks, "home").cast("long"))).cast("int")

    def units_of(self, lists) -> dict[int, list[int]]:
        """The units that hold rows of some lists, and which of the lists."""
        out: dict[int, list[int]] = {}
        for k in lists:
            if self.counts[k]:
                for u in range(int(self.base[k]), int(self.base[k] + self.units[k])):
                    out.setdefault(u, []).append(int(k))
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id, best first."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def sent(qkey: np.ndarray, batch: pa.RecordBatch, floor: pa.Array, places: list[dict[int, list[int]]]) -> pa.RecordBatch:
    """A row for each query and each unit that it goes to.  batch: id, vector, list of queries; floor: their k-th best known."""
    at = pa.array(np.repeat(np.arange(len(places)), [len(p) for p in places]))
    units = pa.array([u for p in places for u in p], pa.int32())
    lists = pa.array([k for p in places for k in p.values()], pa.list_(pa.int32()))
    names = ["qkey", "qid", "qv", "home", "floor", "unit", "lists"]
    return pa.RecordBatch.from_arrays([pa.array(qkey).take(at), *(batch.column(k).take(at) for k in range(3)), floor.take(at), units, lists], names)


def search(assigned: DataFrame, lists: Lists, every: int, route, scan, score_type: str, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``.

    assigned: ``id``, ``v``, ``list``, ``dist``.  route: mapInArrow function from
    ``qid``, ``v``, ``home`` to rows of ``sent``.  scan: best hits of a unit's
    rows and a block of queries.
    """
    rows = assigned.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"]).select(F.col("id").alias("qid"), "v", F.col("list").alias("home"))
    schema = f"qkey long, qid long, qv array<double>, home int, floor {score_type}, unit int, lists array<int>"
    queries = as_table(rows.mapInArrow(route, schema).withColumn("block", lists.block()))
    held = assigned.withColumn("unit", lists.unit())
    if int((lists.first_block + lists.blocks).max()) > 1:
        wanted = queries.select(F.col("unit").alias("to"), F.col("block").alias("of")).distinct()
        held = held.join(wanted, F.col("unit") == F.col("to")).drop("to").withColumnRenamed("of", "block")
    else:
        held = held.withColumn("block", F.lit(0))
    hits = held.groupBy("unit", "block").cogroup(queries.groupBy("unit", "block")).applyInArrow(scan, f"qkey long, qid long, id long, score {score_type}")
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def stats(rows: DataFrame, every: int) -> tuple[int, int, float]:
    """Rows, queries, and the largest squared norm."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    r = rows.agg(F.count(F.lit(1)), F.count_if(F.pmod("id", F.lit(every)) == 0), F.max(norm)).first()
    return r[0], r[1], float(r[2] or 0.0)


def empty(spark, score_type: str) -> DataFrame:
    return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")


def deal(rows: DataFrame, function) -> DataFrame:
    """Rows with ``list`` and ``dist``, written once."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                where, dist = function(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where, pa.int32()), pa.array(dist, pa.float64())], ["id", "v", "list", "dist"])

    return as_table(rows.mapInArrow(run, "id long, v array<double>, list int, dist double"))


def query_key(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A number for each query row that no other query row has but by a hash collision."""
    f = np.random.Generator(np.random.PCG64(5)).integers(1, 2**62, vectors.shape[1], np.uint64) | np.uint64(1)
    h = (np.ascontiguousarray(vectors).view(np.uint64) * f).sum(1, dtype=np.uint64) + ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
