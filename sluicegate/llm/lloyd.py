"""Centroid clustering in whole numbers: plain Lloyd rounds over written vectors.

Centroids (k x dimensions numbers) go to every task; a task adds up its rows'
components by nearest centroid, and partial sums of all tasks are merged by
groupBy.  All sums are of integers, so no result depends on how rows are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.common import as_table

#: Components beyond this have squared distances that a long may not hold.
LARGEST = 1 << 27


def whole_vectors(df: DataFrame, scale: int, size: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``e`` (floor of scale x component) of vectors of ``size`` components, none of them null or non-finite.

    Others are left out; null and repeated ids stay, a row each.  A component
    beyond ``LARGEST`` raises, since its distances would not fit a long.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("long")
    number = F.transform(v, lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale)).otherwise(large))
    return df.where((F.size(v) == size) & fine).select(F.col(id_col).cast("long").alias("id"), number.alias("e"))


def first_centroids(rows: DataFrame, k: int, salt: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``salt:id``, in that order; equal ids by components, null ids last.  k rows come to the driver."""
    place = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    got = rows.select("e", place.alias("place")).orderBy(F.col("place").asc_nulls_last(), "e").limit(k).collect()
    return np.array([r["e"] for r in got], np.int64)


def nearest(e: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number on ties, and its squared distance."""
    distance = np.stack([((e - c) ** 2).sum(1) for c in centroids], 1)
    at = distance.argmin(1)
    return at, distance[np.arange(len(e)), at]


def _round(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; those of no vectors stay."""
    k, size = centroids.shape

    def add(frames):
        total, number = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for f in frames:
            if len(f):
                e = np.stack(f["e"].to_numpy()).astype(np.int64)
                at, _ = nearest(e, centroids)
                np.add.at(total, at, e)
                number += np.bincount(at, minlength=k)
        used = np.flatnonzero(number)
        yield pd.DataFrame({"cluster": np.repeat(used, size).astype(np.int32), "d": np.tile(np.arange(size, dtype=np.int32), len(used)), "total": total[used].ravel(), "n": np.repeat(number[used], size)})

    merged = rows.select("e").mapInPandas(add, "cluster int, d int, total long, n long").groupBy("cluster", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in merged.collect():  # k x size rows at most
        out[r["cluster"], r["d"]] = r["total"] // r["n"]
    return out


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, salt: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector that takes part.

    Fewer vectors than ``k`` make so many centroids; none make an empty result.
    """
    spark = df.sparkSession
    rows = as_table(whole_vectors(df, scale, size, id_col, vec_col))
    schema = "vec_id long, cluster int, distance long"
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = _round(rows, centroids)
        if (after == centroids).all():  # later rounds would change nothing either
            break
        centroids = after

    def assign(frames):
        for f in frames:
            if len(f):
                at, distance = nearest(np.stack(f["e"].to_numpy()).astype(np.int64), centroids)
                yield pd.DataFrame({"vec_id": f["id"].astype("Int64"), "cluster": at.astype(np.int32), "distance": distance})

    placed = as_table(rows.mapInPandas(assign, schema))
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), F.col("cluster") == F.col("of")).drop("of")
