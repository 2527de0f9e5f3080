"""Samples by hash: the first rows or groups of each split in the order of their hashes, without sorting a split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicegate.operators.lineage import cut

#: Splits have names that a driver can hold; more of them are a mistake.
MAX_SPLITS = 1024
#: Hex digits of a hash that one pass tells apart.
DIGITS = 2


def _boundaries(groups: DataFrame, limit: int) -> dict:
    """For each split the hash prefix below which all groups fit, and the rows left; the prefix "g" is above all hashes.

    groups: ``split``, ``h`` (64 hex digits), ``n``.  Each pass counts the rows
    of at most 256 prefixes a split inside the one where the limit falls, so a
    pass brings a bounded number of rows to the driver, and passes grow with the
    logarithm of the groups.
    """
    found: dict = {}
    inside = {r["split"]: ("", limit) for r in groups.select("split").distinct().limit(MAX_SPLITS + 1).collect()}
    if len(inside) > MAX_SPLITS:
        raise ValueError(f"over {MAX_SPLITS} splits")
    while inside:
        width = DIGITS + len(next(iter(inside.values()))[0])
        here = reduce(lambda a, b: a | b, (F.col("split").eqNullSafe(F.lit(s)) & F.col("h").startswith(p) for s, (p, _) in inside.items()))
        per = groups.where(here).groupBy("split", F.substring("h", 1, width).alias("p")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
        buckets: dict = {}
        for r in per.collect():
            buckets.setdefault(r["split"], []).append((r["p"], r["n"], r["groups"]))
        nearer = {}
        for s, (_, left) in inside.items():
            for p, n, many in sorted(buckets[s]):
                if n <= left:
                    left -= n
                elif many > 1 and width < 64:
                    nearer[s] = (p, left)
                    break
                else:
                    found[s] = (p, left)
                    break
            else:
                # all of this prefix fit: the limit falls between it and what did not fit before
                found[s] = ("g", left)
        inside = nearer
    return found


def least(rows: DataFrame, h: Column, limit: int, key: str, split: str, whole: bool) -> DataFrame:
    """Rows of each split's first groups in the order of ``h``, at most ``limit`` of them.

    A group is all rows of one hash.  The group that the limit falls in is left
    out (``whole``), or gives its first rows by ``key``.
    """
    if isinstance(limit, bool) or limit < 0:
        raise ValueError("the limit must not be negative")
    marked = rows.withColumn("_h", h).withColumn("_s", F.col(split))
    groups = cut(marked.groupBy(F.col("_s").alias("split"), F.col("_h").alias("h")).agg(F.count(F.lit(1)).alias("n")))
    ends = _boundaries(groups, limit)
    own = lambda s: F.col("_s").eqNullSafe(F.lit(s))
    below = reduce(lambda a, b: a | b, (own(s) & (F.col("_h") < p) for s, (p, _) in ends.items()), F.lit(False))
    kept = marked.where(below)
    if not whole:
        for s, (p, left) in ends.items():
            if p != "g" and left:
                kept = kept.union(marked.where(own(s) & F.col("_h").startswith(p)).orderBy(key).limit(left))
    return kept.drop("_s")


def hash_sample(rows: DataFrame, per_split: int, key: str = "id", split: str = "split") -> DataFrame:
    """The first rows of each split by the hash of their key, with their ``place`` (from 1)."""
    kept = least(rows, F.sha2(F.col(key).cast("string"), 256), per_split, key, split, whole=False)
    order = Window.partitionBy(split).orderBy("_h", key)  # over what was kept, at most per_split rows
    return kept.withColumn("place", F.row_number().over(order)).drop("_h")


def paired_sample(rows: DataFrame, per_split: int, seed: str, key: str = "id", source: str = "source_id", origin: str = "origin_id", split: str = "split", whole: bool = True) -> DataFrame:
    """Rows of each split by the hash of (seed, source, origin), so that all rows of an origin stay together.

    per_split: 0 keeps all rows.  whole: an origin that does not fit as a whole
    is left out and ends the sample; else its first rows by key are taken.
    Sources and origins that are null form groups of their own.
    """
    if per_split == 0:
        return rows
    named = F.to_json(F.array(F.lit(seed), F.col(source).cast("string"), F.col(origin).cast("string")))
    return least(rows, F.sha2(named, 256), per_split, key, split, whole).drop("_h")
