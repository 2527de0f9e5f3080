"""A Bloom filter of ids, of fixed size: what it lets through wrongly, a join drops; it only saves exchanges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sluicegate.llm.common import tidy

#: Bits of a filter, and tasks that make one.
BITS, PARTS = 1 << 24, 8


def hashed(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(7))


def _places(x: np.ndarray) -> Iterator[np.ndarray]:
    for shift in (1, 33):
        yield ((x.view(np.uint64) >> np.uint64(shift)) % np.uint64(BITS)).astype(np.int64)


def of(hashes: DataFrame) -> np.ndarray:
    """Packed bits of a table of one column of hashes."""

    @tidy
    def marks(batches):
        own = np.zeros(BITS, bool)
        for b in batches:
            for k in _places(b.column(0).to_numpy()):
                own[k] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()])], ["bits"])

    whole = np.zeros(BITS // 8, np.uint8)
    for r in hashes.repartition(PARTS).mapInArrow(marks, "bits binary").collect():
        whole |= np.frombuffer(r["bits"], np.uint8)
    return whole


def may_hold(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k in _places(x):
        ok &= (bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 == 1
    return ok


def keep(rows: DataFrame, id_col: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """Rows whose id may stand in ``wanted``; only ids go to Python."""
    held = rows.sparkSession.sparkContext.broadcast(of(wanted.select(hashed(wanted_col).alias("x"))))

    @F.arrow_udf(BooleanType())
    def test(x: pa.Array) -> pa.Array:
        return pa.array(may_hold(held.value, x.to_numpy(zero_copy_only=False)))

    return rows.where(test(hashed(id_col)))
