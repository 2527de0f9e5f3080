"""Bounded-space online best-fit packing of tokenised documents.

Every task packs what it reads, as it reads it: a fixed number of bins is open,
a bitset has one bit for each amount of free space that some open bin has, and
a piece goes to the open bin with the least free space that suffices.  When one
bin too many is open, the fullest closes.  No text or token is exchanged.  The
bins still open when tasks end are then merged, whole, by the same rule: only
their numbers and fill levels move.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.common import as_table, tidy
from sluicegate.llm.tokens import encoder, texts_of

#: Open bins per packer.
OPEN_BINS = 256
#: Open bins of tasks that are merged by one packer.
MERGE_ROWS = 100_000


class BestFit:
    """Online best-fit with at most ``open_bins`` bins open."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free_bits = 0  # bit f: some open bin has f free
        self.n_open = self.n_bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for a piece of at most ``capacity``."""
        fits = self.free_bits >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.n_bins, self.capacity
            self.n_bins += 1
        rest = free - length
        if rest:
            if self.n_open == self.open_bins:
                least = (self.free_bits & -self.free_bits).bit_length() - 1
                if least <= rest:
                    self._take(least)  # the fullest closes
                else:
                    return number, free_to_offset(self.capacity, free)
            self.by_free[rest].append(number)
            self.free_bits |= 1 << rest
            self.n_open += 1
        return number, free_to_offset(self.capacity, free)

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def still_open(self):
        """(bin, used) of each open bin."""
        for free, bins in enumerate(self.by_free):
            for number in bins:
                yield number, self.capacity - free


def free_to_offset(capacity: int, free: int) -> int:
    return capacity - free


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: the first takes what whole pieces leave."""
    first = length % capacity or min(length, capacity)
    if not length:
        return []
    return [(0, first), *((k, capacity) for k in range(first, length, capacity))]


def pack(df: DataFrame, path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and its ``ids`` if asked for.

    A document is its ids and ``end_id``; only documents of over ``capacity``
    ids are cut.  Null or empty text: one piece with ``end_id`` alone.  Repeated
    rows are packed each; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long" + (", ids array<int>" if with_ids else "")
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    tail = int(end_id).to_bytes(4, "little")

    @tidy
    def run(batches):
        enc, bins, id_type = encoder(path), BestFit(capacity, open_bins), None
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            id_type = b.column(0).type
            rows, held = [], []
            for k, ids in enumerate(enc.encode(texts_of(b.column(1)))):
                data = memoryview(ids.tobytes() + tail)
                if with_ids:
                    held.append(np.frombuffer(data, "<i4"))
                for piece, (start, length) in enumerate(pieces_of(len(ids) + 1, capacity)):
                    number, offset = bins.place(length)
                    rows.append((k, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), base + number, offset))
            if rows:
                k, *cols = zip(*rows, strict=True)
                # pieces follow each other as their ids do
                listed = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cols[2])), pa.int32()), pa.array(np.concatenate(held)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), *(pa.array(c, t) for c, t in zip(cols, [pa.int32(), *[pa.int64()] * 5], strict=True)), *listed], names)
        if id_type is not None and (rows := [(None, -1, 0, used, 0, base + number, 0) for number, used in bins.still_open()]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [id_type, pa.int32(), *[pa.int64()] * 5], strict=True)] + ([pa.array([None] * len(rows), pa.list_(pa.int32()))] if with_ids else []), names)

    placed = as_table(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    left = placed.where("piece < 0").select("sequence_id", "length")
    n = left.count()

    def merge(batches):
        bins, names_of = BestFit(capacity, max(open_bins, 4 * OPEN_BINS)), {}
        for b in batches:
            rows = []
            for seq, used in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0])):
                number, offset = bins.place(used)
                rows.append((seq, names_of.setdefault(number, seq), offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["old", "new", "shift"])

    groups = max(1, -(-n // MERGE_ROWS))
    moved = as_table(left.repartition(groups).sortWithinPartitions(F.desc("length"), "sequence_id").mapInArrow(merge, "old long, new long, shift long"))
    out = placed.where("piece >= 0").join(moved.where("old <> new"), F.col("sequence_id") == F.col("old"), "left")
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.coalesce("new", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), *(["ids"] if with_ids else []),
    )
