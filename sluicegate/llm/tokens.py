"""Byte-level BPE over DataFrames: encode, decode, round-trip digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm import bpe
from sluicegate.llm.common import tidy

_ENCODERS: dict[tuple[str, int], bpe.Encoder] = {}


def encoder(path: str, cache_pieces: int = bpe.CACHE_PIECES) -> bpe.Encoder:
    """This worker's encoder for a vocabulary file (``.json`` or ranks)."""
    if (path, cache_pieces) not in _ENCODERS:
        load = bpe.Vocabulary.from_json if path.endswith(".json") else bpe.Vocabulary.from_ranks
        _ENCODERS[path, cache_pieces] = bpe.Encoder(load(path), cache_pieces)
    return _ENCODERS[path, cache_pieces]


def texts_of(column: pa.Array) -> Iterator[str]:
    """Texts one by one; null is empty."""
    for x in column:
        yield x.as_py() or ""


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (array of int) of each row; null text encodes as empty."""
    kind = df.schema[id_col].dataType

    @tidy
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [x.astype(np.int32) for x in enc.encode(texts_of(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "n_tokens", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``data`` (the bytes that the ids stand for); null ids decode to no bytes."""
    kind = df.schema[id_col].dataType

    @tidy
    def run(batches):
        vocabulary = encoder(path).vocabulary
        for b in batches:
            data = [vocabulary.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "data"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind.simpleString()}, data binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and return digests of both in one pass.

    One row per input row: ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the
    decoded bytes).  Null text is empty; repeated rows give repeated results.
    """
    kind = df.schema[id_col].dataType

    @tidy
    def run(batches):
        enc = encoder(path)
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for ids in enc.encode(texts_of(b.column(1))):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for k in range(0, len(ids), 1 << 18):
                    digest.update(enc.vocabulary.decode(ids[k : k + (1 << 18)]))
                out_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
