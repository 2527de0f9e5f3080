"""Byte-balanced sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of text, hash of id, number of the row), so that equal
texts are neighbours.  Candidate boundaries of that key space are probed level
by level: each pass counts exactly the bytes and rows below every probe inside
the cells that still hold a wanted splitter, until each splitter is within
tolerance.  Splitters stand between different texts; a group of copies is cut,
between ids or between rows of one id, only where its nearer end is more than
``GROUP_SHARE`` of a shard away.  Then rows are exchanged once, to sub-ranges of
shards, and numbered there.
"""

from __future__ import annotations

import bisect
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicegate.llm.common import as_table

_LOW, _HIGH = -(2**63), 2**63 - 1
_KEYS = ("k1", "k2", "k3")
#: (number of the key, bits below the prefix) of each level of probes.
_LEVELS = [(k, s) for k in range(3) for s in range(56, -1, -8)]
_LAST_OF_TEXT = _LEVELS.index((0, 0))
#: How far from its place a splitter may stand, as a share of a shard, rather than cut a group of copies.
GROUP_SHARE = 0.01


def _prefix(level: int) -> list[Column]:
    key, shift = _LEVELS[level]
    return [F.col(k) if i < key else F.shiftright(k, shift) if i == key else F.lit(0).cast("long") for i, k in enumerate(_KEYS)]


def _edge(level: int, p: tuple[int, int, int], right: bool) -> tuple[int, int, int]:
    """Least key of a cell, or of what follows it."""
    key, shift = _LEVELS[level]
    at = [*p[:key], (p[key] + right) << shift, *[_LOW] * (2 - key)]
    for i in range(key, -1, -1):  # carry
        if at[i] > _HIGH:
            if i == 0:
                return (_HIGH,) * 3
            at[i], at[i - 1] = _LOW, at[i - 1] + 1
    return tuple(at)


def _parent(level: int, p: tuple[int, int, int]) -> tuple[int, int, int]:
    """The cell of the level above that holds a cell."""
    if not level:
        return (0, 0, 0)
    (key, shift), (above, more) = _LEVELS[level], _LEVELS[level - 1]
    return tuple(x if i < above else p[above] >> (more - shift if key == above else 0) if i == above else 0 for i, x in enumerate(p))


def splitters(keys: DataFrame, parts: int, tolerance: float, total: int) -> list[tuple[tuple[int, int, int], int, int]]:
    """(key, bytes below, rows below) of ``parts - 1`` splitters, ascending.

    Bounded driver state: at most 256 counts for each cell that holds a splitter.
    """
    allowed, whole = tolerance * total / parts, max(tolerance, GROUP_SHARE) * total / parts
    done: dict[int, tuple[tuple[int, int, int], int, int]] = {}
    cells = {(0, 0, 0): (0, 0, list(range(1, parts)))} if parts > 1 else {}  # cell: bytes below, rows below, wanted
    for level in range(len(_LEVELS)):
        if not cells:
            break
        names = ["p1", "p2", "p3"]
        rows = keys
        if level:
            active = keys.sparkSession.createDataFrame([*cells], "c1 long, c2 long, c3 long")
            same = [p == F.col(c) for p, c in zip(_prefix(level - 1), active.columns, strict=True)]
            rows = keys.join(F.broadcast(active), same[0] & same[1] & same[2], "left_semi")
        counted = rows.groupBy(*(p.alias(n) for p, n in zip(_prefix(level), names, strict=True))).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        deeper: dict = {}
        for cell, children in groupby(sorted(map(tuple, counted)), key=lambda r, level=level: _parent(level, r[:3])):
            below, rows_below, wanted = cells[cell]
            edges, counts, kids = [below], [rows_below], list(children)
            for *_, b, n in kids:
                edges.append(edges[-1] + b)
                counts.append(counts[-1] + n)
            for j in wanted:
                target = total * j / parts
                i = min(max(bisect.bisect_right(edges, target) - 1, 0), len(kids) - 1)
                right = target - edges[i] > edges[i + 1] - target
                off = abs(edges[i + right] - target)
                if off <= allowed or kids[i][4] == 1 or level == len(_LEVELS) - 1 or (level >= _LAST_OF_TEXT and off <= whole):
                    done[j] = (_edge(level, kids[i][:3], right), edges[i + right], counts[i + right])
                else:
                    deeper.setdefault(kids[i][:3], (edges[i], counts[i], []))[2].append(j)
        cells = deeper
    return [done[j] for j in sorted(done)]


def shard(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, tolerance: float = 0.001, bucket_rows: int = 250_000) -> DataFrame:
    """Add ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``shard`` and ``slot``.

    Shards hold nearly equal bytes; slots count from 0 without gaps in key
    order.  ``keep``: columns besides the id to carry (default: all).  Null text
    has size 1 and crc32 0.  Equal texts stay in one shard unless their group is
    too large for that (see the module); rows equal in id and text are told
    apart by their numbers in the written table, so they are spread likewise.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in (df.columns if keep is None else keep) if c != id_col]
    table = as_table(df.select(
        F.col(id_col).alias("id"), F.struct(*(F.col(c) for c in kept)).alias("kept") if kept else F.lit(None).cast("int").alias("kept"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col), F.lit(1)).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    ))
    keys = table.select(*_KEYS, "size")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    each = min(256, max(8, -(-n // (n_shards * bucket_rows))))
    found = splitters(keys, n_shards * each, tolerance * each, total) if n else []
    if n:  # the splitters of whole shards are held to the tolerance of shards
        fine = splitters(keys, n_shards, tolerance, total)
        for j, x in enumerate(fine, 1):
            found[j * each - 1] = x
        for j in range(1, len(found)):  # keep the order where a sub-range's splitter was less exact
            whole = (j + 1) % each == 0
            if found[j][0] < found[j - 1][0]:
                if whole:
                    k = j - 1
                    while k >= 0 and found[k][0] > found[j][0] and (k + 1) % each:
                        found[k] = found[j]
                        k -= 1
                else:
                    found[j] = found[j - 1]
    first = [0, *(x[2] for x in found)]
    by_bin: dict[int, list] = {}
    for key, *_ in found:
        by_bin.setdefault(key[0] >> 56, []).append(key)
    bins, base = [], 0
    for b in range(-128, 128):
        here = by_bin.get(b, [])
        bins.append((b, base, here))
        base += len(here)
    lookup = df.sparkSession.createDataFrame(bins, "bin long, base int, cuts array<struct<k1: long, k2: long, k3: long>>")
    starts = df.sparkSession.createDataFrame([(j, j // each, f - first[j // each * each]) for j, f in enumerate(first)], "bucket int, shard int, base_slot long")
    passed = F.size(F.filter("cuts", lambda c: c <= F.struct(*_KEYS)))
    placed = table.join(F.broadcast(lookup), F.shiftright("k1", 56) == F.col("bin")).withColumn("bucket", F.col("base") + passed)
    order = Window.partitionBy("bucket").orderBy(*_KEYS)
    numbered = placed.withColumn("number", F.row_number().over(order)).join(F.broadcast(starts), "bucket")
    return numbered.select(
        F.col("id").alias(id_col), *(F.col("kept")[c].alias(c) for c in kept if c not in ("size", "text_crc32", "shard", "slot")),
        "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base_slot") + F.col("number") - 1).alias("slot"),
    )
