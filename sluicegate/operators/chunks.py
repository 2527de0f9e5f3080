"""Ordered chunks: payloads that cross the seam between neighbours."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sluicegate.functions import rules as R
from sluicegate.functions import text as T
from sluicegate.functions.surfaces import decode, fold
from sluicegate.operators.lineage import cut

WINDOW_CHARS = 256
#: Why a seam was not looked at: its chunk stands before one that was seen earlier.
LATE = "chunk_out_of_order"
_HIT = StructType([StructField(c, StringType()) for c in ("family", "severity", "label", "body")])
_SEAM = StructType([StructField("hits", ArrayType(_HIT)), StructField("reasons", ArrayType(StringType()))])


def edges_of(chunks: DataFrame, source: str, order: str, window_chars: int = WINDOW_CHARS) -> DataFrame:
    """What a seam needs of each chunk: ``source``, ``place``, ``ordinal`` and the ends of its text, ``tail`` and ``start``."""
    text = F.coalesce("text", F.lit(""))
    return chunks.select(F.col(source).alias("source"), F.col(order).alias("place"), "ordinal", F.right(text, F.lit(window_chars)).alias("tail"), F.substring(text, 1, window_chars).alias("start"))


def _pairs(batches, part: int):
    """Neighbours of one source among a partition's sorted rows, and its first and last row (``next_ordinal`` null, ``end`` -1 and 1)."""
    names = ["end", "part", "source", "ordinal", "tail", "next_ordinal", "head"]

    def edge(row: pa.RecordBatch, end: int) -> pa.RecordBatch:
        none = pa.nulls(1, row.column(2).type)
        return pa.RecordBatch.from_arrays([pa.array([end], pa.int32()), pa.array([part], pa.int32()), row.column(0), row.column(2), row.column(3), none, row.column(4)], names)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is None:
            yield edge(b.slice(0, 1), -1)
            t = b
        else:
            t = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        held = b.slice(b.num_rows - 1, 1)
        a, z = t.slice(0, t.num_rows - 1), t.slice(1)
        x, y = a.column(0), z.column(0)
        alike = pc.or_kleene(pc.fill_null(pc.equal(x, y), False), pc.and_(x.is_null(), y.is_null()))
        columns = [pa.array([0] * len(x), pa.int32()), pa.array([part] * len(x), pa.int32()), x, a.column(2), a.column(3), z.column(2), z.column(4)]
        yield pa.RecordBatch.from_arrays(columns, names).filter(alike)
    if held is not None:
        yield edge(held, 1)


def neighbours(chunks: DataFrame, source: str, order: str, window_chars: int = WINDOW_CHARS) -> DataFrame:
    """Each chunk but the last of its source: ``ordinal``, ``tail``, and ``next_ordinal`` and ``head`` of the one after it.

    Only the edges of texts are sorted, over ranges of (source, order, ordinal),
    so that one source with all rows spreads over all tasks.  The last row of a
    partition meets the first of the next one: two short rows a partition.
    """
    rows = edges_of(chunks, source, order, window_chars)
    sort = ["source", "place", "ordinal"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"end int, part int, source {kind['source']}, ordinal {kind['ordinal']}, tail string, next_ordinal {kind['ordinal']}, head string"
    found = cut(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(lambda batches: _pairs(batches, TaskContext.get().partitionId()), schema))
    inside = found.where("end = 0").select("ordinal", "tail", "next_ordinal", "head")
    parts = sorted(r["part"] for r in found.where("end = 1").select("part").collect())
    if len(parts) < 2:
        return inside
    follows = chunks.sparkSession.createDataFrame([*zip(parts, parts[1:], strict=False)], "part int, after int")
    last = found.where("end = 1").select("part", F.col("source").alias("s"), F.col("ordinal").alias("o"), F.col("tail").alias("t")).join(F.broadcast(follows), "part")
    first = found.where("end = -1").select(F.col("part").alias("after"), "source", "ordinal", "head")
    stitched = last.join(first, "after").where(F.col("s").eqNullSafe(F.col("source")))
    return inside.unionByName(stitched.select(F.col("o").alias("ordinal"), F.col("t").alias("tail"), F.col("ordinal").alias("next_ordinal"), "head"))


def _compiled(enabled) -> list[tuple[R.Rule, re.Pattern]]:
    python = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", r"\\x\1", p)
    return [(r, re.compile(python(r.search))) for r in R.INJECTION_RULES if enabled is None or r.family in enabled]


@dataclass(frozen=True)
class View:
    """A text that rules of one surface read, and the stretch of it that a match must touch."""

    surface: str
    label: str
    text: str
    low: int
    high: int

    @classmethod
    def across(cls, surface: str, label: str, whole: str, tail: str, head: str) -> View:
        """The seam lies between what the whole has in common with its sides as they fold alone; a match must reach into or over it."""
        begun = len(os.path.commonprefix([whole, tail]))
        ended = len(whole) - len(os.path.commonprefix([whole[::-1], head[::-1]]))
        return cls(surface, label, whole, min(begun, ended), max(begun, ended))

    def first(self, pattern: re.Pattern) -> str | None:
        return next((m[0] for m in pattern.finditer(self.text) if m.start() < self.high and m.end() > self.low), None)


def views(tail: str, head: str) -> tuple[list[View], list[str]]:
    """What rules read of two neighbours, in the order of preference, and the limits that decoding hit.

    The sides are joined by a line end and without one; encoded runs count where they span the seam.
    """
    sides = [fold(tail), fold(head)]
    out, decoded, limits = [], [], []
    for whole in (f"{tail}\n{head}", tail + head):
        out.append(View.across(R.RAW, "", whole, tail, head))
        for label, surface, *parts in zip(("", "[deobfuscated] "), fold(whole), *sides, strict=True):
            if surface is not None:
                out.append(View.across(R.CANONICAL, label, surface, *(p if p is not None else side[0] for p, side in zip(parts, sides, strict=True))))
        segments, reasons = decode(whole)
        limits += reasons
        for s in segments:
            if s["start"] < len(tail) < s["end"]:
                shown = [(R.RAW, s["raw"]), (R.CANONICAL, s["canonical"]), (R.CANONICAL, s["deobfuscated"])]
                decoded += [View(surface, f"[{s['label']}-decoded] ", text, 0, len(text) + 1) for surface, text in shown if text]
    return out + decoded, list(dict.fromkeys(limits))


def seam_hits(tail: str, head: str, rules: list[tuple[R.Rule, re.Pattern]]) -> tuple[list[dict], list[str]]:
    """Each rule's first hit over the seam, and the limits."""
    seen, limits = views(tail, head)
    found = []
    for rule, pattern in rules:
        hits = ((v.label, v.first(pattern)) for v in seen if v.surface == rule.surface)
        if hit := next((h for h in hits if h[1] is not None), None):
            found.append({"family": rule.family, "severity": rule.severity, "label": hit[0], "body": hit[1]})
    return found, limits


def seam_findings(seams: DataFrame, enabled: frozenset[str] | None = None) -> DataFrame:
    """Findings of seams (``ordinal``, ``next_ordinal``, ``tail``, ``head``), in batches or streams; a null head is a chunk that came too late to be joined."""
    if enabled is not None and "split_payload" not in enabled:
        enabled = frozenset()

    @F.arrow_udf(_SEAM)
    def seam(tail: pa.Array, head: pa.Array) -> pa.Array:
        rules = _compiled(enabled)
        hits, reasons = zip(*(seam_hits(a.as_py(), b.as_py(), rules) if b.is_valid else ([], [LATE]) for a, b in zip(tail, head, strict=True)), strict=True) if len(tail) else ((), ())
        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("family", "severity", "label", "body")]))
        return pa.StructArray.from_arrays([pa.array(hits, kind), pa.array(reasons, pa.list_(pa.string()))], ["hits", "reasons"])

    seams = seams.withColumn("s", seam("tail", "head"))
    raw = F.regexp_replace(F.concat_ws(" ", "tail", "head"), "\n", " ")
    made = F.concat(
        F.transform("s.reasons", lambda r: F.struct(F.lit("scan_incomplete").alias("family"), F.lit("high").alias("severity"), F.lit("").alias("owasp"), r.alias("evidence"), F.lit("coverage-limit").alias("confidence"))),
        F.transform("s.hits", lambda h: F.struct(F.lit("split_payload").alias("family"), h["severity"].alias("severity"), F.lit("LLM01").alias("owasp"), T.finish_evidence(h["label"], F.when(h["label"] == "", T.locate(raw, h["body"])).otherwise(h["body"])).alias("evidence"), F.lit("heuristic").alias("confidence"))),
    )
    rows = seams.select("ordinal", "next_ordinal", F.posexplode(made).alias("seq", "f"))
    return rows.select(
        "ordinal", F.col("ordinal").cast("string").alias("document_id"), F.when(F.col("f.family") == "scan_incomplete", "scan_incomplete").otherwise("chunk_split_attack").alias("finding_type"),
        "f.severity", "f.family", "f.owasp", "f.evidence", "f.confidence", F.lit(None).cast("string").alias("metadata_path"), F.array_compact(F.array("ordinal", "next_ordinal")).alias("related"), "seq",
    )


def scan_boundaries(chunks: DataFrame, source: str, order: str, window_chars: int = WINDOW_CHARS, enabled: frozenset[str] | None = None) -> DataFrame:
    """``split_payload`` and ``scan_incomplete`` findings of seams, attached to the first chunk and related to both."""
    if window_chars < 1:
        raise ValueError("window_chars must be positive")
    return seam_findings(neighbours(chunks, source, order, window_chars), enabled)


def case_rollup(decisions: DataFrame, case: str) -> DataFrame:
    """A case's decision is its strictest chunk's; families are the sorted union; complete if all are."""
    order = F.array(F.lit("accept"), F.lit("review"), F.lit("reject"))
    return decisions.groupBy(case).agg(
        F.max_by("decision", F.array_position(order, F.col("decision"))).alias("decision"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"), F.every("scan_complete").alias("scan_complete"), F.count(F.lit(1)).alias("chunks"),
    )
