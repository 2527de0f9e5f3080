"""Incremental secret scanning over a content-addressed ledger, DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger
holds one row for each (blob, rule version) that was ever scanned.  A run scans
only the pairs that the ledger lacks, once each however many paths carry the
blob, and joins findings back to all paths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.common import as_table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # must behave alike in split and extract
    group: int = 0  # whose length counts
    least: int = 1  # shortest group that is kept
    hint: str = ""  # plain text that every match holds


#: The base rules, in order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that is too short is skipped whole either way, so the length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
_SPAN = "array<struct<start: int, kind: int, end: int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


#: Items that a running fold appends to one array: more are folded block by block, as appending copies.
_BLOCK = 128


def _blocks(items: Column) -> Column:
    """An array cut into arrays of ``_BLOCK`` items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda k: F.slice(items, k * _BLOCK + 1, F.lit(_BLOCK)))


def _bind(value: Column, function) -> Column:
    """function of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), 0)


def _before(blocks: Column, step) -> Column:
    """What a fold of integers from 0 has reached before each block; step: of the number reached and a block."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    add = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
    return F.aggregate(blocks, start, add, lambda acc: acc["all"])


def _rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """Leftmost non-overlapping matches with their offsets in code points."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), counted.alias("g")), lambda a, m: F.struct(F.length(a).alias("gap"), F.length(m["w"]).alias("size"), F.length(m["g"]).alias("counted")))

    def add(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["counted"] >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def of_block(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans")), add, lambda acc: acc["spans"])

    def of_blocks(blocks):
        reached = _before(blocks, lambda at, block: F.aggregate(block, at, lambda n, x: n + x["gap"] + x["size"]))
        return F.flatten(F.zip_with(blocks, reached, of_block))

    hit = text.rlike(rule.pattern)
    if rule.hint:
        hit = text.contains(rule.hint) & hit
    return F.when(hit, _bind(steps, lambda x: _bind(_blocks(x), of_blocks))).otherwise(F.array().cast(_SPAN))


def find_spans(text: Column, rules=RULES) -> Column:
    """All spans of all rules, by start, then rule, as an array of structs (null text: empty)."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_rule_spans(text, k, r) for k, r in enumerate(rules))))


def span_text(spans: Column, rules=RULES) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every span masked; overlapping spans get one mask.

    spans: in the order of ``find_spans``.  Pieces are cut from fixed-width
    bytes, so that a cut doesn't count characters from the start, and joined once.
    """
    cuts_type = "array<struct<a: int, b: int>>"

    def add(acc, s):
        gap = F.struct(acc["at"].alias("a"), s["start"].alias("b"))
        cuts = F.when(s["start"] >= acc["at"], F.array_append(acc["cuts"], gap)).otherwise(acc["cuts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), cuts.alias("cuts"))

    def of_block(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(cuts_type).alias("cuts")), add, lambda acc: acc["cuts"])

    def pieces(x):
        last = F.struct(F.array_max(F.transform(x["spans"], lambda s: s["end"])).alias("a"), x["n"].alias("b"))
        reached = lambda blocks: _before(blocks, lambda at, block: F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"]))))
        cuts = _bind(_blocks(x["spans"]), lambda blocks: F.flatten(F.zip_with(blocks, reached(blocks), of_block)))
        cut = lambda c: F.decode(F.substring(x["wide"], 4 * c["a"] + 1, 4 * (c["b"] - c["a"])), "UTF-32")
        return F.array_join(F.transform(F.concat(cuts, F.array(last).cast(cuts_type)), cut), mask)

    given = F.struct(spans.alias("spans"), F.length(text).alias("n"), F.encode(text, "UTF-32").alias("wide"))
    return F.when(F.size(spans) > 0, _bind(given, pieces)).otherwise(text)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(versions, new ledger rows).

    versions: ``id``, ``blob_id`` of every row of ``docs``, null ids and
    repeated rows included.  New ledger rows: ``blob_id``, ``rule_version``,
    ``spans`` of the blobs that ``ledger`` lacks under the rules' version; null
    text is the empty blob.  Append them to the ledger to make the next run
    incremental.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob_id", blob_id(F.col("text")))
    versions = as_table(rows.select("id", "blob_id"))
    blobs = rows.select("blob_id", "text")
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob_id")
        blobs = blobs.join(versions.select("blob_id").distinct().join(known, "blob_id", "left_anti"), "blob_id", "left_semi")
    # each task drops its own copies before texts are exchanged, so that a large group of copies costs one row of each
    found = blobs.distinct().select("blob_id", F.lit(rule_version(rules)).alias("rule_version"), find_spans(F.col("text"), rules).alias("spans"))
    return versions, as_table(found)


def by_path(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """``id``, ``blob_id`` and ``spans`` of every version; blobs without findings have an empty array."""
    hits = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob_id", "spans")
    return versions.join(hits, "blob_id", "left").select("id", "blob_id", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))
