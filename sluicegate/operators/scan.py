"""Findings of documents: rules over surfaces, metadata leaves, coverage limits."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from sluicegate.functions import rules as R
from sluicegate.functions import text as T
from sluicegate.functions.batches import small_batches, tidy
from sluicegate.functions.literals import Look
from sluicegate.functions.surfaces import SURFACES, Limits, fold, surfaces_of, with_surfaces

#: Columns of findings, in order.
FINDING_COLUMNS = ["ordinal", "document_id", "finding_type", "severity", "family", "owasp", "evidence", "confidence", "metadata_path", "related", "seq"]
_NONE = "array<string>"


def _all(surface: Column, pattern: str, most: int) -> Column:
    """Distinct matches among the first that are looked at."""
    found = F.when(surface.rlike(pattern), F.slice(F.regexp_extract_all(surface, F.lit(pattern), F.lit(0)), 1, most))
    return F.array_distinct(F.coalesce(found, F.array().cast(_NONE)))


def _labelled(label: Column, matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(label.alias("label"), m.alias("body")))


def _of_surfaces(rule: R.Rule, raw: Column, canonical: Column, plain: Column, most: int, label: Column) -> Column:
    """(label, body) of a rule's matches: canonical first, deobfuscated where it adds some."""
    if rule.surface == R.RAW:
        return _labelled(label, _all(raw, rule.search, most))
    first = _all(canonical, rule.search, most)
    more = F.array_except(_all(plain, rule.search, most), first)
    return F.concat(_labelled(label, first), _labelled(F.concat(label, F.lit("[deobfuscated] ")), more))


def evidence(rule: R.Rule, raw: Column, surfaces: Column, cap: int, limits: Limits = Limits(), read: tuple[Column, ...] | None = None) -> Column:
    """Up to ``cap`` finished pieces of evidence of one rule, body before decoded segments.

    read: the body's raw, canonical and deobfuscated surfaces as far as the rule may match them; all of them by default.
    """
    most = limits.looked_at * cap
    body = read or (raw, surfaces["canonical"], surfaces["deobfuscated"])
    own = F.transform(_of_surfaces(rule, *body, most, F.lit("")), lambda e: F.struct(e["label"].alias("label"), F.when(e["label"] == "", T.locate(raw, e["body"])).otherwise(e["body"]).alias("body")))
    found = own
    if rule.group == R.INJECTION:
        tagged = lambda s: F.concat(F.lit("["), s["label"], F.lit("-decoded] "))
        decoded = F.flatten(F.transform(surfaces["segments"], lambda s: _of_surfaces(rule, s["raw"], s["canonical"], s["deobfuscated"], most, tagged(s))))
        found = F.when(F.size(surfaces["segments"]) > 0, F.concat(own, decoded)).otherwise(own)
    done = F.array_distinct(F.transform(found, lambda e: T.finish_evidence(e["label"], e["body"], limits.evidence_chars)))
    if rule.family == "metadata_credential_leak":
        done = F.when(F.size(done) > 0, F.array(F.lit(T.REDACTED_CREDENTIAL))).otherwise(done)
    return F.slice(done, 1, cap)


def presence(rule: R.Rule, raw: Column, surfaces: Column, read: tuple[Column, ...] | None = None) -> Column:
    """Whether a rule matches anywhere: one look at each surface, and no evidence."""
    own = lambda body, canonical, plain: [body] if rule.surface == R.RAW else [canonical, plain]
    matched = lambda *s: T.any_of([F.coalesce(x.rlike(rule.search), F.lit(False)) for x in own(*s)])
    found = matched(*(read or (raw, surfaces["canonical"], surfaces["deobfuscated"])))
    if rule.group == R.INJECTION:
        found = found | F.exists(surfaces["segments"], lambda s: matched(s["raw"], s["canonical"], s["deobfuscated"]))
    return found


def _composite(read: tuple[Column, ...], rule: R.Rule, base: R.Rule) -> Column:
    return T.any_of([F.coalesce(s.rlike(rule.search) & s.rlike(base.search), F.lit(False)) for s in read[1:]])


def _hit(k: int, kind: str, rule: R.Rule):
    return lambda e: F.struct(
        F.lit(k).alias("seq"), F.lit(kind).alias("finding_type"), F.lit(rule.family).alias("family"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.owasp).alias("owasp"), e.alias("evidence"),
    )


def rule_hits(raw: Column, surfaces: Column, chosen: list[R.Rule], cap: int = 1, origin: str | None = None, limits: Limits = Limits(), shown: bool = True) -> Column:
    """Array of (seq, finding_type, family, severity, owasp, evidence) of all rules, in one projection.

    Surfaces are bound before rules read them, so that each is made once however
    many rules there are, and so are the literals that each of them has: a rule
    reads only what has one that it needs.  shown: with evidence; without it, a
    rule that matches gives one hit.
    """
    looks = [Look(chosen, x) for x in (R.RAW, R.CANONICAL, R.CANONICAL)]

    def of(s):
        every = []
        own = s["raw"], s["surfaces"]["canonical"], s["surfaces"]["deobfuscated"]
        for k, rule in enumerate(chosen):
            read = tuple(look.read(rule, x, s[f"found{n}"]) for n, (look, x) in enumerate(zip(looks, own, strict=True)))
            if rule is R.COMPOSITE:
                kind, said = "canonical_injection", F.lit("override combined with an enumerated instruction" if shown else "")
                found = F.when(_composite(read, rule, R.BY_FAMILY["instruction_override"]), F.array(said))
            elif shown:
                kind, found = R.FINDING_TYPES[origin or rule.group], evidence(rule, s["raw"], s["surfaces"], cap, limits, read)
            else:
                kind, found = R.FINDING_TYPES[origin or rule.group], F.when(presence(rule, s["raw"], s["surfaces"], read), F.array(F.lit("")))
            every.append(F.transform(F.coalesce(found, F.array().cast(_NONE)), _hit(k, kind, rule)))
        return F.concat(*every)

    found = [look.found(x).alias(f"found{n}") for n, (look, x) in enumerate(zip(looks, (raw, surfaces["canonical"], surfaces["deobfuscated"]), strict=True))]
    return T.bind(F.struct(raw.alias("raw"), surfaces.alias("surfaces"), *found), of)


def _limit_hits(reasons: Column) -> Column:
    return F.transform(reasons, lambda r: F.struct(
        F.lit(-1).alias("seq"), F.lit("scan_incomplete").alias("finding_type"), F.lit("scan_incomplete").alias("family"),
        F.lit("high").alias("severity"), F.lit("").alias("owasp"), r.alias("evidence"),
    ))


def _long(df: DataFrame, hits: Column, path: Column | None = None) -> DataFrame:
    rows = df.withColumn("_hit", F.explode(hits))
    h = F.col("_hit")
    return rows.select(
        "ordinal", "document_id", h["finding_type"].alias("finding_type"), h["severity"].alias("severity"), h["family"].alias("family"), h["owasp"].alias("owasp"),
        h["evidence"].alias("evidence"), F.when(h["family"] == "scan_incomplete", "coverage-limit").otherwise("heuristic").alias("confidence"),
        (F.lit(None).cast("string") if path is None else path).alias("metadata_path"), F.array("ordinal").alias("related"), h["seq"].alias("seq"),
    )


def scan_documents(
    docs: DataFrame, *, injection: bool = True, metadata: bool = True, splits: bool = True, enabled: frozenset[str] | None = None,
    cap: int = 1, shown: bool = True, rules: tuple[R.Rule, ...] = R.ALL_RULES, limits: Limits = Limits(),
) -> DataFrame:
    """Findings, long: ``FINDING_COLUMNS``; ``seq`` orders those of a document.

    docs: ``ordinal``, ``id``, ``text``, and optionally ``metadata`` (JSON).
    Switches and names are resolved when the plan is built, so that disabled
    work is not in it; without an injection rule nothing is decoded or limited.
    shown: with evidence; decisions don't need it, and without it a rule costs
    one look and gives one finding.  rules: the table, which callers may extend.
    """
    if isinstance(cap, bool) or cap < 1:
        raise ValueError("cap must be positive")
    chosen = R.select_rules(enabled, rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("document_id", T.document_id(F.col("id"), F.col("text")))
    body = [r for r in chosen if (injection and r.group == R.INJECTION) or (splits and r.group == R.SPLIT)]
    if R.COMPOSITE in body and R.BY_FAMILY["instruction_override"] not in chosen:
        body.remove(R.COMPOSITE)
    parts = []
    if body:
        seen = with_surfaces(base.select("ordinal", "document_id", text.alias("text")), limits=limits)
        hits = rule_hits(F.col("text"), F.col("surfaces"), body, cap, limits=limits, shown=shown)
        if any(r.group == R.INJECTION for r in body):
            hits = F.concat(_limit_hits(F.col("surfaces.reasons")), hits)
        parts.append(_long(seen, hits))
    if metadata and "metadata" in docs.columns and any(r.group in (R.INJECTION, R.METADATA) for r in chosen):
        parts.append(scan_metadata(base, chosen, cap, limits))
    if not parts:
        empty = base.withColumn("_none", F.array().cast("array<struct<seq:int,finding_type:string,family:string,severity:string,owasp:string,evidence:string>>"))
        return _long(empty, F.col("_none"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A leaf's text as it is matched and its surfaces, whether it has a value, its pointer as it may be shown, whether a segment of it is a credential's name; or why no more leaves were read.
_LEAF = StructType([StructField("text", StringType()), StructField("surfaces", SURFACES), StructField("valued", BooleanType()), StructField("shown", StringType()), StructField("below", BooleanType()), StructField("reason", StringType())])
#: Leaves and characters of leaves that a Python worker holds at a time.
LEAVES, LEAF_CHARS = 4096, 1 << 20
_NAME, _SECRET = re.compile(T.CREDENTIAL_NAME, re.I), re.compile(T.SECRET, re.I)
#: Metadata that cannot be walked: not JSON, nested too deeply, or a number that no reader takes.
UNREADABLE = "metadata_unreadable"


def pointer(path: str, known: dict[str, tuple[bool, bool]]) -> tuple[str, bool]:
    """A JSON pointer as it may be shown, and whether one of its segments is a credential's name.

    Segments are unescaped and made canonical before they are looked at.  A
    segment that holds a secret is masked, and so is all below a credential's
    name, which has to be the whole segment.
    """
    shown, below = [], False
    for segment in path.split("/")[1:]:
        if segment not in known:
            canonical = fold(segment.replace("~1", "/").replace("~0", "~"))[0]
            known[segment] = _NAME.fullmatch(canonical) is not None, _SECRET.search(canonical) is not None
        name, secret = known[segment]
        shown.append(T.REDACTED if below or secret else segment)
        below = below or name
    return "".join(f"/{x}" for x in shown), below


class _Limit(Exception):
    pass


def leaves_of(document: str, max_nodes: int = Limits.metadata_nodes, max_chars: int = Limits.metadata_chars, max_depth: int = Limits.metadata_depth) -> tuple[list[tuple[str, str, str]], str | None]:
    """(pointer, key, value) of all leaves of a JSON object in reading order, and the limit that ended the walk."""
    found: list[tuple[str, str, str]] = []
    left = {"nodes": max_nodes, "chars": max_chars}

    def pay(kind: str, amount: int, reason: str) -> None:
        left[kind] -= amount
        if left[kind] < 0:
            raise _Limit(reason)

    def walk(x, path: str, key: str, depth: int) -> None:
        if depth > max_depth:
            raise ValueError("metadata is nested too deeply")
        pay("nodes", 1, "metadata_node_limit")
        if isinstance(x, dict | list):
            if key:
                found.append((path, key, ""))
            for k, y in x.items() if isinstance(x, dict) else enumerate(x):
                name = k if isinstance(k, str) else ""
                pay("chars", len(name), "metadata_char_limit")
                walk(y, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}", name, depth + 1)
            return
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("metadata numbers must be finite")
        if isinstance(x, int) and not isinstance(x, bool) and x.bit_length() > 4 * left["chars"] + 64:
            raise _Limit("metadata_char_limit")
        shown = "" if x is None else str(x)
        pay("chars", len(shown), "metadata_char_limit")
        found.append((path, key, shown))

    try:
        walk(json.loads(document), "", "", 0)
    except _Limit as e:
        return found, str(e)
    return found, None


def _leaves(limits: Limits):
    """(ordinal, document_id, metadata) to a row for each leaf, in bounded batches, and one for each limit that is hit."""

    @tidy
    def run(batches):
        for b in batches:
            at, rows, chars = [], [], 0

            def made(b=b, at=at, rows=rows):
                texts, *rest = ([r[k] for r in rows] for k in range(5))
                columns = [pa.array(texts, pa.string()), surfaces_of(texts, limits), *(pa.array(x, t) for x, t in zip(rest, (pa.bool_(), pa.string(), pa.bool_(), pa.string()), strict=True))]
                out = pa.RecordBatch.from_arrays([*b.select([0, 1]).take(pa.array(at, pa.int64())).columns, *columns], ["ordinal", "document_id", *_LEAF.names])
                at.clear()
                rows.clear()
                return out

            for n, x in enumerate(b.column(2)):
                known: dict[str, tuple[bool, bool]] = {}
                try:
                    found, reason = leaves_of(x.as_py(), limits.metadata_nodes, limits.metadata_chars, limits.metadata_depth) if x.as_py() else ([], None)
                except (ValueError, RecursionError):  # one object must not end the others' job
                    found, reason = [], UNREADABLE
                for path, key, value in found:
                    text = value if key == "" else f"{key}: {value}"
                    at.append(n)
                    rows.append((text, value != "", *pointer(path, known), None))
                    chars += len(text)
                    if len(at) >= LEAVES or chars >= LEAF_CHARS:
                        yield made()
                        chars = 0
                if reason:
                    at.append(n)
                    rows.append((None, False, None, False, reason))
            if at:
                yield made()

    return run


def scan_metadata(docs: DataFrame, chosen: tuple[R.Rule, ...], cap: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Findings of metadata: every leaf as "key: value" against injection and metadata rules, and credential names.

    No secret of a name or a value is in what is returned.  Metadata that cannot
    be walked, or is beyond a limit, gives a ``scan_incomplete`` finding.
    """
    use = [r for r in chosen if r.group in (R.INJECTION, R.METADATA) and r is not R.COMPOSITE]
    small_batches(docs.sparkSession)
    source = docs.select("ordinal", "document_id", F.col("metadata").cast("string").alias("metadata"))
    seen = source.mapInArrow(_leaves(limits), StructType([*source.schema.fields[:2], *_LEAF.fields]))  # one worker a task, for leaves and their surfaces
    leak = R.BY_FAMILY["metadata_credential_leak"]
    below, reason = F.col("below"), F.col("reason")
    hits = F.concat(_limit_hits(F.col("surfaces.reasons")), rule_hits(F.col("text"), F.col("surfaces"), use, cap, R.METADATA, limits))
    if leak in use:
        extra = F.array(F.struct(F.lit(len(use)).alias("seq"), F.lit("metadata_injection").alias("finding_type"), F.lit(leak.family).alias("family"), F.lit(leak.severity).alias("severity"), F.lit(leak.owasp).alias("owasp"), F.lit("").alias("evidence")))
        named = below & F.col("valued") & ~F.exists(hits, lambda h: h["family"] == leak.family)
        hits = F.concat(hits, F.when(named, extra).otherwise(F.slice(extra, 1, 0)))
    # in the order of leaves, and of the rules of a leaf
    masked = F.transform(hits, lambda h: F.when(below & (h["family"] != "scan_incomplete"), h.withField("evidence", F.lit(T.REDACTED_METADATA))).otherwise(h))
    every = F.when(reason.isNull(), masked).otherwise(_limit_hits(F.array(reason)))
    return _long(seen, every, F.col("shown")).withColumn("seq", F.when(F.col("metadata_path").isNull(), F.col("seq")).otherwise(1000 + F.col("seq")))
