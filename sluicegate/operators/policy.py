"""From findings to decisions: actions, advisory families, counters, release."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.functions import rules as R

ACTIONS = ("accept", "review", "reject")
BOUNDARIES = ("ingestion", "retrieval", "tool_output", "memory_read", "memory_write", "tool_description", "final_context")
MAX_TEXT_CHARS = 1_000_000


@dataclass(frozen=True)
class Policy:
    auto_reject: bool = False
    blocking: frozenset[str] = frozenset({"critical", "high"})
    floor: str = "medium"
    family_actions: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not (self.blocking <= R.SEVERITY_RANK.keys() and self.floor in R.SEVERITY_RANK):
            raise ValueError("unknown severity")
        if any(not k.strip() or v not in ACTIONS for k, v in self.family_actions.items()):
            raise ValueError("family actions need names and known actions")
        if self.blocking and R.SEVERITY_RANK[self.floor] > min(R.SEVERITY_RANK[s] for s in self.blocking):
            raise ValueError("the floor is above a blocking severity")

    def fingerprint(self, scanner: dict | None = None, detector: dict | None = None) -> str:
        """SHA-256 of the policy, and of the settings of the scanner and the detector where they are given."""
        shape = {"auto_reject": self.auto_reject, "blocking": sorted(self.blocking), "floor": self.floor, "family_actions": self.family_actions, "scanner": scanner, "detector": detector}
        return hashlib.sha256(json.dumps(shape, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def severity_rank(severity: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in R.SEVERITY_RANK.items():
        out = out.when(severity == name, rank)
    return out


def own_action(policy: Policy, family: Column) -> Column:
    """The rank of a family's own action, or null."""
    out = F.when(F.lit(False), 0)
    for name, action in policy.family_actions.items():
        out = out.when(family == name, ACTIONS.index(action))
    return out


def action_rank(policy: Policy) -> Column:
    """0 accept, 1 review, 2 reject; an incomplete scan always rejects."""
    rank = severity_rank(F.col("severity"))
    by_severity = F.when(rank < R.SEVERITY_RANK[policy.floor], 0).when(F.col("severity").isin(*policy.blocking), 2).otherwise(1)
    return F.when(F.col("family") == "scan_incomplete", 2).otherwise(F.coalesce(own_action(policy, F.col("family")), by_severity))


def is_advisory(policy: Policy) -> Column:
    return (F.col("family") != "scan_incomplete") & own_action(policy, F.col("family")).isNull() & (severity_rank(F.col("severity")) < R.SEVERITY_RANK[policy.floor])


def _name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), rank + 1)


def decide(docs: DataFrame, findings: DataFrame, policy: Policy, related: bool = False) -> DataFrame:
    """One row per document: decision, families, advisory families, scan_complete, counts.

    Findings are summed up by document before they meet the documents, so a
    clean document costs no shuffle of its text.  related: a finding counts for
    all documents it names.
    """
    if related:
        findings = findings.withColumn("ordinal", F.explode(F.array_distinct(F.concat(F.array("ordinal"), "related"))))
    summed = findings.withColumn("_advisory", is_advisory(policy)).groupBy("ordinal").agg(
        F.max(action_rank(policy)).alias("worst"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("family")).alias("families"), F.collect_set(F.when(~F.col("_advisory"), F.col("family"))).alias("binding"),
        F.array_sort(F.collect_set(F.when(F.col("family") == "scan_incomplete", F.col("evidence")))).alias("incomplete_reasons"),
    )
    none = F.array().cast("array<string>")
    worst = F.coalesce("worst", F.lit(0))
    final = worst if policy.auto_reject else F.least(worst, F.lit(1))
    families = F.coalesce("families", none)
    return docs.join(summed, "ordinal", "left").select(
        *(docs[c] for c in docs.columns), _name(final).alias("decision"), families.alias("families"),
        F.array_sort(F.array_except(families, F.coalesce("binding", none))).alias("advisory_families"),
        F.coalesce("incomplete_reasons", none).alias("incomplete_reasons"),
        (~F.array_contains(families, "scan_incomplete")).alias("scan_complete"), F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"),
    )


def counters(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") != "reject").alias("accepted"), F.count_if(F.col("decision") == "review").alias("review"),
        F.count_if(F.col("decision") == "reject").alias("rejected"), F.count_if(F.col("n_findings") == 0).alias("clean"),
    )


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def with_successors(findings: DataFrame) -> DataFrame:
    """Findings with ``owasp_mappings``: the 2025 number and its successor; unknown numbers get an empty list."""
    table = F.create_map(*(F.lit(x) for k, v in R.OWASP_SUCCESSORS.items() for x in (k, f"{k}:2025,LLM{v}:2026")))
    return findings.withColumn("owasp_mappings", F.coalesce(F.split(F.element_at(table, F.col("owasp")), ","), F.array().cast("array<string>")))


def release(decisions: DataFrame, policy: Policy, boundary: str = "ingestion", allow_review: bool = False, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """The gate: text only where the scan is complete and the decision allows it; fingerprints always.

    A text of over ``max_chars`` characters raises when it is read.
    """
    if boundary not in BOUNDARIES:
        raise ValueError(f"unknown boundary {boundary}")
    fits = F.coalesce(F.length("text"), F.lit(0)) <= max_chars
    fits = F.when(fits, True).otherwise(F.raise_error(F.lit(f"text is longer than {max_chars} characters")).cast("boolean"))
    ok = fits & F.col("scan_complete") & (F.col("decision") != "reject") & ((F.col("decision") != "review") | F.lit(allow_review))
    return decisions.select(
        "ordinal", F.lit(boundary).alias("boundary"), "decision", "families", ok.alias("released"), F.when(ok, F.col("text")).alias("released_text"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), F.lit(policy.fingerprint()).alias("policy_sha256"),
    )


def matches_text(content_sha256: Column, text: Column) -> Column:
    """Whether a fingerprint is that of exactly this text."""
    return content_sha256 == F.sha2(F.coalesce(text, F.lit("")), 256)


def release_enforced(decisions: DataFrame, policy: Policy, mode: str, **more) -> DataFrame:
    """``enforce``: reviews are withheld; ``monitor``: they are released."""
    if mode not in ("enforce", "monitor"):
        raise ValueError(f"unknown mode {mode}")
    return release(decisions, policy, allow_review=mode == "monitor", **more)


def request_summary(decisions: DataFrame, request: str, max_documents: int = 64) -> DataFrame:
    """Strictest decision, families and release of all documents of a request; too many documents are never released."""
    rank = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("decision")) - 1
    return decisions.groupBy(request).agg(F.max(rank).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"), F.every("scan_complete").alias("complete"), F.count(F.lit(1)).alias("n")).select(
        request, _name(F.col("r").cast("int")).alias("decision"), "families", ((F.col("r") < 2) & F.col("complete") & (F.col("n") <= max_documents)).alias("release"),
    )
