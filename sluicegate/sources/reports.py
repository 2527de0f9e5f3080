"""Writing decisions, findings and frames as JSON; one-row reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.operators import policy as P
from sluicegate.sources import corpora

SCHEMA_VERSION = "1.3"


def finding_json() -> Column:
    return F.to_json(F.struct(
        F.col("finding_type").alias("type"), "severity", "document_id", "evidence", F.col("owasp").alias("owasp_mapping"), F.col("owasp_mappings"),
        "family", F.col("ordinal").alias("document_index"), "metadata_path", F.col("related").alias("related_document_indices"), "confidence",
    ))


def decision_json() -> Column:
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("ordinal").alias("document_index"), "decision", "families", "advisory_families", "scan_complete", "incomplete_reasons"))


def write_decisions(decisions: DataFrame, path: str) -> None:
    decisions.select(decision_json().alias("value")).write.text(path)


def write_gate(released: DataFrame, released_path: str, quarantine_path: str) -> None:
    """Released text and quarantined fingerprints, apart."""
    released.where("released").select("ordinal", "released_text", "content_sha256", "policy_sha256").write.parquet(released_path)
    released.where("not released").select("ordinal", "decision", "families", "content_sha256", "policy_sha256").write.parquet(quarantine_path)


def worker_frame(request: str = "request_id") -> Column:
    """A success frame: no text, metadata or evidence."""
    return F.to_json(F.struct(F.lit(1).alias("protocol"), F.col(request).alias("id"), F.lit(True).alias("ok"), "release", "decision", "families", F.lit(SCHEMA_VERSION).alias("schema_version")))


def error_frame(request: str = "request_id") -> Column:
    """A failure frame: it names the request where that is known, and says no more."""
    return F.to_json(F.struct(F.lit(1).alias("protocol"), F.col(request).alias("id"), F.lit(False).alias("ok"), F.lit(False).alias("release"), F.lit("request_failed").alias("error")), {"ignoreNullFields": "false"})


def ready_frame(ruleset: str) -> str:
    return json.dumps({"protocol": 1, "type": "ready", "ruleset_version": ruleset, "schema_version": SCHEMA_VERSION})


def batch_json(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """One row ``value``: the counters and the severity histogram of a batch; its documents are rows of their own."""
    counts = P.counters(decisions)
    summed = P.severity_summary(findings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_summary"))
    return counts.crossJoin(summed).select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *counts.columns, "severity_summary")).alias("value"))


def export(report: DataFrame, path: str) -> None:
    """Write a report of one row as indented JSON with sorted keys; more rows raise."""
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a report has one row, not {len(rows)}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(rows[0].asDict(recursive=True), indent=2, sort_keys=True, default=str) + "\n")


def _percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}%"


def markdown(split: str, totals: dict, rates: dict, categories: list[dict]) -> str:
    """A report to read: totals, rates and categories of one split, all of them bounded in number."""
    head = [f"# Evaluation of split {split}", "", f"{totals['scored']} of {totals['total']} cases completed, {totals['unknown']} unknown.", "", "| Metric | Value |", "|---|---|"]
    body = [f"| {name} | {_percent(rates[name])} |" for name in ("detection", "block", "false_positive", "false_block")]
    table = ["", "| Label | Category | Cases | Flagged | Rate |", "|---|---|---|---|---|"]
    table += [f"| {c['label']} | {c['category']} | {c['n']} | {c['flagged']} | {_percent(c['rate'])} |" for c in sorted(categories, key=lambda c: (c["label"], c["category"]))]
    return "\n".join([*head, *body, *table]) + "\n"


def payload_digests(entries: DataFrame, evaluated: DataFrame, records: DataFrame, entry_columns: list[str], record_columns: list[str]) -> DataFrame:
    """Order-free digests of a corpus, of what was evaluated of it, and of the results without their times: ``part``, ``n``, ``sha256``."""
    parts = (("corpus", entries, entry_columns), ("evaluated", evaluated, entry_columns), ("results", records, [c for c in record_columns if not c.endswith("latency_ms")]))
    each = [corpora.digest(rows, columns).select(F.lit(name).alias("part"), "n", "sha256") for name, rows, columns in parts]
    return each[0].union(each[1]).union(each[2])


def schemas(**tables: DataFrame) -> dict[str, dict]:
    """The schemas of output tables, as JSON objects."""
    return {name: json.loads(df.schema.json()) for name, df in tables.items()}


def summary_line(summary: DataFrame) -> DataFrame:
    """Severities in alphabetical order with their counts, zeros left out."""
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "severity", F.col("n").cast("string"))))
    return summary.where("n > 0").agg(F.array_join(parts, ", ").alias("summary"))
