"""Quality gates: bounds on rates by split and category and on latency, checked before and after they meet records."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.operators import metrics as M
from sluicegate.operators.lineage import cut

VIOLATION = "gate string, split string, category string, value double, bound double, violation string"
SPLITS = ("dev", "holdout", "all")
# The names of gates, the rate that each holds, and whether its bound is the least or the most.
OVERALL = {
    "min_attack_detection_rate": ("detection", "least"), "min_attack_block_rate": ("block", "least"),
    "max_benign_false_positive_rate": ("false_positive", "most"), "max_benign_false_block_rate": ("false_block", "most"),
}
CATEGORY = {"min_category_detection_rate": ("attack", "least"), "max_category_false_positive_rate": ("benign", "most")}
LATENCY = "max_p95_latency_ms"


def _bound(x, most: float = 1.0) -> bool:
    if isinstance(x, bool) or not isinstance(x, int | float):
        return False
    return 0 <= x <= min(most, 1e300)  # false for NaN


def malformed(gates) -> list[tuple[str, str | None, str]]:
    """(gate, split, what is wrong) of gates as they were given; names that begin with ``_`` are remarks."""
    if not isinstance(gates, dict):
        return [("gates", None, "not an object")]
    out: list[tuple[str, str | None, str]] = []
    for gate, told in sorted(gates.items()):
        if gate == LATENCY:
            if not _bound(told, math.inf):
                out.append((gate, None, "not a bound"))
        elif gate not in OVERALL and gate not in CATEGORY:
            if not gate.startswith("_"):
                out.append((gate, None, "unknown gate"))
        elif not isinstance(told, dict):
            out.append((gate, None, "not by split"))
        else:
            for split, x in told.items():
                if split not in SPLITS:
                    out.append((gate, str(split), "unknown split"))
                if gate in OVERALL:
                    fine = _bound(x)
                else:
                    fine = isinstance(x, dict) and all(isinstance(c, str) and c and _bound(b) for c, b in x.items())
                if not fine:
                    out.append((gate, str(split), "not a rate" if gate in OVERALL else "not rates by category"))
    return out


def _judged(held: DataFrame, missing: str) -> DataFrame:
    """Rows of ``gate, split, category, kind, bound, value, there`` that fail."""
    why = F.when(~F.col("there"), missing).when(F.col("value").isNull(), "no sample")
    why = why.when((F.col("kind") == "least") & (F.col("value") < F.col("bound")), "below minimum").when((F.col("kind") == "most") & (F.col("value") > F.col("bound")), "above maximum")
    return held.withColumn("violation", why).where("violation is not null").select("gate", "split", "category", "value", "bound", "violation")


def check(records: DataFrame, gates, latency: str = "latency_ms") -> DataFrame:
    """Violations (``VIOLATION``): none if all gates hold.

    records: ``label``, ``category``, ``split``, ``decision``, ``scan_complete``,
    and the latency column where a gate asks for it.  Malformed gates give their
    own rows and nothing is measured.  Any unknown case is a violation, since a
    gate can't be met by leaving cases out.  Splits that no record has are
    skipped; a category that a split lacks is a violation, as is a rate without
    samples.
    """
    spark = records.sparkSession
    if bad := malformed(gates):
        return spark.createDataFrame([(g, s, None, None, None, why) for g, s, why in bad], VIOLATION)
    base = cut(records.groupBy("split", "label", "category").agg(*M.confusion_columns()))  # records are read once, and once more for latency
    counters = [c for c in base.columns if c not in ("split", "label", "category")]
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    counts = base.groupingSets([["split"], []], "split").agg(*totals).withColumn("split", F.coalesce("split", F.lit("all")))
    parts = [
        counts.where("split = 'all'").select((F.col("unknown_attack") + F.col("unknown_benign")).cast("double").alias("value")).where("value > 0").select(
            F.lit("coverage").alias("gate"), F.lit("all").alias("split"), F.lit(None).cast("string").alias("category"), "value", F.lit(None).cast("double").alias("bound"), F.lit("unknown cases").alias("violation"),
        )
    ]
    overall = [(g, s, None, kind, float(x), metric) for g, (metric, kind) in OVERALL.items() for s, x in gates.get(g, {}).items()]
    if overall:
        values = M.long_rates(M.rates(counts), "split")
        asked = F.broadcast(spark.createDataFrame(overall, "gate string, split string, category string, kind string, bound double, metric string"))
        parts.append(_judged(values.join(asked, ["split", "metric"]).withColumn("there", F.lit(True)), ""))
    by_category = [(g, s, c, kind, float(x), label) for g, (label, kind) in CATEGORY.items() for s, rates in gates.get(g, {}).items() for c, x in rates.items()]
    if by_category:
        flagged = ((F.sum("tp") + F.sum("fp")) / F.sum("cases")).alias("value")
        each = base.groupingSets([["split", "label", "category"], ["label", "category"]], "split", "label", "category").agg(flagged).withColumn("split", F.coalesce("split", F.lit("all")))
        asked = spark.createDataFrame(by_category, "gate string, split string, category string, kind string, bound double, label string").join(counts.where("cases > 0").select("split"), "split")
        parts.append(_judged(asked.join(each, ["split", "label", "category"], "left").withColumn("there", F.col("value").isNotNull()), "no such category"))
    if LATENCY in gates:
        p95 = M.latency(cut(records.select(latency)), latency).select(F.lit(LATENCY).alias("gate"), F.lit("all").alias("split"), F.lit(None).cast("string").alias("category"), F.lit("most").alias("kind"), F.lit(float(gates[LATENCY])).alias("bound"), F.col("p95").cast("double").alias("value"), F.lit(True).alias("there"))
        parts.append(_judged(p95, ""))
    return reduce(DataFrame.unionByName, parts)
