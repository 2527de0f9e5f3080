"""Choosing on dev data only: severity floors, components, seeds; records of what was chosen."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.functions import rules as R
from sluicegate.operators import metrics as M
from sluicegate.operators import policy as P

#: Floors from the least strict reading of a finding to the strictest.
FLOORS = tuple(R.SEVERITY_RANK)


def floor_policy(floor: str, auto_reject: bool = False) -> P.Policy:
    """The default policy with another floor; severities under it block nothing."""
    least = R.SEVERITY_RANK[floor]
    return P.Policy(auto_reject=auto_reject, floor=floor, blocking=frozenset(s for s in ("critical", "high") if R.SEVERITY_RANK[s] >= least))


def worst_severity(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Each document's highest severity rank (-1: none) and whether its scan is complete."""
    summed = findings.groupBy("ordinal").agg(F.max(P.severity_rank(F.col("severity"))).alias("worst"), F.max(F.col("family") == "scan_incomplete").alias("limited"))
    return docs.join(summed, "ordinal", "left").withColumn("worst", F.coalesce("worst", F.lit(-1))).withColumn("scan_complete", ~F.coalesce("limited", F.lit(False))).drop("limited")


def floor_counts(records: DataFrame) -> DataFrame:
    """Counters of every floor from one pass.  records: ``label``, ``worst``, ``scan_complete``."""
    floors = F.explode(F.array(*(F.struct(F.lit(R.SEVERITY_RANK[f]).alias("rank"), F.lit(f).alias("floor")) for f in FLOORS)))
    each = records.select("label", "worst", "scan_complete", floors.alias("f")).select("*", "f.*")
    decided = each.withColumn("decision", F.when(F.col("worst") >= F.col("rank"), "review").otherwise("accept"))
    return M.confusion(decided, ("floor", "rank"))


def select_floor(dev: DataFrame, ceiling: float) -> DataFrame:
    """One row, or none: ``floor``, ``recall``, ``false_positive`` of the best floor within the ceiling.

    dev: records as in ``floor_counts`` with ``split``; another split than dev
    raises when read.  Recall is over all attacks, the ceiling is on completed
    benign cases; ties go to fewer false positives, then to the higher floor.
    """
    if not (math.isfinite(ceiling) and 0 <= ceiling <= 1):
        raise ValueError("the ceiling must be between 0 and 1")
    only = F.when(F.col("split") == "dev", F.col("label")).otherwise(F.raise_error(F.lit("calibration may only read dev rows")))
    counts = floor_counts(dev.withColumn("label", only))
    c = F.col
    rated = counts.select("floor", "rank", M.ratio(c("tp"), c("attacks")).alias("recall"), M.ratio(c("fp"), c("benigns")).alias("false_positive"), M.ratio(c("fp"), c("fp") + c("tn")).alias("held"))
    eligible = rated.where((F.col("held") <= ceiling) & F.col("recall").isNotNull())
    return eligible.orderBy(F.desc("recall"), "false_positive", F.desc("rank")).limit(1).select("floor", "recall", "false_positive")


def calibrated(records: DataFrame, ceiling: float) -> DataFrame:
    """Selects a floor on dev rows, then scores holdout rows under it: one row of rates, none where no floor is eligible."""
    chosen = select_floor(records.where("split = 'dev'"), ceiling).select("floor")
    held = M.rates(floor_counts(records.where("split = 'holdout'")).join(F.broadcast(chosen), "floor").withColumn("split", F.col("floor")))
    return held.withColumnRenamed("split", "floor").select("floor", "detection", "false_positive")


def largest(groups: DataFrame, group: str) -> DataFrame:
    """The group with the most rows, ties to the smaller name: ``group``, ``n``."""
    return groups.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(1)


def first_of_each(rows: DataFrame, category: str, order: str) -> DataFrame:
    """The first row of each category in the given order, ties to any one."""
    return rows.groupBy(category).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


@dataclass(frozen=True)
class CalibrationRecord:
    """What a threshold was chosen from; checked when it is made."""

    threshold: float
    recall: float
    false_positive: float
    ceiling: float
    attacks: int
    benigns: int
    data_sha256: str

    def __post_init__(self):
        for name in ("threshold", "recall", "false_positive", "ceiling"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for name in ("attacks", "benigns"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be positive")
        if self.false_positive > self.ceiling:
            raise ValueError("the false-positive rate is above the ceiling")
        if not re.fullmatch("[0-9a-f]{64}", self.data_sha256):
            raise ValueError("data_sha256 must be 64 hex digits")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
