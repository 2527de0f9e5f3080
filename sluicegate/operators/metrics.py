"""Measuring detection: confusion, rates, intervals, gates, thresholds, paired outcomes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sluicegate.operators.components import of_shared
from sluicegate.operators.ranks import best_threshold, nearest_ranks

#: Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of k of n; null for none."""
    p, z2 = k / n, Z * Z
    centre, spread, scale = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / scale)), F.when(n > 0, F.least(F.lit(1.0), (centre + spread) / scale))


def _is(label: str) -> Column:
    return F.col("label") == label


def confusion_columns() -> list[Column]:
    """Counters over records: ``label`` (attack, benign), ``decision`` (null: unknown), ``scan_complete``."""
    done = F.coalesce(F.col("scan_complete"), F.lit(False)) & F.col("decision").isNotNull() & (F.col("decision") != "unknown")
    flagged = done & (F.col("decision") != "accept")
    count = lambda c, name: F.count_if(c).alias(name)
    return [
        F.count(F.lit(1)).alias("cases"), count(_is("attack"), "attacks"), count(_is("benign"), "benigns"),
        count(_is("attack") & flagged, "tp"), count(_is("attack") & done & ~flagged, "fn"), count(_is("benign") & flagged, "fp"), count(_is("benign") & done & ~flagged, "tn"),
        count(_is("attack") & ~done, "unknown_attack"), count(_is("benign") & ~done, "unknown_benign"),
        count(_is("attack") & done & (F.col("decision") == "reject"), "blocked"), count(_is("benign") & done & (F.col("decision") == "reject"), "false_blocked"),
    ]


def confusion(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return records.groupBy(*by).agg(*confusion_columns())


def by_split(records: DataFrame) -> DataFrame:
    """Counters of each split and of all, from one aggregation over grouping sets."""
    return records.groupingSets([["split"], []], "split").agg(*confusion_columns()).withColumn("split", F.coalesce("split", F.lit("all")))


def rates(counts: DataFrame) -> DataFrame:
    """Rates over all cases (lower bounds), their upper bounds, and intervals over completed cases."""
    c = F.col
    low, high = wilson(c("tp"), c("tp") + c("fn"))
    flow, fhigh = wilson(c("fp"), c("fp") + c("tn"))
    keep = [x for x in ("split", "category") if x in counts.columns]
    return counts.select(
        *keep, ratio(c("tp"), c("attacks")).alias("detection"), ratio(c("tp") + c("unknown_attack"), c("attacks")).alias("detection_most"), ratio(c("blocked"), c("attacks")).alias("block"),
        ratio(c("fp"), c("benigns")).alias("false_positive"), ratio(c("fp") + c("unknown_benign"), c("benigns")).alias("false_positive_most"), ratio(c("false_blocked"), c("benigns")).alias("false_block"),
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"), low.alias("detection_low"), high.alias("detection_high"), flow.alias("false_positive_low"), fhigh.alias("false_positive_high"),
    )


def category_rates(records: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("scan_complete"), F.lit(False))
    flagged = F.count_if(done & (F.col("decision") != "accept"))
    return records.groupBy("label", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~done).alias("unknown"), flagged.alias("flagged"),
        F.count_if(done & (F.col("decision") == "reject")).alias("rejected"), (flagged / F.count(F.lit(1))).alias("rate"),
    )


def family_precision(records: DataFrame) -> DataFrame:
    """How often each family fired on attacks and on benign cases; listed if it fired at all."""
    fired = records.select("label", F.coalesce("scan_complete", F.lit(False)).alias("done"), F.explode("families").alias("family"))
    a, b = F.count_if(F.col("done") & _is("attack")), F.count_if(F.col("done") & _is("benign"))
    return fired.groupBy("family").agg(a.alias("on_attack"), b.alias("on_benign"), ratio(a, a + b).alias("precision"))


def latency(records: DataFrame, value: str) -> DataFrame:
    """Nearest-rank percentiles of all values that aren't null; exact, by brackets that narrow (``ranks.nearest_ranks``)."""
    kind = records.schema[value].dataType
    p50, p95, most = nearest_ranks(records, value, [0.5, 0.95, 1.0])
    return records.sparkSession.createDataFrame([(p50, p95, most)], StructType([StructField(c, kind) for c in ("p50", "p95", "max")]))


def long_rates(rate_rows: DataFrame, key: str) -> DataFrame:
    """(key, metric, value) rows of a table of rates; null values stay."""
    return rate_rows.unpivot([key], [c for c in rate_rows.columns if c != key], "metric", "value")


def violations(metrics: DataFrame, thresholds: DataFrame, key: str = "split") -> DataFrame:
    """Gates that fail: ``least`` or ``most`` passed, or no value to hold against them."""
    held = thresholds.join(metrics, [key, "metric"], "left")
    missing, under, over = F.col("value").isNull(), F.col("value") < F.col("least"), F.col("value") > F.col("most")
    why = F.when(missing, "no sample").when(F.coalesce(under, F.lit(False)), "below minimum").when(F.coalesce(over, F.lit(False)), "above maximum")
    return held.withColumn("violation", why).where("violation is not null").select(key, "metric", "value", "violation")


@F.arrow_udf(DoubleType())
def next_after(x: pa.Array) -> pa.Array:
    """The least double above each value."""
    values = np.nextafter(x.fill_null(0.0).to_numpy(zero_copy_only=False), np.inf)
    return pa.array(values, pa.float64(), mask=np.asarray(x.is_null()))


def calibrate(samples: DataFrame, ceiling: float) -> DataFrame:
    """The threshold of the best recall whose false-positive rate is within the ceiling: ``threshold``, ``recall``, ``false_positive``.

    samples: ``score`` in [0, 1] or null (an error), boolean ``label``.  A score
    at or above the threshold is positive; ties in recall go to the larger
    threshold.  Benign errors count as false positives, attack errors never earn
    recall.  Counts are summed by score and ordered by range partitions; nothing
    passes through one task.
    """
    per = samples.where("score is not null").groupBy("score").agg(F.count_if("label").alias("a"), F.count_if(~F.col("label")).alias("b"))
    attacks, benigns, errors = samples.agg(F.count_if("label"), F.count_if(~F.col("label")), F.count_if(F.col("score").isNull() & ~F.col("label"))).first()
    above = samples.sparkSession.range(1).select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    nexts = per.select(next_after("score").alias("score"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).where("score <= 1")
    points = per.union(above).union(nexts).groupBy("score").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = best_threshold(points, attacks, benigns, errors, ceiling)
    rate = lambda k, n: ratio(k, F.lit(n))
    return best.select("threshold", rate(F.col("tp"), attacks).alias("recall"), rate(F.col("fp") + errors, benigns).alias("false_positive"))


def hash_split(key: Column, holdout_percent: int = 30) -> Column:
    """dev or holdout by the first 8 hex digits of a hash."""
    bucket = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < holdout_percent, "holdout").otherwise("dev")


def leakage(rows: DataFrame, fields: list[str], split: str = "split") -> DataFrame:
    """Values that stand in more than one split: ``field``, ``value``, ``splits``."""
    values = rows.select(split, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select(split, "x.*")
    return values.where("value is not null").groupBy("field", "value").agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def condition_summary(records: DataFrame) -> DataFrame:
    """records: ``case_id``, ``condition``, ``status``, ``task_success``, ``attack_success``.

    Rates are over valid cases, with their intervals; lower bounds are over all.
    """
    ok, every = F.col("status") == "ok", F.count(F.lit(1))
    n, tasks, attacks = F.count_if(ok), F.count_if(ok & F.col("task_success")), F.count_if(ok & F.col("attack_success"))
    (low, high), (attack_low, attack_high) = wilson(tasks, n), wilson(attacks, n)
    return records.groupBy("condition").agg(
        every.alias("cases"), n.alias("valid"), F.count_if(~ok).alias("errors"), ratio(tasks, n).alias("task_rate"), ratio(attacks, n).alias("attack_rate"),
        ratio(tasks, every).alias("task_least"), low.alias("task_low"), high.alias("task_high"),
        ratio(attacks, every).alias("attack_least"), attack_low.alias("attack_low"), attack_high.alias("attack_high"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """One row: ``total``, ``scored``, ``unknown``, ``errors`` of records (``decision``, ``scan_complete``, ``error_type``)."""
    done = F.coalesce(F.col("scan_complete"), F.lit(False)) & F.col("error_type").isNull()
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("scored"), F.count_if(~done).alias("unknown"), F.count_if(F.col("error_type").isNotNull()).alias("errors"))


def case_lists(records: DataFrame, key: str = "ordinal") -> DataFrame:
    """``list``, ``key`` of cases that a report names: missed, unknown, false_positive, false_block."""
    done = F.coalesce(F.col("scan_complete"), F.lit(False)) & F.col("decision").isNotNull() & (F.col("decision") != "unknown")
    kinds = F.array(
        F.when(~done, "unknown"), F.when(done & _is("attack") & (F.col("decision") == "accept"), "missed"),
        F.when(done & _is("benign") & (F.col("decision") != "accept"), "false_positive"), F.when(done & _is("benign") & (F.col("decision") == "reject"), "false_block"),
    )
    return records.select(F.explode(F.array_compact(kinds)).alias("list"), key)


def groups_per_split(entries: DataFrame, group: str = "split_group", split: str = "split") -> DataFrame:
    return entries.groupBy(split).agg(F.count_distinct(group).alias("groups"), F.count(F.lit(1)).alias("entries"))


def state_counts(records: DataFrame, arm: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """Cases of each arm in each of the stated execution states."""
    return records.groupBy(arm).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def error_counts(records: DataFrame, error: str = "error_type") -> DataFrame:
    return records.where(F.col(error).isNotNull()).groupBy(error).agg(F.count(F.lit(1)).alias("n"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes over jointly valid pairs; a case without its partner raises."""
    side = lambda df, s: df.select("case_id", "condition", *(F.col(c).alias(c + s) for c in ("status", "task_success", "attack_success")))
    both = side(before, "_b").join(side(after, "_a"), ["case_id", "condition"], "full")
    matched = F.when(F.col("status_b").isNull() | F.col("status_a").isNull(), F.raise_error(F.lit("unpaired case"))).otherwise((F.col("status_b") == "ok") & (F.col("status_a") == "ok"))
    valid = both.withColumn("valid", matched.cast("boolean")).where("valid")
    count = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return valid.groupBy("condition").agg(
        F.count(F.lit(1)).alias("pairs"), count("task_success_b and not task_success_a", "successes_lost"), count("task_success_a and not task_success_b", "successes_gained"),
        count("attack_success_b and not attack_success_a", "attacks_prevented"), count("attack_success_a and not attack_success_b", "attacks_gained"),
    )


def mode_summary(scores: DataFrame, threshold: float) -> DataFrame:
    """Rules, model and either, side by side: counters of scored rows (``rule_decision``, ``score``, ``label``), rates over all, their upper bounds."""
    rule = F.col("rule_decision") != "accept"
    model = F.when(F.col("score").isNotNull(), F.col("score") >= threshold)
    modes = F.array(*(F.struct(F.lit(k).alias("mode"), v.alias("flagged")) for k, v in (("rules", rule), ("model", model), ("combined", F.when(rule, True).otherwise(model)))))
    rows = scores.select("label", F.explode(modes).alias("m")).select("label", "m.*")
    hit = lambda label: F.count_if(_is(label) & F.col("flagged"))
    most = lambda label: F.count_if(_is(label) & F.coalesce("flagged", F.lit(True)))
    attacks, benigns = F.count_if(_is("attack")), F.count_if(_is("benign"))
    return rows.groupBy("mode").agg(
        hit("attack").alias("tp"), hit("benign").alias("fp"), F.count_if(F.col("flagged").isNull()).alias("withheld"), ratio(hit("attack"), attacks).alias("detection"),
        ratio(hit("benign"), benigns).alias("false_positive"), ratio(most("attack"), attacks).alias("detection_most"), ratio(most("benign"), benigns).alias("false_positive_most"),
    )


def shared_word_components(items: DataFrame) -> DataFrame:
    """items (``item``, ``words``): ``item``, ``component`` (least item reachable over shared words)."""
    return of_shared(items.select("item", F.explode_outer("words").alias("word")), "item", "word")
