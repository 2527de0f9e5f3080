"""Gates, samples that keep origins together, canonical JSON and digests of nested values."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sluicegate.functions.canonical import canonical_json, canonical_row
from sluicegate.operators import gates, sampling
from sluicegate.sources import corpora


def dumps(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_canonical_json_equals_python(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(8 if depth < 4 else 6)
        if kind == 6:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 7:
            return {"".join(rng.choice("abé漢😀￮/~\"\\\n ") for _ in range(rng.randrange(4))): value(depth + 1) for _ in range(rng.randrange(5))}
        return [None, True, rng.randrange(-5, 10**rng.randrange(1, 25)), rng.choice([1.0, 0.1, 1e22, 1e-7, -0.0, 1e16, 123456.75]), "é\u001f\x7f <b>", "plain 12.5"][kind]

    values = [value(0) for _ in range(400)]
    written = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    more = {'{"a":1,"a":2}': '{"a":2}', "": None, "{": None, "NaN": None, "[1e999]": None, '"\\ud800"': None, "-0": "0", "1.50": "1.5", "[" * 100_000: None, "9" * 5000: None, ' "x" ': '"x"'}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*written, *more, None])], "k int, t string").repartition(3)
    got = [r.c for r in rows.select("k", canonical_json(F.col("t")).alias("c")).orderBy("k").collect()]
    assert got == [*map(dumps, values), *more.values(), None]


def test_rows_with_nested_values(spark):
    rows = spark.createDataFrame([(1, 'a"\u001f', '{"b": 1.0, "a": [null]}'), (2, None, None)], "id int, text string, metadata string")
    got = [r.c for r in rows.select(canonical_row(["text", "id", "metadata"], ("metadata",)).alias("c")).collect()]
    assert got == [dumps({"id": 1, "text": 'a"\u001f', "metadata": {"a": [None], "b": 1.0}}), dumps({"id": 2, "text": None, "metadata": None})]
    other = spark.createDataFrame([(2, None, "null"), (1, 'a"\u001f', '{"a":[null],"b":1.0}')], "id int, text string, metadata string")
    a, b = (corpora.digest(x, ["id", "text"], ("metadata",)).first() for x in (rows, other))
    assert a == b and a["n"] == 2
    changed = other.withColumn("metadata", F.lit('{"a":[null],"b":1}'))
    assert corpora.digest(changed, ["id", "text"], ("metadata",)).first() != a
    settings = {"seed": 7, "system": "é"}
    assert corpora.revision(rows, ["id", "text"], settings, ("metadata",)) == corpora.revision(other, ["id", "text"], settings, ("metadata",)) != corpora.revision(other, ["id", "text"], {**settings, "seed": 8}, ("metadata",))
    with pytest.raises(Exception, match="not JSON"):
        corpora.digest(other.withColumn("metadata", F.lit("{")), ["id"], ("metadata",)).collect()


@pytest.mark.parametrize("limit", [0, 1, 7, 40, 333, 5000])
def test_samples_keep_origins_together(spark, limit):
    rng = random.Random(limit)
    rows = [(k, rng.choice(["dev", "holdout", None]), "s", None if rng.random() < 0.05 else f"o{0 if rng.random() < 0.3 else rng.randrange(300)}") for k in range(2000)]
    table = spark.createDataFrame(rows, "id int, split string, source_id string, origin_id string").repartition(3)
    for whole in (True, False):
        want = []
        for split in ("dev", "holdout", None):
            own = sorted((hashlib.sha256(dumps(["x", s, o]).encode()).hexdigest(), k) for k, p, s, o in rows if p == split)
            if whole and limit:
                cut = own[: limit + 1]
                own = own[:limit] if len(own) <= limit else [x for x in own[:limit] if x[0] != cut[-1][0]]
            want += [k for _, k in (own[:limit] if limit else own)]
        got = sampling.paired_sample(table, limit, "x", whole=whole)
        assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == table.columns
    if limit:
        placed = sampling.hash_sample(table.where("split = 'dev'"), limit)
        first = sorted((hashlib.sha256(str(k).encode()).hexdigest(), k) for k, p, _, _ in rows if p == "dev")[:limit]
        assert {(r.id, r.place) for r in placed.collect()} == {(k, n) for n, (_, k) in enumerate(first, 1)}


def test_samples_of_nothing(spark):
    none = spark.createDataFrame([], "id int, split string, source_id string, origin_id string")
    assert sampling.paired_sample(none, 5, "x").count() == 0 and sampling.hash_sample(none, 5).count() == 0
    with pytest.raises(ValueError):
        sampling.paired_sample(none, -1, "x")


RECORDS = "label string, category string, split string, decision string, scan_complete boolean, latency_ms double"


def violations(records, told):
    return {(r.gate, r.split, r.category, r.violation) for r in gates.check(records, told).collect()}


def test_gates(spark):
    rows = [("attack", "a", "dev", "reject", True, 5.0), ("attack", "a", "dev", "accept", True, 50.0), ("benign", "b", "dev", "review", True, 1.0), ("benign", "b", "dev", "accept", True, None)]
    records = spark.createDataFrame(rows, RECORDS)
    assert violations(records, {}) == violations(records, {"_remark": 1, "min_attack_detection_rate": {"dev": 0.5, "all": 0.5, "holdout": 1}, "max_benign_false_positive_rate": {"dev": 0.5}, "max_p95_latency_ms": 50}) == set()
    told = {"min_attack_detection_rate": {"all": 0.51}, "min_attack_block_rate": {"dev": 1}, "max_benign_false_positive_rate": {"dev": 0.4}, "max_benign_false_block_rate": {"dev": 0}, "max_p95_latency_ms": 49.5,
            "min_category_detection_rate": {"dev": {"a": 0.6, "b": 0.1}, "holdout": {"a": 1}}, "max_category_false_positive_rate": {"all": {"b": 0.4}}}
    assert violations(records, told) == {
        ("min_attack_detection_rate", "all", None, "below minimum"), ("min_attack_block_rate", "dev", None, "below minimum"), ("max_benign_false_positive_rate", "dev", None, "above maximum"), ("max_p95_latency_ms", "all", None, "above maximum"),
        ("min_category_detection_rate", "dev", "a", "below minimum"), ("min_category_detection_rate", "dev", "b", "no such category"), ("max_category_false_positive_rate", "all", "b", "above maximum"),
    }
    only_benign = records.where("label = 'benign'").withColumn("scan_complete", F.col("decision") != "review")
    assert violations(only_benign, {"min_attack_detection_rate": {"dev": 0.1}}) == {("coverage", "all", None, "unknown cases"), ("min_attack_detection_rate", "dev", None, "no sample")}
    assert violations(records.limit(0), told) == {("max_p95_latency_ms", "all", None, "no sample")}


def test_malformed_gates(spark):
    records = spark.createDataFrame([], RECORDS)
    told = {
        "min_detection": 1, "min_attack_detection_rate": 0.5, "min_attack_block_rate": {"test": 0.5, "dev": 1.01}, "max_benign_false_positive_rate": {"dev": True}, "max_benign_false_block_rate": {"dev": math.nan},
        "min_category_detection_rate": {"dev": {"": 0.5}}, "max_category_false_positive_rate": {"dev": 0.5}, "max_p95_latency_ms": -1,
    }
    assert {x[:2] + x[3:] for x in violations(records, told)} == {
        ("min_detection", None, "unknown gate"), ("min_attack_detection_rate", None, "not by split"), ("min_attack_block_rate", "test", "unknown split"), ("min_attack_block_rate", "dev", "not a rate"),
        ("max_benign_false_positive_rate", "dev", "not a rate"), ("max_benign_false_block_rate", "dev", "not a rate"), ("min_category_detection_rate", "dev", "not rates by category"),
        ("max_category_false_positive_rate", "dev", "not rates by category"), ("max_p95_latency_ms", None, "not a bound"),
    }
    assert violations(records, [1]) == {("gates", None, None, "not an object")} and violations(records, {"max_p95_latency_ms": 10**400})
