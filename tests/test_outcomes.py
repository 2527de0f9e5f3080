"""Outcome artifacts: provenance and record rules, each broken in turn; answers by case folding."""

import json

import pytest
from pyspark.sql import functions as F

from sluicegate.functions import text as T
from sluicegate.sources import corpora

FINE = {
    "schema_version": 2, "benchmark": "b", "benchmark_revision": "r", "model": "m", "model_revision": "v", "seed": 0, "judging_method": "exact", "defense": "none", "generation_config": {"n": 1}, "input_sha256": "0" * 64,
    "records": [
        {"case_id": "1", "condition": "clean", "status": "ok", "task_success": True}, {"case_id": "1", "condition": "attacked", "status": "ok", "task_success": False, "attack_success": True},
        {"case_id": "2", "condition": "clean", "status": "error", "task_success": None},
    ],
}


def test_outcomes(spark, tmp_path):
    (tmp_path / "fine.json").write_text(json.dumps(FINE, indent=1))
    got = {(r.case_id, r.condition, r.status, r.task_success, r.attack_success, r.model, r.defense) for r in corpora.read_outcomes(spark, f"{tmp_path}/fine.json").collect()}
    assert got == {("1", "clean", "ok", True, None, "m", "none"), ("1", "attacked", "ok", False, True, "m", "none"), ("2", "clean", "error", None, None, "m", "none")}
    (tmp_path / "old.json").write_text(json.dumps({**FINE, "schema_version": 1}))
    with pytest.raises(Exception, match="/schema_version"):
        corpora.read_outcomes(spark, f"{tmp_path}/old.json").collect()

    def record(**more):
        return {**FINE, "records": [{**FINE["records"][0], **more}]}

    broken = {
        "/model: not": {**FINE, "model": ""}, "/seed: type": {**FINE, "seed": None}, "/defense: required": {k: v for k, v in FINE.items() if k != "defense"}, "/generation_config: minProperties": {**FINE, "generation_config": {}},
        "/input_sha256: pattern": {**FINE, "input_sha256": "A" * 64}, "/records: minItems": {**FINE, "records": []}, "/records/0: type": {**FINE, "records": [1]}, "/records/0/case_id: minLength": record(case_id=""),
        "/records/0/condition: enum": record(condition="both"), "/records/0/status: enum": record(status="late"), "/records/0/task_success: type": record(task_success=1), "/records/0/attack_success: type": record(attack_success=False),
        "/records/0/attack_success: required": record(condition="attacked"), "/records: duplicate case": {**FINE, "records": [FINE["records"][0]] * 2}, ": not JSON": None,
    }
    rows = spark.createDataFrame([(k, json.dumps(v) if v else '{"schema_version": NaN}') for k, v in broken.items()], "want string, v string")
    for r in rows.select("want", corpora.outcome_problems(F.col("v")).alias("p")).collect():
        assert r.want in r.p, (r.want, r.p)


def test_answers_fold_as_python_does(spark):
    texts = ["  A\tB\x1cC..", "Straße. ", "ΟΔΟΣ", " ﬁ X.", "...", "", None, "a . b", "İ", "x\n.", "ſ"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.f for r in rows.select("k", T.answer_form(F.col("t")).alias("f")).orderBy("k").collect()]
    assert got == [None if t is None else " ".join(t.split()).casefold().rstrip(".") for t in texts]
