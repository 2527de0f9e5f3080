"""Scores with a deadline: late models are killed, broken ones stay errors, answers are checked."""

import os
import signal
import time

import pytest

from sluicegate.operators import child
from sluicegate.operators import detectors as D


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "ordinal long, text string").coalesce(1)


def gone(pid):
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return True
    return False


def test_a_scorer_that_never_returns_leaves_no_process(spark, tmp_path):
    def load():
        with open(f"{tmp_path}/{os.getpid()}", "w"):
            pass
        signal.signal(signal.SIGTERM, signal.SIG_IGN)

        def score(texts):
            while "stay" in texts[0]:
                time.sleep(0.1)
            if texts[0] == "die":
                os._exit(3)
            return [0.25] * len(texts)

        return score

    rows = table(spark, "a", "stay", "b", "die", "c")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        began = time.time()
        got = sorted(D.run_detector(rows, D.Detector(load, seconds=1.0)).collect())  # a sort of Spark's would score twice
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.score, r.status) for r in got] == [(0.25, "ok"), (None, "timeout"), (0.25, "ok"), (None, "ChildDied"), (0.25, "ok")]
    pids = [int(p) for p in os.listdir(tmp_path)]
    assert len(pids) == 3 and all(map(gone, pids)) and time.time() - began < 90


def test_a_child_alone():
    with pytest.raises(child.Failed, match="ZeroDivisionError"):
        child.Child(lambda: 1 / 0, 1.0)(["a"])
    with pytest.raises(child.Late):
        child.Child(lambda: time.sleep(60), 1.0, 0.5)(["a"])
    one = child.Child(lambda: lambda texts: [len(t) for t in texts] if texts != ["x"] else (k for k in texts), 5.0)
    assert one(["ab", "c"]) == [2, 1]
    pid = one.process.pid
    assert one(["x"]) is None and one(["abc"]) == [3] and one.process.pid == pid  # an answer that can't be sent is none
    one.close()
    one.close()
    assert gone(pid)


def test_answers_tell_what_they_cost(spark):
    def statuses(*answers, **more):
        return [(r.status, r.input_tokens, r.output_tokens, r.cost_usd) for r in D.run_detector(table(spark, *"ab"[: len(answers)]), D.Detector(lambda: lambda texts: list(answers), **more)).orderBy("ordinal").collect()]

    assert statuses(D.Answer(0.5, 3, 0, 0.01), 1) == [("ok", 3, 0, 0.01), ("ok", None, None, None)]
    assert statuses(D.Answer(0.5, 3, cost_usd=2), seconds=20.0) == [("ok", 3, None, 2.0)]
    bad = [(D.Answer(1.5),), (D.Answer(None),), (D.Answer(0.5, -1),), (D.Answer(0.5, True),), (D.Answer(0.5, 1.0),), (D.Answer(0.5, 2**63),), (D.Answer(0.5, cost_usd=float("nan")),), (D.Answer(0.5, cost_usd=-1),), (float("inf"),), (None,), (10**400,)]
    assert all(statuses(*answers) == [("bad_answer", None, None, None)] for answers in bad)
    for field in ("model", "adapter", "revision"):
        for name in ("", "x" * 257):
            with pytest.raises(ValueError):
                D.Detector(lambda: None, **{field: name})
    with pytest.raises(ValueError):
        D.Detector(lambda: None, seconds=0)
