"""Models as columns: detectors and embedders run in Arrow batches, fail closed."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.operators.child import START_SECONDS, Child, Failed, Late

MAX_DOCUMENTS, MAX_CHARS, MAX_TOTAL = 100, 20_000, 200_000
MAX_NAME = 256
_ANSWER = "struct<score: double, status: string, input_tokens: bigint, output_tokens: bigint, cost_usd: double>"


def within_budget(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_CHARS, max_total: int = MAX_TOTAL) -> None:
    """Raise before any call where documents, a document's characters, or all characters are too many."""
    size = F.coalesce(F.length("text"), F.lit(0))
    n, longest, total = docs.agg(F.count(F.lit(1)), F.max(size), F.sum(size)).first()
    if n > max_documents or (longest or 0) > max_chars or (total or 0) > max_total:
        raise ValueError(f"detector budget exceeded: {n} documents, longest {longest}, total {total}")


@dataclass(frozen=True)
class Detector:
    """A model: ``load`` makes the scoring function once per worker; what it gives back is checked.

    A score is a number, or an ``Answer`` that also tells what it cost.  seconds:
    a batch that takes longer is an error (None: no limit, and no process of its
    own): the model then runs in a child of the worker, which is killed when it
    is late and started anew for the next batch; loading has ``start_seconds``.
    max_tokens and count: texts of more tokens are errors, as nothing is cut.
    Provenance and calibration hashes go with every run.
    """

    load: Callable[[], Callable[[list[str]], list]]
    model: str = "unnamed"
    adapter: str = "function"
    revision: str = "none"
    config_sha256: str = "0" * 64
    calibration_sha256: str = "0" * 64
    seconds: float | None = None
    max_tokens: int | None = None
    count: Callable[[str], int] | None = None
    start_seconds: float = START_SECONDS

    def __post_init__(self):
        if not all(isinstance(x, str) and 1 <= len(x) <= MAX_NAME for x in (self.model, self.adapter, self.revision)):
            raise ValueError(f"names of the model, its adapter and its revision must have 1 to {MAX_NAME} characters")
        if not all(re.fullmatch("[0-9a-f]{64}", x) for x in (self.config_sha256, self.calibration_sha256)):
            raise ValueError("hashes must be 64 hex digits")
        if not all(math.isfinite(x) and x > 0 for x in (self.seconds, self.start_seconds) if x is not None):
            raise ValueError("seconds must be positive")
        if (self.max_tokens is None) != (self.count is None):
            raise ValueError("a token limit needs a way to count tokens")


def by_length(texts: list[str]) -> list[float]:
    """A stand-in for a model, which the box has none of: scores that tests can state."""
    return [len(t) % 97 / 96 for t in texts]


@dataclass(frozen=True)
class Answer:
    """A score in [0, 1], and what it cost where the model tells."""

    score: float
    input_tokens: int | None = None
    output_tokens: int | None = None
    cost_usd: float | None = None


def _number(x, most: float = math.inf) -> bool:
    """A number from 0 to ``most``, neither a truth value nor NaN nor infinite."""
    return not isinstance(x, bool) and isinstance(x, int | float) and 0 <= x <= min(most, 1e300)


def _valid(answer) -> bool:
    if not isinstance(answer, Answer):
        return _number(answer, 1)
    tokens = (answer.input_tokens, answer.output_tokens)
    return _number(answer.score, 1) and all(n is None or (type(n) is int and 0 <= n < 2**63) for n in tokens) and (answer.cost_usd is None or _number(answer.cost_usd))


def _answers(detector: Detector, detect, texts: list[str]) -> tuple[list[Answer], list[str]]:
    """Answers and statuses of a batch: a batch that raises, is late or answers badly is an error for all its rows."""
    fits = [detector.max_tokens is None or detector.count(t) <= detector.max_tokens for t in texts]
    asked = [t for t, ok in zip(texts, fits, strict=True) if ok]
    try:
        got = list(detect(asked)) if asked else []
        fine, why = len(got) == len(asked) and all(map(_valid, got)), "bad_answer"
    except Late:
        fine, why = False, "timeout"
    except Failed as e:
        fine, why = False, str(e)
    except Exception as e:  # a model may raise anything; the rows stay unknown, and its words stay out
        fine, why = False, type(e).__name__
    none = Answer(None)
    given = iter([x if isinstance(x, Answer) else Answer(x) for x in got] if fine else [none] * len(asked))
    return [next(given) if ok else none for ok in fits], ["too_long" if not ok else "ok" if fine else why for ok in fits]


def run_detector(docs: DataFrame, detector: Detector | Callable, max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_CHARS, max_total: int = MAX_TOTAL) -> DataFrame:
    """``ordinal``, ``score``, ``status`` (ok, or the kind of error), tokens and cost where told, ``model``, ``adapter``, ``revision``.

    The budgets are held to before anything is scored; beyond them this raises.
    """
    within_budget(docs, max_documents, max_chars, max_total)
    made = detector if isinstance(detector, Detector) else Detector(lambda: detector)

    def rows_of(detect, texts: pa.Array) -> pa.Array:
        answers, status = _answers(made, detect, [t or "" for t in texts.to_pylist()])
        as_double = lambda x: None if x is None else float(x)
        columns = [pa.array([as_double(a.score) for a in answers], pa.float64()), pa.array(status, pa.string())]
        columns += [pa.array([a.input_tokens for a in answers], pa.int64()), pa.array([a.output_tokens for a in answers], pa.int64()), pa.array([as_double(a.cost_usd) for a in answers], pa.float64())]
        return pa.StructArray.from_arrays(columns, ["score", "status", "input_tokens", "output_tokens", "cost_usd"])

    @F.arrow_udf(_ANSWER)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if made.seconds is None:
            detect = made.load()
            for texts in batches:
                yield rows_of(detect, texts)
        else:
            with closing(Child(made.load, made.seconds, made.start_seconds)) as child:
                for texts in batches:
                    yield rows_of(child, texts)

    return docs.select("ordinal", score("text").alias("r")).select("ordinal", "r.*", F.lit(made.model).alias("model"), F.lit(made.adapter).alias("adapter"), F.lit(made.revision).alias("revision"))


def score_records(entries: DataFrame, decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """One record per entry: what rules decided and what the model scored; errors stay unknown."""
    rules = decisions.select("ordinal", F.col("decision").alias("rule_decision"), F.col("families").alias("rule_families"), F.col("scan_complete").alias("rule_scan_complete"))
    model = scores.select("ordinal", "score", "status", F.when(F.col("status") != "ok", F.col("status")).alias("error_type"))
    own = entries.select("ordinal", "label", "category", "split", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).alias("input_chars"))
    return own.join(rules, "ordinal", "left").join(model, "ordinal", "left")


def detector_findings(scores: DataFrame, threshold: float, severity: str = "high", places: int | None = None) -> DataFrame:
    """Findings of scored documents; an error is an incomplete scan.  places: of scores in evidence, else six digits."""
    bad = F.col("status") != "ok"
    hit = scores.where(bad | (F.col("score") >= threshold))
    pick = lambda a, b: F.when(bad, a).otherwise(b)
    return hit.select(
        "ordinal", F.col("ordinal").cast("string").alias("document_id"), pick("scan_incomplete", "prompt_injection_in_document").alias("finding_type"), pick("high", severity).alias("severity"),
        pick("scan_incomplete", "semantic_prompt_injection").alias("family"), pick("", "LLM01").alias("owasp"),
        pick(F.concat(F.lit("detector_"), F.col("status")), F.concat(F.lit("[semantic detector] score="), F.format_string("%.6g" if places is None else f"%.{places}f", "score"))).alias("evidence"), pick("coverage-limit", "model-assessed").alias("confidence"),
        F.lit(None).cast("string").alias("metadata_path"), F.array("ordinal").alias("related"), F.lit(2000).alias("seq"),
    )


def embed(docs: DataFrame, function: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Add ``fresh``: vectors of texts, made batch by batch."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(function([t.as_py() or "" for t in texts]), pa.list_(pa.float64()))

    return docs.withColumn("fresh", run("text"))
