"""What Python workers hold: small batches of whole tables."""

import json
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from sluicegate.functions import surfaces
from sluicegate.functions.batches import BATCH_BYTES, BATCH_ROWS
from sluicegate.functions.surfaces import SURFACES, Limits, surfaces_of, with_surfaces
from sluicegate.operators import scan
from sluicegate.plans import catalog

KEYS = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]


def test_surfaces_are_made_in_small_batches(spark):
    @F.arrow_udf("long")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int64())

    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([sum(map(len, texts.to_pylist()))] * len(texts), pa.int64())

    try:
        for k in KEYS:
            spark.conf.unset(k)
        long = spark.range(0, 6000, 1, 1).select("id", F.when(F.col("id") < 400, F.repeat(F.lit("&amp; x "), 5000)).otherwise("1a").alias("text"))
        made = with_surfaces(long)
        most = made.select(F.max(rows("text")), F.max(size("text"))).first()
        assert most[0] <= BATCH_ROWS and most[1] <= BATCH_BYTES + 40000
        assert made.where(F.length("surfaces.canonical") == F.when(F.col("id") < 400, 20000).otherwise(2)).count() == 6000
        spark.conf.set(KEYS[0], 7)  # a caller's smaller batches stay
        with_surfaces(long)
        assert spark.conf.get(KEYS[0]) == "7"
    finally:
        for k in KEYS:
            spark.conf.unset(k)


def test_evidence_reads_a_whole_table_in_small_batches(spark, tmp_path, monkeypatch):
    """Workers note what they are given: no batch of finding_evidence grows with the table, and every row comes once."""
    notes = tmp_path / "notes"
    notes.mkdir()

    def noting(limits):
        @F.arrow_udf(SURFACES)
        def run(texts: pa.Array) -> pa.Array:
            (notes / uuid.uuid4().hex).write_text(str(len(texts)))
            return surfaces_of(texts.to_pylist(), limits)

        return run

    monkeypatch.setattr(surfaces, "_surfaces", noting)
    n = 2500 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.lit("w0rd").alias("text"), F.lit("en").alias("lang"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    try:
        for k in KEYS:
            spark.conf.unset(k)
        found = catalog.queries()["finding_evidence"](spark, str(tmp_path))
        assert found.select("ordinal").distinct().count() == n // 8 * 7  # one ending of eight has nothing
        given = [int(f.read_text()) for f in notes.iterdir()]
        assert max(given) <= BATCH_ROWS and sum(given) == n
    finally:
        for k in KEYS:
            spark.conf.unset(k)


def test_leaves_come_in_bounded_batches_from_one_worker(spark):
    """Objects of many or long leaves, one beyond a limit, one that can't be read and one without leaves: every leaf once, in order."""
    objects = [json.dumps({f"k{k}": k for k in range(9000)}), json.dumps({"long": ["x " * 150_000] * 3}), "{", None, json.dumps(list(range(20_000))), json.dumps({"password": "blue"})]
    ids = list(range(len(objects)))
    source = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(map(str, ids)), pa.array(objects, pa.string())], ["ordinal", "document_id", "metadata"])
    made = list(scan._leaves(Limits())(iter([source])))
    assert all(b.num_rows <= scan.LEAVES + 1 and sum(len(x or "") for x in b.column("text").to_pylist()) <= scan.LEAF_CHARS + 300_010 for b in made)
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["ordinal"], r["reason"]) for r in rows if r["reason"]] == [(2, "metadata_unreadable"), (4, "metadata_node_limit")]
    assert [r["text"] for r in rows if r["ordinal"] == 0] == [f"k{k}: {k}" for k in range(9000)] and sum(r["ordinal"] == 4 for r in rows) == 10_000

    docs = spark.createDataFrame(list(zip(ids, objects, strict=True)), "ordinal long, metadata string").select("ordinal", F.col("ordinal").cast("string").alias("id"), F.lit("").alias("text"), "metadata")
    found = scan.scan_documents(docs, injection=False, splits=False)
    assert sorted((r.ordinal, r.family, r.metadata_path, r.evidence, r.seq < 0) for r in found.collect()) == [
        (2, "scan_incomplete", None, "metadata_unreadable", True), (4, "scan_incomplete", None, "metadata_node_limit", True), (5, "metadata_credential_leak", "/password", scan.T.REDACTED_METADATA, False),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
