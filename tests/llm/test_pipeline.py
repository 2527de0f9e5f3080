"""Stages of the corpus pipeline on awkward documents."""

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from sluicegate.llm import jaccard

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_near_copies_leave_one_of_each_group(spark, docs):
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0)], docs.schema)
    table = docs.union(extra).union(docs.limit(3))
    kept = C.drop_near_copies(spark, table, SF)
    groups = {r.component_id for r in jaccard.join(table).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(groups) and kept.columns == docs.columns


def test_near_copies_decide_by_row(spark, docs):
    copy = "the very same words stand in this text and in its copies too"
    other, third = "an unlinked text of quite different words that stays as it is", "yet another text that shares nothing with those two above it"
    rows = [(1, copy), (5, copy), (5, other), (5, other), (7, third), (7, copy), (None, "null ids have copies as well as others have them"), (None, "null ids have copies as well as others have them"), (None, "null ids have copies as well as others have them"), (None, third), (9, None), (9, None), (9, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in C.drop_near_copies(spark, table, SF).collect()))
    assert kept == sorted([(1, copy), (5, other), (7, third), (0, rows[6][1]), (9, ""), (9, ""), (9, "")])
    assert C.drop_near_copies(spark, table.limit(0), SF).count() == 0


def test_masking_touches_only_secrets(spark, docs):
    table = docs.limit(5).union(spark.createDataFrame([(9003, 'x secret = "abcdefgh" y', "en", "s", 23)], docs.schema))
    got = {r.doc_id: r for r in C.mask_secrets(spark, table, SF).collect()}
    assert got[9003].text == "x [REDACTED]\" y" and got[9003].n_chars == len(got[9003].text) and len(got) == 6


def test_filters_and_run(spark, docs):
    kept = C.drop_undetermined(spark, docs.union(spark.createDataFrame([(9004, "123", "en", "s", 3), (9005, "это русский текст", None, "s", 17), (9006, "qxjk wvbz kqxz", None, "s", 14)], docs.schema)), SF)
    assert kept.where("doc_id between 9004 and 9006").count() == 0 and kept.count() >= 0.98 * docs.count() and kept.columns == docs.columns
    assert [n for n, _ in C.STAGES] == ["toxicity", "language", "near_copies", "secrets", "packing"]
    out = C.run(spark, SF).toPandas()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = docs
    for _, stage in C.STAGES[:-1]:
        last = stage(spark, last, SF)
    texts = {r.doc_id: r.text for r in last.collect()}
    assert set(out.doc_id) == set(texts) and 0 < len(texts) < docs.count()
    for i, own in out.sort_values("piece").groupby("doc_id"):
        assert np.concatenate(own.ids.to_list()).tolist() == [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == list(np.cumsum(own.length) - own.length) and own.length.sum() <= 1024


CLASHING = ["id", "blob_id", "spans", "_blob", "_hit", "hit", "masked", "score", "ratio", "bits", "lang_pred", "_key", "node", "h", "c0", "c1", "label", "sequence_id"]


def test_stages_keep_clashing_columns(spark, docs):
    secret = spark.createDataFrame([(9003, 'the secret = "abcdefgh" is in the house of the city and the water', "en", "s", 23), (9007, None, "en", "s", None)], docs.schema)
    table = docs.limit(40).union(secret)
    table = table.select(*(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING[:9]), "*", *(F.struct(F.col("doc_id").alias("x")).alias(c) for c in CLASHING[9:]))
    given = {r.doc_id: r for r in table.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, table, SF)
        rows = out.collect()
        assert out.columns == table.columns and len(rows) >= 25, name
        for r in rows:
            assert all(r[c] == given[r.doc_id][c] for c in [*CLASHING, "lang", "source"]), name
            assert name == "secrets" or r.text == given[r.doc_id].text
        assert stage(spark, table.limit(0), SF).count() == 0
    assert C.pack(spark, table, SF).count() >= len(given)
