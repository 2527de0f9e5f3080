"""A training-corpus pipeline of five stages over ``documents``.

Toxic documents go; documents of no determinable language go; of each group of
near copies the document of the least id stays; secrets are masked; what is left
is packed into sequences.  Each stage is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm import jaccard, language, packing, secrets, toxicity
from sluicegate.llm.common import as_table, fold, read

#: A document whose best language has less than this share of certainty, against other languages and plain bytes, is rejected.
LEAST_CERTAINTY = 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by position, so that no name of a stage clashes with one of theirs, and what each is called."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 stay, null and empty texts too; repeated rows fare alike; an empty table stays empty."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"), train_rows=fold("doc_id", 5) != 0)
    rows, at = numbered(docs)
    scored = toxicity.score(rows, model, id_col=at["doc_id"], text_col=at["text"], keep=rows.columns, with_ratio=False)
    return scored.where("score < 0.5").select(rows.columns).toDF(*docs.columns)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain stay; null texts, texts without a letter and texts that plain bytes explain better go; repeated rows fare alike."""
    model = language.fit(docs.select("doc_id", "text", "lang"), train_rows=fold("doc_id", 4) != 2)
    rows, at = numbered(docs)
    told = language.identify(rows, model, id_col=at["doc_id"], text_col=at["text"], keep=rows.columns)
    return told.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_CERTAINTY)).select(rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: see ``jaccard.one_of_each`` for nulls, repeats and ties."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with its secrets masked and ``n_chars`` renewed where something was; null texts stay null; rows of one id are told apart by their texts."""
    versions, ledger = secrets.scan(docs)
    found = secrets.by_path(versions, ledger).where(F.size("spans") > 0).dropDuplicates(["id", "blob_id"])
    rows, at = numbered(docs)
    text, size = F.col(at["text"]), F.col(at["n_chars"])
    same = F.col(at["doc_id"]).eqNullSafe(F.col("id")) & (secrets.blob_id(text) == F.col("blob_id"))
    masked = F.when(F.col("spans").isNotNull(), secrets.redact(text, F.col("spans"))).otherwise(text)
    out = rows.join(found, same, "left").select(*rows.columns, F.col("spans").isNotNull().alias("hit"), masked.alias("masked"))
    renewed = {at["text"]: F.col("masked"), at["n_chars"]: F.when(F.col("hit"), F.length("masked").cast("long")).otherwise(size)}
    return out.select(*(renewed.get(c, F.col(c)).alias(c) for c in rows.columns)).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every row with its ``ids``, repeated rows and null texts (the end id alone) included; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The classifiers and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the input of the next; the last one returns every piece, its ids and its place."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = as_table(docs)
    return docs
