"""Reading and checking evaluation corpora, manifests, artifacts and frames."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluicegate.functions.canonical import canonical_row
from sluicegate.sources.shapes import Shape

#: Metadata stays JSON text: it is dynamic and may hold numbers of any size.
ENTRY = "id string, text string, metadata string, label string, category string, split string, notes string, source_id string, origin_id string, split_group string, _bad string"
CHUNK_ENTRY = "id string, chunks array<struct<text: string, metadata: string>>, window_chars int, label string, category string, split string, notes string, _bad string"
OUTCOMES = "schema_version int, benchmark string, benchmark_revision string, model string, model_revision string, seed long, judging_method string, defense string, input_sha256 string, records array<struct<case_id: string, condition: string, status: string, task_success: boolean, attack_success: boolean>>"
FRAME = "protocol int, id string, documents array<struct<text: string, metadata: string>>"


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores.

    A file of one row group is one task's work however many cores wait.  Only a
    table that makes fewer scan tasks than there are cores is exchanged, so what
    is moved is bounded by cores x the size of a split; larger tables stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(cores, rows.columns[0]) if tasks < cores else rows


def documents(rows: DataFrame, order_by: list[str] | None = None, text: str = "text", id_: str | None = "id", metadata: str | None = None, source: str | None = None, ordinal: str | None = None) -> DataFrame:
    """``ordinal``, ``id``, ``text``, ``metadata``, ``source`` from any table of documents.

    The ordinal is a given column, or the place in a stated order, computed by
    range-partitioned counting so that no task holds all rows.
    """
    null = F.lit(None).cast("string")
    pick = lambda c: F.col(c).cast("string") if c else null
    if ordinal:
        number, frame = F.col(ordinal).cast("long"), rows
    else:
        frame = with_ordinal(rows, order_by or [id_])
        number = F.col("_ordinal")
    return frame.select(number.alias("ordinal"), pick(id_).alias("id"), pick(text).alias("text"), pick(metadata).alias("metadata"), pick(source).alias("source"))


def with_ordinal(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """Add ``_ordinal``, 0-based in the given order: sort by range, then add what earlier partitions hold.

    The sorted rows are cut off from their plan once, so that both reads of them see the same partitions.
    """
    from pyspark.sql.window import Window

    from sluicegate.operators.lineage import cut

    placed = cut(rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_part", F.spark_partition_id()))
    per = placed.groupBy("_part").count()
    first = per.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return placed.withColumn("_n", number).join(F.broadcast(first), "_part").withColumn("_ordinal", F.col("_first") + F.col("_n") - 1).drop("_part", "_n", "_first")


def read_entries(spark: SparkSession, paths: list[str], schema: str = ENTRY) -> DataFrame:
    """JSON lines with their file names; blank lines are skipped, bad ones kept in ``_bad``."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(paths).withColumn("file", F.col("_metadata.file_name"))


def entry_problem(chunked: bool = False) -> Column:
    """Why an entry is not valid, or null."""
    body = F.coalesce(F.size("chunks"), F.lit(0)) < 1 if chunked else F.col("text").isNull()
    out = F.when(F.col("_bad").isNotNull(), "not JSON").when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(body, "no content")
    out = out.when(~F.coalesce(F.col("label").isin("attack", "benign"), F.lit(False)), "bad label").when(~F.coalesce(F.col("split").isin("dev", "holdout"), F.lit(False)), "bad split")
    return out.when(F.coalesce(F.col("window_chars"), F.lit(256)) < 1, "bad window") if chunked else out


def checked(entries: DataFrame, chunked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid entries, problems): problems also name ids that stand more than once, over all files."""
    marked = entries.withColumn("problem", entry_problem(chunked))
    twice = entries.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("twice"))
    marked = marked.join(twice, "id", "left").withColumn("problem", F.coalesce("problem", "twice")).drop("twice")
    return marked.where("problem is null").drop("problem", "_bad"), marked.where("problem is not null").select("file", "id", "problem")


def digest(rows: DataFrame, columns: list[str], nested: tuple[str, ...] = ()) -> DataFrame:
    """One row: count and an order-free SHA-256 of canonical rows, whatever their number.

    nested: columns that hold JSON, which counts by what it says, not by how it is
    written; null of it is JSON null, and what is not JSON raises when it is read.

    All 240 bits of a row's hash but the first 8 and last 8 are summed, in four
    parts, by its first hex digits; the ordered sums are hashed: no task holds all rows.
    """
    if nested:
        said = F.coalesce(canonical_row(sorted({*columns, *nested}), nested), F.raise_error(F.lit("a nested column is not JSON")).cast("string"))
    else:
        said = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    row = F.sha2(said, 256)
    parts = [F.sum(F.conv(F.substring("r", 3 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    buckets = rows.select(row.alias("r")).groupBy(F.substring("r", 1, 2).alias("b")).agg(F.concat_ws("-", *parts).alias("s"), F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "b", "s", F.col("n").cast("string"))))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(listed, ","), 256).alias("sha256"))


def revision(cases: DataFrame, columns: list[str], settings: dict, nested: tuple[str, ...] = ()) -> str:
    """One SHA-256 that changes with any case and any setting (prompts, seeds, budgets) of a benchmark."""
    told = digest(cases, columns, nested).first()
    whole = json.dumps({"cases": {"n": told["n"], "sha256": told["sha256"]}, "settings": settings}, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(whole.encode()).hexdigest()


#: What a manifest says of where a corpus comes from.
_PROVENANCE = ("kind", "source", "license", "collection_method")


def verify_manifest(entries: DataFrame, manifest: dict, columns: list[str]) -> None:
    """Raise unless the manifest says where the corpus comes from and its holdout has that count and digest."""
    told = manifest.get("provenance", {})
    if missing := [k for k in _PROVENANCE if not str(told.get(k) or "").strip()]:
        raise ValueError(f"manifest lacks provenance: {missing}")
    got = digest(entries.where("split = 'holdout'"), columns).first()
    if (got["n"], got["sha256"]) != (manifest["holdout_count"], manifest["holdout_sha256"]):
        raise ValueError(f"holdout differs from the manifest: {got['n']} rows, {got['sha256']}")


def verify_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Size and SHA-256 of source files, read as they are."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


_FILLED = {"type": ["string", "integer"], "not": {"const": ""}}
#: What an outcome artifact must say of where it comes from, and of each record.
OUTCOME_RULES = {
    "type": "object",
    "properties": {
        "schema_version": {"const": 2}, **dict.fromkeys(("benchmark", "benchmark_revision", "model", "model_revision", "seed", "judging_method", "defense"), _FILLED),
        "generation_config": {"type": "object", "minProperties": 1}, "input_sha256": {"type": "string", "pattern": "^[0-9a-f]{64}$"},
        "records": {"type": "array", "minItems": 1, "items": {
            "type": "object", "required": ["case_id", "condition", "status"],
            "properties": {"case_id": {"type": "string", "minLength": 1}, "condition": {"enum": ["clean", "attacked"]}, "status": {"enum": ["ok", "error"]}},
            "if": {"properties": {"status": {"const": "ok"}}},
            "then": {
                "required": ["task_success"], "properties": {"task_success": {"type": "boolean"}},
                "if": {"properties": {"condition": {"const": "attacked"}}},
                "then": {"required": ["attack_success"], "properties": {"attack_success": {"type": "boolean"}}}, "else": {"properties": {"attack_success": {"type": "null"}}},
            },
            "else": {"properties": {"task_success": {"type": "null"}, "attack_success": {"type": "null"}}},
        }},
    },
}
OUTCOME_RULES["required"] = list(OUTCOME_RULES["properties"])


def outcome_problems(document: Column) -> Column:
    """Pointers at which an outcome artifact breaks its rules; a case that stands twice under one condition among them."""
    of = F.from_json(document, OUTCOMES)["records"]
    keys = F.transform(of, lambda r: F.struct(r["case_id"].alias("c"), r["condition"].alias("d")))
    twice = F.size(F.array_distinct(keys)) < F.size(keys)
    found = Shape(OUTCOME_RULES).problems(document)
    return F.when((F.size(found) == 0) & F.coalesce(twice, F.lit(False)), F.array(F.lit("/records: duplicate case"))).otherwise(found)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Records of outcome artifacts of version 2, one file each; one that breaks the rules raises when read."""
    rows = spark.read.text(path, wholetext=True).withColumn("p", outcome_problems(F.col("value")))
    told = F.from_json("value", OUTCOMES)
    fine = F.when(F.size("p") == 0, told).otherwise(F.raise_error(F.concat(F.lit("outcome artifact breaks its rules at "), F.get("p", F.lit(0)))))
    return rows.select(fine.alias("a")).select("a.model", "a.defense", F.explode("a.records").alias("r")).select("model", "defense", "r.*")


@F.arrow_udf(StringType())
def strict_problem(lines: pa.Array) -> pa.Array:
    """Why a frame is not strict JSON (repeated keys, NaN, not an object), or null."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def refuse(name):
        raise ValueError(f"{name} is not a number")

    out = []
    for x in lines:
        try:
            out.append(None if isinstance(json.loads(x.as_py(), object_pairs_hook=pairs, parse_constant=refuse), dict) else "not an object")
        except (TypeError, ValueError) as e:
            out.append(str(e) if str(e) in ("repeated key",) or "not a number" in str(e) else "not JSON")
    return pa.array(out, pa.string())


def parse_frames(lines: DataFrame, max_bytes: int = 1 << 20, max_documents: int = 64) -> DataFrame:
    """Request frames of a column ``value``: ``id``, ``documents``, ``problem`` (null: valid)."""
    frame = F.from_json(F.col("value"), FRAME)
    rows = lines.select(frame.alias("f"), strict_problem("value").alias("strict"), F.octet_length("value").alias("size"))
    problem = F.when(F.col("size") > max_bytes, "frame too long").when(F.col("strict").isNotNull(), F.col("strict"))
    problem = problem.when(F.coalesce(F.col("f.protocol"), F.lit(0)) != 1, "bad protocol").when(~F.coalesce(F.length("f.id").between(1, 128), F.lit(False)), "bad id")
    problem = problem.when(~F.coalesce(F.size("f.documents").between(1, max_documents), F.lit(False)), "bad number of documents")
    return rows.select("f.id", "f.documents", problem.alias("problem"))


def search(rows: DataFrame, query: str, order: str, limit: int = 8) -> DataFrame:
    """First hits of a keyword in stored order."""
    return rows.where(F.contains(F.lower("text"), F.lit(query.lower()))).orderBy(order).limit(limit)


def result_texts(rows: DataFrame, leaves: str) -> DataFrame:
    """Projections of a tool result's text leaves (array of struct<group, text>): joined, by line, by group; each once."""
    texts = F.transform(leaves, lambda x: x["text"])
    groups = F.array_distinct(F.transform(leaves, lambda x: x["group"]))
    grouped = F.transform(groups, lambda g: F.array_join(F.transform(F.filter(leaves, lambda x: x["group"] == g), lambda x: x["text"]), ""))
    return rows.withColumn("projections", F.array_distinct(F.concat(F.array(F.array_join(texts, ""), F.array_join(texts, "\n")), grouped)))
