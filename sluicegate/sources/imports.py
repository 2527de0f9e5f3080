"""Sources that come from elsewhere: pinned files, upstream corpora, tool results."""

from __future__ import annotations

import json
import platform
import posixpath

import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sluicegate.operators import metrics as M
from sluicegate.operators import selection as S
from sluicegate.sources import corpora


def within(root: str, relative: str) -> str:
    """The path of a file under ``root``; a path that leads out of it raises."""
    path = posixpath.normpath(relative)
    if not relative or posixpath.isabs(path) or path.split("/")[0] == ".." or "\\" in relative or ":" in relative:
        raise ValueError(f"path leaves its source: {relative!r}")
    return posixpath.join(root, path)


def read_pinned(spark: SparkSession, root: str, pins: dict[str, str]) -> DataFrame:
    """``path``, ``content`` of files under ``root``; one whose SHA-256 is not its pin raises when read."""
    paths = {within(root, name): sha for name, sha in pins.items()}
    pinned = spark.createDataFrame([(p.split("://")[-1].lstrip("/"), sha) for p, sha in paths.items()], "place string, pin string")
    files = spark.read.format("binaryFile").load(list(paths)).withColumn("place", F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), r"^/+", ""))
    held = files.join(F.broadcast(pinned), "place")
    content = F.when(F.sha2("content", 256) == F.col("pin"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("file differs from its pin: "), "place")).cast("binary"))
    return held.select("path", content.alias("content"))


def json_digest(value: Column) -> Column:
    """SHA-256 of a value as canonical JSON."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.sha2(F.substring(whole, 6, F.length(whole) - 6), 256)


def benign_entries(rows: DataFrame, source: str) -> DataFrame:
    """Entries from benign prompts (``key``, ``prompt``, ``category``, ``words``).

    Prompts that share trigger words, however indirectly, are one group; the
    largest group is dev, all others are holdout.
    """
    groups = M.shared_word_components(rows.select(F.col("key").alias("item"), "words"))
    dev = S.largest(groups, "component").select(F.col("component").alias("dev_group"))
    placed = rows.join(groups, rows["key"] == groups["item"], "left").withColumn("component", F.coalesce("component", "key")).join(F.broadcast(dev), F.col("component") == F.col("dev_group"), "left")
    return placed.select(
        F.concat(F.lit(f"{source}-"), F.col("key").cast("string")).alias("id"), F.col("prompt").alias("text"), F.lit(None).cast("string").alias("metadata"),
        F.lit("benign").alias("label"), "category", F.when(F.col("dev_group").isNotNull(), "dev").otherwise("holdout").alias("split"),
        F.lit("verbatim").alias("notes"), F.lit(source).alias("source_id"), json_digest(F.col("prompt")).alias("origin_id"), F.col("component").cast("string").alias("split_group"),
    )


def attack_entries(rows: DataFrame, source: str) -> DataFrame:
    """Entries from attacks (``key``, ``response``, ``category``, ``tools``): cases of one set of tools go to one split by its hash."""
    group = json_digest(F.array_sort("tools"))
    bucket = F.conv(F.substring(group, 1, 8), 16, 10).cast("long") % 100
    return rows.select(
        F.concat(F.lit(f"{source}-"), F.col("key").cast("string")).alias("id"), F.col("response").alias("text"), F.lit(None).cast("string").alias("metadata"),
        F.lit("attack").alias("label"), "category", F.when(bucket < 30, "holdout").otherwise("dev").alias("split"),
        F.lit("verbatim").alias("notes"), F.lit(source).alias("source_id"), json_digest(F.struct("key", "category")).alias("origin_id"), group.alias("split_group"),
    )


def reload(spark: SparkSession, path: str, identity: dict, columns: list[str]) -> DataFrame:
    """Converted entries read again; another count or digest than ``identity`` raises."""
    rows = spark.read.parquet(path)
    got = corpora.digest(rows, columns).first()
    if (got["n"], got["sha256"]) != (identity["n"], identity["sha256"]):
        raise ValueError(f"converted corpus differs: {got['n']} rows, {got['sha256']}")
    return rows


def provenance(spark: SparkSession, paths: list[str]) -> dict:
    """Runtime, versions, and the hashes of files that a run was made from."""
    files = {r["path"]: r["sha256"] for r in corpora.verify_files(spark, paths).collect()}
    return {"python": platform.python_version(), "spark": spark.version, "pyspark": pyspark.__version__, "pyarrow": pa.__version__, "files": dict(sorted(files.items()))}


_TEXTS = StructType([StructField("texts", ArrayType(StringType())), StructField("problem", StringType())])
#: Block types that hold no text.
_MEDIA = frozenset({"image", "image_url", "audio", "input_audio", "video", "input_image", "input_video"})


class _Refused(ValueError):
    pass


class ResultTexts:
    """All that a tool result says, as texts to scan; what is malformed or over budget is refused whole."""

    def __init__(self, max_nodes: int, max_depth: int, max_chars: int):
        self.nodes, self.depth, self.leaf_chars, self.shown_chars = max_nodes, max_depth, max_chars, max_chars

    def spend(self, **amounts: int) -> None:
        for name, amount in amounts.items():
            left = getattr(self, name) - amount
            setattr(self, name, left)
            if left < 0:
                raise _Refused(f"too many {name}")

    def leaves(self, value) -> list[str]:
        """Keys and strings in reading order, walked with a stack of its own."""
        out: list[str] = []
        waiting = [(value, 0)]
        while waiting:
            x, depth = waiting.pop()
            self.spend(nodes=1)
            if depth > self.depth:
                raise _Refused("too deep")
            if isinstance(x, _Key):
                self.nodes += 1  # a key is no node
                self.spend(leaf_chars=len(x.name) + 1)
                out.append(x.name)
            elif isinstance(x, str):
                self.spend(leaf_chars=len(x) + 1)
                out.append(x)
            elif isinstance(x, dict):
                if isinstance(x.get("type"), str) and x["type"] in _MEDIA:
                    raise _Refused("not text")
                for k, y in reversed(x.items()):
                    waiting += [(y, depth + 1), (_Key(k), depth)]
            elif isinstance(x, list):
                waiting += [(y, depth + 1) for y in reversed(x)]
        return out

    def blocks(self, value) -> list[str]:
        if not isinstance(value, list) or not all(isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) for b in value):
            raise _Refused("not text blocks")
        self.spend(nodes=len(value), shown_chars=sum(len(b["text"]) + 1 for b in value))
        return [b["text"] for b in value]

    def read(self, document: str) -> list[str]:
        result = json.loads(document)
        if not isinstance(result, dict):
            raise _Refused("not an object")
        said = self.leaves(result)
        groups = [self.blocks(result[k]) for k in ("content", "feedback") if k in result]
        contexts = result.get("additionalContexts", [])
        if not isinstance(contexts, list) or not all(isinstance(c, dict) for c in contexts):
            raise _Refused("not contexts")
        for c in contexts:
            self.spend(nodes=1)
            text = c.get("content")
            if isinstance(text, str):
                self.spend(shown_chars=len(text) + 1)
            groups.append([text] if isinstance(text, str) else self.blocks(text))
        shown = [t for g in groups for t in g]
        views = ["".join(shown), "\n".join(shown), "\n".join("".join(g) for g in groups)]
        return [*dict.fromkeys(views), "\n".join(said)]


class _Key:
    def __init__(self, name: str):
        self.name = name


def tool_result_texts(rows: DataFrame, column: str, max_nodes: int = 10_000, max_depth: int = 64, max_chars: int = 200_000) -> DataFrame:
    """Add ``texts`` (joined, by line and by group, each once; then all keys and strings) and ``problem`` of JSON tool results.

    Null, broken, malformed and oversized results have null texts and a problem.
    """

    @F.arrow_udf(_TEXTS)
    def run(documents: pa.Array) -> pa.Array:
        texts, problems = [], []
        for x in documents.to_pylist():
            try:
                got, problem = (ResultTexts(max_nodes, max_depth, max_chars).read(x), None) if x is not None else (None, "null")
            except _Refused as e:
                got, problem = None, str(e)
            except (ValueError, RecursionError):
                got, problem = None, "not JSON"
            texts.append(got)
            problems.append(problem)
        return pa.StructArray.from_arrays([pa.array(texts, pa.list_(pa.string())), pa.array(problems, pa.string())], ["texts", "problem"])

    return rows.withColumn("_r", run(column)).select(*rows.columns, "_r.texts", "_r.problem")
