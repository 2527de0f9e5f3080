"""Deterministic transforms of seed texts, and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variants(seeds: DataFrame, text: str = "text") -> DataFrame:
    """Six rows for each seed: ``transform`` and ``variant``."""
    t = F.col(text)
    letters = F.filter(F.split(t, ""), lambda x: x != "")
    entities = F.array_join(F.transform(letters, lambda x: F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))), "")
    # base64 may come in lines of 76 characters, by the session's settings
    every = (
        ("identity", t), ("uppercase", F.upper(t)), ("entities", entities), ("zero_width", F.array_join(letters, chr(0x200B))),
        ("base64", F.translate(F.base64(t.cast("binary")), "\r\n", "")), ("spaces", F.replace(t, F.lit(" "), F.lit("   "))),
    )
    made = F.array(*(F.struct(F.lit(k).alias("transform"), v.alias("variant")) for k, v in every))
    return seeds.withColumn("v", F.explode(made)).select(*seeds.columns, "v.transform", "v.variant")


def context(chunks: DataFrame, document: str, order: str, title: str = "title") -> DataFrame:
    """Each document's title and its chunks in order, joined by lines."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
    return chunks.groupBy(document, title).agg(ordered.alias("c")).select(document, F.concat_ws("\n", title, F.array_join(F.transform("c", lambda x: x["text"]), "\n")).alias("context"))


def probe_grid(cases: DataFrame) -> DataFrame:
    """cases x {clean, attacked} x {baseline, defended}; an arm's context is that of its condition."""
    grid = F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(a).alias("arm")) for c in ("clean", "attacked") for a in ("baseline", "defended")))
    rows = cases.withColumn("g", F.explode(grid)).select(*cases.columns, "g.*")
    return rows.withColumn("context", F.when(F.col("condition") == "clean", F.col("clean_context")).otherwise(F.col("attacked_context")))


def allowed(rows: DataFrame, grants: DataFrame, key: str) -> DataFrame:
    """Rows whose owner the grants name."""
    return rows.join(grants.select(key).distinct(), key, "left_semi")
