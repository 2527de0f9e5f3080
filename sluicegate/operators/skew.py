"""Joining rows with a fact of their key where some keys hold much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; fewer than 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 256


def with_fact(rows: DataFrame, key: str, fact: Column, name: str, total: int) -> DataFrame:
    """``rows`` with an aggregate of their key (null keys: null), hot keys spread over all tasks.

    Facts are summed with map-side combining.  Those of hot keys, fewer than 256
    rows however large the table, are broadcast; the others are joined.  total:
    the number of rows.
    """
    limit = int(total * HOT_SHARE)
    facts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(fact.alias(name), F.count(F.lit(1)).alias("_n"))
    hot = facts.where(F.col("_n") > limit).select("_key", F.col(name).alias("_hot"))
    rest = facts.where(F.col("_n") <= limit).select("_key", name)
    bare = rows.where(F.col(key).isNull()).withColumn(name, F.lit(None).cast(facts.schema[name].dataType))  # nulls meet nothing, and nowhere
    near = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").drop("_key")
    told = near.where("_hot is not null").withColumnRenamed("_hot", name)
    asked = near.where("_hot is null").drop("_hot").join(rest, F.col(key) == F.col("_key"), "left").drop("_key")
    return bare.unionByName(told.select(*rows.columns, name)).unionByName(asked.select(*rows.columns, name))
