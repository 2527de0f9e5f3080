"""Filter interaction audit: what each of five filters removes, in every order in which they could run.

Direct relational replay: each document's flags meet 120 broadcast orders, five
steps are exploded, the first failure is found and sums are taken with map-side
combining, so that what is exchanged is bounded by partitions x parts x orders x
steps whatever the number of documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicegate.llm.common import as_table

#: A text held by more than this share of all documents is hot: fewer than 1 / HOT_SHARE texts are, so their first ids are broadcast.
HOT_SHARE = 1 / 256
LETTERS = "ABCDE"


def text_flags(text: Column) -> list[Column]:
    """Failures of A to D, which look at one text only: short, repetitive, upper case, symbols."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals.cast("long") > 5 * F.length(t), t.rlike(r"[#$%&*|]")]


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part``, ``fails`` (bits of A to E) and ``good``, ``toxic`` of each document; written once, texts are never exchanged.

    Null texts are empty texts and a null part is the empty string.  A row of a
    null id never fails E and is no smaller id for others; rows that repeat an
    id and its text are not duplicates of each other.  Where labels repeat an
    id, one row of 1 is enough.
    """
    ask = [f.cast("int") for f in text_flags(F.col(text_col))]
    bits = sum((f * (1 << k) for k, f in enumerate(ask)), F.lit(0))
    t = F.coalesce(F.col(text_col), F.lit(""))
    each = as_table(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(t, 256)).alias("digest")))
    groups = each.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    copied = as_table(groups.where("first <> last").select(F.col("digest").alias("of"), "first", "n"))
    limit = int(each.count() * HOT_SHARE)
    hot = copied.where(F.col("n") > limit).select("of", F.col("first").alias("hot_first"))  # fewer than 256 rows
    near = each.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left").drop("of")
    rest = copied.where(F.col("n") <= limit).select("of", "first")
    settled = near.where("hot_first is not null").select("id", "part", "bits", F.col("hot_first").alias("first"))
    asked = near.where("hot_first is null").join(rest, F.col("digest") == F.col("of"), "left").select("id", "part", "bits", "first")
    told = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    late = F.coalesce((F.col("id") > F.col("first")).cast("int"), F.lit(0))
    both = settled.unionByName(asked).join(told, F.col("id") == F.col("labelled"), "left")
    return both.select("part", (F.col("bits") + 16 * late).alias("fails"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def orders(spark) -> DataFrame:
    """The 120 orders: ``filter_order`` and the bit that each of five steps looks at."""
    rows = [("".join(p), *(1 << LETTERS.index(c) for c in p)) for p in permutations(LETTERS)]
    return spark.createDataFrame(rows, "filter_order string, s1 int, s2 int, s3 int, s4 int, s5 int")


def audit(flagged: DataFrame) -> DataFrame:
    """A row for each part, order and step, zeros included; an empty table gives no rows.  flagged: as of ``flags``."""
    each = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession)))
    failed = [F.col("fails").bitwiseAND(F.col(f"s{k}")) != 0 for k in range(1, 6)]
    first = F.coalesce(*(F.when(f, k) for k, f in enumerate(failed, 1)), F.lit(6))
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"s{k}").alias("bit")) for k in range(1, 6))))
    steps = each.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), steps.alias("s")).select("*", "s.step", "s.bit")
    here, fails = F.col("first") == F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    counts = {
        "kept": F.col("first") > F.col("step"), "removed": here, "redundant": fails & (F.col("first") < F.col("step")), "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": here & (F.col("good") == 1), "toxic_lost": here & (F.col("toxic") == 1),
    }
    summed = steps.groupBy("part", "filter_order", "step", "bit").agg(*(F.count_if(c).alias(name) for name, c in counts.items()))
    whole = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows a group
    return summed.select("part", "filter_order", "step", *counts, whole.alias("shapley"))
