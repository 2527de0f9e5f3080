"""Quotation linking: reply-ordered conversations without quotes, DataFrame operations only.

Lines that begin with ``>`` marks are quotes; their level is the number of
marks.  Neighbouring lines of one level form a passage.  Passages, their
paragraphs and their lines are normalised (letters lowered, white space made
single) and hashed; a quoted passage links by its longest unit that an earlier
message of its conversation wrote itself, to the latest such message.
A message replies to what its outermost quotes link to, or to the turn before
it.  No conversation is gathered in one place: order is carried by keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PASSAGES = "array<struct<level: int, body: string>>"
#: White space around and between quote marks.
_MARKS = r"^[ \t]*((>[ \t]?)+)"


def passages(text: Column) -> Column:
    """Runs of lines of one quote level: array of (level, body), in order; null text has none."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)
    parsed = F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), r"[^>]", "")).alias("level"),
        F.regexp_replace(x, _MARKS, "").alias("body"),
    ))
    # without a quote mark the whole text is one passage
    whole = F.filter(F.array(F.struct(F.lit(0).alias("level"), F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r", "\n").alias("body"))), _said)
    return F.when(F.coalesce(text, F.lit("")).contains(">"), F.get(F.transform(F.array(parsed), _runs), 0)).otherwise(whole).cast(_PASSAGES)


def _said(run: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(run["body"], r"\s+", " "))) > 0


def _runs(parsed: Column) -> Column:
    """Runs of parsed lines: a run ends where the level changes."""
    at = F.sequence(F.lit(0), F.size(parsed) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(parsed, i)["level"] != F.get(parsed, i - 1)["level"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(parsed)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(
        F.get(parsed, a)["level"].alias("level"),
        F.array_join(F.transform(F.slice(parsed, a + 1, b - a), lambda x: x["body"]), "\n").alias("body"),
    ))
    return F.filter(runs, _said)


def passage_hash(body: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(body), r"\s+", " ")), 256)


def _units(body: Column) -> Column:
    """A passage, its paragraphs and its lines, each said once: array of (size, h)."""
    text = F.lower(body)
    found = F.concat(F.array(text), F.split(text, r"\n\s*\n", -1), F.split(text, r"\n", -1))
    plain = F.array_distinct(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.transform(F.filter(plain, lambda x: F.length(x) > 0), lambda x: F.struct(F.length(x).alias("size"), F.unhex(F.sha2(x, 256)).alias("h")))


def own_text(found: Column) -> Column:
    """What a message itself wrote: its passages of level 0."""
    return F.array_join(F.transform(F.filter(found, lambda r: r["level"] == 0), lambda r: F.regexp_replace(r["body"], r"^\s+|\s+$", "")), "\n")


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: ``conv_id``, ``turn``, ``role``, ``reply_to``, ``linked_quotes``, ``n_quotes``, ``body``, ``chat``.

    reply_to: the latest turn that an outermost quoted passage links to (each by
    its longest unit: itself, a paragraph, a line; of equal ones the latest
    turn); without one, the greatest earlier turn; null for a first turn.
    linked_quotes and n_quotes count quoted passages of all levels.  body: the
    message without quotes; chat: body with its role's tag.  (conv_id, turn)
    orders replies after what they answer.  Null text is empty; messages with a
    null conversation or turn link to nothing; rows that share a turn each give
    a row, with the links of its own quotes; an empty table gives no rows.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), passages(F.col(text_col)).alias("found"))
    quoted = F.filter("found", lambda r: r["level"] > 0)
    rows = rows.withColumn("own_quotes", F.xxhash64(quoted))  # rows of one turn with the same quotes link alike
    placed = rows.where("conv is not null and turn is not null")
    own = F.filter("found", lambda r: r["level"] == 0)
    origins = placed.select("conv", "turn", F.explode(own).alias("p")).select("conv", "turn", F.explode(_units(F.col("p.body"))).alias("u")).select("conv", "turn", "u.h", F.lit(True).alias("own"))
    # some quotes of a message are the same passage: each counts, but is looked up once
    quotes = placed.where(F.size(quoted) > 0).select("conv", "turn", "own_quotes", F.explode(quoted).alias("p")).select("conv", "turn", "own_quotes", F.col("p.level").alias("level"), F.col("p.body").alias("body"), passage_hash(F.col("p.body")).alias("passage"))
    quotes = quotes.groupBy("conv", "turn", "own_quotes", "passage").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("times"), F.array_distinct(F.flatten(F.collect_set(_units(F.col("body"))))).alias("units"))
    parts = quotes.select("conv", "turn", "own_quotes", "passage", "level", "times", F.explode("units").alias("u")).select("conv", "turn", "own_quotes", "passage", "level", "times", "u.size", "u.h")
    said = latest(origins.union(parts.select("conv", "turn", "h", F.lit(False))))
    hits = parts.join(said, ["conv", "turn", "h"]).groupBy("conv", "turn", "own_quotes", "passage").agg(F.max(F.struct("size", "said")).alias("longest"), F.first("level").alias("level"), F.first("times").alias("times"))
    hits = hits.select("conv", "turn", "own_quotes", F.col("longest.said").alias("said"), "level", "times")
    outer = hits.groupBy("conv", "turn", "own_quotes").agg(F.max(F.struct((-F.col("level")).alias("outermost"), "said")).alias("best"), F.sum("times").alias("linked"))
    copies = rows.where(F.size(quoted) > 0).groupBy("conv", "turn", "own_quotes").agg(F.count(F.lit(1)).alias("copies"))  # equal rows
    outer = outer.join(copies, ["conv", "turn", "own_quotes"]).select("conv", "turn", "own_quotes", F.col("best.said").alias("answered"), (F.col("linked") / F.col("copies")).cast("long").alias("linked"))
    # the turn before: turns are usually dense, so the predecessor is looked up; a gap takes the greatest smaller turn
    turns = rows.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    joined = rows.join(outer, ["conv", "turn", "own_quotes"], "left").join(previous(turns), ["conv", "turn"], "left")
    body = own_text(F.col("found"))
    return joined.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
        F.coalesce("answered", "before").alias("reply_to"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked_quotes"),
        F.size(quoted).cast("long").alias("n_quotes"), body.alias("body"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), body).alias("chat"),
    )


def latest(events: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``h``, ``said`` of turns that quote a unit: the greatest smaller turn that wrote it itself.

    Spans of 1024 turns as in ``previous``, so that no common line is joined with all its quotes.
    """
    from pyspark.sql.window import Window

    once = events.groupBy("conv", "h", "turn").agg(F.max(F.when(F.col("own"), F.col("turn"))).alias("own"), F.max(~F.col("own")).alias("asks")).withColumn("span", F.floor(F.col("turn") / 1024))
    w = Window.partitionBy("conv", "h", "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    inside = once.withColumn("near", F.last("own", ignorenulls=True).over(w)).where("asks")
    over = Window.partitionBy("conv", "h").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tops = once.groupBy("conv", "h", "span").agg(F.max("own").alias("top")).withColumn("carried", F.last("top", ignorenulls=True).over(over)).select("conv", "h", "span", "carried")
    return inside.join(tops, ["conv", "h", "span"]).select("conv", "turn", "h", F.coalesce("near", "carried").alias("said")).where("said is not null")


def previous(turns: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``before``: the greatest smaller turn of the conversation, without a window over it.

    Turns are cut in spans of 1024; a span's first turn takes the greatest turn of the spans before it.
    """
    from pyspark.sql.window import Window

    spans = turns.withColumn("span", F.floor(F.col("turn") / 1024))
    inside = spans.withColumn("near", F.lag("turn").over(Window.partitionBy("conv", "span").orderBy("turn")))
    tops = spans.groupBy("conv", "span").agg(F.max("turn").alias("top"))
    # a conversation has a thousandth as many spans as turns, and spans with turns follow each other
    w = Window.partitionBy("conv").orderBy("span")
    carried = tops.withColumn("carried", F.lag("top").over(w)).select("conv", "span", "carried")
    return inside.join(carried, ["conv", "span"]).select("conv", "turn", F.coalesce("near", "carried").alias("before"))
