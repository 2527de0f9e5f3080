"""Bounded, deterministic samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = 1 << 30


def bounded_sample(labelled: DataFrame, rows: int, max_bytes: int) -> dict[str, list[str]]:
    """At most ``rows`` whole texts of at most ``max_bytes`` bytes of each label, least hash of id first.

    labelled: ``id``, ``text``, ``label``.  One pass counts labels, one picks
    rows by hash; nothing is shuffled but the counts.  Labels are few by
    assumption (languages, classes); the sample's bytes are bounded by
    labels x rows x max_bytes.
    """
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(_SPREAD))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    wanted = F.lit(False)
    for label, n in counts.items():
        share = min(1.0, 1.25 * rows / n + 40 / n)  # more than enough; the surplus is cut below
        wanted = wanted | ((F.col("label") == label) & (place < int(share * _SPREAD)))
    picked = labelled.where(wanted & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("label", "id", "text", place.alias("place")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["place"], str(r["id"]), r["text"])):
        if len(texts := out.setdefault(r["label"], [])) < rows:
            texts.append(r["text"])
    return out
