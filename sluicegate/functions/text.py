"""Native text expressions: identity, evidence, redaction, similarity, answers."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Shapes of secrets, names of credentials, and what replaces them.
SECRET = r"\bsk-[a-zA-Z0-9_-]{20,}|\b(?:api[-_]?key|access[-_]?token|secret|password|authorization)\s*[:=]\s*[\"']?[^\s\"',}]+"
CREDENTIAL_NAME = r"api[-_]?key|access[-_]?token|secret|password|authorization|credential"
REDACTED, REDACTED_CREDENTIAL, REDACTED_METADATA = "[REDACTED]", "[REDACTED credential]", "[REDACTED credential-bearing metadata]"
EVIDENCE_CHARS, LEXICAL_CHARS = 120, 20_000


def document_id(id_: Column, text: Column) -> Column:
    """The explicit id, or 12 hex digits of the SHA-256 of the text."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12))


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, "(?iU)" + SECRET, REDACTED)


def locate(raw: Column, match: Column) -> Column:
    """The match as raw text has it, where it stands there but for case; else the match."""
    at = F.instr(F.lower(raw), F.lower(match))
    return F.when(at > 0, F.substring(raw, at, F.length(match))).otherwise(match)


def finish_evidence(label: Column, body: Column, most: int = EVIDENCE_CHARS) -> Column:
    """Label and body, redacted before the body is cut to its first characters."""
    return F.concat(label, F.substring(redact_secrets(body), 1, most))


def lexical_form(text: Column, most: int | None = LEXICAL_CHARS) -> Column:
    """Lowered, white space single.  most: of the first characters only; None: of the whole text."""
    read = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(read if most is None else F.substring(read, 1, most)), r"(?U)[\s\x1c-\x1f]+", " "))


def words(form: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(form, F.lit(r"(?U)(\w+)"), F.lit(1)))


def trigrams(form: Column) -> Column:
    every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(form) - 2), lambda i: F.substring(form, i, F.lit(3))))
    return F.when(F.length(form) < 3, F.array().cast("array<string>")).otherwise(every)


def jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def lexical_similarity(form_a: Column, words_a: Column, grams_a: Column, form_b: Column, words_b: Column, grams_b: Column) -> Column:
    return F.when(form_a == form_b, 1.0).otherwise(F.greatest(jaccard(words_a, words_b), jaccard(grams_a, grams_b)))


@F.arrow_udf(StringType())
def _folded_answer(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else " ".join(x.split()).casefold().rstrip(".") for x in texts.to_pylist()], pa.string())


def answer_form(text: Column) -> Column:
    """Case folded, white space single, full stops at the end gone.  ASCII stays in native expressions."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    native = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"[\s\x0b\x1c-\x1f]+", " "))), r"\.+$", "")
    return F.when(plain, native).otherwise(_folded_answer(F.when(~plain, text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def unit_vector(v: Column) -> Column:
    """By the largest component, then by length: safe for very large and very small vectors. Null where invalid."""
    v = v.cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    largest = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    scaled = bind(F.struct(v.alias("v"), largest.alias("m")), lambda s: F.transform(s["v"], lambda x: x / s["m"]))
    unit = bind(scaled, lambda w: bind(F.struct(w.alias("w"), F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x)).alias("n")), lambda s: F.transform(s["w"], lambda x: x / s["n"])))
    return F.when(fine, unit)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
