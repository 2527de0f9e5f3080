"""Canonical JSON: keys sorted at every level, no spaces, literal Unicode, numbers as Python writes them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What VARIANT may write otherwise: escapes, control signs, fractions and exponents, long numbers, signs beyond 16 bits (they sort otherwise).
_OTHERWISE = r"[\\\x00-\x1f\x{D800}-\x{DFFF}\x{E000}-\x{10FFFF}]|[0-9][.eE]|[0-9]{18}"


def _refuse(name: str):
    raise ValueError(f"{name} is not a number")


def canonical_text(document: str) -> str | None:
    """Null for what is not JSON, NaN and infinities, endless depth, and lone surrogates, which no digest can read."""
    try:
        out = json.dumps(json.loads(document, parse_constant=_refuse), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        out.encode()
    except (ValueError, RecursionError):
        return None
    return out


@F.arrow_udf(StringType())
def _by_python(documents: pa.Array) -> pa.Array:
    return pa.array([None if x is None else canonical_text(x) for x in documents.to_pylist()], pa.string())


def canonical_json(document: Column) -> Column:
    """A JSON string in canonical form, or null; of keys that repeat the last counts.

    Most documents stay in native expressions, by way of VARIANT, whose keys are
    sorted; those that it may write otherwise go to Python.
    """
    native = F.when(~document.rlike(_OTHERWISE), F.to_json(F.try_parse_json(document)))
    return F.coalesce(native, _by_python(F.when(native.isNull(), document)))


def json_of(value: Column) -> Column:
    """The JSON text of a column of any type; null is ``null``."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, 6, F.length(whole) - 6)


def canonical_row(columns: list[str], nested: tuple[str, ...] = ()) -> Column:
    """A row as one canonical object.  nested: columns that hold JSON themselves, null among it."""
    member = lambda c: F.concat(F.lit(json.dumps(c) + ":"), F.coalesce(F.col(c), F.lit("null")) if c in nested else json_of(F.col(c)))
    return canonical_json(F.concat(F.lit("{"), F.concat_ws(",", *map(member, columns)), F.lit("}")))
