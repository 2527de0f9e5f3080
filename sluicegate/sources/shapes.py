"""JSON Schema as column expressions: a document's problems, each with the pointer to where it stands.

A schema (the part of Draft 2020-12 below) is compiled once, when the plan is
built, into expressions over VARIANT; nothing is parsed or walked in Python.
References are followed by name; those that lead back to themselves raise, since
an expression has no recursion.  Keywords that are not known raise as well, so
that no rule is silently left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicegate.functions.text import bind

_NOTES = frozenset({"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"})
#: Types as the prefix of the name that Spark gives to a variant's type.
_KINDS = {"null": "VOID", "boolean": "BOOLEAN", "string": "STRING", "object": "OBJECT", "array": "ARRAY"}
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _none() -> Column:
    return F.array().cast("array<string>")


def _said(at: Column, keyword: str) -> Column:
    return F.array(F.concat(at, F.lit(": " + keyword)))


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _below(at: Column, name: Column) -> Column:
    """The pointer of a member whose name is data."""
    return F.concat(at, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


class Shape:
    """A compiled schema.  ``definition``: one of its ``$defs``; None: the schema itself."""

    def __init__(self, schema: dict, definition: str | None = None):
        self.root = schema
        self.top = schema if definition is None else {"$ref": f"#/$defs/{definition}"}
        self._check(self.top, F.parse_json(F.lit("null")), F.lit(""), ())  # unknown keywords and endless references raise here

    def problems(self, document: Column) -> Column:
        """Array of ``pointer: keyword`` of a JSON string, in the schema's order; empty where it is valid.

        Null and broken JSON, repeated keys among it, give the one problem ``: not JSON``.
        """
        return bind(F.try_parse_json(document), lambda v: F.when(v.isNull(), F.array(F.lit(": not JSON"))).otherwise(self._check(self.top, v, F.lit(""), ())))

    def _target(self, ref: str, seen: tuple[str, ...]) -> dict:
        if ref in seen:
            raise ValueError(f"{ref} leads back to itself")
        if not ref.startswith("#/"):
            raise ValueError(f"{ref} leads out of its schema")
        found = self.root
        for part in ref[2:].split("/"):
            found = found[part.replace("~1", "/").replace("~0", "~")]
        return found

    def _names(self, schema: dict, seen: tuple[str, ...] = ()) -> set[str]:
        """Properties that a schema speaks of, in itself or in what it applies to the same object."""
        names = set(schema.get("properties", ()))
        if ref := schema.get("$ref"):
            names |= self._names(self._target(ref, seen), (*seen, ref))
        for sub in [*schema.get("allOf", ()), *(schema[k] for k in ("if", "then", "else") if k in schema)]:
            names |= self._names(sub, seen)
        return names

    def _check(self, schema: dict, v: Column, at: Column, seen: tuple[str, ...]) -> Column:
        """Problems of a variant that is there (JSON null is there)."""
        known = {k: f for k, f in _KEYWORDS.items() if k in schema}
        if unknown := set(schema) - set(known) - _NOTES - {"then", "else"}:
            raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
        return _all([f(self, schema, v, at, seen) for f in known.values()])


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(name: str, v: Column) -> Column:
    if name == "number":
        return _kind(v).rlike(_NUMBER)
    if name == "integer":
        return bind(F.try_variant_get(v, "$", "double"), lambda x: _kind(v).rlike(_NUMBER) & (x == F.floor(x)))
    if name not in _KINDS:
        raise ValueError(f"unknown type {name}")
    return _kind(v).startswith(_KINDS[name])


def _equals(value, v: Column) -> Column:
    if isinstance(value, int | float) and not isinstance(value, bool):
        return F.coalesce(_is("number", v) & (F.try_variant_get(v, "$", "double") == F.lit(float(value))), F.lit(False))
    return F.to_json(v) == F.lit(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def _unless(keyword: str, fine: Callable):
    """A keyword with one problem of its own name."""

    def check(shape: Shape, schema: dict, v: Column, at: Column, seen) -> Column:
        return F.when(fine(schema[keyword], v), _none()).otherwise(_said(at, keyword))

    return check


def _only(kind: str, fine: Callable) -> Callable:
    """A rule for one type of values, which holds for all others."""
    return lambda told, v: F.coalesce(~_is(kind, v) | fine(told, v), F.lit(True))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _value(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _ref(shape, schema, v, at, seen) -> Column:
    ref = schema["$ref"]
    return shape._check(shape._target(ref, seen), v, at, (*seen, ref))


def _required(shape, schema, v, at, seen) -> Column:
    names = F.array(*map(F.lit, schema["required"]))
    missing = bind(_members(v), lambda m: F.filter(names, lambda n: ~F.array_contains(F.map_keys(m), n)))
    return F.transform(F.when(_is("object", v), missing).otherwise(_none()), lambda n: F.concat(_below(at, n), F.lit(": required")))


def _properties(shape, schema, v, at, seen) -> Column:
    def member(name: str, sub: dict) -> Callable:
        return lambda x: F.when(x.isNull(), _none()).otherwise(shape._check(sub, x, F.concat(at, F.lit("/" + _escaped(name))), seen))

    def of(m: Column) -> Column:
        return _all([bind(F.element_at(m, name), member(name, sub)) for name, sub in schema["properties"].items()])

    return bind(_members(v), lambda m: F.when(m.isNull(), _none()).otherwise(of(m)))


def _others(keyword: str, names: Callable):
    """Members that no property speaks of: none where the keyword is false, else by its schema."""

    def check(shape, schema, v, at, seen) -> Column:
        told = schema[keyword]
        if told is True:
            return _none()
        known = [F.lit(n) for n in sorted(names(shape, schema, seen))]
        left = bind(_members(v), lambda m: F.map_filter(m, lambda k, _: ~F.array_contains(F.array(*known), k) if known else F.lit(True)))
        if told is False:
            every = bind(left, lambda m: F.transform(F.map_keys(m), lambda k: F.concat(_below(at, k), F.lit(": " + keyword))))
        else:
            every = bind(left, lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: shape._check(told, e["value"], _below(at, e["key"]), seen))))
        return F.coalesce(every, _none())

    return check


def _property_names(shape, schema, v, at, seen) -> Column:
    as_value = lambda k: F.try_parse_json(F.to_json(F.array(k)))
    bad = lambda k: F.size(bind(F.variant_get(as_value(k), "$[0]", "variant"), lambda x: shape._check(schema["propertyNames"], x, F.lit(""), seen))) > 0
    return F.coalesce(bind(_members(v), lambda m: F.transform(F.filter(F.map_keys(m), bad), lambda k: F.concat(_below(at, k), F.lit(": propertyNames")))), _none())


def _items(shape, schema, v, at, seen) -> Column:
    of = lambda x, i: shape._check(schema["items"], x, F.concat(at, F.lit("/"), i.cast("string")), seen)
    return F.coalesce(bind(_items_of(v), lambda a: F.flatten(F.transform(a, of))), _none())


def _unique(told, v: Column) -> Column:
    return bind(F.transform(_items_of(v), lambda x: F.to_json(x)), lambda a: F.size(F.array_distinct(a)) == F.size(a)) if told else F.lit(True)


def _all_of(shape, schema, v, at, seen) -> Column:
    return _all([shape._check(sub, v, at, seen) for sub in schema["allOf"]])


def _fits(shape, sub, v, seen) -> Column:
    return F.size(shape._check(sub, v, F.lit(""), seen)) == 0


def _some_of(keyword: str, enough: Callable):
    def check(shape, schema, v, at, seen) -> Column:
        n = sum((_fits(shape, sub, v, seen).cast("int") for sub in schema[keyword]), F.lit(0))
        return F.when(enough(n), _none()).otherwise(_said(at, keyword))

    return check


def _if(shape, schema, v, at, seen) -> Column:
    then, other = (shape._check(schema.get(k, {}), v, at, seen) for k in ("then", "else"))
    return F.when(_fits(shape, schema["if"], v, seen), then).otherwise(other)


def _not(shape, schema, v, at, seen) -> Column:
    return F.when(_fits(shape, schema["not"], v, seen), _said(at, "not")).otherwise(_none())


def _any(test: Callable):
    def fine(told, v):
        out = F.lit(False)
        for x in told if isinstance(told, list) else [told]:
            out = out | test(x, v)
        return out

    return fine


_KEYWORDS: dict[str, Callable] = {
    "$ref": _ref,
    "type": _unless("type", _any(_is)),
    "const": _unless("const", _equals),
    "enum": _unless("enum", _any(_equals)),
    "minimum": _unless("minimum", _only("number", lambda x, v: _value(v) >= x)),
    "maximum": _unless("maximum", _only("number", lambda x, v: _value(v) <= x)),
    "minLength": _unless("minLength", _only("string", lambda x, v: F.length(_text(v)) >= x)),
    "maxLength": _unless("maxLength", _only("string", lambda x, v: F.length(_text(v)) <= x)),
    "pattern": _unless("pattern", _only("string", lambda x, v: _text(v).rlike(x))),
    "minItems": _unless("minItems", _only("array", lambda x, v: F.size(_items_of(v)) >= x)),
    "maxItems": _unless("maxItems", _only("array", lambda x, v: F.size(_items_of(v)) <= x)),
    "minProperties": _unless("minProperties", _only("object", lambda x, v: F.size(_members(v)) >= x)),
    "uniqueItems": _unless("uniqueItems", _only("array", _unique)),
    "required": _required,
    "properties": _properties,
    "additionalProperties": _others("additionalProperties", lambda shape, schema, seen: set(schema.get("properties", ()))),
    "unevaluatedProperties": _others("unevaluatedProperties", lambda shape, schema, seen: shape._names(schema, seen)),
    "propertyNames": _property_names,
    "items": _items,
    "allOf": _all_of,
    "anyOf": _some_of("anyOf", lambda n: n >= 1),
    "oneOf": _some_of("oneOf", lambda n: n == 1),
    "if": _if,
    "not": _not,
}
