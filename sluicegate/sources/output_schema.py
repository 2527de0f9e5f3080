"""The schema of what this library writes as JSON: decisions, findings, batches, frames."""

from __future__ import annotations

import json

from sluicegate.functions import rules as R
from sluicegate.operators import policy as P
from sluicegate.sources import reports
from sluicegate.sources.shapes import Shape

_FAMILIES = {"type": "array", "items": {"type": "string", "minLength": 1}, "uniqueItems": True}
_COUNT = {"type": "integer", "minimum": 0}


def _closed(properties: dict, optional: tuple[str, ...] = ()) -> dict:
    """An object of these properties and no others."""
    return {"type": "object", "properties": properties, "required": [p for p in properties if p not in optional], "additionalProperties": False}


def output_schema() -> dict:
    """The schema, in Draft 2020-12; severities, types and versions are those of the modules that write them."""
    version, severity, decision = ({"$ref": f"#/$defs/{name}"} for name in ("version", "severity", "action"))
    frame = {"protocol": {"const": 1}, "id": {"type": "string", "minLength": 1}}
    definitions = {
        "version": {"const": reports.SCHEMA_VERSION},
        "severity": {"enum": sorted(R.SEVERITY_RANK)},
        "action": {"enum": list(P.ACTIONS)},
        "finding": _closed({
            "type": {"enum": sorted({*R.FINDING_TYPES.values(), "canonical_injection", "scan_incomplete", "embedding_poisoning", "cross_user_contamination"})},
            "severity": severity, "document_id": {"type": "string", "minLength": 1}, "evidence": {"type": "string"}, "owasp_mapping": {"type": "string", "pattern": "^(LLM[0-9]{2})?$"},
            "owasp_mappings": {"type": "array", "items": {"type": "string", "pattern": "^LLM[0-9]{2}:20[0-9]{2}$"}}, "family": {"type": "string", "minLength": 1}, "document_index": _COUNT,
            "metadata_path": {"type": "string"}, "related_document_indices": {"type": "array", "items": _COUNT}, "confidence": {"type": "string", "minLength": 1},
        }, ("metadata_path",)),
        "decision": _closed({
            "schema_version": version, "document_index": _COUNT, "decision": decision, "families": _FAMILIES, "advisory_families": _FAMILIES, "scan_complete": {"type": "boolean"}, "incomplete_reasons": _FAMILIES,
        }) | {
            "if": {"properties": {"scan_complete": {"const": False}}},
            "then": {"properties": {"decision": {"enum": ["review", "reject"]}}},
            "else": {"properties": {"incomplete_reasons": {"maxItems": 0}}},
        },
        "batch": _closed({
            "schema_version": version, "total": _COUNT, "accepted": _COUNT, "review": _COUNT, "rejected": _COUNT, "clean": _COUNT,
            "severity_summary": {"type": "object", "propertyNames": severity, "additionalProperties": {"type": "integer", "minimum": 1}},
        }),
        "success": _closed(frame | {"ok": {"const": True}, "release": {"type": "boolean"}, "decision": decision, "families": _FAMILIES, "schema_version": version})
        | {"if": {"properties": {"decision": {"const": "reject"}}}, "then": {"properties": {"release": {"const": False}}}},
        "failure": _closed(frame | {"id": {"type": ["string", "null"]}, "ok": {"const": False}, "release": {"const": False}, "error": {"type": "string", "minLength": 1}}),
        "frame": {"oneOf": [{"$ref": "#/$defs/success"}, {"$ref": "#/$defs/failure"}]},
    }
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Screening output", "oneOf": [{"$ref": f"#/$defs/{d}"} for d in ("finding", "decision", "batch", "frame")], "$defs": definitions}


def shape(definition: str | None = None) -> Shape:
    """The compiled rules of one kind of output, or of all."""
    return Shape(output_schema(), definition)


def write_schema(path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(output_schema(), f, indent=2)
