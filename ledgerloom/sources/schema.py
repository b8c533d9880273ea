"""Schemas of bindings' configurations: a small subset of JSON Schema, written as short texts."""

from __future__ import annotations

from collections.abc import Mapping

#: The keys that each source type reads and their kinds; `!` marks required ones.
KEYS = {
    "constant": "type:string",
    "linked_doctype_field": "link_field:string target_doctype:string! target_field:string!",
    "whole_doctype": "link_field:string target_doctype:string! fields:array include_child_tables:array",
    "child_table_aggregate": "child_table_field:string! field:string aggregate:string filter_expr:string",
    "global_default": "key:string!",
    "session_variable": "key:string!",
    "doctype_query": "doctype:string! filters:array fieldname:string aggregate:string",
    "custom_function": "module:string! function:string! args:object",
    "dynamic_link": "doctype_field:string! name_field:string! target_field:string!",
    "computed": "formula:string! dependencies:array",
    "pipeline": "steps:array! merge_strategy:string",
    "conditional": "branches:array! default:object",
    "fallback_chain": "chain:array!",
    "matrix_lookup": "doctype:string! row_key_field:string col_key_field:string value_field:string!",
    "reuse_formula_result": "formula_document:string! result_field:string! line_field:string aggregation:string",
    "composite_key_lookup": "doctype:string! value_field:string! key_fields:array! key_values:array! fallback_keys:array multipliers:object",
    "range_lookup": "doctype:string! value_field:string! range_from_field:string! range_to_field:string!",
    "child_table_lookup": "child_table_field:string! key_field:string! value_field:string!",
    "aggregate_from_items": "rows_source:string child_table_field:string key_field:string aggregate:string",
}
_CHOICES = {
    "aggregate": ["sum", "avg", "average", "min", "max", "count", "first", "last", "list"], "aggregation": ["sum", "avg", "average", "min", "max", "count", "first", "last", "list"],
    "rows_source": ["resolved", "child_table", "doctype_query", "snapshot"], "merge_strategy": ["last", "all"],
}
_KINDS = {"object": Mapping, "string": str, "array": (list, tuple), "boolean": bool, "number": (int, float), "integer": int}


def schema_of(source_type: str) -> dict:
    """The schema of a built-in source type; empty for others."""
    wanted, properties = [], {}
    for item in KEYS.get(source_type, "").split():
        name, kind = item.rstrip("!").split(":")
        properties[name] = {"type": kind} | ({"enum": _CHOICES[name]} if name in _CHOICES else {})
        if item.endswith("!"):
            wanted.append(name)
    return {"type": "object", "required": wanted, "properties": properties} if properties else {}


def problems(value, schema: Mapping, path: str = "config") -> list[str]:
    """What in a value is against a schema of type, required, required_unless, properties, enum,
    minimum, maximum, items. required_unless: {field: {"if": other, "equals": value}}."""
    if not schema:
        return []
    kind = schema.get("type", "object")
    numeric = kind in ("number", "integer")
    if not isinstance(value, _KINDS[kind]) or (numeric and isinstance(value, bool)):
        return [f"{path}: {kind} expected, not {type(value).__name__}"]
    if kind == "object":
        spared = {f for f, u in (schema.get("required_unless") or {}).items() if value.get(u.get("if")) == u.get("equals")}
        found = [f"{path}.{f}: required" for f in schema.get("required", ()) if value.get(f) is None and f not in spared]
        inner = schema.get("properties", {})
        return found + [p for f, s in inner.items() if value.get(f) is not None for p in problems(value[f], s, f"{path}.{f}")]
    if kind == "array":
        return [p for k, v in enumerate(value) for p in problems(v, schema.get("items", {}), f"{path}[{k}]")]
    if "enum" in schema and value not in schema["enum"]:
        return [f"{path}: {value!r} is none of {schema['enum']}"]
    low, high = schema.get("minimum"), schema.get("maximum")
    if numeric and (low is not None and value < low or high is not None and value > high):
        return [f"{path}: {value} is outside {low} to {high}"]
    return []
