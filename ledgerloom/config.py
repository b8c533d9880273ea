"""Export and import of formula sets and bindings as JSON with a checksum."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from ledgerloom.errors import ConfigError

SCHEMA_VERSION = 1


def checksum(payload: Mapping) -> str:
    plain = {k: v for k, v in payload.items() if k != "checksum"}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def export_config(formulas: list[Mapping], bindings: list[Mapping] = (), meta: Mapping | None = None) -> str:
    payload = {"schema_version": SCHEMA_VERSION, "meta": dict(meta or {}), "formula_set": [dict(f) for f in formulas], "bindings": [dict(b) for b in bindings]}
    return json.dumps(payload | {"checksum": checksum(payload)}, ensure_ascii=False, indent=2, sort_keys=True)


def problems(payload: Mapping) -> list[str]:
    found = []
    if payload.get("schema_version") != SCHEMA_VERSION:
        found.append(f"schema_version {payload.get('schema_version')!r} isn't {SCHEMA_VERSION}")
    for k, f in enumerate(payload.get("formula_set") or []):
        if not f.get("name") or "formula" not in f:
            found.append(f"formula {k} needs a name and a formula")
    for k, b in enumerate(payload.get("bindings") or []):
        if not (b.get("variable_name") or b.get("variable")) or not b.get("source_type"):
            found.append(f"binding {k} needs a variable and a source type")
    if payload.get("checksum") and payload["checksum"] != checksum(payload):
        found.append("the checksum doesn't fit the content")
    return found


def import_config(text: str) -> dict:
    try:
        payload = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from None
    if bad := problems(payload):
        raise ConfigError("; ".join(bad))
    return payload
