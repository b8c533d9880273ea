"""Filters and templates of bindings.

Filters are [field, operator, value] rows. Texts are compared trimmed; `like` means contains,
whatever the case; order compares numbers; a null field matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.errors import BindingError

_TEMPLATE = re.compile(r"\{\{?\s*(row|doc|resolved|inputs|binding)\.(\w+)\s*\}?\}")


def value_column(value, columns, binding: dict | None = None) -> Column:
    """A constant, or a template: one that is the whole text keeps its type."""
    if not isinstance(value, str):
        return F.lit(value)
    whole = _TEMPLATE.fullmatch(value.strip())

    def one(scope: str, name: str) -> Column:
        if scope == "binding":
            return F.lit((binding or {}).get(name))
        return F.col(f"`{name}`") if name in columns else F.lit(None)

    if whole:
        return one(whole[1], whole[2])
    parts, at = [], 0
    for m in _TEMPLATE.finditer(value):
        parts += [F.lit(value[at : m.start()]), F.coalesce(one(m[1], m[2]).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(value[at:])) if parts else F.lit(value)


def is_template(value) -> bool:
    return isinstance(value, str) and _TEMPLATE.search(value) is not None


def rows_of(filters) -> list[tuple[str, str, object]]:
    """Filters as (field, operator, value), from rows or from a mapping."""
    if not filters:
        return []
    if isinstance(filters, dict):
        return [(k, v[0], v[1]) if isinstance(v, (list, tuple)) and len(v) == 2 else (k, "=", v) for k, v in filters.items()]
    return [(f[0], f[1], f[2]) if len(f) == 3 else (f[0], "=", f[1]) for f in filters]


def text_key(c: Column) -> Column:
    return F.trim(c.cast("string"))


def test(c: Column, op: str, value: Column, constant=None) -> Column:
    """Where c meets the filter; never null."""
    op = op.strip().lower()
    if op in ("=", "=="):
        met = text_key(c) == text_key(value)
    elif op in ("!=", "<>"):
        met = text_key(c) != text_key(value)
    elif op == "like":
        met = F.contains(F.lower(c.cast("string")), F.lower(F.replace(value.cast("string"), F.lit("%"), F.lit(""))))
    elif op in ("in", "not in"):
        listed = [str(v).strip() for v in (constant if isinstance(constant, (list, tuple)) else str(constant).split(","))]
        met = text_key(c).isin(*listed)
        met = met if op == "in" else ~met
    elif op in ("<", "<=", ">", ">="):
        a, b = c.cast("string").try_cast("double"), value.cast("string").try_cast("double")
        met = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    else:
        raise BindingError(f"unknown filter operator {op!r}")
    return F.coalesce(c.isNotNull() & met, F.lit(False))


def constant_condition(filters) -> Column:
    """The condition of filters without templates, over the columns of one table."""
    out = F.lit(True)
    for name, op, value in rows_of(filters):
        if not is_template(value):
            out = out & test(F.col(f"`{name}`"), op, F.lit(value) if not isinstance(value, (list, tuple)) else F.lit(None), value)
    return out
