"""The criteria mini-language of SUMIF and its relatives, as predicates on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.expr.values import Val, is_bool, is_null, is_num, text

_OPERATOR = re.compile(r"^(>=|<=|<>|!=|==|>|<|=)(.*)$", re.S)


def _as_number(v: Val) -> Column:
    return v.col.cast("double") if is_num(v.dtype) else F.lit(None).cast("double") if is_bool(v.dtype) else v.col.cast("string").try_cast("double")


def _as_text(v: Val) -> Column:
    return F.lower(F.trim(F.coalesce(text(v), F.lit("")))) if not is_null(v.dtype) else F.lit("")


def _is(value: bool | Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _like(v: Val, pattern: str) -> Column:
    spelled = ".*".join(re.escape(p) for p in pattern.split("*"))
    return F.coalesce(text(v), F.lit("")).rlike(f"(?is)^{spelled}$")


def _number(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def matches(value: Val, criterion: Val) -> Column:
    """Where value meets criterion; never null."""
    if criterion.is_const:
        return _constant(value, criterion.const)
    if is_num(criterion.dtype) or is_bool(criterion.dtype):
        c = criterion.col.cast("double")
        return F.when(c.isNull(), value.col.isNull()).otherwise(_is(_as_number(value) == c))
    return _dynamic(value, criterion)


def _constant(value: Val, c) -> Column:
    if c is None:
        return value.col.isNull()
    if isinstance(c, (bool, int, float)):
        if is_bool(value.dtype) and isinstance(c, bool):
            return _is(value.col == c)
        return _is(_as_number(value) == float(c))
    s = str(c).strip()
    if not s:
        return F.lit(False)
    m = _OPERATOR.match(s)
    if not m:
        return _like(value, s) if "*" in s else _as_text(value) == s.lower()
    op, right = m[1], m[2].strip()
    bound = _number(right)
    if op in (">", "<", ">=", "<="):
        if bound is None:
            return F.lit(False)
        left = _as_number(value)
        return _is({">": left > bound, "<": left < bound, ">=": left >= bound, "<=": left <= bound}[op])
    if bound is not None:
        same = F.coalesce(_as_number(value) == bound, _as_text(value) == right.lower())
    else:
        same = _like(value, right) if "*" in right else _as_text(value) == right.lower()
    return ~_is(same) if op in ("<>", "!=") else _is(same)


def _dynamic(value: Val, criterion: Val) -> Column:
    """The same with a criterion that differs from row to row."""
    c = F.trim(text(criterion))
    op = F.regexp_extract(c, r"^(>=|<=|<>|!=|==|>|<|=)", 1)
    right = F.trim(F.regexp_replace(c, r"^(>=|<=|<>|!=|==|>|<|=)", ""))
    bound, left, shown = right.try_cast("double"), _as_number(value), _as_text(value)
    wild = F.concat(F.lit(r"^\Q"), F.replace(F.lower(right), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E$"))
    same = F.when(bound.isNotNull() & left.isNotNull(), left == bound).when(F.contains(right, F.lit("*")), F.regexp_like(shown, wild)).otherwise(shown == F.lower(right))
    met = (
        F.when(op == ">", left > bound).when(op == "<", left < bound).when(op == ">=", left >= bound).when(op == "<=", left <= bound)
        .when(op.isin("<>", "!="), ~_is(same)).otherwise(same)
    )
    return F.when(c.isNull(), value.col.isNull()).when(c == "", F.lit(False)).otherwise(_is(met))
