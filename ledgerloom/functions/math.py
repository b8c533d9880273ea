"""Mathematical functions. Where Python would raise, the value is undefined (not ok)."""

from __future__ import annotations

import math as _math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.expr import values as V
from ledgerloom.expr.values import BOOL, DOUBLE, LONG, STRING, Val, carry, number
from ledgerloom.functions.registry import CONSTANTS, register

CONSTANTS["pi"] = _math.pi


def unary(name: str, build, domain=None, dtype: T.DataType | None = DOUBLE) -> None:
    @register(name, least=1, most=1, family="math")
    def _(x: Val) -> Val:
        n = number(x)
        arg = n.col.cast("double") if dtype is DOUBLE else n.col
        out = dtype or n.dtype
        return carry([n], build(arg).cast(out), out, domain(arg) if domain else None)


unary("abs", F.abs, dtype=None)
unary("floor", F.floor, dtype=LONG)
unary("ceil", F.ceil, dtype=LONG)
unary("sqrt", F.sqrt, lambda x: x >= 0)
unary("exp", F.exp, lambda x: x <= 709.78)
unary("ln", F.ln, lambda x: x > 0)
unary("log10", F.log10, lambda x: x > 0)
for _name in ("sin", "cos", "tan", "atan", "degrees", "radians"):
    unary(_name, getattr(F, _name))
unary("asin", F.asin, lambda x: F.abs(x) <= 1)
unary("acos", F.acos, lambda x: F.abs(x) <= 1)


@register("log", least=1, most=2, family="math")
def log(x: Val, base: Val | None = None) -> Val:
    n = number(x)
    if base is None:
        return carry([n], F.ln(n.col.cast("double")), DOUBLE, n.col > 0)
    b = number(base)
    return carry([n, b], F.ln(n.col.cast("double")) / F.nullif(F.ln(b.col.cast("double")), F.lit(0.0)), DOUBLE, n.col > 0, b.col > 0, b.col != 1)


@register("power", least=2, most=2, family="math")
def power(x: Val, y: Val) -> Val:
    a, b = number(x), number(y)
    col = F.pow(a.col.cast("double"), b.col.cast("double"))
    return carry([a, b], col, DOUBLE, ~((a.col == 0) & (b.col < 0)), ~((a.col < 0) & (b.col != F.floor(b.col))), F.abs(col) < float("inf"))


@register("atan2", least=2, most=2, family="math")
def atan2(y: Val, x: Val) -> Val:
    a, b = number(y), number(x)
    return carry([a, b], F.atan2(a.col.cast("double"), b.col.cast("double")), DOUBLE)


@register("round", least=1, most=2, family="math")
def round_(x: Val, digits: Val | None = None) -> Val:
    """Half to even, on the decimal value that is shown."""
    n = number(x)
    if digits is None:
        return carry([n], F.bround(n.col.cast("double"), 0).cast("long"), LONG)
    d = int(digits.const) if digits.is_const else None
    if d is not None:
        return carry([n], F.bround(n.col.cast("double"), d).cast(n.dtype), n.dtype)
    g = number(digits)
    scale = F.pow(F.lit(10.0), g.col.cast("double"))
    return carry([n, g], F.bround(n.col.cast("double") * scale, 0) / scale, DOUBLE)


def _scaled(x: Val, digits: Val | None, step) -> Val:
    n, d = number(x), number(digits if digits is not None else V.lit(0))
    scale = F.pow(F.lit(10.0), d.col.cast("double"))
    return carry([n, d], step(n.col.cast("double") * scale).cast("double") / scale, DOUBLE)


@register("roundup", least=1, most=2, family="math")
def roundup(x: Val, digits: Val | None = None) -> Val:
    return _scaled(x, digits, F.ceil)


@register("rounddown", least=1, most=2, family="math")
def rounddown(x: Val, digits: Val | None = None) -> Val:
    return _scaled(x, digits, F.floor)


def divided(a: Val, b: Val) -> Column:
    return a.col.cast("double") / F.nullif(b.col.cast("double"), F.lit(0.0))


def _or_default(parts: list[Val], col: Column, default: Val | None) -> Val:
    """col where it is defined, else the default: what safe functions do."""
    d = number(default) if default is not None else V.lit(0)
    ok = V.both(*(p.ok for p in parts))
    good = col if ok is None else F.when(ok, col)
    return carry([d], F.coalesce(good, d.col.cast("double")), DOUBLE)


@register("safe_div", least=2, most=3, family="math")
def safe_div(a: Val, b: Val, default: Val | None = None) -> Val:
    x, y = number(a), number(b)
    return _or_default([x, y], divided(x, y), default)


@register("percent_of", least=2, most=3, family="math")
def percent_of(a: Val, b: Val, default: Val | None = None) -> Val:
    x, y = to_float(a), to_float(b)
    return _or_default([x, y], divided(x, y) * 100, default)


def to_float(v: Val) -> Val:
    """float(v): numeric strings count."""
    if V.is_str(v.dtype):
        got = F.trim(v.col).try_cast("double")
        return Val(got, DOUBLE, V.both(v.ok, got.isNotNull()), v.zero)
    return number(v)


@register("clamp", least=3, most=3, family="math")
def clamp(x: Val, low: Val, high: Val) -> Val:
    n, a, b = number(x), number(low), number(high)
    dtype = LONG if all(V.is_int(v.dtype) for v in (n, a, b)) else DOUBLE
    return carry([n], F.greatest(a.col.cast(dtype), F.least(b.col.cast(dtype), n.col.cast(dtype))), dtype)


@register("between", least=3, most=3, family="math")
def between(x: Val, low: Val, high: Val) -> Val:
    return carry([x, low, high], F.coalesce(x.col.between(low.col, high.col), F.lit(False)), BOOL)


@register("isnumber", least=1, most=1, family="math")
def isnumber(x: Val) -> Val:
    return carry([x], x.col.isNotNull() if V.is_num(x.dtype) else F.lit(False), BOOL)


@register("to_number", least=1, most=2, family="math")
def to_number(x: Val, default: Val | None = None) -> Val:
    d = number(default) if default is not None else V.lit(0)
    if V.is_num(x.dtype) or V.is_bool(x.dtype):
        col = x.col.cast("double")
    else:
        col = F.regexp_replace(V.text(x), r"[^0-9.\-]", "").try_cast("double")
    return carry([x, d], F.coalesce(col, d.col.cast("double")), DOUBLE)


@register("int", least=1, most=1, family="cast")
def int_(x: Val) -> Val:
    if V.is_str(x.dtype):
        col = F.when(F.trim(x.col).rlike(r"^[+-]?\d+$"), F.trim(x.col).try_cast("long"))
    else:
        n = number(x)
        return carry([n], n.col.cast("long"), LONG)
    return carry([x], col, LONG, col.isNotNull())


@register("float", least=1, most=1, family="cast")
def float_(x: Val) -> Val:
    n = to_float(x)
    return carry([n], n.col.cast("double"), DOUBLE)


@register("str", least=1, most=1, family="cast")
def str_(x: Val) -> Val:
    return carry([x], F.coalesce(V.text(x), F.lit("None")), STRING)


@register("bool", least=1, most=1, family="cast")
def bool_(x: Val) -> Val:
    return carry([x], V.truthy(x), BOOL)
