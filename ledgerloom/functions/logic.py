"""Logic. IF is lazy: only the branch that is taken can be undefined; the rest are eager."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerloom.errors import ArgumentError
from ledgerloom.expr import values as V
from ledgerloom.expr.values import BOOL, Val, carry, truthy
from ledgerloom.functions.registry import register


def chosen(branches: list[tuple], otherwise: Val, lazy: bool, extra: list[Val]) -> Val:
    """branches: (condition column, value). The first whose condition holds, else otherwise."""
    every = [v for _, v in branches] + [otherwise]
    dtype = reduce(V.unify, (v.dtype for v in every))

    def pick(of, last):
        column = None
        for condition, v in branches:
            column = F.when(condition, of(v)) if column is None else column.when(condition, of(v))
        return column.otherwise(last)

    col = pick(lambda v: V.cast(v, dtype), V.cast(otherwise, dtype))
    if not lazy:
        return carry([*extra, *every], col, dtype)
    ok = None if all(v.ok is None for v in every) else pick(lambda v: v.ok if v.ok is not None else F.lit(True), otherwise.ok if otherwise.ok is not None else F.lit(True))
    zero = None if all(v.zero is None for v in every) else pick(lambda v: v.zero if v.zero is not None else F.lit(False), otherwise.zero if otherwise.zero is not None else F.lit(False))
    return Val(col, dtype, V.both(*(e.ok for e in extra), ok), V.either(*(e.zero for e in extra), zero))


@register("IF", least=3, most=3, family="logic")
def if_(c: Val, a: Val, b: Val) -> Val:
    return chosen([(truthy(c), a)], b, True, [c])


@register("IIF", least=3, most=3, family="logic")
def iif(c: Val, a: Val, b: Val) -> Val:
    return chosen([(truthy(c), a)], b, False, [c])


@register("IFS", least=2, family="logic")
def ifs(*args: Val) -> Val:
    if len(args) % 2:
        raise ArgumentError("IFS takes pairs of condition and value")
    return chosen([(truthy(c), v) for c, v in zip(args[::2], args[1::2], strict=True)], V.lit(None), False, list(args[::2]))


@register("SWITCH", least=3, family="logic")
def switch(e: Val, *args: Val) -> Val:
    pairs = list(zip(args[::2], args[1::2], strict=False))
    default = args[-1] if len(args) % 2 else V.lit(None)
    return chosen([(equal(e, k), v) for k, v in pairs], default, False, [e, *(k for k, _ in pairs)])


def equal(a: Val, b: Val):
    """Python's ==, never null: values of different kinds differ, None equals None."""
    kind = lambda t: 0 if V.is_num(t) or V.is_bool(t) else 1 if V.is_str(t) else 2 if V.is_date(t) else 3
    if V.is_null(a.dtype) or V.is_null(b.dtype):
        return b.col.isNull() if V.is_null(a.dtype) else a.col.isNull()
    if kind(a.dtype) != kind(b.dtype):
        return a.col.isNull() & b.col.isNull()
    if V.is_bool(a.dtype) != V.is_bool(b.dtype):
        return a.col.cast("double").eqNullSafe(b.col.cast("double"))
    return a.col.eqNullSafe(b.col)


@register("and_", family="logic")
def and_(*args: Val) -> Val:
    return carry(args, reduce(lambda x, y: x & y, map(truthy, args), F.lit(True)), BOOL)


@register("or_", family="logic")
def or_(*args: Val) -> Val:
    return carry(args, reduce(lambda x, y: x | y, map(truthy, args), F.lit(False)), BOOL)


@register("not_", least=1, most=1, family="logic")
def not_(x: Val) -> Val:
    return carry([x], ~truthy(x), BOOL)


@register("coalesce", family="logic")
def coalesce(*args: Val) -> Val:
    """The first that is neither None nor ''."""
    if not args:
        return V.lit(None)
    dtype = reduce(V.unify, (v.dtype for v in args))
    return carry(args, F.coalesce(*[F.nullif(V.cast(v, dtype), F.lit("")) if V.is_str(dtype) else V.cast(v, dtype) for v in args]), dtype)


@register("is_blank", least=1, most=1, family="logic")
def is_blank(x: Val) -> Val:
    blank = x.col.isNull()
    if V.is_str(x.dtype):
        blank = blank | (x.col == "")
    elif V.is_num(x.dtype):
        blank = blank | (x.col == 0)
    elif V.is_bool(x.dtype):
        blank = blank | ~x.col
    return carry([x], F.coalesce(blank, F.lit(True)), BOOL)


@register("not_blank", least=1, most=1, family="logic")
def not_blank(x: Val) -> Val:
    b = is_blank(x)
    return carry([b], ~b.col, BOOL)
