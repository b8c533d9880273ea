"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.expr import values as V
from ledgerloom.expr.values import LONG, STRING, Val, carry, number, truthy
from ledgerloom.functions.registry import register


def shown(v: Val) -> Column:
    """str(v), with None as "None"."""
    return F.coalesce(V.text(v), F.lit("None"))


@register("concat", family="text")
def concat(*args: Val) -> Val:
    return carry(args, F.concat_ws("", *[V.text(a) for a in args]), STRING)


@register("concatenate", family="text")
def concatenate(*args: Val) -> Val:
    return carry(args, F.concat_ws("", *[F.when(truthy(a), V.text(a)) for a in args]), STRING)


@register("text_join", least=1, family="text")
def text_join(d: Val, *args: Val) -> Val:
    parts = F.filter(F.array(*[V.text(a) for a in args]), lambda x: x.isNotNull())
    return carry([d, *args], _joined(parts, shown(d)), STRING)


def _joined(parts: Column, between: Column) -> Column:
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(rest, F.coalesce(F.get(parts, F.lit(0)), F.lit("")), lambda acc, x: F.concat(acc, between, x))


@register("textjoin", least=2, family="text")
def textjoin(d: Val, ignore: Val, *args: Val) -> Val:
    pieces = F.array(*[F.when(truthy(a), V.text(a)).otherwise(F.lit("")) for a in args])
    kept = F.filter(pieces, lambda x: x != "")
    parts = F.when(truthy(ignore), kept).otherwise(pieces)
    return carry([d, ignore, *args], _joined(parts, shown(d)), STRING)


@register("left", least=1, most=2, family="text")
def left(t: Val, n: Val | None = None) -> Val:
    k = number(n) if n is not None else V.lit(1)
    c = k.col.cast("int")
    s = F.coalesce(V.text(t), F.lit(""))
    return carry([t, k], F.when(c >= 0, F.substring(s, F.lit(1), c)).otherwise(F.substring(s, F.lit(1), F.greatest(F.length(s) + c, F.lit(0)))), STRING)


@register("right", least=1, most=2, family="text")
def right(t: Val, n: Val | None = None) -> Val:
    """right(t, 0) is the whole text."""
    k = number(n) if n is not None else V.lit(1)
    s, c = F.coalesce(V.text(t), F.lit("")), k.col.cast("int")
    return carry([t, k], F.when((c == 0) | (c >= F.length(s)), s).when(c > 0, F.right(s, c)).otherwise(F.substring(s, 1 - c, F.length(s))), STRING)


@register("mid", least=3, most=3, family="text")
def mid(t: Val, start: Val, n: Val) -> Val:
    a, k, s = number(start), number(n), F.coalesce(V.text(t), F.lit(""))
    at = F.greatest(a.col.cast("int"), F.lit(1))
    return carry([t, a, k], F.substring(s, at, F.greatest(k.col.cast("int"), F.lit(0))), STRING)


def _each(name: str, build) -> None:
    @register(name, least=1, most=1, family="text")
    def _(t: Val) -> Val:
        return carry([t], build(shown(t)), STRING)


_each("upper", F.upper)
_each("lower", F.lower)
_each("trim", lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


@register("replace", least=3, most=3, family="text")
def replace(t: Val, old: Val, new: Val) -> Val:
    return carry([t, old, new], F.replace(shown(t), shown(old), shown(new)), STRING)


@register("substitute", least=3, most=4, family="text")
def substitute(t: Val, old: Val, new: Val, nth: Val | None = None) -> Val:
    s, o, w = shown(t), shown(old), shown(new)
    if nth is None:
        return carry([t, old, new], F.replace(s, o, w), STRING)
    n = number(nth)
    k = n.col.cast("int")
    parts = F.split(s, F.concat(F.lit(r"\Q"), o, F.lit(r"\E")))
    inside = (k >= 1) & (k < F.size(parts))
    safe = F.when(inside, k).otherwise(F.lit(1))
    changed = F.concat(_joined(F.slice(parts, F.lit(1), safe), o), w, _joined(F.slice(parts, safe + 1, F.size(parts)), o))
    return carry([t, old, new, n], F.when(inside, changed).otherwise(s), STRING)


@register("find", least=2, most=3, family="text")
def find(what: Val, t: Val, start: Val | None = None) -> Val:
    """1-based; 0 if absent."""
    a = number(start) if start is not None else V.lit(1)
    return carry([what, t, a], F.position(shown(what), shown(t), F.greatest(a.col.cast("int"), F.lit(1))).cast("long"), LONG)


@register("len_text", least=1, most=1, family="text")
def len_text(t: Val) -> Val:
    return carry([t], F.length(F.coalesce(V.text(t), F.lit("None"))).cast("long"), LONG)


@register("safe_str", least=1, most=1, family="text")
def safe_str(t: Val) -> Val:
    return carry([t], F.when(truthy(t), V.text(t)).otherwise(F.lit("")), STRING)


@register("number_to_words", least=1, most=1, family="text", keywords=("currency", "decimal_mode", "decimal_digits"))
def number_to_words(amount: Val, **options: Val) -> Val:
    from ledgerloom.functions.words import spell_udf

    read = spell_udf(**{k: v.const for k, v in options.items()})
    return carry([amount], read(V.text(amount)), STRING)
