"""Look-ups and ordered access over lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ArgumentError
from ledgerloom.expr import values as V
from ledgerloom.expr.values import LONG, Val, carry, number
from ledgerloom.functions.arrays import elements, field, item, kept, mapped
from ledgerloom.functions.logic import chosen, equal
from ledgerloom.functions.registry import register


def _or(found: Val, there: Column, default: Val | None, used: list[Val]) -> Val:
    d = default if default is not None else V.lit(None)
    return chosen([(there, found)], d, True, used)


@register("vlookup", least=2, most=4, family="lookup")
def vlookup(key: Val, table: Val, col: Val | None = None, default: Val | None = None) -> Val:
    """First row whose key equals; col counts the fields after the key, 0 is the key itself."""
    at = int(col.const) if col is not None and col.is_const else 1
    if isinstance(table.dtype, T.MapType):
        row = V.from_column(F.try_element_at(table.col, key.col.cast(table.dtype.keyType)), table.dtype.valueType)
        there = F.coalesce(F.map_contains_key(table.col, key.col.cast(table.dtype.keyType)), F.lit(False))
        if at == 0:
            found = key
        elif isinstance(row.dtype, (T.StructType, T.ArrayType)):
            found = field(row, at - 1)
        else:
            found = row
        return _or(found, there, default, [key, table])
    rows = elements(table)
    hit = kept(rows, lambda r: equal(field(r, 0), key))
    return _or(field(item(rows, F.get(hit.col, F.lit(0))), at), F.size(hit.col) > 0, default, [key, rows])


@register("xlookup", least=3, most=4, family="lookup")
def xlookup(value: Val, look: Val, back: Val, missing: Val | None = None) -> Val:
    a, b = elements(look), elements(back)
    at = F.array_position(F.transform(a.col, lambda x: equal(item(a, x), value)), F.lit(True))
    there = (at > 0) & (F.size(a.col) == F.size(b.col))
    return _or(item(b, F.get(b.col, F.greatest(at - 1, F.lit(0)).cast("int"))), there, missing if missing is not None else V.lit(0), [value, a, b])


@register("index", least=2, most=3, family="lookup")
def index(array: Val, row: Val, col: Val | None = None) -> Val:
    """1-based; out of range is undefined."""
    a, r = elements(array), number(row)
    inside = (r.col >= 1) & (r.col <= F.size(a.col))
    got = item(a, F.get(a.col, (r.col - 1).cast("int")))
    if col is None:
        return carry([a, r], got.col, got.dtype, inside)
    if V.is_array(got.dtype):
        c = number(col)
        cell = item(got, F.get(got.col, (c.col - 1).cast("int")))
        return carry([a, r, c], cell.col, cell.dtype, inside, (c.col >= 1) & (c.col <= F.size(got.col)))
    cell = field(got, int(col.const) - 1)
    return carry([a, r], cell.col, cell.dtype, inside)


@register("match", least=2, most=3, family="lookup")
def match(value: Val, array: Val, kind: Val | None = None) -> Val:
    """1-based position: 0 exact; 1 the last while elements are <=; -1 the last while they are >=."""
    a = elements(array)
    k = int(kind.const) if kind is not None and kind.is_const else 1 if kind is None else 0
    if k == 0:
        at = F.array_position(F.transform(a.col, lambda x: equal(item(a, x), value)), F.lit(True))
        return carry([value, a], at, LONG, at > 0)
    v = number(value)
    if not V.is_num(a.dtype.elementType):
        return carry([v, a], F.lit(0).cast("long"), LONG, F.lit(False))
    fails = (lambda x: x > v.col) if k == 1 else (lambda x: x < v.col)
    stop = F.array_position(F.transform(a.col, lambda x: F.coalesce(fails(x), F.lit(False))), F.lit(True))
    upto = F.when(stop > 0, stop - 1).otherwise(F.size(a.col)).cast("int")
    last = F.array_max(F.filter(F.transform(a.col, lambda x, i: F.when(x.isNotNull() & (i < upto), i + 1)), lambda i: i.isNotNull())).cast("long")
    return carry([v, a], last, LONG, last.isNotNull())


@register("choose", least=2, family="lookup")
def choose(i: Val, *options: Val) -> Val:
    n = number(i)
    picked = chosen([(n.col == k + 1, o) for k, o in enumerate(options)], V.lit(None), True, [n])
    return picked.need((n.col >= 1) & (n.col <= len(options)))


@register("filter_array", least=2, most=5, family="array", keywords=("key", "value"))
def filter_array(data: Val, op: Val | None = None, threshold: Val | None = None, key: Val | None = None, value: Val | None = None) -> Val:
    rows = elements(data)
    of = lambda r: field(r, key) if key is not None else r
    if value is not None:
        return kept(rows, lambda r: equal(of(r), value))
    if op is None or threshold is None or not op.is_const:
        raise ArgumentError("filter_array takes a constant operator and a threshold")

    def test(r: Val) -> Column:
        x = of(r)
        if op.const in ("==", "="):
            return equal(x, threshold)
        if op.const in ("!=", "<>"):
            return ~equal(x, threshold)
        if V.is_num(x.dtype) != V.is_num(threshold.dtype):
            return F.lit(False)
        made = {">": x.col > threshold.col, "<": x.col < threshold.col, ">=": x.col >= threshold.col, "<=": x.col <= threshold.col}
        if op.const not in made:
            raise ArgumentError(f"filter_array has no operator {op.const!r}")
        return F.coalesce(made[op.const], F.lit(False))

    return kept(rows, test)


@register("map_key", least=2, most=2, family="array")
def map_key(data: Val, key: Val) -> Val:
    return mapped(elements(data), lambda r: field(r, key))


@register("rf", least=2, most=4, family="array")
def rf(row: Val, *args: Val) -> Val:
    """rf(row, field) or rf(table, position, field, default): safe access, default 0."""
    if V.is_array(row.dtype):
        if len(args) < 2:
            raise ArgumentError("rf(table, position, field[, default])")
        got = field(field(row, args[0]), args[1])
        default = args[2] if len(args) > 2 else V.lit(0)
        used = [args[0]]
    else:
        got, default, used = field(row, args[0]), args[1] if len(args) > 1 else V.lit(0), []
    return chosen([(got.col.isNotNull(), got)], default, True, used)


# --- order -----------------------------------------------------------------------------------


def rank_key(v: Val) -> Column:
    """A sort key over kinds: null < dates and ISO dates < numbers and numeric texts < other texts."""
    t = v.dtype
    none = F.lit(None)
    if V.is_num(t) or V.is_bool(t):
        tier, n, s = F.when(v.col.isNull(), 0).otherwise(2), v.col.cast("double"), none.cast("string")
    elif V.is_date(t):
        tier, n, s = F.when(v.col.isNull(), 0).otherwise(1), v.col.cast("timestamp").cast("double"), none.cast("string")
    else:
        shown = V.text(v)
        day = F.when(shown.rlike(r"^\d{4}-\d{2}-\d{2}"), shown.try_cast("timestamp").cast("double"))
        num = shown.try_cast("double")
        tier = F.when(shown.isNull(), 0).when(day.isNotNull(), 1).when(num.isNotNull(), 2).otherwise(3)
        n, s = F.coalesce(day, num), F.when(day.isNull() & num.isNull(), F.lower(shown))
    return F.struct(tier.alias("tier"), n.alias("n"), s.alias("s"))


def _sorted(rows: Val, key: Val | None, reverse: bool) -> Column:
    """rows in the order of their keys; equal keys keep their order."""
    names = [k.strip() for k in str(key.const).split(",")] if key is not None and key.is_const and isinstance(key.const, str) else None
    of = lambda x: F.struct(*[rank_key(field(item(rows, x), n)).alias(f"k{j}") for j, n in enumerate(names)]) if names else rank_key(item(rows, x))
    keyed = F.transform(rows.col, lambda x, i: F.struct(of(x).alias("k"), (-i if reverse else i).alias("i"), x.alias("x")))
    ordered = F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    out = F.transform(ordered, lambda e: e["x"])
    return F.reverse(out) if reverse else out


def _ordered(rows: Val, sort_by: Val | None, reverse: bool, preserve: Val | None) -> Column:
    plain = not isinstance(rows.dtype.elementType, (T.StructType, T.MapType))
    if preserve is not None and preserve.const is True:
        return rows.col
    if sort_by is None or sort_by.const is None:
        return _sorted(rows, None, reverse) if plain else rows.col
    return _sorted(rows, sort_by, reverse)


def _pick(reverse: bool):
    def build(data: Val, sort_by: Val | None = None, n: Val | None = None, group_by: Val | None = None, value_key: Val | None = None, default: Val | None = None, preserve_order: Val | None = None) -> Val:
        rows = elements(data)
        count = int(n.const) if n is not None and n.is_const and n.const is not None else 1
        out = lambda v: field(v, value_key) if value_key is not None else v
        if group_by is not None and group_by.const is not None:
            keys = mapped(rows, lambda r: field(r, group_by))

            def entry(k: Column) -> Column:
                own = Val(F.filter(rows.col, lambda r: field(item(rows, r), group_by).col == k), rows.dtype)
                best = _ordered(own, sort_by, reverse, preserve_order)
                kept_ = out(item(rows, F.get(best, F.lit(0)))).col if count == 1 else F.slice(best, 1, count)
                return F.struct(k.alias("key"), kept_.alias("value"))

            value_type = out(item(rows, F.get(rows.col, F.lit(0)))).dtype if count == 1 else rows.dtype
            distinct = F.array_distinct(F.filter(keys.col, lambda k: k.isNotNull()))
            return carry([rows], F.map_from_entries(F.transform(distinct, entry)), T.MapType(keys.dtype.elementType, value_type))
        best = _ordered(rows, sort_by, reverse, preserve_order)
        if count == 1:
            return _or(out(item(rows, F.get(best, F.lit(0)))), F.size(rows.col) > 0, default, [rows])
        top = Val(F.slice(best, 1, count), rows.dtype, rows.ok, rows.zero)
        return mapped(top, out) if value_key is not None else top

    return build


_KEYS = ("sort_by", "n", "group_by", "value_key", "default", "preserve_order")
register("last", "latest", least=1, most=7, family="order", keywords=_KEYS)(_pick(True))
register("first", "earliest", least=1, most=7, family="order", keywords=_KEYS)(_pick(False))


@register("nth", least=2, most=5, family="order", keywords=("sort_by", "value_key", "default"))
def nth(data: Val, n: Val, sort_by: Val | None = None, value_key: Val | None = None, default: Val | None = None) -> Val:
    """n-th in ascending order, 1-based; out of range: the default."""
    rows, k = elements(data), number(n)
    best = _ordered(rows, sort_by, False, None)
    got = item(rows, F.get(best, (k.col - 1).cast("int")))
    got = field(got, value_key) if value_key is not None else got
    return _or(got, (k.col >= 1) & (k.col <= F.size(rows.col)), default, [rows, k])


@register("sorted_array", "sort", "sorted", least=1, most=3, family="order", keywords=("key", "reverse"))
def sorted_array(data: Val, key: Val | None = None, reverse: Val | None = None) -> Val:
    """Null keys last in ascending order, first in descending."""
    rows = elements(data)
    of = lambda x: field(item(rows, x), key) if key is not None and key.const is not None else item(rows, x)
    keyed = F.transform(rows.col, lambda x, i: F.struct(of(x).col.isNull().alias("z"), of(x).col.alias("k"), i.alias("i"), x.alias("x")))
    up = F.array_sort(keyed, lambda a, b: F.when(a["z"] & ~b["z"], 1).when(~a["z"] & b["z"], -1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    down = F.array_sort(keyed, lambda a, b: F.when(a["z"] & ~b["z"], -1).when(~a["z"] & b["z"], 1).when(a["k"] > b["k"], -1).when(a["k"] < b["k"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    order = down if reverse is not None and bool(reverse.const) else up
    return carry([rows], F.transform(order, lambda e: e["x"]), rows.dtype)


