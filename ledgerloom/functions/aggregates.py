"""Aggregates over lists. plans.grouped has the same over the rows of child tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ArgumentError
from ledgerloom.expr import values as V
from ledgerloom.expr.criteria import matches
from ledgerloom.expr.values import BOOL, DOUBLE, LONG, Val, carry
from ledgerloom.functions.arrays import by_key, elements, field, gathered, item, kept, mapped, numbers, total
from ledgerloom.functions.registry import register


@register("sum", least=1, family="aggregate", keywords=("key",))
def sum_(*args: Val, key: Val | None = None) -> Val:
    g = gathered(args) if key is None else numbers(by_key(elements(args[0]), key))
    dtype = g.dtype.elementType if key is None else DOUBLE
    return carry([g], total(g.col.cast(T.ArrayType(dtype)), dtype), dtype)


def _extreme(name: str, of, merge) -> None:
    @register(name, least=1, family="aggregate", keywords=("key",))
    def _(*args: Val, key: Val | None = None) -> Val:
        if key is None and len(args) > 1 and all(V.is_num(a.dtype) for a in args):
            dtype = LONG if all(V.is_int(a.dtype) for a in args) else DOUBLE
            return carry(args, F.coalesce(merge(*[a.col.cast(dtype) for a in args]), F.lit(0).cast(dtype)), dtype)
        g = gathered(args) if key is None else numbers(by_key(elements(args[0]), key))
        return carry([g], F.coalesce(of(g.col), F.lit(0).cast(g.dtype.elementType)), g.dtype.elementType)


_extreme("min", F.array_min, F.least)
_extreme("max", F.array_max, F.greatest)


@register("count", "counta", least=1, family="aggregate")
def count(*args: Val) -> Val:
    """Elements that are neither None nor ''."""
    parts = []
    for a in args:
        if V.is_array(a.dtype) or isinstance(a.dtype, T.MapType):
            e = elements(a)
            parts.append(F.size(F.filter(e.col, lambda x, t=e.dtype.elementType: (x.isNotNull() & (x != "")) if V.is_str(t) else x.isNotNull())))
        else:
            there = a.col.isNotNull() & (a.col != "") if V.is_str(a.dtype) else a.col.isNotNull()
            parts.append(F.coalesce(there, F.lit(False)).cast("int"))
    return carry(args, sum(parts[1:], parts[0]).cast("long"), LONG)


@register("countnum", least=1, family="aggregate")
def countnum(*args: Val) -> Val:
    parts = [F.size(numbers(elements(a), bools=True).col) if V.is_array(a.dtype) else (a.col.isNotNull().cast("int") if V.is_num(a.dtype) or V.is_bool(a.dtype) else F.lit(0)) for a in args]
    return carry(args, sum(parts[1:], parts[0]).cast("long"), LONG)


def _mean(array: Val) -> Column:
    return F.coalesce(total(array.col.cast("array<double>"), DOUBLE) / F.nullif(F.size(array.col), F.lit(0)), F.lit(0.0))


@register("average", least=1, family="aggregate", keywords=("key",))
def average(*args: Val, key: Val | None = None) -> Val:
    g = gathered(args) if key is None else numbers(by_key(elements(args[0]), key))
    return carry([g], _mean(g), DOUBLE)


def _paired(a: Val, b: Val) -> Val:
    """array<struct<a, b>> of two lists, as long as the longer."""
    t = T.ArrayType(T.StructType([T.StructField("a", a.dtype.elementType), T.StructField("b", b.dtype.elementType)]))
    return carry([a, b], F.zip_with(a.col, b.col, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), t)


def _selected(area: Val, criterion: Val, sums: Val | None, key: Val | None) -> Val:
    rows = elements(area)
    tested = by_key(rows, key)
    values = elements(sums) if sums is not None else tested
    pairs = _paired(tested, values)
    hit = kept(pairs, lambda p: matches(field(p, "a"), criterion))
    out = numbers(mapped(hit, lambda p: field(p, "b")))
    return carry([out, criterion], out.col, out.dtype, F.size(tested.col) == F.size(values.col))


@register("sumif", least=2, most=4, family="aggregate", keywords=("key",))
def sumif(area: Val, criterion: Val, sums: Val | None = None, key: Val | None = None) -> Val:
    s = _selected(area, criterion, sums, key)
    return carry([s], total(s.col, s.dtype.elementType), s.dtype.elementType)


@register("averageif", least=2, most=3, family="aggregate")
def averageif(area: Val, criterion: Val, sums: Val | None = None) -> Val:
    s = _selected(area, criterion, sums, None)
    return carry([s], _mean(s), DOUBLE)


@register("countif", least=2, most=3, family="aggregate", keywords=("key",))
def countif(area: Val, criterion: Val, key: Val | None = None) -> Val:
    rows = by_key(elements(area), key)
    return carry([rows, criterion], F.size(kept(rows, lambda x: matches(x, criterion)).col).cast("long"), LONG)


def _pairs(args: tuple[Val, ...], name: str) -> list[tuple[Val, Val]]:
    if len(args) % 2:
        raise ArgumentError(f"{name} takes pairs of range and criterion")
    return [(elements(a), c) for a, c in zip(args[::2], args[1::2], strict=True)]


@register("sumifs", least=3, family="aggregate")
def sumifs(sums: Val, *args: Val) -> Val:
    """A range shorter than the sums doesn't test the rest."""
    values, pairs = elements(sums), _pairs(args, "sumifs")

    def keep(x: Column, i: Column) -> Column:
        ok = F.lit(True)
        for area, criterion in pairs:
            ok = ok & F.when(i < F.size(area.col), matches(item(area, F.get(area.col, i)), criterion)).otherwise(F.lit(True))
        return ok

    hit = numbers(Val(F.filter(values.col, keep), values.dtype, values.ok, values.zero))
    return carry([hit, *(a for a, _ in pairs), *(c for _, c in pairs)], total(hit.col, hit.dtype.elementType), hit.dtype.elementType)


@register("countifs", family="aggregate")
def countifs(*args: Val) -> Val:
    """A range shorter than the first doesn't match there."""
    pairs = _pairs(args, "countifs")
    if not pairs:
        return V.lit(0)

    def keep(x: Column, i: Column) -> Column:
        ok = F.lit(True)
        for area, criterion in pairs:
            ok = ok & F.when(i < F.size(area.col), matches(item(area, F.get(area.col, i)), criterion)).otherwise(F.lit(False))
        return ok

    return carry([*(a for a, _ in pairs), *(c for _, c in pairs)], F.size(F.filter(pairs[0][0].col, keep)).cast("long"), LONG)


@register("sum_by_type", least=4, most=5, family="aggregate")
def sum_by_type(items: Val, type_at: Val, value_at: Val, target: Val, trace: Val | None = None) -> Val:
    from ledgerloom.functions.logic import equal

    rows = elements(items)
    hit = kept(rows, lambda r: equal(field(r, type_at), target))
    found = numbers(mapped(hit, lambda r: field(r, value_at)), bools=True)
    return carry([found, target], total(found.col.cast("array<double>"), DOUBLE), DOUBLE)


def _first_per_key(rows: Val, key: Val, value: Val) -> Val:
    """The values of the rows that are the first with their key."""
    keys = mapped(rows, lambda r: field(r, key))
    col = F.filter(rows.col, lambda r, i: F.array_position(F.transform(keys.col, lambda k: F.coalesce(k.cast("string"), F.lit("\0"))), F.coalesce(field(item(rows, r), key).col.cast("string"), F.lit("\0"))) == i + 1)
    return numbers(mapped(Val(col, rows.dtype, rows.ok, rows.zero), lambda r: field(r, value)), bools=True)


@register("unique_key_sum_by_type", least=5, most=5, family="aggregate")
def unique_key_sum_by_type(items: Val, key_at: Val, type_at: Val, value_at: Val, target: Val) -> Val:
    from ledgerloom.functions.logic import equal

    rows = kept(elements(items), lambda r: equal(field(r, type_at), target))
    found = _first_per_key(rows, key_at, value_at)
    return carry([found, target], total(found.col.cast("array<double>"), DOUBLE), DOUBLE)


@register("unique_sum", least=3, most=3, family="aggregate")
def unique_sum(items: Val, key_at: Val, value_at: Val) -> Val:
    found = _first_per_key(elements(items), key_at, value_at)
    return carry([found], total(found.col.cast("array<double>"), DOUBLE), DOUBLE)


@register("unique", least=1, most=2, family="aggregate", keywords=("key",))
def unique(data: Val, key: Val | None = None) -> Val:
    """Distinct elements, sorted by their text (the deterministic order)."""
    rows = by_key(elements(data), key)
    t = rows.dtype.elementType
    pairs = F.array_sort(F.transform(F.array_distinct(rows.col), lambda x: F.struct(F.coalesce(V.text(V.from_column(x, t)), F.lit("None")).alias("k"), x.alias("v"))))
    return carry([rows], F.transform(pairs, lambda p: p["v"]), rows.dtype)


@register("count_unique", least=1, most=2, family="aggregate", keywords=("key",))
def count_unique(data: Val, key: Val | None = None) -> Val:
    rows = by_key(elements(data), key)
    return carry([rows], F.size(F.array_distinct(rows.col)).cast("long"), LONG)


@register("flatten", least=1, most=1, family="array")
def flatten(data: Val) -> Val:
    v = elements(data)
    col, t = v.col, v.dtype
    while V.is_array(t.elementType):
        col, t = F.flatten(F.filter(col, lambda x: x.isNotNull())), t.elementType
    return carry([v], col, t)


def _grouped(data: Val, key: Val, value: Val | None, of, dtype: T.DataType, drop_empty: bool) -> Val:
    rows = elements(data)
    keys = mapped(rows, lambda r: field(r, key))
    kt = keys.dtype.elementType
    distinct = F.array_distinct(F.filter(keys.col, lambda k: k.isNotNull()))

    def entry(k: Column) -> Column:
        own = Val(F.filter(rows.col, lambda r: field(item(rows, r), key).col == k), rows.dtype)
        vals = numbers(mapped(own, lambda r: field(r, value)), bools=True) if value is not None else own
        return F.struct(k.alias("key"), of(vals).cast(dtype).alias("value"))

    entries = F.transform(distinct, entry)
    if drop_empty:
        entries = F.filter(entries, lambda e: e["value"].isNotNull())
    return carry([rows], F.map_from_entries(entries), T.MapType(kt, dtype))


@register("group_sum", "group_by_sum", least=3, most=3, family="group")
def group_sum(data: Val, key: Val, value: Val) -> Val:
    return _grouped(data, key, value, lambda v: total(v.col.cast("array<double>"), DOUBLE), DOUBLE, False)


@register("group_count", "group_by_count", least=2, most=2, family="group")
def group_count(data: Val, key: Val) -> Val:
    return _grouped(data, key, None, lambda v: F.size(v.col), LONG, False)


@register("group_avg", least=3, most=3, family="group")
def group_avg(data: Val, key: Val, value: Val) -> Val:
    return _grouped(data, key, value, lambda v: total(v.col.cast("array<double>"), DOUBLE) / F.nullif(F.size(v.col), F.lit(0)), DOUBLE, True)


@register("sum_dict", least=1, most=1, family="group")
def sum_dict(data: Val) -> Val:
    if isinstance(data.dtype, T.StructType):
        parts = [F.coalesce(data.col.getField(f.name).cast("double"), F.lit(0.0)) for f in data.dtype.fields if V.is_num(f.dataType)]
        return carry([data], sum(parts[1:], parts[0]) if parts else F.lit(0.0), DOUBLE)
    if not isinstance(data.dtype, T.MapType):
        return carry([data], F.lit(0.0), DOUBLE)
    n = numbers(elements(data))
    return carry([n], total(n.col.cast("array<double>"), DOUBLE), DOUBLE)


@register("any", least=1, most=1, family="aggregate")
def any_(data: Val) -> Val:
    e = elements(data)
    return carry([e], F.exists(e.col, lambda x: V.truthy(item(e, x))), BOOL)


@register("all", least=1, most=1, family="aggregate")
def all_(data: Val) -> Val:
    e = elements(data)
    return carry([e], F.forall(e.col, lambda x: V.truthy(item(e, x))), BOOL)


@register("list", "tuple", least=1, most=1, family="array")
def list_(data: Val) -> Val:
    return elements(data)


@register("len", "length", least=1, most=1, family="array")
def len_(x: Val) -> Val:
    if V.is_str(x.dtype):
        return carry([x], F.length(x.col).cast("long"), LONG, x.col.isNotNull())
    if isinstance(x.dtype, T.MapType):
        return carry([x], F.size(x.col).cast("long"), LONG, x.col.isNotNull())
    e = elements(x)
    return carry([e], F.size(e.col).cast("long"), LONG)


@register("zip", least=1, family="array")
def zip_(*args: Val) -> Val:
    arrays = [elements(a) for a in args]
    n = F.least(*[F.size(a.col) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0].col)
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[F.get(a.col, i).alias(f"_{k + 1}") for k, a in enumerate(arrays)]))
    t = T.StructType([T.StructField(f"_{k + 1}", a.dtype.elementType) for k, a in enumerate(arrays)])
    return carry(arrays, F.when(n > 0, made).otherwise(F.array().cast(T.ArrayType(t))), T.ArrayType(t))


