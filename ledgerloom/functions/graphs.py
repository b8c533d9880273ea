"""Dependency order of a list of rows, as in a document's child table. Graphs that span rows of a
table are in operators.graph; these work on one value and cost the square of a list's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ArgumentError
from ledgerloom.expr import values as V
from ledgerloom.expr.values import Val, carry
from ledgerloom.functions.arrays import elements, field
from ledgerloom.functions.registry import register


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _listed(row: Val, key: Val, inner: Val | None) -> Column:
    """Ids that a row depends on: a list of ids, or with `inner` a list of records (or its JSON)."""
    got = field(row, key)
    none = F.array().cast("array<string>")
    if inner is None:
        if not V.is_array(got.dtype):
            raise ArgumentError("dependencies must be a list of ids")
        return F.coalesce(got.col.cast("array<string>"), none)
    if V.is_str(got.dtype):
        ids = F.transform(F.from_json(got.col, "array<map<string,string>>"), lambda m: m[inner.const])
    elif V.is_array(got.dtype):
        ids = F.transform(got.col, lambda x: field(V.from_column(x, got.dtype.elementType), inner).col.cast("string"))
    else:
        raise ArgumentError("dependencies must be a list of records or JSON text")
    return F.coalesce(F.filter(ids, lambda x: x.isNotNull()), none)


def _graph(rows: Val, key: Val, deps: Val, inner: Val | None) -> Column:
    """array<struct<r, needs array<int>>>: of equal ids the first row, with the positions of the rows
    it needs. Unknown ids, itself and repeats don't count."""
    element = rows.dtype.elementType
    of = lambda r: V.from_column(r, element)
    raw = F.transform(rows.col, lambda r: F.struct(F.coalesce(field(of(r), key).col.cast("string"), F.lit("")).alias("id"), _listed(of(r), deps, inner).alias("deps"), r.alias("r")))
    named = lambda all_: F.transform(all_, lambda n: n["id"])
    first = _let(raw, lambda a: _let(named(a), lambda ids: F.filter(a, lambda n, i: F.array_position(ids, n["id"]) == i + 1)))

    def linked(a: Column) -> Column:
        place = lambda ids, d: F.array_position(ids, d).cast("int") - 1
        return _let(named(a), lambda ids: F.transform(a, lambda n, i: F.struct(n["r"].alias("r"), F.array_distinct(F.filter(F.transform(n["deps"], lambda d: place(ids, d)), lambda p: (p >= 0) & (p != i))).alias("needs"))))

    return _let(first, linked)


def _indexes(a: Column) -> Column:
    return F.transform(a, lambda x, i: i)


def _by_need(a: Column) -> Column:
    """Rows in the order in which their needs are met, first come first; those of cycles at the end
    in the order of the list."""
    free = F.filter(F.transform(a, lambda n, i: F.when(F.size(n["needs"]) == 0, i)), lambda i: i.isNotNull())

    def step(order: Column, k: Column) -> Column:
        done = F.slice(order, F.lit(1), k + 1)
        met = lambda p: F.array_contains(F.get(a, p)["needs"], F.get(order, k)) & (F.size(F.array_except(F.get(a, p)["needs"], done)) == 0)
        return F.when(k < F.size(order), F.concat(order, F.filter(_indexes(a), met))).otherwise(order)

    return _let(F.aggregate(_indexes(a), free, step), lambda order: F.concat(order, F.array_except(_indexes(a), order)))


def _by_component(a: Column) -> Column:
    """Rows grouped by strongly connected component, needs before what needs them: what a component
    reaches is larger than what any of its needs reaches. Ties keep the order of the list."""
    start = F.transform(a, lambda n, i: F.array_union(F.array(i), n["needs"]))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a) + F.lit(1))).cast("int"))
    reach = F.aggregate(rounds, start, lambda s, k: F.transform(s, lambda own: F.array_distinct(F.flatten(F.transform(own, lambda q: F.get(s, q))))))
    keyed = lambda s: F.transform(s, lambda own, i: F.struct(F.size(own).alias("n"), F.array_min(F.filter(own, lambda q: F.array_contains(F.get(s, q), i))).alias("c"), i.alias("i")))
    return _let(reach, lambda s: F.transform(F.array_sort(keyed(s)), lambda e: e["i"]))


def _sorted(order, rows: Val, key: Val, deps: Val, inner: Val | None) -> Val:
    rows = elements(rows)
    if not isinstance(rows.dtype.elementType, T.StructType) or not all(v is None or v.is_const for v in (key, deps, inner)):
        raise ArgumentError("a dependency sort takes a list of records and constant field names")
    made = _let(_graph(rows, key, deps, inner), lambda a: F.transform(order(a), lambda p: F.get(a, p)["r"]))
    return carry([rows], made, rows.dtype)


@register("topo_sort_flat", least=3, most=3, family="graph")
def topo_sort_flat(rows: Val, key: Val, deps: Val) -> Val:
    return _sorted(_by_need, rows, key, deps, None)


@register("topo_sort_data", least=4, most=4, family="graph")
def topo_sort_data(rows: Val, key: Val, deps: Val, dep_key: Val) -> Val:
    return _sorted(_by_need, rows, key, deps, dep_key)


@register("scc_topo_sort_flat", least=3, most=3, family="graph")
def scc_topo_sort_flat(rows: Val, key: Val, deps: Val) -> Val:
    return _sorted(_by_component, rows, key, deps, None)


@register("scc_topo_sort_data", least=4, most=4, family="graph")
def scc_topo_sort_data(rows: Val, key: Val, deps: Val, dep_key: Val) -> Val:
    return _sorted(_by_component, rows, key, deps, dep_key)
