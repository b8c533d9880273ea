"""Array views of values, shared by the aggregate and look-up functions.

Lists are ARRAY columns. A map counts as the list of its values. Null elements are skipped by the
numeric aggregates, as are elements of a type that isn't numeric.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ArgumentError, TypeMismatchError
from ledgerloom.expr import values as V
from ledgerloom.expr.values import DOUBLE, Val, carry


def elements(v: Val) -> Val:
    """v as an array value; null counts as an empty list."""
    if isinstance(v.dtype, T.MapType):
        v = Val(F.map_values(v.col), T.ArrayType(v.dtype.valueType), v.ok, v.zero)
    if V.is_null(v.dtype):
        return Val(F.array().cast("array<double>"), T.ArrayType(DOUBLE), v.ok, v.zero)
    if not V.is_array(v.dtype):
        raise TypeMismatchError(f"a list is needed, not {v.dtype.simpleString()}")
    return Val(F.coalesce(v.col, F.array().cast(v.dtype)), v.dtype, v.ok, v.zero)


def item(array: Val, element: Column) -> Val:
    return V.from_column(element, array.dtype.elementType)


def field(row: Val, key: Val | str | int) -> Val:
    """row[key] for structs (by name or position) and maps; null where it is absent."""
    name = key.const if isinstance(key, Val) and key.is_const else key
    if isinstance(row.dtype, T.StructType):
        fields = row.dtype.fields
        if isinstance(name, bool) or isinstance(name, Val):
            raise ArgumentError("a field's name or position must be a constant")
        if isinstance(name, int):
            at = name if name >= 0 else len(fields) + name
            if not 0 <= at < len(fields):
                return V.lit(None)
            return V.from_column(row.col.getField(fields[at].name), fields[at].dataType)
        for f in fields:
            if f.name == name:
                return V.from_column(row.col.getField(f.name), f.dataType)
        return V.lit(None)
    if isinstance(row.dtype, T.MapType):
        k = key.col if isinstance(key, Val) else F.lit(key)
        return V.from_column(F.try_element_at(row.col, k.cast(row.dtype.keyType)), row.dtype.valueType)
    if V.is_array(row.dtype):
        if isinstance(name, int) and not isinstance(name, bool):
            return V.from_column(F.try_element_at(row.col, F.lit(name + 1 if name >= 0 else name)), row.dtype.elementType)
        if isinstance(key, Val) and V.is_num(key.dtype):
            k = key.col.cast("int")
            return V.from_column(F.when(k >= 0, F.get(row.col, k)).otherwise(F.get(row.col, F.size(row.col) + k)), row.dtype.elementType)
    return V.lit(None)


def mapped(array: Val, body: Callable[[Val], Val]) -> Val:
    """The array of body(element); its type is found by building the body once."""
    kind: list[T.DataType] = []

    def run(x: Column) -> Column:
        got = body(item(array, x))
        kind.append(got.dtype)
        return got.col

    col = F.transform(array.col, run)
    return Val(col, T.ArrayType(kind[0] if not V.is_null(kind[0]) else T.StringType()), array.ok, array.zero)


def kept(array: Val, test: Callable[[Val], Column]) -> Val:
    return Val(F.filter(array.col, lambda x: test(item(array, x))), array.dtype, array.ok, array.zero)


def by_key(array: Val, key: Val | None) -> Val:
    return array if key is None else mapped(array, lambda r: field(r, key))


def numbers(array: Val, bools: bool = False) -> Val:
    """Non-null numeric elements, or none if the elements aren't numeric."""
    t = array.dtype.elementType
    if V.is_num(t) or (bools and V.is_bool(t)):
        target = "long" if V.is_int(t) or V.is_bool(t) else "double"
        out = V.LONG if target == "long" else DOUBLE
        return Val(F.transform(F.filter(array.col, lambda x: x.isNotNull()), lambda x: x.cast(target)), T.ArrayType(out), array.ok, array.zero)
    return Val(F.filter(F.array().cast("array<long>"), lambda x: x.isNotNull()), T.ArrayType(V.LONG), array.ok, array.zero)


def total(array: Column, dtype: T.DataType) -> Column:
    zero = F.lit(0).cast(dtype)
    return F.aggregate(array, zero, lambda acc, x: acc + x)


def gathered(args: tuple[Val, ...]) -> Val:
    """Scalars and lists mixed, flattened one level, as one array of numbers."""
    parts = []
    for a in args:
        if V.is_array(a.dtype) or isinstance(a.dtype, T.MapType) or (V.is_null(a.dtype) and len(args) == 1):
            parts.append(numbers(elements(a)))
        elif V.is_num(a.dtype):
            parts.append(Val(F.array_compact(F.array(a.col)), T.ArrayType(a.dtype), a.ok, a.zero))
        elif len(args) == 1:
            raise TypeMismatchError(f"a list or number is needed, not {a.dtype.simpleString()}")
        else:
            parts.append(Val(F.array().cast("array<long>"), T.ArrayType(V.LONG), a.ok, a.zero))
    dtype = reduce(V.unify, (p.dtype.elementType for p in parts))
    cols = [p.col.cast(T.ArrayType(dtype)) for p in parts]
    return carry(parts, cols[0] if len(cols) == 1 else F.concat(*cols), T.ArrayType(dtype))
