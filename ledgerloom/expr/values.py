"""Compiled values: a column, the condition under which it is defined, and its static type."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import TypeMismatchError

LONG, DOUBLE, STRING, BOOL, DATE, TIMESTAMP, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.NullType()
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MISSING = object()


@dataclass(frozen=True)
class Val:
    """ok: None if the value is always defined. zero: where a division by zero happened. const: the
    Python value of a literal."""

    col: Column
    dtype: T.DataType
    ok: Column | None = None
    zero: Column | None = None
    const: object = MISSING

    @property
    def is_const(self) -> bool:
        return self.const is not MISSING

    def need(self, condition: Column) -> Val:
        return replace(self, ok=both(self.ok, condition), const=MISSING)


def both(*conditions: Column | None) -> Column | None:
    real = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, real) if real else None


def either(*conditions: Column | None) -> Column | None:
    real = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, real) if real else None


def carry(values, col: Column, dtype: T.DataType, *conditions: Column | None) -> Val:
    """A value made of others: defined where all of them are, and the conditions hold."""
    return Val(col, dtype, both(*(v.ok for v in values), *conditions), either(*(v.zero for v in values)))


def lit(value) -> Val:
    kinds = {bool: BOOL, int: LONG, float: DOUBLE, str: STRING, type(None): NULL}
    dtype = kinds.get(type(value))
    if dtype is None:
        raise TypeMismatchError(f"constant {value!r} has no column type")
    column = F.lit(value).cast(dtype) if value is not None else F.lit(None)
    return Val(column, dtype, const=value)


def from_column(column: Column, dtype: T.DataType) -> Val:
    if isinstance(dtype, _INTEGRAL) and not isinstance(dtype, T.LongType):
        return Val(column.cast("long"), LONG)
    if isinstance(dtype, (T.FloatType, T.DecimalType)):
        return Val(column.cast("double"), DOUBLE)
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return Val(column, STRING)
    if isinstance(dtype, T.TimestampNTZType):
        return Val(column.cast("timestamp"), TIMESTAMP)
    return Val(column, dtype)


def is_int(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL)


def is_num(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_str(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_bool(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def unify(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both branches of a conditional."""
    if a == b or is_null(b):
        return a
    if is_null(a):
        return b
    if (is_num(a) or is_bool(a)) and (is_num(b) or is_bool(b)):
        return LONG if (is_int(a) or is_bool(a)) and (is_int(b) or is_bool(b)) else DOUBLE
    if is_date(a) and is_date(b):
        return TIMESTAMP
    if is_array(a) and is_array(b):
        return T.ArrayType(unify(a.elementType, b.elementType))
    if isinstance(a, (T.StructType, T.MapType)) or isinstance(b, (T.StructType, T.MapType)) or is_array(a) or is_array(b):
        raise TypeMismatchError(f"{a.simpleString()} and {b.simpleString()} have no common type")
    return STRING


def cast(v: Val, dtype: T.DataType) -> Column:
    if v.dtype == dtype:
        return v.col
    if is_str(dtype):
        return text(v)
    return v.col.cast(dtype)


def number(v: Val) -> Val:
    """v as a number; bool counts as 0 and 1. NULL is an error operand."""
    if is_num(v.dtype):
        col = v.col
    elif is_bool(v.dtype):
        col = v.col.cast("long")
    elif is_null(v.dtype):
        return Val(F.lit(None).cast("long"), LONG, F.lit(False), v.zero)
    else:
        return Val(F.lit(None).cast("double"), DOUBLE, F.lit(False), v.zero)
    dtype = LONG if is_int(v.dtype) or is_bool(v.dtype) else DOUBLE
    return Val(col if v.dtype == dtype else col.cast(dtype), dtype, v.ok if v.is_const else both(v.ok, col.isNotNull()), v.zero, v.const if is_num(v.dtype) else MISSING)


def truthy(v: Val) -> Column:
    """Truth of a value: not null, zero, empty or false."""
    t = v.dtype
    if v.is_const:
        return F.lit(bool(v.const))
    if is_bool(t):
        return F.coalesce(v.col, F.lit(False))
    if is_num(t):
        return F.coalesce(v.col != 0, F.lit(False))
    if is_str(t):
        return F.coalesce(v.col != "", F.lit(False))
    if is_array(t) or isinstance(t, T.MapType):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def text(v: Val) -> Column:
    """str() of a value: True/False, floats with a point and no exponent in the usual range."""
    if is_str(v.dtype):
        return v.col
    if is_bool(v.dtype):
        return F.when(v.col, "True").when(~v.col, "False")
    if isinstance(v.dtype, T.DoubleType):
        plain = v.col.cast("string")
        size = F.abs(v.col)
        whole = F.concat(v.col.cast("decimal(38,0)").cast("string"), F.lit(".0"))
        small = F.regexp_replace(v.col.cast("decimal(38,18)").cast("string"), r"0+$", "")
        return F.when((size >= 1e7) & (size < 1e16) & (v.col == F.floor(v.col)), whole).when((size >= 1e-4) & (size < 1e-3), small).otherwise(plain)
    if isinstance(v.dtype, T.TimestampType):
        return F.date_format(v.col, "yyyy-MM-dd HH:mm:ss")
    return v.col.cast("string")
