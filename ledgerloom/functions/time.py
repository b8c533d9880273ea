"""Time-bucket functions of the formula language. A bucket is a struct, a list of them an array."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ArgumentError
from ledgerloom.expr import values as V
from ledgerloom.expr.values import BOOL, DATE, STRING, Val, carry, number
from ledgerloom.functions.dates import as_date
from ledgerloom.functions.registry import CONSTANTS, register
from ledgerloom.operators import timebuckets as B

CONSTANTS["TB_FORMAT"] = B.TB_FORMAT
_FIELDS = (("name", STRING), ("short_label", STRING), ("full_label", STRING), ("type", STRING), ("index", T.IntegerType()), ("year", T.IntegerType()), ("from_date", DATE), ("to_date", DATE), ("prev_name", STRING), ("next_name", STRING))
BUCKET = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")


def _kind(v: Val | None, default: str = "month") -> str:
    kind = str(v.const).lower() if v is not None and v.is_const else default
    if kind not in B.TYPES:
        raise ArgumentError(f"unknown bucket type {kind!r}")
    return kind


def _all(kind: str, year):
    y = year.cast("int")
    n = F.lit(0) if kind == "year" else B.weeks_in(y) if kind == "week" else F.lit(B.PER_YEAR[kind])
    return F.transform(F.sequence(F.lit(0 if kind == "year" else 1), n), lambda i: B.bucket(kind, i, y))


@register("time_buckets", least=1, most=2, family="time")
def time_buckets(year: Val, kind: Val | None = None) -> Val:
    y = number(year)
    return carry([y], _all(_kind(kind), y.col), T.ArrayType(BUCKET))


@register("year_buckets", least=1, most=3, family="time")
def year_buckets(year: Val, offset: Val | None = None, types: Val | None = None) -> Val:
    y, k = number(year), number(offset) if offset is not None else V.lit(0)
    kinds = [t.strip() for t in str(types.const).split(",")] if types is not None and types.is_const else list(B.TYPES)
    return carry([y, k], F.concat(*[_all(t, y.col + k.col) for t in kinds]), T.ArrayType(BUCKET))


@register("in_time_bucket", least=2, most=2, family="time")
def in_time_bucket(day: Val, bucket: Val) -> Val:
    d = as_date(day, _FORMATS)
    return carry([day, bucket], F.coalesce(d.between(bucket.col["from_date"], bucket.col["to_date"]), F.lit(False)), BOOL)


@register("get_bucket_label", least=1, most=3, family="time")
def get_bucket_label(day: Val, kind: Val | None = None, label: Val | None = None) -> Val:
    d, k = as_date(day, _FORMATS), _kind(kind)
    index = B.index_of(d, k)
    which = str(label.const) if label is not None and label.is_const else "short_label"
    made = B.bucket(k, index, F.year(d))
    field = {"label": "short_label", "short": "short_label", "full": "full_label", "value": "name"}.get(which, which)
    return carry([day], F.when(index.isNotNull(), made[field].cast("string")), STRING)


@register("get_period", least=3, most=3, family="time")
def get_period(kind: Val, index: Val, year: Val) -> Val:
    k, i, y = _kind(kind), number(index), number(year)
    n = F.lit(0) if k == "year" else B.weeks_in(y.col.cast("int")) if k == "week" else F.lit(B.PER_YEAR[k])
    inside = F.lit(True) if k == "year" else (i.col >= 1) & (i.col <= n)
    return carry([i, y], F.when(inside, B.bucket(k, (F.lit(0) if k == "year" else i.col).cast("int"), y.col.cast("int"))), BUCKET)


@register("period_offset", least=2, most=2, family="time")
def period_offset(bucket: Val, steps: Val) -> Val:
    n = number(steps)
    return carry([bucket, n], B.offset_column(bucket.col, n.col.cast("int")), BUCKET)


@register("same_period_last_year", least=1, most=2, family="time")
def same_period_last_year(bucket: Val, years: Val | None = None) -> Val:
    return carry([bucket], B.same_period_column(bucket.col, int(years.const) if years is not None else 1), BUCKET)
