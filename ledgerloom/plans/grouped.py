"""Aggregates over the rows of tables: what functions.aggregates does over lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.expr import values as V
from ledgerloom.expr.criteria import matches
from ledgerloom.functions.lookup import rank_key


def _test(df: DataFrame, column: str, criterion) -> Column:
    return matches(V.from_column(F.col(f"`{column}`"), df.schema[column].dataType), V.lit(criterion))


def _number(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("double") if isinstance(df.schema[column].dataType, T.NumericType) else F.lit(None).cast("double")


def sumifs(df: DataFrame, by: list[str], value: str, criteria: dict[str, object], out: str = "sumifs") -> DataFrame:
    hit = F.lit(True)
    for c, k in criteria.items():
        hit = hit & _test(df, c, k)
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(hit, _number(df, value))), F.lit(0.0)).alias(out))


def countifs(df: DataFrame, by: list[str], criteria: dict[str, object], out: str = "countifs") -> DataFrame:
    hit = F.lit(bool(criteria))
    for c, k in criteria.items():
        hit = hit & _test(df, c, k)
    return df.groupBy(*by).agg(F.count_if(hit).alias(out))


def averageif(df: DataFrame, by: list[str], column: str, criterion, value: str, out: str = "averageif") -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(_test(df, column, criterion), _number(df, value))), F.lit(0.0)).alias(out))


def group_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """Null keys are dropped; a group without numbers has 0.0."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(_number(df, value)), F.lit(0.0)).alias("group_sum"))


def group_count(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("group_count"))


def group_avg(df: DataFrame, key: str, value: str) -> DataFrame:
    """Groups without numbers are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(_number(df, value)).alias("group_avg")).filter(F.col("group_avg").isNotNull())


def unique_sum(df: DataFrame, by: list[str], key: str, value: str, order_by: list[str], out: str = "unique_sum") -> DataFrame:
    """Sum of the first value of each key."""
    firsts = df.groupBy(*by, key).agg(F.min_by(_number(df, value), F.struct(*order_by)).alias("__v"))
    return firsts.groupBy(*by).agg(F.coalesce(F.sum("__v"), F.lit(0.0)).alias(out))


def pick(df: DataFrame, by: list[str], sort_by: str, n: int = 1, *, last: bool = True, ties: list[str] | None = None) -> DataFrame:
    """The n last (or first) rows of each group, by kind of value and value; `position` from 1."""
    key = rank_key(V.from_column(F.col(sort_by), df.schema[sort_by].dataType))
    order = [key.desc() if last else key.asc(), *[F.col(t) for t in ties or []]]
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("position") <= n)


def running(df: DataFrame, by: list[str], order_by: list[str], value: str, out: str = "balance", initial: float = 0.0) -> DataFrame:
    """The recurrence out = previous out + value, as a running sum."""
    w = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.lit(initial) + F.sum(F.coalesce(_number(df, value), F.lit(0.0))).over(w))
