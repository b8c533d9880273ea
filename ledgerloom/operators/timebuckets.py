"""Calendar buckets: years, halves, quarters, months and weeks, as columns and as a dimension."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Label presets and type names.
TB_FORMAT = {
    "short": "{type_short}{index}", "short_year": "{type_short}{index}-{year}", "short_year2": "{type_short}{index}-{year2}", "full": "{type_full} {index} {year}",
    "slash_year": "{type_short}{index}/{year}", "slash_year2": "{type_short}{index}/{year2}", "padded": "{type_short}{index02}", "padded_year": "{type_short}{index02}-{year}",
    "date_range": "{from_date} → {to_date}",
}
TYPES = ("year", "half", "quarter", "month", "week")
SHORT = {"year": "Y", "half": "H", "quarter": "Q", "month": "M", "week": "W"}
PER_YEAR = {"year": 1, "half": 2, "quarter": 4, "month": 12}


def first_week(year: Column, week_start: str = "monday") -> Column:
    """First day of a year's week 1: Monday weeks start with the one that holds January 4, Sunday
    weeks with the one that holds January 1."""
    if week_start == "sunday":
        at = F.make_date(year, F.lit(1), F.lit(1))
        return F.date_sub(at, F.dayofweek(at) - 1)
    at = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_sub(at, F.weekday(at))


def index_of(day: Column, kind: str, week_start: str = "monday") -> Column:
    """Index of the bucket that holds a day, in the day's own calendar year; null where there is
    none (days before the first week). Years have index 0."""
    if kind == "year":
        return F.when(day.isNotNull(), F.lit(0))
    if kind == "half":
        return F.floor((F.month(day) - 1) / 6).cast("int") + 1
    if kind == "quarter":
        return F.quarter(day)
    if kind == "month":
        return F.month(day)
    n = F.floor(F.datediff(day, first_week(F.year(day), week_start)) / 7).cast("int") + 1
    return F.when(n >= 1, n)


def bounds(kind: str, index: Column, year: Column, week_start: str = "monday") -> tuple[Column, Column]:
    """First and last day of a bucket."""
    if kind == "week":
        start = F.date_add(first_week(year, week_start), ((index - 1) * 7).cast("int"))
        return start, F.date_add(start, 6)
    months = 12 // PER_YEAR[kind]
    start = F.make_date(year, ((F.lit(0) if kind == "year" else index - 1) * months + 1).cast("int"), F.lit(1))
    return start, F.date_sub(F.add_months(start, months), 1)


def weeks_in(year: Column, week_start: str = "monday") -> Column:
    last = F.make_date(year, F.lit(12), F.lit(31))
    return F.floor(F.datediff(last, first_week(year, week_start)) / 7).cast("int") + 1


def name_of(kind: str, index: Column, year: Column) -> Column:
    return F.concat(F.lit("Y"), year.cast("string")) if kind == "year" else F.concat(F.lit(SHORT[kind]), index.cast("string"))


def label_of(kind: str, index: Column, year: Column, fmt: str, week_start: str = "monday") -> Column:
    """A label from a preset or a pattern of {year} {year2} {index} {index02} {type_short}
    {type_full} {from_date} {to_date}."""
    start, end = bounds(kind, index, year, week_start)
    tokens = {
        "{year}": year.cast("string"), "{year2}": F.right(year.cast("string"), F.lit(2)), "{index}": index.cast("string"), "{index02}": F.lpad(index.cast("string"), 2, "0"),
        "{type_short}": F.lit(SHORT[kind]), "{type_full}": F.lit(kind.capitalize()), "{from_date}": start.cast("string"), "{to_date}": end.cast("string"),
    }
    pieces = [x for x in re.split(r"(\{\w+\})", TB_FORMAT.get(fmt, fmt)) if x]
    return F.concat(*[tokens.get(x, F.lit(x)) for x in pieces]) if pieces else F.lit("")


def bucket(kind: str, index: Column, year: Column, week_start: str = "monday", short: str = "short", full: str = "full") -> Column:
    """A bucket as a struct: name, short_label, full_label, type, index, year, from_date, to_date,
    prev_name, next_name (of another year with @year)."""
    pair = F.struct(index.cast("int").alias("index"), year.cast("int").alias("year"))
    return _let(pair, lambda p: _bucket(kind, p["index"], p["year"], week_start, short, full))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bucket(kind: str, index: Column, year: Column, week_start: str, short: str, full: str) -> Column:
    start, end = bounds(kind, index, year, week_start)
    if kind == "year":
        before, after = F.concat(F.lit("Y"), (year - 1).cast("string")), F.concat(F.lit("Y"), (year + 1).cast("string"))
    else:
        n, m = (weeks_in(year, week_start), weeks_in(year - 1, week_start)) if kind == "week" else (F.lit(PER_YEAR[kind]), F.lit(PER_YEAR[kind]))
        s = F.lit(SHORT[kind])
        before = F.when(index > 1, F.concat(s, (index - 1).cast("string"))).otherwise(F.concat(s, m.cast("string"), F.lit("@"), (year - 1).cast("string")))
        after = F.when(index < n, F.concat(s, (index + 1).cast("string"))).otherwise(F.concat(s, F.lit("1@"), (year + 1).cast("string")))
    return F.struct(
        name_of(kind, index, year).alias("name"), label_of(kind, index, year, "{year}" if kind == "year" and short == "short" else short, week_start).alias("short_label"),
        label_of(kind, index, year, full, week_start).alias("full_label"), F.lit(kind).alias("type"), index.cast("int").alias("index"), year.cast("int").alias("year"),
        start.alias("from_date"), end.alias("to_date"), before.alias("prev_name"), after.alias("next_name"),
    )


def calendar(spark: SparkSession, years, types=TYPES, week_start: str = "monday", short: str = "short", full: str = "full") -> DataFrame:
    """All buckets of some years, one row each: the calendar dimension."""
    base = spark.createDataFrame([(int(y),) for y in years], "year int")
    parts = []
    for kind in types:
        n = F.lit(1) if kind == "year" else weeks_in(F.col("year"), week_start) if kind == "week" else F.lit(PER_YEAR[kind])
        indexes = base.select("year", F.explode(F.array(F.lit(0)) if kind == "year" else F.sequence(F.lit(1), n)).alias("index"))
        parts.append(indexes.select(bucket(kind, F.col("index"), F.col("year"), week_start, short, full).alias("b")).select("b.*"))
    return reduce(DataFrame.unionByName, parts)


def with_bucket(df: DataFrame, day: str, kind: str, out: str = "bucket", week_start: str = "monday") -> DataFrame:
    """df with the bucket that holds a day as a struct column; null where there is none."""
    d = F.col(day).cast("date")
    index = index_of(d, kind, week_start)
    return df.withColumn(out, F.when(index.isNotNull(), bucket(kind, index, F.year(d), week_start)))


def shifted(kind: str, index: Column, year: Column, steps: Column, week_start: str = "monday") -> tuple[Column, Column]:
    """(index, year) so many buckets later. Weeks step by seven days from one week to the next, so a
    week that two years share is stepped over once."""
    if kind == "week":
        day = F.date_add(bounds("week", index, year, week_start)[0], (steps * 7).cast("int"))
        middle = F.date_add(day, 3)
        y = F.year(middle)
        return F.floor(F.datediff(day, first_week(y, week_start)) / 7).cast("int") + 1, y
    if kind == "year":
        return index, year + steps
    n = F.lit(PER_YEAR[kind])
    at = year * n + index - 1 + steps
    y = F.floor(at / n).cast("int")
    return (at - y * n + 1).cast("int"), y


def period_offset(df: DataFrame, column: str, steps: int | Column, out: str, week_start: str = "monday") -> DataFrame:
    """df with the bucket so many periods after the one in `column` (a bucket struct)."""
    return df.withColumn(out, offset_column(F.col(column), F.lit(steps) if isinstance(steps, int) else steps, week_start))


def offset_column(b: Column, steps: Column, week_start: str = "monday") -> Column:
    def moved(x: Column) -> Column:
        made = None
        for kind in TYPES:
            i, y = shifted(kind, x["b"]["index"], x["b"]["year"], x["n"], week_start)
            one = bucket(kind, i, y, week_start)
            made = F.when(x["b"]["type"] == kind, one) if made is None else made.when(x["b"]["type"] == kind, one)
        return made

    return _let(F.struct(b.alias("b"), steps.alias("n")), moved)


def same_period_last_year(df: DataFrame, column: str, out: str, years: int = 1, week_start: str = "monday") -> DataFrame:
    """The same period so many years before; weeks go back 52 a year."""
    return df.withColumn(out, same_period_column(F.col(column), years, week_start))


def same_period_column(b: Column, years: int = 1, week_start: str = "monday") -> Column:
    def steps(x: Column) -> Column:
        n = F.when(x["type"] == "week", -52 * years)
        for kind, per in PER_YEAR.items():
            n = n.when(x["type"] == kind, -per * years)
        return n

    return _let(b, lambda x: offset_column(x, steps(x), week_start))


#: The shapes in which a flat list of buckets is asked for, new name to bucket field.
SHAPES = {
    "ui": {"value": "name", "label": "short_label", "short_label": "short_label", "full_label": "full_label", "from_date": "from_date", "to_date": "to_date"},
    "filter": {"period": "name", "from_date": "from_date", "to_date": "to_date"},
    "entry": {"period": "name", "period_label": "short_label", "period_full": "full_label", "from_date": "from_date", "to_date": "to_date", "year": "year", "index": "index"},
}


def shaped(buckets: DataFrame, shape: str) -> DataFrame:
    """A calendar() in one of SHAPES."""
    return buckets.select(*[F.col(c).alias(n) for n, c in SHAPES[shape].items()])
