"""Structured Streaming forms: formulas on streams, calendar buckets with watermarks, incremental
recomputation and recurrences with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.timebuckets import bounds, index_of
from ledgerloom.plans.engine import FormulaEngine


def apply_stream(engine: FormulaEngine, stream: DataFrame, **options) -> DataFrame:
    """Formulas are projections, so they run on a stream as they do on a table."""
    return engine.apply(stream, **options)


def bucket_totals(stream: DataFrame, time: str, value: str, kind: str, *, by: list[str] | None = None) -> DataFrame:
    """Sum and count for each calendar bucket, late rows included, for output mode update or
    complete. State is a row for each bucket and `by` value, a few a year."""
    day = F.col(time).cast("date")
    start = bounds(kind, index_of(day, kind), F.year(day))[0]
    return stream.groupBy(*(by or []), start.alias("bucket_start")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def daily_totals(stream: DataFrame, time: str, value: str, *, lateness: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """Sum and count for each day, for output mode append: a day is written once, when the watermark
    has passed it, and its state is dropped; rows over `lateness` late are left out."""
    late = stream.withWatermark(time, lateness)
    return late.groupBy(F.window(time, "1 day"), *(by or [])).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def incremental_sink(engine: FormulaEngine, key: str, order: str, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the row of each key that is greatest by `order`, with its formulas, under a
    folder of the batch's own, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("__r")).select("__r.*")
        engine.apply(newest).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def running_balance(stream: DataFrame, key: str, time: str, value: str, lateness: str = "10 minutes") -> DataFrame:
    """(key, time, value, balance): the recurrence balance = previous balance + value with state by
    key, in event-time order within each batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, {time} timestamp, {value} double, balance double"

    def step(group, parts: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        before = state.get[0] if state.exists else 0.0
        rows["balance"] = before + rows[value].fillna(0.0).cumsum()
        state.update((float(rows["balance"].iloc[-1]),))
        yield rows[[key, time, value, "balance"]]

    late = stream.select(key, F.col(time).cast("timestamp").alias(time), F.col(value).cast("double").alias(value)).withWatermark(time, lateness)
    return late.groupBy(key).applyInPandasWithState(step, schema, "balance double", "append", GroupStateTimeout.NoTimeout)
