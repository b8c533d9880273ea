"""Named tables for bindings, and joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import BindingError, did_you_mean

#: A dimension is broadcast if a count shows at most so many rows; beyond it, joins are shuffled.
BROADCAST_ROWS = 200_000


@dataclass
class Catalog:
    """tables: name to DataFrame or to a Parquet path. order: a table's row order, where "first" and
    "last" need one (name to column names; `-name` descending)."""

    spark: SparkSession
    tables: Mapping[str, DataFrame | str]
    keys: Mapping[str, str] = field(default_factory=dict)
    order: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    settings: Mapping[str, object] = field(default_factory=dict)
    session: Mapping[str, object] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., Column]] = field(default_factory=dict)
    links: Mapping[tuple[str, str], str] = field(default_factory=dict)
    _small: dict[str, bool] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise BindingError(f"unknown table {name!r}{did_you_mean(name, self.tables)}")
        t = self.tables[name]
        return self.spark.read.parquet(t) if isinstance(t, str) else t

    def key(self, name: str) -> str:
        return self.keys.get(name, "name")

    def ordinal(self, name: str, df: DataFrame) -> Column:
        """What decides which of several rows is the first: the declared order, else all columns."""
        cols = self.order.get(name) or tuple(c for c, t in df.dtypes if not t.startswith(("map", "variant")))
        return F.struct(*[_sortable(F.col(c.lstrip("-")), dict(df.dtypes)[c.lstrip("-")], c.startswith("-")).alias(f"o{k}") for k, c in enumerate(cols)])

    def is_small(self, name: str, rows: int = BROADCAST_ROWS) -> bool:
        if name not in self._small:
            self._small[name] = self.table(name).limit(rows + 1).count() <= rows
        return self._small[name]

    def sized(self, name: str, df: DataFrame) -> DataFrame:
        """df, made of table `name` with no more rows than that, as a join's right side."""
        return F.broadcast(df) if self.is_small(name) else df


def _sortable(c: Column, dtype: str, descending: bool) -> Column:
    if not descending:
        return c
    if dtype in ("timestamp", "date"):
        return -F.unix_micros(c.cast("timestamp"))
    if dtype == "string":
        raise BindingError("a descending order needs numbers, dates or timestamps")
    return -c
