"""Global variables, and outputs of other formula sets, as inputs of formulas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import CircularReferenceError, FormulaError
from ledgerloom.plans.engine import FormulaEngine
from ledgerloom.sources import filters as fl
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.transform import cast_value

SOURCES = ("CONSTANT", "FORMULA", "DB_QUERY")
#: Spark types of the variables' data types.
TYPES = {"Int": "bigint", "Float": "double", "Currency": "double", "Percent": "double", "Check": "boolean", "Bool": "boolean"}


@dataclass(frozen=True)
class GlobalVariable:
    """source CONSTANT: value. FORMULA: formula over the constants. DB_QUERY: `column` of the first
    row of `table` that fits `filters` (equality; a value $name is another variable's)."""

    name: str
    source: str = "CONSTANT"
    value: object = None
    formula: str = ""
    table: str = ""
    column: str = ""
    filters: Mapping[str, object] = field(default_factory=dict)
    data_type: str | None = None
    is_active: bool = True


def global_values(variables: Iterable[GlobalVariable], catalog: Catalog, allowed: Iterable[str] = ()) -> dict[str, object]:
    """Name to value on the driver, one value each. Inactive variables are left out; one that fails,
    or whose table isn't in `allowed`, is None. A query is an aggregate that returns one row."""
    active = {v.name: v for v in variables if v.is_active}
    allowed, found, open_ = set(allowed), {}, []

    def typed(v: GlobalVariable, value):
        kind = TYPES.get(v.data_type or "")
        if value is None or kind is None:
            return value
        one = catalog.spark.range(1).select(F.lit(value).alias("v"))
        return one.select(cast_value(F.col("v"), one.schema["v"].dataType, v.data_type)).first()[0]

    def get(name: str):
        if name in found or name not in active:
            return found.get(name)
        if name in open_:
            raise CircularReferenceError("circular reference: " + " -> ".join([*open_[open_.index(name):], name]))
        open_.append(name)
        v = active[name]
        try:
            found[name] = _value(v, get, typed)
        except CircularReferenceError:
            raise
        except FormulaError:
            found[name] = None
        open_.pop()
        return found[name]

    def _value(v: GlobalVariable, get, typed):
        if v.source == "CONSTANT":
            return typed(v, v.value)
        if v.source == "FORMULA":
            others = {w.name: get(w.name) for w in active.values() if w.source == "CONSTANT" and w.name != v.name}
            row = catalog.spark.range(1).select(*[F.lit(x).alias(n) for n, x in others.items()])
            return FormulaEngine({"__g": v.formula}, on_error="null", zero_division_policy="allow").apply(row, keep_inputs=False).first()["__g"]
        if v.source != "DB_QUERY":
            raise FormulaError(f"a variable's source is one of {SOURCES}, not {v.source!r}")
        if v.table not in allowed:
            return None
        rows = catalog.table(v.table)
        for c, x in v.filters.items():
            wanted = get(x[1:]) if isinstance(x, str) and x.startswith("$") else x
            rows = rows.filter(fl.text_key(F.col(c)) == fl.text_key(F.lit(wanted)))
        return typed(v, rows.agg(F.min_by(v.column, catalog.ordinal(v.table, rows)).alias("v")).first()["v"])

    return {name: get(name) for name in active}


def with_globals(df: DataFrame, variables: Iterable[GlobalVariable], catalog: Catalog, allowed: Iterable[str] = ()) -> DataFrame:
    """df with a literal column for each global variable; a column of that name wins."""
    values = global_values(variables, catalog, allowed)
    return df.withColumns({n: F.lit(x) for n, x in values.items() if n not in df.columns})


def with_formula_sets(df: DataFrame, formulas: Mapping[str, str], sets: Mapping[str, Mapping[str, str]], **options) -> DataFrame:
    """df with a struct column for each set of `sets` that `formulas` read as `code.variable`. A set
    is computed over df's columns and the sets that it reads itself; unused outputs are pruned by the
    optimizer."""
    done = df.columns

    def add(df: DataFrame, formulas: Mapping[str, str], path: tuple[str, ...]) -> DataFrame:
        for code in sorted(FormulaEngine(formulas, **options).inputs & sets.keys() - set(done)):
            if code in path:
                raise CircularReferenceError("circular reference: " + " -> ".join([*path[path.index(code):], code]))
            if code in df.columns:
                continue
            df = add(df, sets[code], (*path, code))
            names = list(sets[code])
            out = FormulaEngine(sets[code], **options).apply(df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns])))
            df = out.select("__row.*", F.struct(*[F.col(f"`{n}`") for n in names]).alias(code))
        return df

    return add(df, formulas, ())
