"""The transform layer: what is done to a binding's value after it is found."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.expr import parser
from ledgerloom.expr import values as V
from ledgerloom.expr.compiler import Compiler
from ledgerloom.functions.registry import load, spellings

CASTS = {"Float": "double", "Currency": "double", "Percent": "double", "Int": "long", "Check": "boolean", "Bool": "boolean", "Data": "string", "Text": "string"}


def cast_value(c: Column, dtype: T.DataType, data_type: str | None) -> Column:
    """A binding's cast. What can't be cast is NULL: columns have one type."""
    kind = CASTS.get(data_type or "")
    if kind is None or isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return c
    if kind == "long":
        return c.cast("string").try_cast("double").cast("long") if not isinstance(dtype, T.BooleanType) else c.cast("long")
    if kind == "boolean":
        if isinstance(dtype, T.StringType):
            return F.when(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), True).when(c.isNotNull(), False)
        return c.cast("boolean")
    if kind == "double":
        return c.cast("string").try_cast("double") if isinstance(dtype, T.StringType) else c.cast("double")
    return V.text(V.from_column(c, dtype))


def transform_value(c: Column, dtype: T.DataType, config: Mapping | None) -> Column:
    """multiply, divide (unless 0), add, formula over `value`, round, cast. NULL stays NULL; a step
    that fails keeps the value that was reached."""
    if not config:
        return c
    value = c
    numeric = isinstance(dtype, T.NumericType) or any(k in config for k in ("multiply", "divide", "add", "formula", "round"))
    if numeric:
        value = c.cast("double") if isinstance(dtype, T.NumericType) else c.cast("string").try_cast("double")
    if config.get("multiply") is not None:
        value = value * float(config["multiply"])
    if config.get("divide"):
        value = value / float(config["divide"])
    if config.get("add") is not None:
        value = value + float(config["add"])
    if config.get("formula"):
        registry = load()
        v = Compiler({"value": V.Val(value, V.DOUBLE)}, registry).compile(parser.parse(config["formula"], spellings(registry), parser.FILTER))
        made = V.number(v)
        value = F.when(F.coalesce(made.ok, F.lit(True)) & made.col.isNotNull(), made.col.cast("double")).otherwise(value) if made.ok is not None else F.coalesce(made.col.cast("double"), value)
    if config.get("round") is not None:
        value = F.bround(value, int(config["round"]))
    kind = {"int": "long", "float": "double", "str": "string"}.get(str(config.get("cast") or ""))
    if kind == "string":
        return V.text(V.Val(value, V.DOUBLE if numeric else dtype))
    return value.cast(kind) if kind else value
