"""Recurrences: formulas that read the previous row's outputs as prev_<name>."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.expr import values as V
from ledgerloom.plans.engine import FormulaEngine


def apply_with_memory(engine: FormulaEngine, df: DataFrame, partition_by: list[str], order_by: list[str], memory: Mapping[str, T.DataType] | list[str], initial: Mapping[str, object] | None = None) -> DataFrame:
    """df's rows with the formulas, each row seeing prev_<name> of the row before it in its
    partition, and row_index.

    A fold over the partition's rows in order, inside the JVM. A partition is one row while it is
    folded, so it must be of the size of a ledger, not of a table.
    """
    kinds = dict(memory) if isinstance(memory, Mapping) else {m: T.DoubleType() for m in memory}
    fields = df.columns
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(order_by)], F.struct(*fields).alias("row"))))
    packed = df.groupBy(*partition_by).agg(rows.alias("__rows"))
    schema = df.schema
    start = F.struct(*[F.lit((initial or {}).get(m, 0)).cast(t).alias(m) for m, t in kinds.items()])

    def outputs(row: Column, prev: Column, index: Column) -> list[Column]:
        from ledgerloom.expr.compiler import Compiler

        env = {f.name: V.from_column(row[f.name], f.dataType) for f in schema.fields}
        env |= {f"prev_{m}": V.from_column(prev[m], t) for m, t in kinds.items()} | {"row_index": V.Val(index.cast("long"), V.LONG)}
        made: dict[str, Column] = {}
        for name in engine.topo_order:
            c = engine.compile_value(name, Compiler(env, engine.registry).compile(engine.trees[name]))
            env[name] = V.Val(c.value, c.dtype)
            made[name] = c.value
        return [made[n].cast(kinds[n]).alias(n) if n in kinds else made[n].alias(n) for n in engine.topo_order]

    sample = outputs(F.struct(*fields), start, F.lit(0))
    probe = df.select(*[c for c in sample]).schema
    out_type = T.StructType([T.StructField(f.name, f.dataType) for f in probe.fields])
    empty = F.array().cast(T.ArrayType(out_type))

    def step(acc: Column, item: Column) -> Column:
        made = F.struct(*outputs(item["row"], acc["prev"], acc["n"])).cast(out_type)
        # computed once: bound by the inner transform
        return F.get(F.transform(F.array(made), lambda m: F.struct(F.struct(*[m[k].cast(t).alias(k) for k, t in kinds.items()]).alias("prev"), (acc["n"] + 1).alias("n"), F.array_append(acc["out"], m).alias("out"))), F.lit(0))

    zero = F.struct(start.alias("prev"), F.lit(0).alias("n"), empty.alias("out"))
    folded = packed.withColumn("__acc", F.aggregate("__rows", zero, step))
    pairs = folded.select(F.explode(F.arrays_zip(F.col("__rows.row").alias("row"), F.col("__acc.out").alias("out"))).alias("p"))
    return pairs.select("p.row.*", *[F.col(f"p.out.{f.name}").alias(f.name) for f in out_type.fields])
