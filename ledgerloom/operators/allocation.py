"""Allocation of source amounts over targets: join, window shares, and a residual for rounding.

Targets of a group must come in an order (for "last", and for ties of "largest"): `order_by`. The
number of lines is that of source and target pairs of each group, as the result has a line for each.
A group's target sums are taken once, before the join, so the join is by group key only; a hot group
is split by Spark's skew join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.errors import ArgumentError

METHODS = ("equal", "qty", "amount", "weight", "pct", "manual_amount", "manual_pct", "mixed")
ROUNDING = ("last", "largest", "none")
#: The target column that a method reads.
COLUMNS = {"qty": "qty", "amount": "amount", "weight": "alloc_weight", "pct": "alloc_pct", "manual_amount": "alloc_amount", "manual_pct": "manual_pct"}


@dataclass(frozen=True)
class Allocation:
    """lines: source_id, source_amount, target_id, allocated, ratio, method, weight, stage. warnings:
    source_id, warning. unallocated: source_id, amount."""

    lines: DataFrame
    unallocated: DataFrame
    warnings: DataFrame
    targets: DataFrame
    digits: int

    def source_totals(self) -> DataFrame:
        return self.lines.groupBy("source_id").agg(F.bround(F.sum("allocated"), self.digits).alias("allocated"))

    def target_totals(self) -> DataFrame:
        return self.lines.groupBy("target_id").agg(F.bround(F.sum("allocated"), self.digits).alias("allocated"))

    def by_source(self) -> DataFrame:
        return self.lines.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "allocated", "ratio"))).alias("lines"))

    def by_target(self) -> DataFrame:
        return self.lines.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "allocated", "ratio"))).alias("lines"))

    def apply_to(self, targets: DataFrame, target_id: str, column: str = "allocated") -> DataFrame:
        """targets with what each got: the in-place form."""
        t = self.target_totals().withColumnRenamed("target_id", "__t").withColumnRenamed("allocated", "__a")
        return targets.join(t, F.col(target_id) == F.col("__t"), "left").withColumn(column, F.coalesce("__a", F.lit(0.0))).drop("__t", "__a")

    def ok(self) -> DataFrame:
        """One row: whether every source had a target."""
        return self.warnings.agg((F.count_if(F.contains("warning", F.lit("no target"))) == 0).alias("ok"))


def allocate(
    sources: DataFrame, targets: DataFrame, method: str = "equal", *, source_id: str = "id", source_amount: str = "amount", target_id: str = "id", order_by: str | None = None,
    group_key: str | None = None, rounding: str = "last", digits: int = 2, residual: str = "equal", columns: dict[str, str] | None = None,
) -> Allocation:
    """Spread each source over the targets of its group (all targets without group_key).

    equal, qty, amount, weight: in proportion (all zero: equally, with a warning). pct, manual_pct:
    percentages, normalised if they miss 100 by over 0.01. manual_amount: amounts as given. mixed:
    given amounts, then percentages of what is left, then the rest by `residual`.
    """
    if method not in METHODS or rounding not in ROUNDING:
        raise ArgumentError(f"method is one of {METHODS}, rounding one of {ROUNDING}")
    names = COLUMNS | (columns or {})
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in targets.columns else F.lit(0.0)
    raw = lambda c: F.col(c).cast("double") if c in targets.columns else F.lit(None).cast("double")
    key = F.col(group_key).cast("string") if group_key else F.lit("")
    weight = {"equal": F.lit(1.0), "mixed": F.lit(1.0)}.get(method)
    weight = num(names[method]) if weight is None else weight
    rest = num(names[residual]) if residual in names else F.lit(1.0)
    t = targets.select(key.alias("g"), F.col(target_id).alias("target_id"), F.col(order_by or target_id).alias("o"), weight.alias("w"), raw(names["manual_amount"]).alias("fixed"), raw(names["manual_pct"]).alias("share"), rest.alias("rw"))
    in_group = Window.partitionBy("g")
    t = t.withColumns({"n": F.count(F.lit(1)).over(in_group), "total": F.sum("w").over(in_group)})
    s = sources.select(key.alias("g"), F.col(source_id).alias("source_id"), F.coalesce(F.col(source_amount).cast("double"), F.lit(0.0)).alias("source_amount"))
    pairs = s.join(t, "g")
    r = lambda c: F.bround(c, digits)
    amount, stage, used = F.col("source_amount"), F.lit(None).cast("string"), F.col("w")
    own = Window.partitionBy("source_id", "g")
    if method in ("equal", "qty", "amount", "weight"):
        used = F.when(F.col("total") == 0, 1.0).otherwise(F.col("w"))
        exact = amount * used / F.when(F.col("total") == 0, F.col("n")).otherwise(F.col("total"))
    elif method in ("pct", "manual_pct"):
        off = F.abs(F.col("total") - 100.0) > 0.01
        zero = F.lit(100.0) / F.col("n") if method == "pct" else F.col("w")
        used = F.when(off & (F.col("total") > 0), F.col("w") * 100.0 / F.col("total")).when(off & (F.col("total") == 0), zero).when(off & F.lit(method == "pct"), F.col("w") * 100.0 / F.col("total")).otherwise(F.col("w"))
        exact = amount * used / 100.0
    elif method == "manual_amount":
        used = exact = r(F.col("w"))
    if method == "mixed":
        lines = _mixed(pairs, own, r, rounding, digits, residual)
    else:
        made = pairs.withColumns({"used": used, "exact": exact})
        lines = made.withColumn("allocated", r(F.col("exact")) if method == "manual_amount" else _settled(F.col("exact"), amount, own, rounding, digits))
        lines = lines.withColumns({"method": F.lit(method), "stage": stage})
    lines = lines.select(
        "source_id", "source_amount", "target_id", "allocated", F.when(F.col("source_amount") != 0, F.bround(F.col("allocated") / F.col("source_amount"), digits)).otherwise(F.lit(0.0)).alias("ratio"),
        "method", F.col("used").alias("weight"), "stage", "g",
    )
    groups = t.select("g", "n", "total").distinct()
    checked = s.join(groups, "g", "left")
    given = lines.groupBy("source_id", "g").agg(F.sum("allocated").alias("given"))
    left = checked.join(given, ["source_id", "g"], "left").withColumn("amount", F.bround(F.col("source_amount") - F.coalesce("given", F.lit(0.0)), digits))
    unallocated = left.filter(F.col("n").isNull() | (F.abs("amount") > 10.0 ** (-digits))).select("source_id", "amount")
    said = [F.when(F.col("n").isNull(), F.lit("no target to allocate to"))]
    if method in ("qty", "amount", "weight"):
        said.append(F.when(F.col("total") == 0, F.lit(f"total {names[method]} is 0, allocated equally")))
    if method in ("pct", "manual_pct"):
        said.append(F.when(F.abs(F.col("total") - 100.0) > 0.01, F.lit("percentages don't sum to 100, normalised")))
    if method == "mixed":
        said.append(F.when(F.col("n").isNotNull() & (F.abs("amount") > 0), F.lit("a rest has no residual target")))
    warned = left.select("source_id", F.explode(F.array_compact(F.array(*said))).alias("warning"))
    return Allocation(lines.drop("g"), unallocated, warned, targets, digits)


def _settled(exact: Column, total: Column, own, rounding: str, digits: int) -> Column:
    """exact rounded, with the difference to total on the last or the largest part."""
    rounded = F.bround(exact, digits)
    if rounding == "none":
        return rounded
    diff = F.bround(total - F.sum(rounded).over(own), digits)
    if rounding == "largest":
        # the first of the largest: greatest amount, then least order
        top = F.max(rounded).over(own)
        first = F.min(F.when(rounded == top, F.struct("o", "target_id"))).over(own)
        mine = (rounded == top) & (F.struct("o", "target_id") == first)
    else:
        mine = F.struct("o", "target_id") == F.max(F.struct("o", "target_id")).over(own)
    return F.when(mine, F.bround(rounded + diff, digits)).otherwise(rounded)


def _mixed(pairs: DataFrame, own, r, rounding: str, digits: int, residual: str) -> DataFrame:
    by_amount = F.col("fixed").isNotNull()
    by_share = ~by_amount & F.col("share").isNotNull()
    one = pairs.withColumn("p1", F.when(by_amount, r(F.col("fixed")))).withColumn("left1", F.col("source_amount") - F.coalesce(F.sum("p1").over(own), F.lit(0.0)))
    two = one.withColumn("p2", F.when(by_share, r(F.col("left1") * F.col("share") / 100.0))).withColumn("left2", r(F.col("left1") - F.coalesce(F.sum("p2").over(own), F.lit(0.0))))
    tail = two.withColumn("last", F.col("p1").isNull() & F.col("p2").isNull())
    part = Window.partitionBy("source_id", "g", "last")
    tail = tail.withColumns({"rt": F.sum("rw").over(part), "rn": F.count(F.lit(1)).over(part)})
    weight = F.when(F.col("rt") == 0, 1.0).otherwise(F.col("rw"))
    tail = tail.withColumn("p3x", F.col("left2") * weight / F.when(F.col("rt") == 0, F.col("rn")).otherwise(F.col("rt")))
    tail = tail.withColumn("p3", _settled(F.col("p3x"), F.col("left2"), part, rounding, digits))
    done = F.col("last") & (F.col("left2") != 0)
    return tail.withColumns({
        "allocated": F.coalesce("p1", "p2", F.when(done, F.col("p3")), F.lit(0.0)), "used": F.coalesce("p1", F.when(F.col("p2").isNotNull(), F.col("share")), F.when(done, weight), F.lit(0.0)),
        "method": F.when(F.col("p1").isNotNull(), "mixed:manual_amount").when(F.col("p2").isNotNull(), "mixed:manual_pct").when(done, f"mixed:{residual}").otherwise("mixed"),
        "stage": F.when(F.col("p1").isNotNull(), "pass1_manual_amount").when(F.col("p2").isNotNull(), "pass2_manual_pct").when(done, "pass3_residual"),
    })
