"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import allocation, documents, graph, snapshots, timebuckets
from ledgerloom.plans import grouped, memory
from ledgerloom.plans.engine import Assertion, FormulaEngine, InputField, diff_inputs
from ledgerloom.sources.bindings import Binding, Resolver
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.variables import GlobalVariable, with_formula_sets, with_globals
from ledgerloom.streaming import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def engine(formulas, **options) -> FormulaEngine:
    return FormulaEngine(formulas, **({"zero_division_policy": "allow"} | options))


def run(df: DataFrame, keys: list[str], formulas: dict[str, str], **options) -> DataFrame:
    return engine(formulas, **options).apply(df).select(*keys, *formulas)


# --- formulas


@query("""SELECT l_orderkey, l_linenumber, disc_price, disc_price * (1 + l_tax) AS charge, CASE WHEN disc_price * (1 + l_tax) > 50000 THEN 'H' WHEN disc_price * (1 + l_tax) > 10000 THEN 'M' ELSE 'L' END AS band,
 coalesce(disc_price * (1 + l_tax) / nullif(l_quantity, 0), 0) AS unit FROM (SELECT *, l_extendedprice * (1 - l_discount) AS disc_price FROM lineitem)""")
def q_formula_dag_pricing(spark, d):
    f = {"unit": "safe_div(charge, l_quantity)", "band": "IF(charge > 50000, 'H', IF(charge > 10000, 'M', 'L'))", "charge": "disc_price * (1 + l_tax)", "disc_price": "l_extendedprice * (1 - l_discount)"}
    return run(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], f)


@query("""SELECT l_orderkey, l_linenumber, coalesce(100.0::DOUBLE / nullif(l_quantity - 25, 0), 0) AS by_default, coalesce(100.0::DOUBLE / nullif(l_quantity - 25, 0), 0) + 1 AS after_it, coalesce(100.0::DOUBLE / nullif(l_quantity - 25, 0), -1) AS safe,
 l_quantity = 25 AS failed FROM lineitem""")
def q_error_modes(spark, d):
    e = engine({"by_default": "100 / (l_quantity - 25)", "after_it": "by_default + 1", "safe": "safe_div(100, l_quantity - 25, -1)"})
    out = e.apply(table(spark, d, "lineitem"), errors_col="errors")
    return out.select("l_orderkey", "l_linenumber", "by_default", "after_it", "safe", F.array_contains("errors", "by_default").alias("failed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 25 THEN NULL ELSE 1.0::DOUBLE / (l_quantity - 25) END AS x, CASE WHEN l_quantity = 25 THEN NULL ELSE 1.0::DOUBLE / (l_quantity - 25) * 2 END AS y FROM lineitem""")
def q_null_mode(spark, d):
    return run(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"x": "1 / (l_quantity - 25)", "y": "x * 2"}, on_error="null")


@query("""SELECT p_partkey, abs(p_size - 25) AS a, p_size - 25 - 7 * CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS m, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS fd, CAST(floor(p_retailprice) AS BIGINT) AS fl, CAST(ceil(p_retailprice) AS BIGINT) AS ce,
 ceil(p_retailprice / 3 * 10) / 10 AS ru, floor(p_retailprice / 3 * 10) / 10 AS rd, round(sqrt(p_size), 8) AS sq, round(ln(p_size), 8) AS ln1, round(log10(p_size), 8) AS lg, round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 8) AS tr,
 greatest(10, least(40, p_size)) AS cl, coalesce(p_size * 100.0::DOUBLE / nullif(p_retailprice, 0), 0) AS pc, p_size BETWEEN 10 AND 20 AS bt, round(pow(p_size, 2), 4) AS pw FROM part""")
def q_scalar_math(spark, d):
    f = {
        "a": "abs(p_size - 25)", "m": "(p_size - 25) % 7", "fd": "(p_size - 25) // 7", "fl": "floor(p_retailprice)", "ce": "CEIL(p_retailprice)", "ru": "roundup(p_retailprice / 3, 1)", "rd": "rounddown(p_retailprice / 3, 1)",
        "sq": "round(sqrt(p_size), 8)", "ln1": "round(ln(p_size), 8)", "lg": "round(log10(p_size), 8)", "tr": "round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 8)", "cl": "clamp(p_size, 10, 40)", "pc": "p_size * 100 / p_retailprice",
        "bt": "between(p_size, 10, 20)", "pw": "round(p_size ** 2, 4)",
    }
    return run(table(spark, d, "part"), ["p_partkey"], f)


@query("""SELECT p_partkey, p_name || '-' || p_size AS cc, substr(p_name, 1, 3) AS l3, right(p_name, 4) AS r4, substr(p_name, 2, 5) AS m5, upper(p_brand) AS up, lower(p_type) AS lo, replace(p_type, 'A', 'a') AS su, CAST(instr(p_brand, '#') AS BIGINT) AS fi,
 CAST(length(p_name) AS BIGINT) AS le, p_brand || '|' || p_size AS tj FROM part""")
def q_scalar_text(spark, d):
    f = {"cc": "concat(p_name, '-', p_size)", "l3": "left(p_name, 3)", "r4": "right(p_name, 4)", "m5": "mid(p_name, 2, 5)", "up": "upper(p_brand)", "lo": "lower(p_type)", "su": "substitute(p_type, 'A', 'a')", "fi": "find('#', p_brand)", "le": "len_text(p_name)", "tj": "textjoin('|', 1, p_brand, p_size)"}
    return run(table(spark, d, "part"), ["p_partkey"], f)


@query("""SELECT o_orderkey, CAST(year(d) AS BIGINT) AS y, CAST(month(d) AS BIGINT) AS m, CAST(day(d) AS BIGINT) AS dd, CAST(quarter(d) AS BIGINT) AS q, CAST(d - DATE '1995-06-17' AS BIGINT) AS days,
 CAST((year(d) - 1995) * 12 + month(d) - 6 - CASE WHEN day(d) < 17 THEN 1 ELSE 0 END AS BIGINT) AS months, CAST(d + INTERVAL 1 MONTH AS DATE) AS plus, strftime(d, '%d/%m/%Y') AS shown,
 CAST((SELECT count(*) FROM range(1, 31) r(k) WHERE isodow(d + CAST(k AS INTEGER)) <= 5) AS BIGINT) AS work FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q_scalar_date(spark, d):
    f = {"y": "year(o_orderdate)", "m": "month(o_orderdate)", "dd": "day(o_orderdate)", "q": "quarter(o_orderdate)", "days": "date_diff(o_orderdate, '1995-06-17')", "months": "date_diff(o_orderdate, '1995-06-17', 'months')", "plus": "date_add(o_orderdate, 0, 1)", "shown": "date_format(o_orderdate)", "work": "workdays(o_orderdate, date_add(o_orderdate, 30))"}
    return run(table(spark, d, "orders"), ["o_orderkey"], f)


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'debt' END AS ifs, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END AS sw, c_acctbal > 0 AND c_nationkey < 10 AS an, c_acctbal > 0 OR c_nationkey < 10 AS o_, NOT c_acctbal > 0 AS no,
 CASE WHEN c_nationkey <> 0 THEN c_nationkey ELSE 7 END AS alt, c_acctbal = 0 AS bl, 0 < c_nationkey AND c_nationkey < 5 AS chain, c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS member FROM customer""")
def q_logic(spark, d):
    f = {"ifs": "IFS(c_acctbal > 5000, 'rich', c_acctbal < 0, 'debt')", "sw": "SWITCH(c_mktsegment, 'BUILDING', 1, 'MACHINERY', 2, 9)", "an": "AND(c_acctbal > 0, c_nationkey < 10)", "o_": "c_acctbal > 0 or c_nationkey < 10", "no": "not c_acctbal > 0", "alt": "c_nationkey or 7", "bl": "is_blank(c_acctbal)", "chain": "0 < c_nationkey < 5", "member": "c_mktsegment in ['BUILDING', 'AUTOMOBILE']"}
    return run(table(spark, d, "customer"), ["c_custkey"], f)


# --- aggregates over rows


@query("SELECT l_returnflag, coalesce(round(sum(CASE WHEN l_quantity >= 10 AND lower(l_linestatus) = 'o' THEN l_extendedprice END), 2), 0) AS sumifs FROM lineitem GROUP BY l_returnflag")
def q_sumifs(spark, d):
    return grouped.sumifs(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"l_quantity": ">=10", "l_linestatus": "o"}).withColumn("sumifs", F.round("sumifs", 2))


@query("SELECT p_brand, CAST(sum(CASE WHEN p_type ILIKE '%e%' AND p_size <> 10 THEN 1 ELSE 0 END) AS BIGINT) AS countifs FROM part GROUP BY p_brand")
def q_countifs(spark, d):
    return grouped.countifs(table(spark, d, "part"), ["p_brand"], {"p_type": "*e*", "p_size": "<>10"})


@query("SELECT l_linestatus, coalesce(round(avg(CASE WHEN lower(l_returnflag) <> 'a' THEN l_quantity END), 6), 0) AS averageif FROM lineitem GROUP BY l_linestatus")
def q_averageif(spark, d):
    return grouped.averageif(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "<>A", "l_quantity").withColumn("averageif", F.round("averageif", 6))


@query("""SELECT o_orderpriority, round(sum(o_totalprice), 2) AS group_sum, count(*) AS group_count, round(avg(o_totalprice), 4) AS group_avg FROM orders GROUP BY o_orderpriority""")
def q_group_sum_count_avg(spark, d):
    o = table(spark, d, "orders")
    a, b, c = grouped.group_sum(o, "o_orderpriority", "o_totalprice"), grouped.group_count(o, "o_orderpriority"), grouped.group_avg(o, "o_orderpriority", "o_totalprice")
    return a.join(b, "o_orderpriority").join(c, "o_orderpriority").select("o_orderpriority", F.round("group_sum", 2).alias("group_sum"), "group_count", F.round("group_avg", 4).alias("group_avg"))


@query("SELECT l_orderkey, sum(q) AS unique_sum FROM (SELECT l_orderkey, l_suppkey, arg_min(l_quantity, (l_linenumber, l_quantity)) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def q_unique_sum(spark, d):
    return grouped.unique_sum(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_quantity", ["l_linenumber", "l_quantity"])


@query("""SELECT o_custkey, o_orderkey, CAST(position AS INTEGER) AS position FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 3""")
def q_first_last_nth(spark, d):
    return grouped.pick(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 3, ties=["o_orderkey"]).select("o_custkey", "o_orderkey", "position")


# --- aggregates over lists


def _order_lists(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice"))).alias("items"))


@query("""SELECT l_orderkey, round(sum(l_quantity), 2) AS total, count(*) AS n, max(l_quantity) AS top, round(avg(l_quantity), 6) AS mean, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS r_sum, CAST(sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) AS BIGINT) AS big,
 arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS first_supp, count(DISTINCT l_returnflag) AS flags, round(sum(CASE WHEN l_quantity > 5 THEN l_quantity * l_extendedprice ELSE 0 END), 2) AS weighted, coalesce(arg_min(l_quantity, (l_suppkey, l_returnflag, l_quantity)) FILTER (WHERE l_linenumber = 2), -1) AS second FROM lineitem GROUP BY l_orderkey""")
def q_array_functions(spark, d):
    f = {
        "total": "round(sum(items.*.l_quantity), 2)", "n": "count(map_key(items, 'l_linenumber'))", "top": "max(map_key(items, 'l_quantity'))", "mean": "round(average(map_key(items, 'l_quantity')), 6)",
        "r_sum": "sumif(map_key(items, 'l_returnflag'), 'R', map_key(items, 'l_quantity'))", "big": "countif(map_key(items, 'l_quantity'), '>20')", "first_supp": "items[0].l_suppkey", "flags": "count_unique(map_key(items, 'l_returnflag'))",
        "weighted": "round(sum(r.l_quantity * r.l_extendedprice for r in items if r.l_quantity > 5), 2)", "second": "xlookup(2, map_key(items, 'l_linenumber'), map_key(items, 'l_quantity'), -1)",
    }
    return run(_order_lists(spark, d), ["l_orderkey"], f)


@query("""SELECT l_orderkey, max(l_linenumber) FILTER (WHERE l_quantity = mx) AS best_line, min(mx) AS best FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS mx FROM lineitem) GROUP BY l_orderkey""")
def q_array_order(spark, d):
    return run(_order_lists(spark, d), ["l_orderkey"], {"best_line": "last(items, 'l_quantity,l_linenumber', 1, None, 'l_linenumber')", "best": "last(items, 'l_quantity', 1, None, 'l_quantity')"})


@query("SELECT p_partkey, CASE WHEN p_size < 1 THEN NULL WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 2 WHEN p_size < 30 THEN 3 ELSE 4 END AS pos FROM part")
def q_match_approx(spark, d):
    return run(table(spark, d, "part"), ["p_partkey"], {"pos": "match(p_size, [1, 10, 20, 30], 1)"}, on_error="null")


# --- bindings


def _catalog(spark, d, **more) -> Catalog:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    tables = {n: f"{d}/{n}.parquet" for n in names} | more
    return Catalog(spark, tables, keys, {"orders": ("o_orderdate", "o_orderkey"), "lineitem": ("l_orderkey", "l_linenumber"), "bands": ("lo",), "matrix": ("n",), "prices": ("n",), "factors": ("k",)})


@query("""SELECT c_custkey, coalesce(n_name, '?') AS nation, n_regionkey AS regionkey, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_linked_field(spark, d):
    link = lambda v, f, t, field, **k: Binding(v, "linked_doctype_field", {"link_field": f, "target_doctype": t, "target_field": field, **k})
    r = Resolver(_catalog(spark, d), "c_custkey")
    first = r.resolve(table(spark, d, "customer"), [link("nation", "c_nationkey", "nation", "n_name", fallback="?"), link("regionkey", "c_nationkey", "nation", "n_regionkey")])
    return r.resolve(first, [link("region", "regionkey", "region", "r_name")]).select("c_custkey", "nation", "regionkey", "region")


@query("SELECT s_suppkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def q_whole_record(spark, d):
    b = Binding("nation", "whole_doctype", {"link_field": "s_nationkey", "target_doctype": "nation"})
    return Resolver(_catalog(spark, d), "s_suppkey").resolve(table(spark, d, "supplier"), [b]).select("s_suppkey", "nation.n_name", "nation.n_regionkey")


@query("""SELECT o_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS r_price, coalesce(sum(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END), 0)::BIGINT AS n_big, max(l_quantity) AS top FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q_child_aggregate(spark, d):
    bs = [
        Binding("r_price", "child_table_aggregate", {"child_table_field": "items", "field": "l_extendedprice", "aggregate": "sum", "filter_expr": "row.l_returnflag == 'R'"}, transform={"round": 2}),
        Binding("n_big", "child_table_aggregate", {"child_table_field": "items", "field": "l_quantity", "aggregate": "count", "filter_expr": "row.l_quantity > 30"}),
        Binding("top", "child_table_aggregate", {"child_table_field": "items", "field": "l_quantity", "aggregate": "max"}),
    ]
    r = Resolver(_catalog(spark, d), "o_orderkey", {"items": table(spark, d, "lineitem")}, "l_orderkey")
    return r.resolve(table(spark, d, "orders"), bs).select("o_orderkey", "r_price", "n_big", "top")


@query("""SELECT o_orderkey, coalesce(round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2), -1) AS f_price, coalesce(sum(CASE WHEN l_quantity >= 10 AND l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END), 0)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q_aggregate_from_items(spark, d):
    base = {"rows_source": "child_table", "child_table_field": "items"}
    bs = [
        Binding("f_price", "aggregate_from_items", base | {"key_field": "l_linestatus", "key_value": "F", "value_field": "l_extendedprice", "aggregate": "sum", "default_value": -1.0}, transform={"round": 2}),
        Binding("n", "aggregate_from_items", base | {"filters": [["l_quantity", ">=", 10], ["l_returnflag", "in", ["A", "R"]]], "value_field": "l_quantity", "aggregate": "count"}),
    ]
    r = Resolver(_catalog(spark, d), "o_orderkey", {"items": table(spark, d, "lineitem")}, "l_orderkey")
    return r.resolve(table(spark, d, "orders"), bs).select("o_orderkey", "f_price", "n")


@query("""SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, round(sum(o_totalprice), 2) AS spent, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def q_doctype_query_last(spark, d):
    base = {"doctype": "orders", "filters": [["o_custkey", "=", "{doc.c_custkey}"]]}
    bs = [Binding("last_order", "doctype_query", base | {"aggregate": "last", "fieldname": "o_orderkey"}), Binding("spent", "doctype_query", base | {"aggregate": "sum", "fieldname": "o_totalprice"}, transform={"round": 2}), Binding("n", "doctype_query", base | {"aggregate": "count"})]
    return Resolver(_catalog(spark, d), "c_custkey").resolve(table(spark, d, "customer"), bs).select("c_custkey", "last_order", "spent", "n")


#: Inline price tables; the SQL has the same rows.
_MATRIX = [(1, "10", "S", 100.0), (2, "10", "ANY", 90.0), (3, "20", "M", 120.0), (4, "ANY", "S", 80.0), (5, "ANY", "ANY", 50.0), (6, "10", "S", 999.0)]
_BANDS = [(1.0, 10.0, "low"), (10.0, 20.0, "mid"), (15.0, 40.0, "high")]
_PRICES = [(1, "Brand#11", "10", 5.0), (2, "Brand#12", "ANY", 4.0), (3, "Brand#13", None, 3.0), (4, "Brand#13", "7", 6.0)]
_FACTORS = [("1", 1.5), ("2", 2.0), ("3", 0.5)]
_SIZE = "CASE WHEN p_size % 3 = 0 THEN '10' WHEN p_size % 3 = 1 THEN '20' ELSE '30' END"
_LETTER = "CASE WHEN p_partkey % 4 = 0 THEN 'S' WHEN p_partkey % 4 = 1 THEN 'M' ELSE 'X' END"


def _rows(table_rows, names: str) -> str:
    shown = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in table_rows)
    return f"(VALUES {shown}) t({names})"


@query(f"""WITH p AS (SELECT p_partkey, {_SIZE} AS s, {_LETTER} AS l FROM part), m AS (SELECT r, c, arg_min(v, n) AS v FROM {_rows(_MATRIX, 'n, r, c, v')} GROUP BY r, c)
SELECT p_partkey, coalesce(a.v, b.v, c.v, e.v, 0) AS price FROM p LEFT JOIN m a ON a.r = s AND a.c = l LEFT JOIN m b ON b.r = 'ANY' AND b.c = l LEFT JOIN m c ON c.r = s AND c.c = 'ANY' LEFT JOIN m e ON e.r = 'ANY' AND e.c = 'ANY'""")
def q_matrix_lookup(spark, d):
    m = spark.createDataFrame(_MATRIX, "n int, r string, c string, v double")
    b = Binding("price", "matrix_lookup", {"doctype": "matrix", "row_key_field": "r", "col_key_field": "c", "value_field": "v", "row_key": "{row.s}", "col_key": "{row.l}", "fallback_row_key": "ANY", "fallback_col_key": "ANY", "default_value": 0.0}, "Float")
    p = table(spark, d, "part").selectExpr("p_partkey", f"{_SIZE} AS s", f"{_LETTER} AS l")
    return Resolver(_catalog(spark, d, matrix=m), "p_partkey").resolve(p, [b]).select("p_partkey", "price")


@query(f"""WITH p AS (SELECT p_partkey, p_brand AS b, CAST(p_size AS VARCHAR) AS s, CAST(p_size % 5 AS VARCHAR) AS f FROM part), x AS (SELECT * FROM {_rows(_PRICES, 'n, br, sz, v')}), k AS (SELECT * FROM {_rows(_FACTORS, 'k, w')})
SELECT p_partkey, coalesce((SELECT arg_min(v, n) FROM x WHERE br = b AND sz = s), (SELECT arg_min(v, n) FROM x WHERE br = b AND (sz IS NULL OR sz IN ('', 'ANY') OR sz = s)) * coalesce(w, 1), 0) AS price FROM p LEFT JOIN k ON k.k = f""")
def q_composite_lookup(spark, d):
    more = {"prices": spark.createDataFrame(_PRICES, "n int, br string, sz string, v double"), "factors": spark.createDataFrame(_FACTORS, "k string, w double")}
    c = {"doctype": "prices", "value_field": "v", "key_fields": ["br", "sz"], "key_values": ["{row.p_brand}", "{row.p_size}"], "fallback_keys": [["br"]], "multipliers": {"sz": {"doctype": "factors", "match_field": "k", "match_value": "{row.f}", "value_field": "w"}}, "default_value": 0.0}
    p = table(spark, d, "part").withColumn("f", (F.col("p_size") % 5).cast("string"))
    return Resolver(_catalog(spark, d, **more), "p_partkey").resolve(p, [Binding("price", "composite_key_lookup", c, "Float")]).select("p_partkey", "price")


@query(f"""SELECT l_orderkey, l_linenumber, coalesce((SELECT arg_min(v, lo) FROM {_rows(_BANDS, 'lo, hi, v')} WHERE l_quantity BETWEEN lo AND hi), 'none') AS band FROM lineitem""")
def q_range_lookup(spark, d):
    t = spark.createDataFrame(_BANDS, "lo double, hi double, v string")
    b = Binding("band", "range_lookup", {"doctype": "bands", "value_field": "v", "input_value": "{row.l_quantity}", "range_from_field": "lo", "range_to_field": "hi", "default_value": "none"}, "Data")
    return Resolver(_catalog(spark, d, bands=t), "l_orderkey").resolve(table(spark, d, "lineitem"), [b]).select("l_orderkey", "l_linenumber", "band")


@query("""WITH latest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(sum(l_extendedprice), 2) AS total, avg(l_quantity) AS mean FROM customer LEFT JOIN latest ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = k GROUP BY c_custkey""")
def q_reuse_latest(spark, d):
    base = {"formula_document": "orders", "scope_field": "o_custkey", "scope_value": "{doc.c_custkey}", "scope_order_by": "o_orderdate desc", "line_field": "lineitem"}
    bs = [Binding("total", "reuse_formula_result", base | {"result_field": "l_extendedprice", "aggregation": "sum"}, transform={"round": 2}), Binding("mean", "reuse_formula_result", base | {"result_field": "l_quantity", "aggregation": "avg"})]
    return Resolver(_catalog(spark, d), "c_custkey", parent="l_orderkey").resolve(table(spark, d, "customer"), bs).select("c_custkey", "total", "mean")


@query("""SELECT o_orderkey, arg_min(l_suppkey, (l_partkey, l_suppkey)) FILTER (WHERE l_linenumber = 2) AS supp FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_child_lookup(spark, d):
    b = Binding("supp", "child_table_lookup", {"child_table_field": "items", "key_field": "l_linenumber", "key_value": 2, "value_field": "l_suppkey"})
    return Resolver(_catalog(spark, d), "o_orderkey", {"items": table(spark, d, "lineitem")}, "l_orderkey").resolve(table(spark, d, "orders"), [b]).select("o_orderkey", "supp")


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 + 1 ELSE -1 END AS cond, c_nationkey * 10 + n_regionkey AS pipe, coalesce(CASE WHEN c_nationkey = 3 THEN n_name END, c_mktsegment) AS fb, round_even(c_acctbal * 1000 / 3 + 7, 1) AS trans
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def q_composition(spark, d):
    link = {"link_field": "c_nationkey", "target_doctype": "nation", "target_field": "n_regionkey"}
    bs = [
        Binding("cond", "conditional", {"branches": [{"condition": "c_acctbal > 0", "source_type": "computed", "source_config": {"formula": "c_acctbal * 2 + 1"}}], "default": {"source_type": "constant", "source_config": {"value": -1.0}}}),
        Binding("pipe", "pipeline", {"steps": [{"source_type": "linked_doctype_field", "source_config": link, "output_as": "reg"}, {"source_type": "computed", "source_config": {"formula": "c_nationkey * 10 + reg"}}]}),
        Binding("fb", "fallback_chain", {"chain": [{"source_type": "linked_doctype_field", "source_config": {"link_field": "k3", "target_doctype": "nation", "target_field": "n_name"}}, {"source_type": "computed", "source_config": {"formula": "c_mktsegment"}}]}),
        Binding("trans", "computed", {"formula": "c_acctbal"}, transform={"multiply": 1000, "divide": 3, "add": 7, "round": 1}),
    ]
    c = table(spark, d, "customer").withColumn("k3", F.when(F.col("c_nationkey") == 3, 3))
    return Resolver(_catalog(spark, d), "c_custkey").resolve(c, bs).select("c_custkey", "cond", "pipe", "fb", "trans")


# --- allocation

_COSTS = "(SELECT s_suppkey, CAST(1000 + s_suppkey % 7 * 100 AS DOUBLE) AS amount, s_suppkey % 3 AS g FROM supplier)"
_TARGETS = """(SELECT n_nationkey, n_nationkey % 3 AS g, CAST(n_nationkey % 4 AS DOUBLE) AS qty, CAST(n_nationkey * 10 + 5 AS DOUBLE) AS amount, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS alloc_weight, CAST(n_nationkey % 6 * 5 + 1 AS DOUBLE) AS alloc_pct,
 CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS alloc_amount, CASE WHEN n_nationkey % 4 = 1 THEN 10.0::DOUBLE END AS manual_pct FROM nation)"""


def _allocated(spark, d, method: str, **options) -> DataFrame:
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "cast(1000 + s_suppkey % 7 * 100 as double) amount", "s_suppkey % 3 g")
    t = table(spark, d, "nation").selectExpr(
        "n_nationkey", "n_nationkey % 3 g", "cast(n_nationkey % 4 as double) qty", "cast(n_nationkey * 10 + 5 as double) amount", "cast(n_nationkey % 5 + 1 as double) alloc_weight", "cast(n_nationkey % 6 * 5 + 1 as double) alloc_pct",
        "case when n_nationkey % 4 = 0 then cast(n_nationkey as double) end alloc_amount", "case when n_nationkey % 4 = 1 then 10.0D end manual_pct",
    )
    a = allocation.allocate(s, t, method, source_id="s_suppkey", target_id="n_nationkey", group_key="g", digits=0, **options)
    return a.lines.select("source_id", "target_id", F.col("allocated").cast("double").alias("allocated"))


def _alloc_sql(exact: str, rounding: str) -> str:
    mine = {"last": "target_id = max(target_id) OVER p", "largest": "target_id = min(CASE WHEN r = mx THEN target_id END) OVER p AND r = mx"}[rounding]
    return f"""WITH j AS (SELECT s_suppkey AS source_id, s.amount AS a, n_nationkey AS target_id, t.* EXCLUDE (n_nationkey, g, amount), t.amount AS tamount FROM {_COSTS} s JOIN {_TARGETS} t ON s.g = t.g),
x AS (SELECT source_id, target_id, a, round_even({exact}, 0) AS r FROM j), y AS (SELECT *, max(r) OVER (PARTITION BY source_id) AS mx FROM x)
SELECT source_id, target_id, CASE WHEN {mine} THEN r + a - sum(r) OVER p ELSE r END AS allocated FROM y WINDOW p AS (PARTITION BY source_id)"""


for _name, _method, _exact, _options in (
    ("equal", "equal", "a / count(*) OVER (PARTITION BY source_id)", {}),
    ("qty", "qty", "a * qty / sum(qty) OVER (PARTITION BY source_id)", {}),
    ("amount", "amount", "a * tamount / sum(tamount) OVER (PARTITION BY source_id)", {}),
    ("weight", "weight", "a * alloc_weight / sum(alloc_weight) OVER (PARTITION BY source_id)", {}),
    ("pct", "pct", "a * (alloc_pct * 100.0::DOUBLE / sum(alloc_pct) OVER (PARTITION BY source_id)) / 100", {}),
    ("largest", "weight", "a * alloc_weight / sum(alloc_weight) OVER (PARTITION BY source_id)", {"rounding": "largest"}),
):
    QUERIES[f"q_alloc_{_name}"] = lambda spark, d, m=_method, o=_options: _allocated(spark, d, m, **o)
    ORACLE_SQL[f"q_alloc_{_name}"] = _alloc_sql(_exact, _options.get("rounding", "last"))

QUERIES["q_alloc_manual_amount"] = lambda spark, d: _allocated(spark, d, "manual_amount")
ORACLE_SQL["q_alloc_manual_amount"] = f"SELECT s_suppkey AS source_id, n_nationkey AS target_id, coalesce(alloc_amount, 0) AS allocated FROM {_COSTS} s JOIN {_TARGETS} t ON s.g = t.g"
QUERIES["q_alloc_manual_pct"] = lambda spark, d: _allocated(spark, d, "manual_pct", rounding="none")
ORACLE_SQL["q_alloc_manual_pct"] = f"SELECT s_suppkey AS source_id, n_nationkey AS target_id, round_even(s.amount * (coalesce(manual_pct, 0) * 100 / sum(manual_pct) OVER (PARTITION BY s_suppkey)) / 100, 0) AS allocated FROM {_COSTS} s JOIN {_TARGETS} t ON s.g = t.g"
QUERIES["q_alloc_mixed"] = lambda spark, d: _allocated(spark, d, "mixed", residual="weight", rounding="none")
ORACLE_SQL["q_alloc_mixed"] = f"""WITH j AS (SELECT s_suppkey AS source_id, s.amount AS a, n_nationkey AS target_id, t.* EXCLUDE (n_nationkey, g, amount) FROM {_COSTS} s JOIN {_TARGETS} t ON s.g = t.g),
k AS (SELECT *, a - coalesce(sum(alloc_amount) OVER (PARTITION BY source_id), 0) AS l1 FROM j), m AS (SELECT *, CASE WHEN alloc_amount IS NULL THEN round_even(l1 * manual_pct / 100, 0) END AS p2 FROM k),
n AS (SELECT *, l1 - coalesce(sum(p2) OVER (PARTITION BY source_id), 0) AS l2, alloc_amount IS NULL AND p2 IS NULL AS lst FROM m)
SELECT source_id, target_id, coalesce(alloc_amount, p2, round_even(l2 * alloc_weight / sum(alloc_weight) OVER (PARTITION BY source_id, lst), 0)) AS allocated FROM n"""


# --- time

_WEEK = "CAST(floor((d - (make_date(year(d), 1, 4) - CAST(isodow(make_date(year(d), 1, 4)) - 1 AS INTEGER))) / 7) AS INTEGER) + 1"


def _bucketed(spark, d, kind: str) -> DataFrame:
    o = timebuckets.with_bucket(table(spark, d, "orders"), "o_orderdate", kind, "b")
    return o.groupBy(F.col("b.name").alias("name"), F.col("b.year").alias("year"), F.col("b.from_date").alias("from_date"), F.col("b.to_date").alias("to_date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_SPANS = {
    "month": ("'M' || month(d)", "date_trunc('month', d)", "INTERVAL 1 MONTH"), "quarter": ("'Q' || quarter(d)", "date_trunc('quarter', d)", "INTERVAL 3 MONTH"),
    "half": ("'H' || (CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END)", "make_date(year(d), CASE WHEN month(d) <= 6 THEN 1 ELSE 7 END, 1)", "INTERVAL 6 MONTH"), "year": ("'Y' || year(d)", "date_trunc('year', d)", "INTERVAL 1 YEAR"),
}
for _kind, (_n, _from, _step) in _SPANS.items():
    QUERIES[f"q_time_bucket_{_kind}"] = lambda spark, d, k=_kind: _bucketed(spark, d, k)
    ORACLE_SQL[f"q_time_bucket_{_kind}"] = f"""SELECT {_n} AS name, CAST(year(d) AS INTEGER) AS year, CAST({_from} AS DATE) AS from_date, CAST({_from} + {_step} - INTERVAL 1 DAY AS DATE) AS to_date, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY ALL"""


@query(f"""SELECT w AS week, CAST(year(d) AS INTEGER) AS year, count(*) AS n FROM (SELECT d, CASE WHEN {_WEEK} >= 1 THEN {_WEEK} END AS w FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE w IS NOT NULL GROUP BY ALL""")
def q_time_bucket_week(spark, d):
    o = timebuckets.with_bucket(table(spark, d, "orders"), "o_orderdate", "week", "b").filter("b IS NOT NULL")
    return o.groupBy(F.col("b.index").alias("week"), F.col("b.year").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
SELECT a.y AS year, a.mo AS month, a.total, b.total AS last_year, c.total AS before FROM m a LEFT JOIN m b ON b.y = a.y - 1 AND b.mo = a.mo LEFT JOIN m c ON c.y * 12 + c.mo = a.y * 12 + a.mo - 1""")
def q_sply(spark, d):
    o = timebuckets.with_bucket(table(spark, d, "orders"), "o_orderdate", "month", "b")
    m = o.groupBy("b").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    m = timebuckets.period_offset(timebuckets.same_period_last_year(m, "b", "ly"), "b", -1, "pv").select(F.col("b.year").alias("year"), F.col("b.index").alias("month"), "total", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("ly", "pv") for c in ("year", "index")])
    side = lambda p, name: m.select(F.col("year").alias(f"{p}_year"), F.col("month").alias(f"{p}_index"), F.col("total").alias(name))
    return m.join(side("ly", "last_year"), ["ly_year", "ly_index"], "left").join(side("pv", "before"), ["pv_year", "pv_index"], "left").select("year", "month", "total", "last_year", "before")


# --- recurrences, graphs


@query("""SELECT user_id, event_id, round(sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events""")
def q_running_memory(spark, d):
    return grouped.running(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", F.round("balance", 4).alias("balance"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER w - 1 AS BIGINT) AS n, round(sum(o_totalprice) OVER w, 2) AS spent, coalesce(lag(o_totalprice) OVER w, 0) AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def q_memory_fold(spark, d):
    e = engine({"spent": "prev_spent + o_totalprice", "last": "o_totalprice", "prev": "prev_last", "n": "row_index"})
    out = memory.apply_with_memory(e, table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"spent": T.DoubleType(), "last": T.DoubleType()})
    return out.select("o_custkey", "o_orderkey", "n", F.round("spent", 2).alias("spent"), "prev")


def _tree(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("b"))
    return p, p.select(F.floor(F.col("id") / 2).cast("long").alias("id"), F.col("id").alias("dep_id"), F.lit(0.3).alias("coeff")).filter("id <> dep_id")


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey AS leaf, 0 AS h FROM part UNION ALL SELECT id // 2, leaf, h + 1 FROM t WHERE id > 0 AND id // 2 IN (SELECT p_partkey FROM part)) SELECT id, CAST(max(h) AS INTEGER) AS level FROM t GROUP BY id""")
def q_topo_levels(spark, d):
    nodes, edges = _tree(spark, d)
    return graph.levels(nodes, edges).select("id", F.col("level").cast("int").alias("level"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS id, p_retailprice AS b, 1.0::DOUBLE AS w FROM part UNION ALL SELECT id // 2, b, w * 0.3::DOUBLE FROM t WHERE id > 0 AND id // 2 IN (SELECT p_partkey FROM part)) SELECT id, round(sum(b * w), 4) AS x FROM t GROUP BY id""")
def q_solver_acyclic(spark, d):
    nodes, edges = _tree(spark, d)
    return graph.solve_linear(nodes, edges).select("id", F.round("x", 4).alias("x"))


@query("SELECT n_nationkey AS id, CAST(n_nationkey - n_nationkey % 5 AS INTEGER) AS scc FROM nation")
def q_scc(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    ring = n.select("id", F.when(F.col("id") % 5 == 4, F.col("id") - 4).otherwise(F.col("id") + 1).alias("dep_id"))
    onward = n.filter("id % 5 = 0").select("id", (F.col("id") + 5).alias("dep_id"))
    return graph.scc(n, ring.unionByName(onward))


# --- governance


@query("""SELECT o_orderkey, s AS scenario, 'net' AS field, o_totalprice * 0.9::DOUBLE AS base_value, o_totalprice * (1 - r) AS value, o_totalprice * (1 - r) - o_totalprice * 0.9::DOUBLE AS delta FROM orders, (VALUES ('base', 0.1::DOUBLE), ('more', 0.25::DOUBLE)) t(s, r)""")
def q_scenarios_compare(spark, d):
    e = engine({"net": "o_totalprice * (1 - rate)"})
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("rate", F.lit(0.0))
    return e.compare_scenarios(o, {"base": {"rate": 0.1}, "more": {"rate": 0.25}}, "base", "o_orderkey", ["net"]).select("o_orderkey", "scenario", "field", "base_value", "value", "delta")


@query("""SELECT o_orderkey, p * 2 AS a, p * 2 + o_custkey AS b, o_custkey + 1 AS c FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS p FROM orders)""")
def q_incremental_equiv(spark, d):
    e = engine({"a": "o_totalprice * 2", "b": "a + o_custkey", "c": "o_custkey + 1"})
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changes = o.filter("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_totalprice") + 100).alias("o_totalprice"))
    return e.apply_incremental(e.apply(o), changes, "o_orderkey").select("o_orderkey", "a", "b", "c")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'outputs' AS part, 'tax' AS field, o_totalprice * 0.5::DOUBLE AS delta FROM orders WHERE o_orderkey % 10 = 0 AND o_totalprice <> 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'inputs', 'o_totalprice', o_totalprice FROM orders WHERE o_orderkey % 10 = 0 AND o_totalprice <> 0""")
def q_snapshot_diff(spark, d):
    e = engine({"tax": "o_totalprice * 0.5"})
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    after = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    return snapshots.compare(snapshots.snapshot(e, o, "o_orderkey"), snapshots.snapshot(e, after, "o_orderkey")).select("doc_id", "part", "field", "delta")


@query("SELECT o_orderkey, o_totalprice * 0.1::DOUBLE AS tax, CASE WHEN o_totalprice * 0.1::DOUBLE > 20000 THEN 1 ELSE 0 END AS n_violations FROM orders")
def q_assertions(spark, d):
    e = engine({"tax": "o_totalprice * 0.1"}, assertions=[Assertion("cap", "tax <= 20000", "too much"), Assertion("sign", "o_totalprice >= 0", severity="ERROR")])
    return e.apply(table(spark, d, "orders"), violations_col="v").select("o_orderkey", "tax", F.size("v").alias("n_violations"))


@query("SELECT o_orderkey, t.step, t.name, t.depth, t.is_root FROM orders, (VALUES (0, 'a', 0, false), (1, 'b', 1, false), (2, 'c', 2, true)) t(step, name, depth, is_root)")
def q_explain(spark, d):
    e = engine({"c": "a + b", "b": "a * 2", "a": "o_totalprice + 1", "z": "1"})
    return e.explain(table(spark, d, "orders"), "c", "o_orderkey").select("o_orderkey", "step", "name", "depth", "is_root")


@query("SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'c_acctbal: minimum' END, CASE WHEN c_mktsegment NOT IN ('BUILDING') THEN 'c_mktsegment: allowed' END], lambda x: x IS NOT NULL)[1] AS issue FROM customer")
def q_validate_inputs(spark, d):
    e = engine({"x": "c_acctbal"}, input_fields=[InputField("c_acctbal", "double", True, minimum=0), InputField("c_mktsegment", "string", allowed=("BUILDING",))])
    return e.validate_inputs(table(spark, d, "customer")).select("c_custkey", F.get("issues", F.lit(0)).alias("issue"))


@query("SELECT l_returnflag, 'net' AS bucket, round(sum(l_extendedprice * (1 - l_discount)), 4) AS amount FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'gross', round(sum(l_extendedprice), 4) FROM lineitem GROUP BY 1")
def q_bucket_roll_up(spark, d):
    e = FormulaEngine([{"name": "n", "formula": "l_extendedprice * (1 - l_discount)", "bucket": "net"}, {"name": "g", "formula": "l_extendedprice", "bucket": "gross"}])
    return e.roll_up(e.apply(table(spark, d, "lineitem")), ["l_returnflag"]).withColumn("amount", F.round("amount", 4))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'x' END AS changed FROM orders")
def q_diff_inputs(spark, d):
    o = table(spark, d, "orders").withColumn("x2", F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return diff_inputs(o, {"x": ("o_totalprice", "x2")}).select("o_orderkey", F.get("changed", F.lit(0)).alias("changed"))


# --- documents


@query("""WITH l AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN l_quantity * 2 WHEN 'A' THEN l_quantity * 3 + l_linenumber ELSE 7 END AS amount FROM lineitem)
SELECT o_orderkey, round(coalesce(sum(amount), 0), 4) AS subtotal, round(coalesce(sum(amount), 0) * 1.5::DOUBLE, 4) AS grand, count(amount) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_document_two_stage(spark, d):
    lines = table(spark, d, "lineitem").withColumn("f", F.when(F.col("l_returnflag") == "R", "l_quantity * 2").when(F.col("l_returnflag") == "A", "l_quantity * 3 + l_linenumber").otherwise("7"))
    e = documents.DocumentEngine({"subtotal": "sum(items.*.amount)", "grand": "subtotal * 1.5", "n": "count(map_key(items, 'amount'))"}, (documents.ChildTable("items", "f", "amount"),), "o_orderkey", "l_orderkey")
    headers, _ = e.apply(table(spark, d, "orders").select("o_orderkey"), {"items": lines})
    return headers.select("o_orderkey", F.round("subtotal", 4).alias("subtotal"), F.round("grand", 4).alias("grand"), "n")


def _lines(spark, d):
    """lineitem, dealt by order over tasks of a counted number of rows. n: a line's place in its order."""
    lines = table(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lines.repartition(documents.tasks_for(spark, lines.count()), "l_orderkey").withColumn("n", place)


@query("""WITH l AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
SELECT l_orderkey AS doc_id, 'items__' || n || '__amount' AS name, l_quantity * 2 + CASE WHEN n > 1 THEN lag(l_quantity * 2) OVER (PARTITION BY l_orderkey ORDER BY n) ELSE 0 END AS value FROM l WHERE n <= 2""")
def q_document_cells(spark, d):
    first = _lines(spark, d).filter("n <= 2")
    text = F.when(F.col("n") == 1, F.concat(F.col("l_quantity").cast("string"), F.lit(" * 2"))).otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit(" * 2 + items.1.amount")))
    rows = documents.cells(first.withColumn("amount", text).withColumn("n", F.col("n").cast("string")), "items", "n", ["amount"], "l_orderkey")
    scalars = first.select(F.col("l_orderkey").alias("doc_id")).distinct()
    return documents.evaluate_cells(rows, scalars, ["items"], dealt=True)


@query("""WITH l AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
SELECT l_orderkey AS doc_id, 'items__' || n || '__amount' AS name, sum(l_quantity * 2) OVER (PARTITION BY l_orderkey ORDER BY n) AS value FROM l""")
def q_document_cells_whole(spark, d):
    """Every line of an order is a cell; each but the first reads the one before."""
    lines = _lines(spark, d)
    before = F.when(F.col("n") > 1, F.concat(F.lit(" + items."), (F.col("n") - 1).cast("string"), F.lit(".amount"))).otherwise("")
    text = F.concat(F.col("l_quantity").cast("string"), F.lit(" * 2"), before)
    rows = documents.cells(lines.withColumn("amount", text).withColumn("n", F.col("n").cast("string")), "items", "n", ["amount"], "l_orderkey")
    scalars = lines.select(F.col("l_orderkey").alias("doc_id")).distinct()
    return documents.evaluate_cells(rows, scalars, ["items"], dealt=True)


@query("""WITH l AS (SELECT l_orderkey, l_quantity * (2 + o_custkey % 3) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT o_orderkey, 2 + o_custkey % 3 AS rate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
f AS (SELECT l_orderkey, x FROM l WHERE n = 1)
SELECT l_orderkey AS doc_id, 'L' || n AS name, CAST(sum(x) OVER (PARTITION BY l_orderkey ORDER BY n) AS DOUBLE) AS value FROM l UNION ALL SELECT o_orderkey, 'rate', CAST(rate AS DOUBLE) FROM o UNION ALL SELECT l_orderkey, 'net', x + 1 FROM f UNION ALL SELECT l_orderkey, 'gross', (x + 1) * 2 FROM f""")
def q_document_cross_refs(spark, d):
    """Rows read header formulas and the row before; header formulas read a row."""
    lines = _lines(spark, d)
    text = F.concat(F.lit("l_quantity * rate"), F.when(F.col("n") > 1, F.concat(F.lit(" + L"), (F.col("n") - 1).cast("string"))).otherwise(""))
    rows = lines.select(F.col("l_orderkey").alias("o_orderkey"), "n", "l_quantity", text.alias("text"))
    headers = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(rows.select("o_orderkey").distinct(), "o_orderkey", "left_semi")
    engine = documents.DocumentEngine({"gross": "net * 2", "net": "L1 + 1", "rate": "2 + o_custkey % 3"}, (documents.ChildTable("items", "text", id="n", prefix="L"),), key="o_orderkey", parent="o_orderkey")
    return engine.graph(headers, {"items": rows})


@query("""SELECT o_orderkey, coalesce(sum(l_quantity * (2 + o_custkey % 3)), 0) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_document_header_reads(spark, d):
    """Rows read a header formula, a header formula reads the rows."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", F.lit("l_quantity * rate").alias("text"))
    engine = documents.DocumentEngine({"total": "sum(items.*.amount)", "rate": "2 + o_custkey % 3"}, (documents.ChildTable("items", "text", order=("l_linenumber",)),), key="o_orderkey", parent="o_orderkey")
    done, _ = engine.apply(table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"items": rows})
    return done.select("o_orderkey", "total")


@query("""WITH l AS (SELECT l_orderkey, l_quantity, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey, l_partkey, l_linenumber, l_extendedprice) AS n FROM lineitem WHERE l_quantity >= 5)
SELECT o_orderkey, sum(l_quantity) FILTER (WHERE n <= 2) AS top2, max(l_suppkey) FILTER (WHERE n = 1) AS best, coalesce(count(n) FILTER (WHERE n <= 2), 0)::BIGINT AS n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q_item_rows_limit(spark, d):
    """Ordered and limited rows of a query, within each document."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "parent")
    base = {"rows_source": "doctype_query", "doctype": "lineitem", "filters": [["l_quantity", ">=", 5]], "order_by": "l_quantity desc, l_suppkey, l_partkey asc, l_linenumber, l_extendedprice", "limit": 2}
    bs = [
        Binding("top2", "aggregate_from_items", base | {"value_field": "l_quantity", "aggregate": "sum"}),
        Binding("best", "aggregate_from_items", base | {"value_field": "l_suppkey", "aggregate": "first"}),
        Binding("n", "aggregate_from_items", base | {"aggregate": "count"}),
    ]
    r = Resolver(Catalog(spark, {"lineitem": lines}), "o_orderkey", {}, "parent")
    return r.resolve(table(spark, d, "orders"), bs).select("o_orderkey", "top2", "best", "n")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS p FROM orders UNION ALL SELECT -1 - o_orderkey, NULL, o_totalprice + 2 FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_orderkey, p * 2 AS a, coalesce(p * 2 + o_custkey, 0) AS b FROM o""")
def q_incremental_context(spark, d):
    """Two changes of a key, the later one counts; keys that are new become rows."""
    e = engine({"a": "o_totalprice * 2", "b": "a + o_custkey"})
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_totalprice")
    some, steps = o.filter("o_orderkey % 10 = 0"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step")
    old = some.select("o_orderkey", "o_totalprice", steps)
    new = some.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", steps)
    changes = old.unionByName(new).withColumn("o_totalprice", F.col("o_totalprice") + F.col("step"))
    return e.apply_changes(e.create_context(o, "o_orderkey"), changes, order_by="step").data.select("o_orderkey", "a", "b")


@query("""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END AS b FROM part)
SELECT a.id, round(a.b + CASE WHEN a.id % 2 = 0 AND o.id IS NOT NULL THEN 0.5::DOUBLE * o.b ELSE 0 END, 4) AS x FROM n a LEFT JOIN n o ON o.id = a.id - 1""")
def q_solver_nulls(spark, d):
    """Null b and coeff are 0; repeated nodes and edges, null ids and unknown ends are given, too."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("b"))
    half = p.filter("id % 2 = 0").select("id", (F.col("id") - 1).alias("dep_id"), F.lit(0.25).alias("coeff"))
    nothing = p.select("id", (F.col("id") - 1).alias("dep_id"), F.lit(None).cast("double").alias("coeff"))
    nodes = p.unionByName(p).unionByName(p.limit(1).select(F.lit(None).cast(dict(p.dtypes)["id"]).alias("id"), F.lit(1.0).alias("b")))
    return graph.solve_linear(nodes, half.unionByName(half).unionByName(nothing)).select("id", F.round("x", 4).alias("x"))


@query("""WITH d AS (SELECT p_partkey, CAST(p_size AS INTEGER) AS n, p_size // 10 AS t, p_size % 10 AS u, ['không', 'một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín'] AS w FROM part),
x AS (SELECT p_partkey, CASE WHEN n < 10 THEN w[n + 1] ELSE (CASE WHEN t = 1 THEN 'mười' ELSE w[t + 1] || ' mươi' END) || CASE WHEN u = 0 THEN '' WHEN u = 5 THEN ' lăm' WHEN u = 1 AND t > 1 THEN ' mốt' WHEN u = 4 AND t > 1 THEN ' tư' ELSE ' ' || w[u + 1] END END AS words FROM d)
SELECT p_partkey, upper(words[1]) || words[2:] AS words FROM x""")
def q_number_to_words(spark, d):
    return run(table(spark, d, "part"), ["p_partkey"], {"words": "number_to_words(p_size)"})


# --- variables and sources beyond one table


@query("""SELECT o_orderkey, o_totalprice * 0.08::DOUBLE AS tax, o_totalprice * 0.08::DOUBLE + 20 + n AS due FROM orders, (SELECT count(*) FILTER (WHERE r_regionkey <= 2) AS n FROM region)""")
def q_global_variables(spark, d):
    vs = [
        GlobalVariable("vat", value="0.08", data_type="Float"), GlobalVariable("fee", "FORMULA", formula="250 * vat"), GlobalVariable("wanted", value="ASIA"), GlobalVariable("off", value="1", is_active=False),
        GlobalVariable("asia", "DB_QUERY", table="region", column="r_regionkey", filters={"r_name": "$wanted"}, data_type="Int"), GlobalVariable("hidden", "DB_QUERY", table="part", column="p_size"),
    ]
    o = with_globals(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), vs, _catalog(spark, d), {"region"})
    return run(o, ["o_orderkey"], {"tax": "o_totalprice * vat", "due": "tax + fee + asia + 1 + IF(hidden == None, 0, 100)"})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * 2 + l_extendedprice * (1 - l_discount) * l_tax AS total FROM lineitem")
def q_formula_set_reference(spark, d):
    sets = {"price": {"net": "l_extendedprice * (1 - l_discount)", "twice": "net * 2"}, "duty": {"due": "price.net * l_tax"}}
    f = {"total": "price.twice + duty.due"}
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return run(with_formula_sets(lines, f, sets, zero_division_policy="allow"), ["l_orderkey", "l_linenumber"], f)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE NULL END AS found FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def q_dynamic_link(spark, d):
    c = table(spark, d, "customer").withColumn("kind", F.when(F.col("c_custkey") % 2 == 0, "nation").otherwise("customer"))
    b = Binding("found", "dynamic_link", {"doctype_field": "kind", "name_field": "c_nationkey", "target_field": "n_regionkey"})
    return Resolver(_catalog(spark, d), "c_custkey").resolve(c, [b]).select("c_custkey", "found")


@query("SELECT s_suppkey, 3 AS level, 'VND' AS currency, 'en' AS lang, s_acctbal + s_nationkey AS mixed FROM supplier")
def q_settings_and_functions(spark, d):
    cat = Catalog(spark, {}, settings={"currency": "VND"}, session={"lang": "en"}, functions={"shop.mix": lambda a, b: a + b})
    bs = [
        Binding("level", "constant", {"value": "3"}, "Int"), Binding("currency", "global_default", {"key": "currency"}), Binding("lang", "session_variable", {"key": "lang"}),
        Binding("mixed", "custom_function", {"module": "shop", "function": "mix", "args": {"a": "doc.s_acctbal", "b": "doc.s_nationkey"}}),
    ]
    out = Resolver(cat, "s_suppkey").resolve(table(spark, d, "supplier"), bs)
    return out.select("s_suppkey", F.col("level").cast("int").alias("level"), "currency", "lang", "mixed")


@query("""SELECT o_orderkey, CAST(count(*) FILTER (WHERE lower(l_shipmode) LIKE '%ai%') AS BIGINT) AS n_like, CAST(count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS BIGINT) AS n_out, CAST(count(*) FILTER (WHERE l_linestatus <> 'F' AND l_linenumber < 3) AS BIGINT) AS n_ne
FROM orders LEFT JOIN (SELECT *, l_comment_mode AS l_shipmode FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'RAIL' WHEN 1 THEN 'Air' ELSE 'ship' END AS l_comment_mode FROM lineitem)) ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q_filter_operators(spark, d):
    base = {"rows_source": "child_table", "child_table_field": "items", "value_field": "l_quantity", "aggregate": "count"}
    filters = {"n_like": [["mode", "like", "AI"]], "n_out": [["l_returnflag", "not in", ["A", "N"]]], "n_ne": [["l_linestatus", "<>", "F"], ["l_linenumber", "<", 3]]}
    mode = F.when(F.col("l_linenumber") % 3 == 0, "RAIL").when(F.col("l_linenumber") % 3 == 1, "Air").otherwise("ship")
    items = table(spark, d, "lineitem").withColumn("mode", mode)
    r = Resolver(_catalog(spark, d), "o_orderkey", {"items": items}, "l_orderkey")
    return r.resolve(table(spark, d, "orders"), [Binding(n, "aggregate_from_items", base | {"filters": f}) for n, f in filters.items()]).select("o_orderkey", *filters)


# --- order of dependencies, cycles


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS id, 0 AS h FROM part UNION ALL SELECT id // 2, h + 1 FROM t WHERE id > 0 AND id // 2 IN (SELECT p_partkey FROM part)), l AS (SELECT id, CAST(max(h) AS INTEGER) AS level FROM t GROUP BY id)
SELECT id, level, row_number() OVER (ORDER BY level, id) AS position FROM l""")
def q_topo_order(spark, d):
    nodes, edges = _tree(spark, d)
    return graph.topo_order(nodes, edges).select("id", F.col("level").cast("int").alias("level"), F.col("position").cast("long").alias("position"))


def _rings(spark, d):
    """Rings of five nations, each ring needing the next one."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    ring = n.select("id", F.when(F.col("id") % 5 == 4, F.col("id") - 4).otherwise(F.col("id") + 1).alias("dep_id"))
    return n, ring.unionByName(n.filter("id % 5 = 0").select("id", (F.col("id") + 5).alias("dep_id")))


@query("SELECT n_nationkey AS id, CAST(n_nationkey - n_nationkey % 5 AS INTEGER) AS scc, -1 AS level, row_number() OVER (ORDER BY -(n_nationkey - n_nationkey % 5), n_nationkey) AS position FROM nation")
def q_scc_order(spark, d):
    out = graph.scc_order(*_rings(spark, d))
    return out.select("id", "scc", F.col("level").cast("int").alias("level"), F.col("position").cast("long").alias("position"))


@query("SELECT CAST(n_nationkey - n_nationkey % 5 AS INTEGER) AS scc, count(*) AS n, false AS is_self_loop FROM nation GROUP BY ALL UNION ALL SELECT CAST(7 AS INTEGER), 1, true")
def q_scc_check(spark, d):
    n, edges = _rings(spark, d)
    loop = n.filter("id = 7").select("id", F.col("id").alias("dep_id"))
    return graph.scc_check(n, edges.unionByName(loop)).select("scc", F.size("members").cast("long").alias("n"), "is_self_loop")


@query("""WITH p AS (SELECT p_partkey AS id, p_retailprice AS b, p_partkey // 2 AS pair, count(*) OVER (PARTITION BY p_partkey // 2) AS n FROM part)
SELECT a.id, round(CASE WHEN a.n = 1 THEN a.b WHEN a.id % 2 = 0 THEN (a.b + 0.5::DOUBLE * o.b) / 0.875::DOUBLE ELSE (a.b + 0.25::DOUBLE * o.b) / 0.875::DOUBLE END, 4) AS x, CASE WHEN a.n = 1 THEN 'direct' ELSE 'gaussian' END AS method
FROM p a LEFT JOIN p o ON o.pair = a.pair AND o.id <> a.id""")
def q_solver_cycles(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("b"))
    edges = p.select("id", F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).alias("dep_id"), F.when(F.col("id") % 2 == 0, 0.5).otherwise(0.25).cast("double").alias("coeff"))
    return graph.solve_linear(p, edges).select("id", F.round("x", 4).alias("x"), "method")


@query("SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber DESC) AS lines, list(l_linenumber ORDER BY l_linenumber DESC) AS grouped FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def q_topo_sort_list(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = rows.withColumn("next", F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    record = F.struct("l_linenumber", F.array("next").alias("needs"), F.to_json(F.array(F.struct(F.col("next").alias("ref")))).alias("refs"))
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(record)).alias("items"))
    return run(lists, ["l_orderkey"], {"lines": "map_key(topo_sort_flat(items, 'l_linenumber', 'needs'), 'l_linenumber')", "grouped": "map_key(scc_topo_sort_data(items, 'l_linenumber', 'refs', 'ref'), 'l_linenumber')"})


# --- calendar functions, tables of formulas


@query("""SELECT 'M' || m AS period, make_date(y, m, 1) AS from_date, CAST(make_date(y, m, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS to_date, 'M' || m AS period_label, 'Month ' || m || ' ' || y AS period_full, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS index
FROM (SELECT unnest(range(1, 13)) AS m), (SELECT unnest(range(1992, 1999)) AS y)""")
def q_calendar_entries(spark, d):
    return timebuckets.shaped(timebuckets.calendar(spark, range(1992, 1999), ("month",)), "entry")


@query("""SELECT o_orderkey, year(o_orderdate) = 1995 AND month(o_orderdate) <= 3 AS in_q1, 'Q' || quarter(o_orderdate) AS label, CAST(year(o_orderdate) - 1 AS INTEGER) AS ly, CAST(CASE WHEN month(o_orderdate) = 1 THEN 12 ELSE month(o_orderdate) - 1 END AS INTEGER) AS pm FROM orders""")
def q_period_functions(spark, d):
    f = {
        "in_q1": "in_time_bucket(day, get_period('quarter', 1, 1995))", "label": "get_bucket_label(day, 'quarter')", "ly": "same_period_last_year(get_period('month', m, y)).year", "pm": "period_offset(get_period('month', m, y), -1).index",
    }
    day = F.col("o_orderdate").cast("date")
    return run(table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.month(day).alias("m"), F.year(day).alias("y")), ["o_orderkey"], f)


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, CASE WHEN l_quantity = 25 THEN NULL ELSE 1 / (l_quantity - 25) END AS part, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS whole FROM lineitem")
def q_calc_table(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    f = {"twice": "l_quantity * 2", "part": "1 / (l_quantity - 25)", "whole": "sum(items.*.l_quantity)"}
    return documents.calc_table(lines, f, parent="l_orderkey", order=("l_linenumber",)).select("l_orderkey", "l_linenumber", *f)


@query("""SELECT o_orderkey, s AS scenario, round(coalesce(sum(l_quantity * r), 0), 4) AS subtotal FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey CROSS JOIN (VALUES ('base', 1.0::DOUBLE), ('high', 1.5::DOUBLE)) t(s, r) GROUP BY ALL""")
def q_document_scenarios(spark, d):
    e = documents.DocumentEngine({"subtotal": "sum(items.*.amount)"}, (documents.ChildTable("items", "f", "amount", order=("l_linenumber",)),), "o_orderkey", "l_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").withColumn("f", F.lit("l_quantity * rate"))
    o = table(spark, d, "orders").select("o_orderkey", F.lit(1.0).alias("rate"))
    out = e.scenarios(o, {"items": lines}, {"base": {}, "high": {"rate": 1.5}})
    return out.select("o_orderkey", "scenario", F.round("subtotal", 4).alias("subtotal"))


@query("SELECT l_orderkey, l_linenumber, l_quantity <> 25 AS ok, CASE WHEN l_quantity = 25 THEN 'zero_division' END AS kind FROM lineitem")
def q_apply_safe(spark, d):
    out = engine({"x": "100 / (l_quantity - 25)"}).apply_safe(table(spark, d, "lineitem"))
    return out.select("l_orderkey", "l_linenumber", F.col("_ok").alias("ok"), F.col("_error_type").alias("kind"))


@query("SELECT count(*) AS n, count(*) AS intact FROM orders")
def q_snapshot_verify(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    made = snapshots.verify(snapshots.snapshot(engine({"tax": "o_totalprice * 0.5"}), o, "o_orderkey"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_if("intact").alias("intact"))


# --- streams


def _stream(spark, d, name: str) -> DataFrame:
    # a pattern, as a stream's plain path must be a folder and a table may be one file
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket_start, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1")
def q_stream_month_totals(spark, d):
    """Everything there is, as a stream that ends; the sink holds a row a month."""
    name = f"months_{uuid.uuid4().hex}"
    totals = adapters.bucket_totals(_stream(spark, d, "orders"), "o_orderdate", "o_totalprice", "month")
    totals.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("total", F.round("total", 2))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def q_stream_formulas(spark, d):
    """A stream of rows through formulas into Parquet in the shared folder."""
    folder = graph.shared_folder(spark, "stream")
    out = adapters.apply_stream(engine({"net": "l_extendedprice * (1 - l_discount)"}), _stream(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "net")
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
