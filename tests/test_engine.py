"""Formulas, engine, bindings, allocation, time buckets, graph, documents, snapshots: literal values."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import export_config, import_config
from ledgerloom.errors import CircularReferenceError, ConfigError, FormulaError, LimitError, SecurityError, UnknownFunctionError
from ledgerloom.expr import parser
from ledgerloom.expr.normalize import clean, normalize
from ledgerloom.functions.registry import load, spellings
from ledgerloom.functions.words import spell
from ledgerloom.operators import allocation, documents, graph, snapshots, timebuckets
from ledgerloom.plans.audit import AuditSession, lineage
from ledgerloom.plans.engine import Assertion, FormulaEngine, Meta
from ledgerloom.plans.memory import apply_with_memory
from ledgerloom.sources.bindings import SOURCES, Binding, Resolver, circular, in_scope, validate
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.schema import KEYS, problems
from ledgerloom.sources.variables import GlobalVariable, global_values, with_formula_sets

ROW = """10L qty, 100L rate, 0.1D vat, cast(null as long) nul, 'Hello World' s, date'2024-02-29' d, array(3L,1L,2L,null) arr, 0L z, 7L a, -3L b, 2.5D h, '2025-12-30' ds,
 array(named_struct('k','A','t','x','v',1L,'q',2.0D),named_struct('k','B','t','y','v',2L,'q',3.0D),named_struct('k','A','t','x','v',3L,'q',null)) items, map('x',1.0D,'y',2.0D) m"""
VALUES = [
    ("qty*rate", 1000), ("a%b", -2), ("a//b", -3), ("-7//2", -4), ("a/2", 3.5), ("IF(qty>5,'H','L')", "H"), ("qty or 1", 10), ("z or 5", 5), ("nul+1", 0), ("nul==None", True), ("5%*200", 10.0), ("1<a<10", True),
    ("sum(items.*.v)", 6), ("sum(r.v*qty for r in items if r.t=='x')", 40), ("sumif(map_key(items,'k'),'A',map_key(items,'v'))", 4), ("countif(arr,'>1')", 2), ("average(arr)", 2.0), ("max(arr)", 3), ("min(4,2)", 2), ("count(arr)", 3),
    ("unique(map_key(items,'k'))", ["A", "B"]), ("group_sum(items,'k','v')", {"A": 4.0, "B": 2.0}), ("unique_sum(items,'k','v')", 3.0), ("index(arr,2)", 1), ("match(2,[1,2,3],0)", 2), ("match(2.5,[1,2,3])", 2), ("choose(2,'a','b')", "b"),
    ("filter_array(arr,'>',1)", [3, 2]), ("rf(items,1,'v')", 2), ("rf(items,9,'v',-1)", -1), ("last(items,'v').v", 3), ("nth(arr,2)", 1), ("sorted_array(arr)", [1, 2, 3, None]), ("vlookup('B',items,2)", 2), ("concat('a',1,nul)", "a1"),
    ("textjoin('-',True,'a','','b')", "a-b"), ("right(s,0)", "Hello World"), ("substitute(s,'o','0',2)", "Hello W0rld"), ("round(h)", 2), ("roundup(2.11,1)", 2.2), ("safe_div(1,0,9)", 9.0), ("date_diff('2024-03-31','2024-02-29','months')", 1),
    ("date_format(d,'%d/%m/%Y')", "29/02/2024"), ("workdays('2024-01-01','2024-01-08')", 5), ("get_bucket_label(ds,'week')", "W53"), ("len(time_buckets(2025,'month'))", 12), ("period_offset(get_period('quarter',1,2025),-1).name", "Q4"),
    ("same_period_last_year(get_period('month',3,2025)).year", 2024), ("number_to_words(1000001)", "Một triệu không trăm linh một"), ("f'{s}-{qty}'", "Hello World-10"), ("arr[0:2]", [3, 1]), ("m.get('q',5)", 5.0), ("sqrt(-1)", 0.0),
    ("IF(z=0, 0, 1/z)", 0.0), ("SWITCH(a,1,'x',7,'y','z')", "y"), ("str(10000000.0)", "10000000.0"), ("countifs(map_key(items,'k'),'A*')", 2), ("flatten([[1,2],[3]])", [1, 2, 3]), ("last(items,'v',1,'k','v')", {"A": 3, "B": 2}), ("missing+1", 0),
    ("pi()*0+1", 1.0), ("unique_key_sum_by_type(items,0,1,2,'x')", 1.0), ("sum_by_type(items,1,2,'x')", 4.0), ("a &gt; 5", True), ("$qty <> 3", True), ("qty&nbsp;+ 1", 11), ("is_blank(z)", True), ("in_time_bucket(ds, get_period('quarter',4,2025))", True),
]


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql(f"SELECT {ROW}")


def test_formula_values(row):
    out = FormulaEngine({f"f{k}": t for k, (t, _) in enumerate(VALUES)}, zero_division_policy="allow").apply(row, keep_inputs=False).first()
    for k, (text, want) in enumerate(VALUES):
        got = out[f"f{k}"]
        assert got == pytest.approx(want) if isinstance(want, float) else got == want, text


def test_registry_is_complete():
    names = """and_ or_ not_ IF IIF IFS SWITCH abs round roundup rounddown floor ceil power sqrt ln log10 sin cos tan asin acos atan atan2 degrees radians exp log min max sum len length zip int float str bool vlookup xlookup sumif sumifs
    countif countifs averageif count countnum counta average unique count_unique flatten sum_by_type unique_key_sum_by_type unique_sum index match filter_array choose rf last latest earliest first nth concat concatenate text_join textjoin left right
    mid upper lower trim replace substitute find len_text number_to_words coalesce safe_div safe_str now today year month day date_diff sorted_array sort map_key group_sum group_by_sum group_count group_by_count group_avg percent_of clamp is_blank
    not_blank isnumber to_number between date_add date_format quarter workdays sum_dict time_buckets in_time_bucket get_bucket_label get_period period_offset same_period_last_year year_buckets""".split()
    assert not set(names) - load().keys() and len(SOURCES) == 19


@pytest.mark.parametrize("text", ["__import__('os')", "lambda x: x", "(x := 1)", "a.__class__", "[i for i in range(3) for j in i]", "eval('1')", "{i for i in a}", "a.append(1)", "(x for x in a)", "open('f')"])
def test_forbidden_syntax(text):
    assert not parser.validate(text, spellings(load())).valid


def test_errors_have_codes_and_hints():
    with pytest.raises(UnknownFunctionError, match="did you mean 'round'"):
        FormulaEngine({"x": "rond(1)"})
    with pytest.raises(CircularReferenceError, match="->"):
        FormulaEngine({"a": "b + 1", "b": "a + 1"})
    with pytest.raises(LimitError):
        FormulaEngine({"a": "1", "b": "2"}, max_formula_count=1)
    with pytest.raises(SecurityError):
        parser.parse("a[0]", None, parser.FILTER)
    assert clean("K1 &lt;&gt; “x”") == 'K1 <> "x"' and normalize("=IF(a=1, 'a=b', 2)", {"if": "IF"}) == "IF(a==1, 'a=b', 2)"


def test_error_modes(spark):
    df = spark.createDataFrame([(1, 2), (1, 0)], "a long, b long")
    apply = lambda **k: [r["x"] for r in FormulaEngine({"x": "a / b"}, **k).apply(df).orderBy("b").collect()]
    assert apply(zero_division_policy="allow") == [0.0, 0.5]
    assert apply(zero_division_policy="allow", on_error="null") == [None, 0.5]
    assert apply(zero_division_policy="warn", default_value=-1) == [-1.0, 0.5]
    with pytest.raises(Exception, match="division by zero"):
        apply()
    safe = FormulaEngine({"x": "a / b"}).apply_safe(df).orderBy("b").collect()
    assert [r["_ok"] for r in safe] == [False, True] and safe[0]["_error_type"] == "zero_division"


def test_dag_incremental_trace(spark):
    e = FormulaEngine({"d": "b + c", "b": "a * 2", "c": "a + 3", "a": "x + y"})
    assert e.topo_order[0] == "a" and e.topo_order[-1] == "d" and e.affected("x") == {"a", "b", "c", "d"}
    df = spark.createDataFrame([(1, 10, 5)], "id long, x long, y long")
    two = FormulaEngine({"a": "x * 2", "b": "a + y"})
    first = two.apply(df)
    new, stats = two.apply_incremental(first, spark.createDataFrame([(1, 100)], "id long, y long"), "id", stats=True)
    assert (first.first()["a"], first.first()["b"], new.first()["b"]) == (20, 25, 120) and (stats["recalculated"], stats["skipped"]) == (1, 1)
    assert two.apply(df, trace_col="t").first()["t"]["b"]["deps"] == {"a": "20", "y": "5"}
    assert FormulaEngine.from_dict(json.loads(json.dumps(two.to_dict()))).hash == two.hash
    with pytest.raises(FormulaError):
        FormulaEngine({"a": "1"}, meta=Meta("F", frozen=True)).with_formula("b", "2")


def test_rounding_and_assertions(spark):
    df = spark.createDataFrame([(1.005, 2.0)], "a double, b double")
    e = FormulaEngine({"x": "a * b", "y": "x * 10"}, rounding_policy={"x": {"decimals": 1}}, assertions=[Assertion("k", "x > 5", "small"), Assertion("m", "gone > 1")])
    r = e.apply(df, violations_col="v").first()
    assert (r["x"], r["y"]) == (2.0, pytest.approx(20.1)) and [v["name"] for v in r["v"]] == ["k"]


def test_memory_fold(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (2, 1, 1.0)], "g long, o long, v double")
    out = apply_with_memory(FormulaEngine({"total": "prev_total * 2 + v"}), df, ["g"], ["o"], {"total": T.DoubleType()})
    assert sorted((r["g"], r["o"], r["total"]) for r in out.collect()) == [(1, 1, 5.0), (1, 2, 17.0), (2, 1, 1.0)]


def test_bindings(spark):
    prices = spark.createDataFrame([(1, "AL-01", "BK", "1.2", 100.0), (2, "AL-01", "WH", None, 95.0), (3, "AL-02", "ANY", "ANY", 90.0)], "n int, item string, color string, thick string, price double")
    doc = spark.createDataFrame([("d1", "AL-01", "BK", "1.2"), ("d2", "AL-01", "WH", "9.9"), ("d3", "XX", "BK", "1")], "name string, item string, color string, thick string")
    r = Resolver(Catalog(spark, {"prices": prices}, order={"prices": ("n",)}))
    c = {"doctype": "prices", "value_field": "price", "key_fields": ["item", "color", "thick"], "key_values": ["{row.item}", "{row.color}", "{row.thick}"], "fallback_keys": [["item", "color"]], "default_value": 0.0}
    out = r.resolve(doc, [Binding("p", "composite_key_lookup", c, "Float")])
    assert {x["name"]: x["p"] for x in out.collect()} == {"d1": 100.0, "d2": 95.0, "d3": 0.0}
    chain = [Binding("base", "constant", {"value": 100}), Binding("factor", "constant", {"value": 0.1}), Binding("result", "computed", {"formula": "base * factor", "dependencies": ["base", "factor"]})]
    assert r.resolve(doc, chain).first()["result"] == 10.0
    assert circular([Binding("a", "computed", {"formula": "b", "dependencies": ["b"]}), Binding("b", "computed", {"formula": "a", "dependencies": ["a"]})])
    assert validate(Binding("x", "matrix_lookup", {})) and in_scope([Binding("x", "constant", applies_to="T", is_global=False)], "U") == []
    step = [Binding("t", "constant", {"value": 3.14159}, transform={"round": 2}), Binding("u", "constant", {"value": 5}, transform={"formula": "value * 2 + 10"}), Binding("w", "constant", {"value": 100.0}, transform={"formula": "value / 0"}), Binding("i", "constant", {"value": "3.7"}, "Int")]
    x = r.resolve(doc, step).first()
    assert (x["t"], x["u"], x["w"], x["i"]) == (3.14, 20.0, 100.0, 3)
    snap = spark.createDataFrame([("d1", json.dumps({"items": [{"cost_bucket": "A", "line_total": 6.0}, {"cost_bucket": "B", "line_total": 1.0}]}))], "name string, snap string")
    b = Binding("a", "aggregate_from_items", {"snapshot_field": "snap", "rows_schema": "cost_bucket:string,line_total:double", "key_field": "cost_bucket", "key_value": "A", "value_field": "line_total"})
    assert r.resolve(snap, [b]).first()["a"] == 6.0
    assert r.preview(chain)["bindings"] == 3


def test_scan_sharing(spark):
    dim = spark.createDataFrame([("x", 1.5, 2.5)], "name string, f double, g double")
    r = Resolver(Catalog(spark, {"dim": dim}, {"dim": "name"}), "id")
    link = lambda v, f, fb=None: Binding(v, "linked_doctype_field", {"link_field": "k", "target_doctype": "dim", "target_field": f, "fallback": fb})
    out = r.resolve(spark.createDataFrame([(1, "x"), (2, "")], "id long, k string"), [link("f", "f", 99.0), link("g", "g")])
    assert [(x["f"], x["g"]) for x in out.orderBy("id").collect()] == [(1.5, 2.5), (99.0, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_allocation(spark):
    s = spark.createDataFrame([("S", 100.0)], "id string, amount double")
    t = spark.createDataFrame([("a", 1.0, 40.0), ("b", 1.0, 40.0), ("c", 1.0, 0.0)], "id string, qty double, alloc_pct double")
    of = lambda a: {r["target_id"]: r["allocated"] for r in a.lines.collect()}
    assert of(allocation.allocate(s, t, "equal")) == {"a": 33.33, "b": 33.33, "c": 33.34}
    assert of(allocation.allocate(s, t, "equal", rounding="largest")) == {"a": 33.34, "b": 33.33, "c": 33.33}
    pct = allocation.allocate(s, t, "pct")
    assert of(pct) == {"a": 50.0, "b": 50.0, "c": 0.0} and pct.warnings.count() == 1
    none = allocation.allocate(s.withColumn("g", F.lit("x")), t.withColumn("g", F.lit("y")), "equal", group_key="g")
    assert none.lines.count() == 0 and none.unallocated.first()["amount"] == 100.0 and not none.ok().first()["ok"]


def test_calendar(spark):
    c = {(r["type"], r["index"], r["year"]): r for r in timebuckets.calendar(spark, [2025, 2026]).collect()}
    assert c["week", 53, 2025]["from_date"] == dt.date(2025, 12, 29) == c["week", 1, 2026]["from_date"]
    assert c["quarter", 1, 2026]["prev_name"] == "Q4@2025" and c["half", 1, 2025]["to_date"] == dt.date(2025, 6, 30) and c["month", 3, 2025]["short_label"] == "M3"
    days = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2024, 2, 29),)], "d date")
    assert [r["b"] and r["b"]["name"] for r in timebuckets.with_bucket(days, "d", "week", "b").orderBy("d").collect()] == [None, "W9"]


@pytest.mark.parametrize("small", [True, False])
def test_graph(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "DRIVER_EDGES", 50_000 if small else 0)
    nodes = spark.createDataFrame([(k, float(k)) for k in (1, 2, 3, 4, 5)], "id long, b double")
    edges = spark.createDataFrame([(2, 1, 0.5), (3, 2, 0.5), (2, 3, 0.5), (4, 3, 1.0), (4, 9, 1.0)], "id long, dep_id long, coeff double")
    assert dict(graph.levels(nodes, edges).collect()) == {1: 0, 5: 0, 2: -1, 3: -1, 4: -1}
    assert dict(graph.scc(nodes, edges).collect()) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    x = {r["id"]: r["x"] for r in graph.solve_linear(nodes, edges).collect()}
    assert x[2] == pytest.approx((2.5 + 1.5) / 0.75) and x[3] == pytest.approx(3 + 0.5 * x[2]) and x[4] == pytest.approx(4 + x[3])


def test_documents(spark):
    head = spark.createDataFrame([("D", 5.0)], "doc_id string, fee double")
    rows = spark.createDataFrame([("D", "A", "qty * price", 2, 100), ("D", "B", "qty * price", 3, 50), ("D", "C", "bad(", 1, 1)], "doc_id string, ref string, formula string, qty long, price long")
    e = documents.DocumentEngine({"subtotal": "sum(items.*.amount)", "grand": "subtotal * 1.1 + fee"}, (documents.ChildTable("items", "formula", "amount"),))
    h, t = e.apply(head, {"items": rows})
    assert h.first()["subtotal"] == 350 and h.first()["grand"] == pytest.approx(390) and {r["ref"]: r["amount"] for r in t["items"].collect()} == {"A": 200.0, "B": 150.0, "C": 0.0}
    cells = spark.createDataFrame([("D", "p__a__w", "W - 2"), ("D", "p__b__w", "p.a.w * 2"), ("D", "p__c__w", "p.c.w + 1")], "doc_id string, name string, text string")
    got = {r["name"]: r["value"] for r in documents.evaluate_cells(cells, spark.createDataFrame([("D", 10)], "doc_id string, W long"), ["p"]).collect()}
    assert got == {"p__a__w": 8.0, "p__b__w": 16.0, "p__c__w": 0.0}


def test_snapshots(spark, tmp_path):
    e = FormulaEngine({"t": "x * 2"})
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"))
    store.create(e, df, "id")
    store.create(e, df.filter("id = 'a'").withColumn("x", F.lit(5.0)), "id", reason="fix")
    assert [r["revision"] for r in store.history("a").collect()] == [1, 2] and store.verify().filter("not intact").count() == 0
    diff = snapshots.compare(store.query("doc_id = 'a' and revision = 1"), store.query("doc_id = 'a' and revision = 2")).collect()
    assert {(r["field"], r["delta_pct"]) for r in diff} == {("x", 400.0), ("t", 400.0)}
    store.lock("doc_id = 'b'")
    with pytest.raises(Exception, match="locked"):
        store.create(e, df.filter("id = 'b'"), "id")


def test_config_round_trip():
    text = export_config([{"name": "a", "formula": "1"}], [{"variable_name": "v", "source_type": "constant"}])
    assert export_config(import_config(text)["formula_set"], import_config(text)["bindings"]) == text
    with pytest.raises(ConfigError, match="checksum"):
        import_config(text.replace('"1"', '"2"'))


@pytest.mark.parametrize(("shown", "options", "want"), [
    ("122351.01", {}, "Một trăm hai mươi hai nghìn ba trăm năm mươi mốt phẩy không một"), ("100.05", {"currency": "USD"}, "Một trăm đô la Mỹ năm cent"), ("100.7", {"currency": "VND"}, "Một trăm linh một đồng"),
    ("1.2345", {"decimal_mode": "digit", "decimal_digits": 4}, "Một phẩy hai ba bốn năm"), ("1.2345", {"decimal_digits": 4}, "Một phẩy hai nghìn ba trăm bốn mươi lăm"), ("9.50", {}, "Chín phẩy năm mươi"), ("-9.5", {}, "Âm chín phẩy năm"),
    ("1.234,56", {}, "Một nghìn hai trăm ba mươi tư phẩy năm mươi sáu"), ("x", {}, "Số không hợp lệ"), ("0", {}, "Không"),
])
def test_number_words(shown, options, want):
    assert spell(shown, **options) == want


def test_streaming(spark, tmp_path):
    from ledgerloom.streaming.adapters import apply_stream, bucket_totals, daily_totals, incremental_sink, running_balance

    src = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, k), float(k)) for k in range(4)], "u long, ts timestamp, v double")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, frame in (("doubled", apply_stream(FormulaEngine({"w": "v * 2"}), stream)), ("balance", running_balance(stream, "u", "ts", "v"))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    months = bucket_totals(stream, "ts", "v", "month").writeStream.format("memory").queryName("months").outputMode("complete").start()
    sink = stream.writeStream.foreachBatch(incremental_sink(FormulaEngine({"w": "v * 2"}), "u", "ts", str(tmp_path / "sink"))).start()
    days = daily_totals(stream, "ts", "v").writeStream.format("memory").queryName("days").outputMode("append").start()
    for q in (months, sink, days):
        q.processAllAvailable()
        q.stop()
    assert [(str(r["bucket_start"]), r["total"]) for r in spark.table("months").collect()] == [("2024-01-01", 6.0)]
    assert [r["w"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == [6.0]
    assert spark.sql("SELECT sum(w) s FROM doubled").first()["s"] == 12.0 and spark.sql("SELECT max(balance) b FROM balance").first()["b"] == 6.0


def test_entry_point():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 50 and entry.oracle_sql().keys() <= entry.queries().keys()


def test_list_order(spark):
    rows = "array(named_struct('id','a','needs',array('c','zz','a')),named_struct('id','b','needs',array('a')),named_struct('id','c','needs',array()),named_struct('id','a','needs',array('b')))"
    ring = "array(named_struct('id','x','needs',array('y')),named_struct('id','y','needs',array('x')),named_struct('id','w','needs',array('x')),named_struct('id','v','needs',array()))"
    df = spark.sql(f"SELECT {rows} AS r, {ring} AS g, filter({rows}, x -> false) AS none")
    f = {k: f"map_key({t}, 'id')" for k, t in {"plain": "topo_sort_flat(r, 'id', 'needs')", "ring": "topo_sort_flat(g, 'id', 'needs')", "scc": "scc_topo_sort_flat(g, 'id', 'needs')", "none": "topo_sort_flat(none, 'id', 'needs')"}.items()}
    out = FormulaEngine({f"o_{k}": t for k, t in f.items()}).apply(df).first()
    assert out["o_plain"] == ["c", "a", "b"] and out["o_ring"] == ["v", "x", "y", "w"] and out["o_none"] == []
    assert out["o_scc"] == ["v", "x", "y", "w"]


def test_component_order(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 1), (9, 1)], "id int, dep_id int")
    got = {r["id"]: (r["scc"], r["level"], r["position"]) for r in graph.scc_order(nodes, edges).collect()}
    assert got == {3: (3, 0, 1), 5: (5, 0, 2), 1: (1, -1, 3), 2: (1, -1, 4), 4: (4, 2, 5)}


def test_global_variables(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, "b", 9)], "n int, k string, v int")
    cat = Catalog(spark, {"t": t}, order={"t": ("-n",)})
    vs = [
        GlobalVariable("c", value="2.5", data_type="Float"), GlobalVariable("f", "FORMULA", formula="c * 4"), GlobalVariable("bad", "FORMULA", formula="nope("), GlobalVariable("key", value="b"),
        GlobalVariable("q", "DB_QUERY", table="t", column="v", filters={"k": "$key"}), GlobalVariable("denied", "DB_QUERY", table="u", column="v"), GlobalVariable("gone", value=1, is_active=False),
    ]
    assert global_values(vs, cat, {"t"}) == {"c": 2.5, "f": 10.0, "bad": None, "key": "b", "q": 9, "denied": None}
    loop = [GlobalVariable("x", "DB_QUERY", table="t", column="v", filters={"k": "$y"}), GlobalVariable("y", "DB_QUERY", table="t", column="v", filters={"k": "$x"})]
    with pytest.raises(CircularReferenceError):
        global_values(loop, cat, {"t"})


def test_formula_sets(spark):
    df = spark.sql("SELECT 2 AS a")
    sets = {"s": {"b": "a * 3", "a2": "b + 1"}, "t": {"x": "s.b + s.a2"}}
    assert with_formula_sets(df, {"y": "t.x"}, sets).select("t.x").first()[0] == 13
    with pytest.raises(CircularReferenceError):
        with_formula_sets(df, {"y": "s.b"}, {"s": {"b": "t.x"}, "t": {"x": "s.b"}})


def test_schemas(spark):
    schema = {"type": "object", "required": ["f"], "required_unless": {"f": {"if": "agg", "equals": "count"}}, "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}, "l": {"type": "array", "items": {"type": "string", "enum": ["x"]}}}}
    assert problems({"agg": "count", "n": 2, "l": ["x"]}, schema) == []
    assert len(problems({"n": 9, "l": ["x", "y", 1]}, schema)) == 4
    assert set(KEYS) == set(SOURCES)
    assert validate(Binding("x", "aggregate_from_items", {"rows_source": "nowhere"}))
    r = Resolver(Catalog(spark, {}), "a")
    assert r.try_binding(spark.sql("SELECT 1 AS a"), Binding("x", "computed", {"formula": "a + 1"})) == {"ok": True, "errors": [], "value": 2}
    assert not r.try_binding(spark.sql("SELECT 1 AS a"), Binding("x", "computed", {"formula": "a +"}))["ok"]


def test_document_tooling(spark):
    e = documents.DocumentEngine({"total": "sum(items.*.amount)", "vat": "total * 0.1"}, (documents.ChildTable("items", "f", "amount"),))
    headers = spark.sql("SELECT 1 AS doc_id, 2.0D AS rate")
    items = spark.sql("SELECT 1 AS doc_id, 3 AS q, 'q * rate' AS f UNION ALL SELECT 1, 4, '5'")
    assert e.dependency_graph() == {"total": ["items"], "vat": ["total"]} and e.preview({"items": items}) == {"items.f": ["q * rate"]}
    assert all(v.valid for v in e.validate({"items": items}).values())
    assert {r["name"]: r["value"] for r in e.explain(headers, {"items": items}, "vat").collect()} == {"total": "11.0", "vat": "1.1"}
    got = {r["scenario"]: (r["doc_id"], r["total"]) for r in e.scenarios(headers, {"items": items}, {"base": {}, "more": {"rate": 10.0}}).collect()}
    assert got == {"base": (1, 11.0), "more": (1, 35.0)}


def test_audit_session_and_lineage(spark):
    e = FormulaEngine({"a": "x * 2", "b": "a + y"}, zero_division_policy="allow", meta=Meta("f", "2"))
    session = AuditSession(e, rate=1.0)
    df = spark.sql("SELECT 1 AS id, 2 AS x, 3 AS y UNION ALL SELECT 2, null, 1")
    assert [r["b"] for r in session.run(df).orderBy("id").collect()] == [7, 1]
    assert session.sample(df, "id").count() == 2
    report = session.end()
    assert (report["rows"], report["failed"], report["engine_uid"]) == (2, 1, "f@2")
    with pytest.raises(FormulaError):
        session.run(df)
    tree = lineage(e, "b")
    assert [n["name"] for n in tree["needs"]] == ["a", "y"] and tree["needs"][0]["needs"][0] == {"name": "x", "formula": None, "needs": []}


def test_build_cells(spark):
    a = spark.sql("SELECT 1 AS doc_id, 'K1' AS slug, '2' AS qty UNION ALL SELECT 1, 'K2', 'a.K1.qty * 3'")
    b = spark.sql("SELECT 1 AS doc_id, 'P' AS slug, 'a.K2.qty + 1' AS amount")
    tables = {"a": documents.CellTable(a, "slug", ("qty",)), "b": documents.CellTable(b, "slug", ("amount",))}
    made = documents.build_cells(tables, synthetic={"total": "b.P.amount * 10"})
    out = {r["name"]: r["value"] for r in documents.evaluate_cells(made, spark.sql("SELECT 1 AS doc_id"), ["a", "b"]).collect()}
    assert out == {"a__K1__qty": 2.0, "a__K2__qty": 6.0, "b__P__amount": 7.0, "total": 70.0}
    with pytest.raises(FormulaError, match="two cells"):
        documents.build_cells({"a": documents.CellTable(a.unionByName(a), "slug", ("qty",))})


@pytest.mark.parametrize("on_error", ["default", "null"])
def test_more_formula_texts_than_one_plan_holds(spark, monkeypatch, on_error):
    monkeypatch.setattr(documents, "MAX_TEMPLATES", 8)
    rows = [("D" if k % 2 else "E", k, f" qty * {k % 40} + 1" if k % 50 else "bad(", [k]) for k in range(200)] + [("D", 200, "7.5", None), ("D", 201, None, None), ("E", 202, "", None)]
    items = spark.createDataFrame(rows, "doc_id string, qty long, formula string, tags array<long>")
    e = documents.DocumentEngine({"total": "sum(items.*.amount)"}, (documents.ChildTable("items", "formula", "amount"),), on_error=on_error)
    heads, out = e.apply(spark.createDataFrame([("D",), ("E",)], "doc_id string"), {"items": items})
    got = {r["qty"]: (r["doc_id"], r["amount"], r["tags"]) for r in out["items"].collect()}
    bad = 0.0 if on_error == "default" else None
    want = {k: (d, {200: 7.5, 201: None, 202: None}.get(k, float(k * (k % 40) + 1) if k % 50 else bad), tags) for d, k, _, tags in rows}
    assert got == want and out["items"].count() == len(rows) and len(e.preview({"items": items})["items.formula"]) == 41
    totals = {r["doc_id"]: r["total"] for r in heads.collect()}
    assert totals == {d: sum(v or 0 for x, v, _ in want.values() if x == d) for d in "DE"}


def test_more_bands_than_one_row_holds(spark, monkeypatch):
    monkeypatch.setattr("ledgerloom.sources.types.MAX_BANDS", 3)
    bands = [(n, float(n % 7), float(n % 7 + n % 3), None if n == 4 else f"b{n}") for n in range(10, 0, -1)]
    t = spark.createDataFrame(bands, "n long, lo double, hi double, v string")
    rows = spark.createDataFrame([(k / 2,) for k in range(-2, 22)] + [(None,)], "x double")
    b = Binding("band", "range_lookup", {"doctype": "t", "value_field": "v", "input_value": "{row.x}", "range_from_field": "lo", "range_to_field": "hi"}, "Data")
    got = {r["x"]: r["band"] for r in Resolver(Catalog(spark, {"t": t}, order={"t": ("n",)}), "x").resolve(rows, [b]).collect()}
    assert got == {x: next((v for n, lo, hi, v in sorted(bands) if x is not None and lo <= x <= hi), None) for x in [k / 2 for k in range(-2, 22)] + [None]}


def test_graph_says_when_rounds_run_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    nodes = spark.createDataFrame([(k,) for k in range(3)], "id long")
    chain = spark.createDataFrame([(1, 0), (2, 1)], "id long, dep_id long")
    monkeypatch.setattr(graph, "MAX_ROUNDS", 3)
    assert dict(graph.levels(nodes, chain).collect()) == {0: 0, 1: 1, 2: 2}
    monkeypatch.setattr(graph, "MAX_ROUNDS", 2)
    with pytest.raises(LimitError):
        graph.levels(nodes, chain)
    monkeypatch.setattr(graph, "MAX_ROUNDS", 0)
    with pytest.raises(LimitError):
        graph.scc(nodes, spark.createDataFrame([(1, 0), (0, 1)], "id long, dep_id long"))


@pytest.mark.parametrize("clamp", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_linear_system_with_a_null(spark, monkeypatch, small, clamp):
    monkeypatch.setattr(graph, "DRIVER_EDGES", 50_000 if small else 0)
    nodes = spark.createDataFrame([(1, 4.0), (2, None), (3, None), (4, 2.0)], "id long, b double")
    edges = spark.createDataFrame([(2, 1, 0.5), (3, 4, 0.5), (4, 3, 0.5)], "id long, dep_id long, coeff double")
    x = {r["id"]: r["x"] for r in graph.solve_linear(nodes, edges, clamp=clamp).collect()}
    assert x == {1: 4.0, 2: 2.0, 3: pytest.approx(4 / 3), 4: pytest.approx(8 / 3)}


def test_incremental_keys_and_stale_contexts(spark):
    from ledgerloom.errors import StaleContextError
    from ledgerloom.plans.engine import FormulaEngine

    e = FormulaEngine({"a": "x * 2", "b": "y + 1"})
    context = e.create_context(spark.createDataFrame([(1, 1.0, 10.0), (None, 2.0, 20.0)], "k long, x double, y double"), "k")
    once = e.apply_changes(context, spark.createDataFrame([(1, 5.0), (None, 6.0), (7, 8.0)], "k long, x double"))
    assert sorted((r["k"] or 0, r["x"], r["a"], r["b"]) for r in once.data.collect()) == [(0, 6.0, 12.0, 21.0), (1, 5.0, 10.0, 11.0), (7, 8.0, 16.0, 0.0)]
    twice = spark.createDataFrame([(1, 5.0, 2), (1, 9.0, 1)], "k long, x double, at int")
    assert {r["k"]: r["a"] for r in e.apply_changes(context, twice, order_by="at").data.collect()}[1] == 10.0
    with pytest.raises(Exception, match="several changes"):
        e.apply_changes(context, twice.drop("at")).data.collect()
    with pytest.raises(StaleContextError):
        FormulaEngine({"a": "x * 3"}).apply_changes(context, twice.drop("at"))
    assert {r["k"]: r["a"] for r in FormulaEngine({"a": "x * 3", "b": "y"}).recalculate(context).data.collect()}[1] == 3.0


@pytest.mark.parametrize("edges_on_driver", [0, 50_000])
def test_solver_nulls_and_repeats_at_any_size(spark, monkeypatch, edges_on_driver):
    from ledgerloom.operators import graph

    monkeypatch.setattr(graph, "DRIVER_EDGES", edges_on_driver)
    nodes = spark.createDataFrame([(1, 4.0), (1, 2.0), (2, None), (3, 1.0), (None, 9.0)], "id long, b double")
    edges = spark.createDataFrame([(2, 1, 0.25), (2, 1, 0.25), (3, 2, None), (3, 99, 1.0), (None, 1, 1.0)], "id long, dep_id long, coeff double")
    assert {r["id"]: r["x"] for r in graph.solve_linear(nodes, edges).collect()} == {1: 4.0, 2: 2.0, 3: 1.0}


@pytest.mark.parametrize("edges_on_driver", [0, 50_000])
def test_solver_rests_on_no_edge_of_coefficient_zero(spark, monkeypatch, edges_on_driver):
    from ledgerloom.operators import graph

    monkeypatch.setattr(graph, "DRIVER_EDGES", edges_on_driver)
    monkeypatch.setattr(graph, "MAX_ROUNDS", 4)  # the chain of null coefficients is longer
    nodes = spark.createDataFrame([(k, float(k)) for k in range(12)], "id long, b double")
    edges = spark.createDataFrame([(k, (k - 1) % 12, None) for k in range(12)] + [(3, 2, 0.5), (7, 6, 0.5), (7, 6, -0.5)], "id long, dep_id long, coeff double")
    got = {r["id"]: (r["x"], r["method"]) for r in graph.solve_linear(nodes, edges).collect()}
    assert got == {k: (4.0 if k == 3 else float(k), "direct") for k in range(12)}


def test_small_cycles_are_solved_as_stacks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from ledgerloom.operators import graph

    rng, rows = np.random.default_rng(5), []
    for c, n in enumerate([1, 2, 2, 3, 2, 20, 4, 2, 1]):
        for i in range(n):
            weight = 1.0 if c in (1, 8) else float(rng.random() / n)  # singular
            rows.append({"id": 100 * c + i, "scc": 100 * c, "b": float(rng.random()), "inside": [{"dep_id": 100 * c + (i + 1) % n, "coeff": weight}]})
    want = {}
    for c in {r["scc"] for r in rows}:
        mine = [r for r in rows if r["scc"] == c]
        x, method, warning = graph._solved_cycle([r["id"] for r in mine], [r["b"] for r in mine], [[(e["dep_id"], e["coeff"]) for e in r["inside"]] for r in mine], True, 1e-9, 50, 1e-6)
        want |= {r["id"]: (v, method, c, warning) for r, v in zip(mine, x.tolist(), strict=True)}
    single = graph._solved_cycle
    calls = []
    monkeypatch.setattr(graph, "_solved_cycle", lambda *a: calls.append(len(a[0])) or single(*a))
    whole = pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("scc", pa.int64()), ("b", pa.float64()), ("inside", pa.list_(pa.struct([("dep_id", pa.int64()), ("coeff", pa.float64())])))]))
    for size in (1, 3, 7, len(rows)):
        got = [r for out in graph._cycle_solver(True, 1e-9, 50, 1e-6)(whole.slice(k, size) for k in range(0, len(rows), size)) for r in out.to_pylist()]
        assert {r["id"]: (r["x"], r["method"], r["scc"], r["warning"]) for r in got} == want and len(got) == len(rows)
    assert sorted(calls[-3:]) == [1, 2, 20]  # all others by stacks


@pytest.mark.parametrize("edges_on_driver", [0, 6, 50_000])
def test_graphs_that_shrink_finish_alike(spark, monkeypatch, edges_on_driver):
    from ledgerloom.operators import graph

    monkeypatch.setattr(graph, "DRIVER_EDGES", edges_on_driver)
    rounds, staged = [], graph._staged
    monkeypatch.setattr(graph, "_staged", lambda df: rounds.append(1) or staged(df))
    tree = [(k // 2, k, 0.5) for k in range(2, 16)]
    ring = [(20, 21, 0.5), (21, 20, 0.5), (22, 21, 1.0), (22, 1, 1.0), (30, 30, 0.5), (31, 30, 2.0)]
    nodes = spark.createDataFrame([(k, 1.0) for k in [*range(1, 16), 20, 21, 22, 30, 31]], "id long, b double")
    edges = spark.createDataFrame(tree + ring, "id long, dep_id long, coeff double")
    depth = {k: 3 - int(math.log2(k)) for k in range(1, 16)}
    assert {r["id"]: r["level"] for r in graph.levels(nodes, edges).collect()} == depth | {20: -1, 21: -1, 22: -1, 30: 0, 31: 1}
    assert {r["id"]: r["scc"] for r in graph.scc(nodes, edges).collect()} == {r: r for r in [*range(1, 16), 20, 22, 30, 31]} | {21: 20}
    got = {r["id"]: (r["x"], r["method"], r["scc"]) for r in graph.solve_linear(nodes, edges).collect()}
    assert got == {k: (float(depth[k] + 1), "direct", k) for k in depth} | {20: (2.0, "gaussian", 20), 21: (2.0, "gaussian", 20), 22: (7.0, "direct", 22), 30: (2.0, "gaussian", 30), 31: (5.0, "direct", 31)}
    if edges_on_driver == 6:
        assert len(rounds) < 40


def test_sparse_elimination_equals_dense(monkeypatch):
    import numpy as np

    from ledgerloom.operators import graph

    rng, n = np.random.default_rng(3), 60
    inside = [[((i + 1) % n, 0.4)] + [(int(j), 0.1) for j in rng.integers(0, n, 2)] for i in range(n)]
    args = (list(range(n)), rng.random(n), inside, False, 1e-9, 50, 1e-6)
    dense = graph._solved_cycle(*args)
    monkeypatch.setattr(graph, "DENSE", 1)
    sparse = graph._solved_cycle(*args)
    assert dense[1] == sparse[1] == "gaussian" and np.allclose(dense[0], sparse[0])
    ring = graph._solved_cycle(list(range(20_000)), np.ones(20_000), [[((i + 1) % 20_000, 0.5)] for i in range(20_000)], True, 1e-9, 50, 1e-6)
    assert ring[1] == "gaussian" and np.allclose(ring[0], 2.0)
    assert graph._solved_cycle([1, 2], [1.0, 1.0], [[(2, 1.0)], [(1, 1.0)]], True, 1e-9, 50, 1e-6)[1] != "gaussian"  # singular


def test_item_rows_of_a_query_are_ordered_and_limited(spark):
    from ledgerloom.sources.bindings import Binding, Resolver
    from ledgerloom.sources.catalog import Catalog

    rows = spark.createDataFrame([("d", 9, 9.0), ("d", 4, 4.0), ("d", 8, 8.0), ("e", None, 1.0), ("e", 2, 2.0)], "parent string, n int, v double")
    base = {"rows_source": "doctype_query", "doctype": "line", "value_field": "v", "aggregate": "sum"}
    bs = [
        Binding("least", "aggregate_from_items", base | {"order_by": "n asc", "limit": 2}), Binding("most", "aggregate_from_items", base | {"order_by": "n desc", "limit": 1}),
        Binding("every", "aggregate_from_items", base), Binding("hidden", "aggregate_from_items", base | {"fields": ["n"]}),
        Binding("odd", "aggregate_from_items", base | {"order_by": "n", "limit": 1, "filters": [["n", ">", 4]]}),
    ]
    docs = spark.createDataFrame([("d",), ("e",)], "name string")
    got = {r["name"]: (r["least"], r["most"], r["every"], r["hidden"], r["odd"]) for r in Resolver(Catalog(spark, {"line": rows}), "name").resolve(docs, bs).collect()}
    assert got == {"d": (12.0, 9.0, 21.0, None, 8.0), "e": (3.0, 2.0, 3.0, None, None)}


def test_rows_read_header_formulas_and_other_rows(spark):
    from ledgerloom.operators.documents import ChildTable, DocumentEngine

    headers = spark.createDataFrame([(1, 3.0), (2, None)], "doc_id long, rate double")
    rows = spark.createDataFrame([(1, "a", 10.0, "rate2 * q"), (1, "b", 1.0, "R_a + gross + q"), (1, None, 5.0, "q"), (2, "a", 2.0, "R_b"), (2, "b", 2.0, "R_a")], "doc_id long, id string, q double, text string")
    e = DocumentEngine({"rate2": "rate * 2", "gross": "R_a * 10"}, (ChildTable("items", "text", id="id", prefix="R_"),))
    got = {(r["doc_id"], r["name"]): r["value"] for r in e.graph(headers, {"items": rows}).collect()}
    assert got == {(1, "rate2"): 6.0, (1, "gross"): 600.0, (1, "R_a"): 60.0, (1, "R_b"): 661.0, (2, "rate2"): 0.0, (2, "gross"): 0.0, (2, "R_a"): 0.0, (2, "R_b"): 0.0}
    _, out = DocumentEngine({"rate2": "rate * 2", "total": "sum(items.*.amount)"}, (ChildTable("items", "text"),)).apply(headers, {"items": rows.filter("id = 'a' AND doc_id = 1")})
    assert out["items"].first()["amount"] == 60.0


def test_cells_are_dealt_by_their_count(spark, monkeypatch):
    from ledgerloom.operators import documents

    monkeypatch.setattr(documents, "CELLS_A_TASK", 10)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(batch)
    rows = [(d, f"c{k}", f"c{k - 1} + rate" if k else "rate") for d in range(30) for k in range(4)] + [(None, "c0", "2 * 3"), (7, "x", "y"), (7, "y", "x + 1"), (7, "z", "x * 0"), (7, "bad", "1 +")]
    spark.conf.set(batch, "3")  # documents go over the ends of batches
    try:
        out = documents.evaluate_cells(spark.createDataFrame(rows, "doc_id long, name string, text string"), spark.createDataFrame([(d, float(d)) for d in range(29)] + [(None, 1.0)], "doc_id long, rate double"), [], default=-1.0)
        got = {(r["doc_id"], r["name"]): r["value"] for r in out.collect()}
        tasks = out.rdd.getNumPartitions()
    finally:
        spark.conf.set(batch, old)
    want = {(d, f"c{k}"): (k + 1.0) * d if d < 29 else -1.0 + 0 * k for d in range(30) for k in range(4)}
    want |= {(29, f"c{k}"): -1.0 for k in range(4)} | {(None, "c0"): 6.0} | {(7, n): -1.0 for n in ("x", "y", "z", "bad")}
    assert got == want and tasks == 13


def test_long_chain_of_cells_takes_time_in_proportion(spark):
    import time

    from ledgerloom.operators import documents

    n = 30_000
    rows = spark.range(n).selectExpr("1L AS doc_id", "concat('c', id) AS name", "if(id = 0, '1', concat('c', id - 1, ' + 1')) AS text")
    start = time.monotonic()
    out = documents.evaluate_cells(rows, spark.createDataFrame([(1, 0.0)], "doc_id long, s double"), [])
    assert out.agg(F.max("value"), F.count("value")).first()[:] == (float(n), n) and time.monotonic() - start < 30


@pytest.mark.parametrize("templates", [1, 500])
def test_documents_are_dealt_by_the_count_of_their_rows(spark, monkeypatch, templates):
    from ledgerloom.operators import documents

    monkeypatch.setattr(documents, "CELLS_A_TASK", 10)
    monkeypatch.setattr(documents, "MAX_TEMPLATES", templates)
    headers = spark.createDataFrame([(d, float(d)) for d in range(20)], "doc_id long, rate double")
    rows = spark.createDataFrame([(d, k, f"rate * {k}") for d in range(18) for k in range(4)] + [(None, 0, "1")], "doc_id long, n int, text string")
    e = documents.DocumentEngine({"twice": "rate * 2", "total": "sum(items.*.amount) + twice"}, (documents.ChildTable("items", "text", order=("n",)),))
    done, out = e.apply(headers, {"items": rows})
    assert {r["doc_id"]: r["total"] for r in done.collect()} == {d: 8.0 * d if d < 18 else 2.0 * d for d in range(20)}
    assert done.rdd.getNumPartitions() == out["items"].rdd.getNumPartitions() == 8 and out["items"].count() == 73


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_documents_that_differ_in_numbers_are_evaluated_together(monkeypatch, kind):
    import random

    import pyarrow as pa

    from ledgerloom.operators import documents

    r = random.Random(5)
    number = lambda: r.choice(["2", "-3", "0.5", "(17.0 * 2)", "((4 - 1) * 2)", "(1e308 * 10)", "-(0.0)", "True"])
    odd = [{"a": "b", "b": "a + 1", "c": "2"}, {"a": "1 / 0", "b": "a + 1"}, {"a": "pi * 2"}, {"a": "missing + 1", "b": "a"}, {"a": "9007199254740993 * b", "b": "1.0"}, {"a": "3 *", "b": "max(1, 2)"}, {"a": "'x'"}]
    docs = [{"a": number(), "b": f"a * {number()} - {number()}", "c": f"-(b + {number()}) + a"} for _ in range(20)] + [{"c": f"b * {number()}", "b": number()} for _ in range(9)] + odd + [{"a": "b - 1", "b": "5"}] * 7
    docs = docs + [{"a": "1.5 * b.x.y", "b__x__y": number()} for _ in range(8)]
    keys = list(range(len(docs)))
    keys[11], key_type = None, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]
    keys = [k if k is None or kind == "long" else float("nan") if kind == "double" and k == 12 else float(k) if kind == "double" else f"d{k}" for k in keys]
    single, calls = documents._document, []
    monkeypatch.setattr(documents, "_document", lambda *a: calls.append(1) or single(*a))
    rows = [(k, n, t) for k, cells in zip(keys, docs, strict=True) for n, t in r.sample(sorted(cells.items()), len(cells))]
    rows += [(keys[-1], "a", "2 * 3")]  # a name twice: the last counts
    want = [(repr(k), n, repr(v)) for k, cells in zip(keys, [*docs[:-1], docs[-1] | {"a": "2 * 3"}], strict=True) for n, v in single(cells, {}, ("b",), -1.0, {}).items()]
    whole = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], key_type), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows])], names=["doc_id", "name", "text"])
    for size in (1, 2, 7, len(rows)):
        calls.clear()
        got = [(repr(x["doc_id"]), x["name"], repr(x["value"])) for out in documents._evaluator(("b",), -1.0)(whole.slice(k, size) for k in range(0, len(rows), size)) for x in out.to_pylist()]
        assert sorted(got) == sorted(want)
    assert len(calls) == len(odd) + 7 + 8  # documents with few of their kind, and, of the last eight, one has a name twice


def test_cells_over_a_window_are_shuffled_once(spark):
    from ledgerloom.queries import QUERIES
    from tests.conftest import SF

    for name in ("q_document_cells", "q_document_cells_whole"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Sort [") == 1, plan
