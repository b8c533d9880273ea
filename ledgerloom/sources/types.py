"""The built-in source types."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import BindingError, FormulaError
from ledgerloom.expr import values as V
from ledgerloom.operators.graph import shared_folder
from ledgerloom.sources import filters as fl
from ledgerloom.sources.bindings import SOURCES, Binding, Resolver, aggregate_of, register_source


def _stable(x) -> str:
    return repr(sorted(x.items()) if isinstance(x, dict) else x)


def _numeric(c: Column, dtype: T.DataType) -> Column:
    return c.cast("double") if isinstance(dtype, T.NumericType) else c.cast("string").try_cast("double") if isinstance(dtype, T.StringType) else F.lit(None).cast("double")


# --- values without a table


@register_source("constant", casts=True)
def constant(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    return df.withColumns({b.variable: F.lit(b.config.get("value")) for b in bs})


@register_source("global_default", ("key",))
def global_default(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    return df.withColumns({b.variable: F.lit(r.catalog.settings.get(b.config["key"])) for b in bs})


@register_source("session_variable", ("key",))
def session_variable(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    built = {"user": F.current_user, "now": F.current_timestamp, "today": F.current_date}
    get = lambda k: F.lit(r.catalog.session[k]) if k in r.catalog.session else built[k]() if k in built else F.lit(None).cast("string")
    return df.withColumns({b.variable: get(b.config["key"]) for b in bs})


@register_source("computed", ("formula",))
def computed(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    for b in bs:
        v = r.formula(df, b.config["formula"])
        df = df.withColumn(b.variable, v.col if v.ok is None else F.when(v.ok, v.col))
    return df


@register_source("custom_function", ("module", "function"))
def custom_function(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """A registered builder of columns, or a (pandas) UDF; nothing is imported by name."""
    for b in bs:
        name = f"{b.config['module']}.{b.config['function']}"
        if name not in r.catalog.functions:
            raise BindingError(f"function {name!r} isn't registered")
        args = {}
        for k, v in (b.config.get("args") or {}).items():
            bare = v.split(".", 1)[1] if isinstance(v, str) and v.split(".", 1)[0] in ("doc", "resolved") and "." in v else None
            args[k] = F.col(f"`{bare}`") if bare in df.columns else fl.value_column(v, df.columns, b.config)
        df = df.withColumn(b.variable, r.catalog.functions[name](**args))
    return df


# --- one row of another table


def _link(r: Resolver, df: DataFrame, config) -> str:
    if config.get("link_field"):
        return config["link_field"]
    named = [c for (_, c), t in r.catalog.links.items() if t == config["target_doctype"] and c in df.columns]
    if not named:
        raise BindingError(f"no field links to {config['target_doctype']!r}")
    return named[0]


@register_source("linked_doctype_field", ("target_doctype", "target_field"), lambda c: (c.get("link_field"), c["target_doctype"]))
def linked_doctype_field(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """One left join for all fields that are taken from one table over one link."""
    table = bs[0].config["target_doctype"]
    link, key = _link(r, df, bs[0].config), r.catalog.key(table)
    wanted = list(dict.fromkeys(b.config["target_field"] for b in bs))
    dim = r.catalog.table(table)
    right = r.first_rows(table, dim.filter(F.col(key).isNotNull()), [key], [c for c in wanted if c != key] or [key]) if not _unique(r, table) else dim.select(key, *[c for c in wanted if c != key])
    right = right.select(F.col(key).alias("__k"), *[F.col(c if c in right.columns else key).alias(f"__v_{c}") for c in wanted])
    joined = df.join(r.catalog.sized(table, right), F.col(f"`{link}`") == F.col("__k"), "left")

    def value(b: Binding) -> Column:
        c = F.col(f"__v_{b.config['target_field']}")
        fallback = b.config.get("fallback")
        return F.coalesce(c, F.lit(fallback).cast(right.schema[f"__v_{b.config['target_field']}"].dataType)) if fallback is not None else c

    return joined.withColumns({b.variable: value(b) for b in bs})


def _unique(r: Resolver, table: str) -> bool:
    """Whether the catalog declares the table's key: then it has one row a key."""
    return table in r.catalog.keys


@register_source("whole_doctype", ("target_doctype",), lambda c: (c.get("link_field"), c["target_doctype"], _stable(c.get("include_child_tables"))))
def whole_doctype(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    table = bs[0].config["target_doctype"]
    link, key = _link(r, df, bs[0].config), r.catalog.key(table)
    dim = r.catalog.table(table)
    every = [f.name for f in dim.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    right = dim
    for child in bs[0].config.get("include_child_tables") or []:
        rows = r.catalog.table(child)
        listed = rows.groupBy(r.parent).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(child))
        right = right.join(listed, right[key] == listed[r.parent], "left").drop(r.parent)
    extra = list(bs[0].config.get("include_child_tables") or [])
    right = right.select(F.col(key).alias("__k"), *[F.struct(*[F.col(c) for c in [*(b.config.get("fields") or every), *extra]]).alias(f"__v_{b.variable}") for b in bs])
    joined = df.join(r.catalog.sized(table, right), F.col(f"`{link}`") == F.col("__k"), "left")
    return joined.withColumns({b.variable: F.when(F.col("__k").isNotNull(), F.col(f"__v_{b.variable}")) for b in bs})


@register_source("dynamic_link", ("doctype_field", "name_field", "target_field"), lambda c: (c["doctype_field"], c["name_field"], c["target_field"]))
def dynamic_link(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """The table's name comes from the row: one dimension of (table, key, value) joined once."""
    c = bs[0].config
    parts = []
    for name in r.catalog.tables:
        t = r.catalog.table(name)
        if c["target_field"] in t.columns and r.catalog.key(name) in t.columns:
            parts.append(t.select(F.lit(name).alias("__t"), F.col(r.catalog.key(name)).cast("string").alias("__k"), F.col(c["target_field"]).cast("string").alias("__v")))
    if not parts:
        raise BindingError(f"no table has the field {c['target_field']!r}")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("__t", "__k").agg(F.min("__v").alias("__v"))
    joined = df.join(every, (F.col(f"`{c['doctype_field']}`") == F.col("__t")) & (F.col(f"`{c['name_field']}`").cast("string") == F.col("__k")), "left")
    return joined.withColumns({b.variable: F.col("__v") for b in bs})


# --- rows of another table


@register_source("doctype_query", ("doctype",), lambda c: (c["doctype"], _stable(c.get("filters"))))
def doctype_query(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """first, last (greatest in the catalog's order), sum, count, list over filtered rows. Equality
    with a template becomes a grouping key and a left join; all bindings of a group share it."""
    c = bs[0].config
    table = r.catalog.table(c["doctype"]).filter(fl.constant_condition(c.get("filters")))
    linked = [(f, v) for f, op, v in fl.rows_of(c.get("filters")) if fl.is_template(v)]
    if any(op not in ("=", "==") for f, op, v in fl.rows_of(c.get("filters")) if fl.is_template(v)):
        raise BindingError("doctype_query: a template is compared by =")
    order = r.catalog.ordinal(c["doctype"], table)
    types = {f.name: f.dataType for f in table.schema.fields}

    def agg(b: Binding) -> Column:
        kind, name = b.config.get("aggregate") or "first", b.config.get("fieldname") or r.catalog.key(c["doctype"])
        value = F.col(name)
        if kind == "sum":
            value = _numeric(value, types[name])
        return aggregate_of(kind, value, order, non_null=False)

    keys = [fl.text_key(F.col(f)).alias(f"__k{k}") for k, (f, _) in enumerate(linked)]
    found = table.groupBy(*keys).agg(*[agg(b).alias(f"__v_{b.variable}") for b in bs])
    on = [fl.text_key(fl.value_column(v, df.columns)) == F.col(f"__k{k}") for k, (_, v) in enumerate(linked)]
    joined = df.join(found, on, "left") if on else df.join(F.broadcast(found), F.lit(True), "left")  # no key: found has one row
    zero = {"count": F.lit(0)}
    return joined.withColumns({b.variable: F.coalesce(F.col(f"__v_{b.variable}"), zero[b.config["aggregate"]]) if b.config.get("aggregate") in zero else F.col(f"__v_{b.variable}") for b in bs})


@register_source("child_table_aggregate", ("child_table_field",), lambda c: (c["child_table_field"],))
def child_table_aggregate(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """One conditional aggregation for all bindings on a child table."""
    child = r.child(bs[0].config["child_table_field"])
    types = {f.name: f.dataType for f in child.schema.fields}
    row = V.Val(F.struct(*[F.col(f"`{c}`") for c in child.columns]), child.schema)
    order = F.struct(*[F.col(f"`{n}`") for n, t in child.dtypes if not t.startswith("map")])

    def agg(b: Binding) -> Column:
        kind, name = (b.config.get("aggregate") or "sum"), b.config.get("field")
        hit = F.lit(True)
        if b.config.get("filter_expr"):
            v = r.formula(child, b.config["filter_expr"], row={"row": row})
            hit = (F.coalesce(v.ok, F.lit(False)) & V.truthy(v)) if v.ok is not None else V.truthy(v)
        value = F.col(f"`{name}`") if name else F.lit(1)
        if kind == "count":
            return F.count_if(hit & value.isNotNull())
        if kind in ("sum", "avg", "average"):
            value = _numeric(value, types[name])
        return aggregate_of(kind, F.when(hit, value), order)

    found = child.groupBy(F.col(r.parent).alias("__k")).agg(*[agg(b).alias(f"__v_{b.variable}") for b in bs])
    joined = df.join(found, F.col(f"`{r.key}`") == F.col("__k"), "left")

    def value(b: Binding) -> Column:
        c = F.col(f"__v_{b.variable}")
        kind = b.config.get("aggregate") or "sum"
        return F.coalesce(c, F.lit(0).cast("long")) if kind == "count" else F.coalesce(c, F.array().cast(found.schema[f"__v_{b.variable}"].dataType)) if kind == "list" else c

    return joined.withColumns({b.variable: value(b) for b in bs})


@register_source("child_table_lookup", ("child_table_field", "key_field", "value_field"), lambda c: (c["child_table_field"], c["key_field"], _stable(c.get("key_value")), c.get("filter_active_field")), casts=True)
def child_table_lookup(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    c = bs[0].config
    child = r.child(c["child_table_field"])
    order = F.struct(*[F.col(f"`{n}`") for n, t in child.dtypes if not t.startswith("map")])
    rows = child.filter(F.col(c["filter_active_field"]).cast("boolean")) if c.get("filter_active_field") else child
    best = rows.groupBy(F.col(r.parent).alias("__p"), F.col(c["key_field"]).alias("__c")).agg(*[F.min_by(b.config["value_field"], order).alias(f"__v_{b.variable}") for b in bs])
    wanted = fl.value_column(c.get("key_value"), df.columns, c)
    joined = df.withColumn("__w", wanted).join(best, (F.col(f"`{r.key}`") == F.col("__p")) & (F.col("__w") == F.col("__c")), "left")
    return joined.withColumns({b.variable: F.col(f"__v_{b.variable}") for b in bs})


def _item_rows(r: Resolver, df: DataFrame, c) -> tuple[DataFrame, Column]:
    """(rows with __p, the document's key; the rows' order) of aggregate_from_items."""
    kind = c.get("rows_source") or "snapshot"
    if kind == "child_table":
        rows = r.child(c["child_table_field"]).withColumnRenamed(r.parent, "__p")
        return rows, F.struct(*[F.col(f"`{n}`") for n, t in rows.dtypes if not t.startswith("map")])
    if kind == "doctype_query":
        rows = r.catalog.table(c["doctype"])
        if r.parent not in rows.columns:
            raise BindingError(f"rows of {c['doctype']!r} need the column {r.parent!r}")
        rows = rows.withColumn("__p", F.col(r.parent))
        return rows, r.catalog.ordinal(c["doctype"], rows.drop("__p"))
    if kind == "resolved":
        held = df.select(F.col(f"`{r.key}`").alias("__p"), F.posexplode(F.col(f"`{c['rows_var']}`")).alias("__o", "__r")).select("__p", "__o", "__r.*")
        return held, F.col("__o")
    if kind == "snapshot":
        table = c.get("snapshot_doctype")
        shape = c.get("rows_schema")
        name, path = c.get("snapshot_field"), c.get("rows_path") or "items"
        source = r.catalog.table(table).withColumn("__s", F.col(name)) if table else df.withColumn("__s", F.col(f"`{name}`"))
        key = F.col(r.catalog.key(table)) if table else F.col(f"`{r.key}`")
        parsed = source.select(key.alias("__p"), F.posexplode(F.from_json(F.get_json_object("__s", f"$.{path}"), f"array<struct<{shape}>>")).alias("__o", "__r")).select("__p", "__o", "__r.*")
        if table and fl.is_template(c.get("snapshot_name")):
            link = df.select(F.col(f"`{r.key}`").alias("__d"), fl.value_column(c["snapshot_name"], df.columns).alias("__n"))
            parsed = link.join(parsed, F.col("__n") == F.col("__p")).drop("__n", "__p").withColumnRenamed("__d", "__p")
        return parsed, F.col("__o")
    raise BindingError(f"unknown rows_source {kind!r}")


def _ranked(c) -> bool:
    """Whether rows are put in an order, or only the first of them count."""
    return c.get("rows_source") == "doctype_query" and bool(c.get("order_by") or int(c.get("limit") or 0) > 0)


def _rows_print(c) -> tuple:
    keys = ["rows_source", "rows_var", "child_table_field", "doctype", "snapshot_doctype", "snapshot_name", "snapshot_field", "rows_path", "rows_schema"]
    if _ranked(c):  # the limit counts rows that pass the filters
        keys += ["order_by", "limit", "filters", "key_field", "key_value"]
    return tuple(_stable(c.get(k)) for k in keys)


def _sort_keys(c, names: list[str], ties: Column) -> list[Column]:
    """What order_by names (asc: nulls first, desc: nulls last), then ties."""
    keys = []
    for part in str(c.get("order_by") or "").split(","):
        name, _, way = part.strip().partition(" ")
        if not name:
            continue
        name = name.strip("`")
        if name not in names:
            raise BindingError(f"order_by: unknown field {name!r}")
        keys.append(F.col(f"`{name}`").desc() if way.strip().lower() == "desc" else F.col(f"`{name}`").asc())
    return [*keys, ties]


@register_source("aggregate_from_items", (), _rows_print, casts=True)
def aggregate_from_items(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """Conditional aggregation: one pass over the rows for all bindings on them. Filters with
    templates read the document, so the columns that they need travel with the rows.

    rows_source doctype_query: order_by and limit hold within each document's filtered rows; a
    value_field that `fields` leaves out has no value.
    """
    rows, order = _item_rows(r, df, bs[0].config)
    templates = list(dict.fromkeys(v for b in bs for _, _, v in _filters(b) if fl.is_template(v)))
    if templates:
        side = df.select(F.col(f"`{r.key}`").alias("__d"), *[fl.value_column(v, df.columns, bs[0].config).alias(f"__t{k}") for k, v in enumerate(templates)])
        rows = rows.join(side, F.col("__p") == F.col("__d")).drop("__d")
    types = {f.name: f.dataType for f in rows.schema.fields}

    def hits(b: Binding) -> Column:
        hit = F.lit(True)
        for name, op, v in _filters(b):
            right = F.col(f"__t{templates.index(v)}") if fl.is_template(v) else F.lit(v) if not isinstance(v, (list, tuple)) else F.lit(None)
            hit = hit & (fl.test(F.col(f"`{name}`"), op, right, v) if name in types else F.lit(False))
        return hit

    ranked = _ranked(bs[0].config)
    if ranked:
        place = F.row_number().over(Window.partitionBy("__p").orderBy(*_sort_keys(bs[0].config, rows.columns, order)))
        rows, order = rows.filter(hits(bs[0])).withColumn("__o", place), F.col("__o")
        if int(bs[0].config.get("limit") or 0) > 0:
            rows = rows.filter(order <= int(bs[0].config["limit"]))

    def agg(b: Binding) -> Column:
        hit = F.lit(True) if ranked else hits(b)
        kind, name = b.config.get("aggregate") or "sum", b.config.get("value_field") or b.config.get("sum_field")
        if kind == "count":
            return F.count_if(hit)
        value = F.col(f"`{name}`") if kind in ("first", "last", "list") else _numeric(F.col(f"`{name}`"), types[name])
        if b.config.get("rows_source") == "doctype_query" and b.config.get("fields") and name not in b.config["fields"]:
            value = F.when(F.lit(False), value)
        return aggregate_of(kind, F.when(hit, value), order)

    found = rows.groupBy("__p").agg(*[agg(b).alias(f"__v_{b.variable}") for b in bs])
    joined = df.join(found, F.col(f"`{r.key}`") == F.col("__p"), "left")
    return joined.withColumns({b.variable: F.coalesce(F.col(f"__v_{b.variable}"), F.lit(0).cast("long")) if b.config.get("aggregate") == "count" else F.col(f"__v_{b.variable}") for b in bs})


def _filters(b: Binding) -> list[tuple[str, str, object]]:
    out = fl.rows_of(b.config.get("filters"))
    if b.config.get("key_field"):
        out.append((b.config["key_field"], "=", b.config.get("key_value")))
    return out


@register_source("reuse_formula_result", ("formula_document", "line_field", "result_field"), lambda c: tuple(_stable(c.get(k)) for k in ("formula_document", "document_name", "scope_field", "scope_value", "scope_order_by", "filters", "line_field", "line_match", "line_match_field")), casts=True)
def reuse_formula_result(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """The latest document of a scope (or the named one), its lines that match, and an aggregate."""
    c = bs[0].config
    docs = r.catalog.table(c["formula_document"]).filter(fl.constant_condition(c.get("filters")))
    key = r.catalog.key(c["formula_document"])
    lines = r.catalog.table(c["line_field"])
    if c.get("document_name"):
        df2, on = df.withColumn("__doc", fl.value_column(c["document_name"], df.columns)), None
    else:
        by = (c.get("scope_order_by") or "modified desc").split()
        newest = F.max_by if len(by) > 1 and by[1].lower() == "desc" else F.min_by
        latest = docs.groupBy(fl.text_key(F.col(c["scope_field"])).alias("__scope")).agg(newest(F.col(key), F.struct(by[0], key)).alias("__doc"))
        on = fl.text_key(fl.value_column(c.get("scope_value"), df.columns)) == F.col("__scope")
        df2 = df.join(latest, on, "left").drop("__scope")
    types = {f.name: f.dataType for f in lines.schema.fields}
    order = r.catalog.ordinal(c["line_field"], lines)
    keys = [F.col(r.parent).alias("__p")]
    match = c.get("line_match_field") or c.get("line_match_key")
    if match:
        keys.append(fl.text_key(F.col(match)).alias("__m"))

    def agg(b: Binding) -> Column:
        kind, name = b.config.get("aggregation") or "sum", b.config["result_field"]
        value = F.col(name) if kind in ("first", "last", "count") else _numeric(F.col(name), types[name])
        return aggregate_of(kind, value, order, non_null=False)

    found = lines.groupBy(*keys).agg(*[agg(b).alias(f"__v_{b.variable}") for b in bs])
    cond = F.col("__doc") == F.col("__p")
    if match:
        df2 = df2.withColumn("__want", fl.text_key(fl.value_column(c.get("line_match"), df.columns)))
        cond = cond & (F.col("__want") == F.col("__m"))
    joined = df2.join(found, cond, "left")
    return joined.withColumns({b.variable: F.col(f"__v_{b.variable}") for b in bs})


# --- price tables


def _fold(c: Column, insensitive: bool) -> Column:
    k = fl.text_key(c)
    return F.lower(k) if insensitive else k


@register_source("matrix_lookup", ("doctype", "value_field"), None, casts=True)
def matrix_lookup(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """Exact, then fallback row with exact column, then exact row with fallback column, then both
    fallbacks. The matrix is reduced to its first non-null cell for each pair of keys once."""
    for b in bs:
        c = b.config
        table = r.catalog.table(c["doctype"]).filter(fl.constant_condition(c.get("filters"))).filter(F.col(c["value_field"]).isNotNull())
        loose = (c.get("match_mode") or "") in ("case_insensitive", "ci", "insensitive")
        axes = [(c.get(f"{a}_key_field"), c.get(f"{a}_key"), c.get(f"fallback_{a}_key")) for a in ("row", "col")]
        axes = [a for a in axes if a[0]]
        order = r.catalog.ordinal(c["doctype"], table)
        cells = table.groupBy(*[_fold(F.col(f), loose).alias(f"__a{k}") for k, (f, _, _) in enumerate(axes)]).agg(F.min_by(c["value_field"], order).alias("__v"))
        if not axes:
            df = df.join(F.broadcast(cells.withColumnRenamed("__v", b.variable)), F.lit(True), "left")  # one row
            continue
        # the attempts in their order: which axes fall back
        tries = sorted(itertools.product((False, True), repeat=len(axes)), key=lambda t: (sum(t), t[::-1])) if len(axes) == 1 else [(False, False), (True, False), (False, True), (True, True)]
        tries = [t for t in tries if all(not back or axes[k][2] not in (None, "") for k, back in enumerate(t))]
        found = []
        for n, t in enumerate(tries):
            right = cells.select(*[F.col(f"__a{k}").alias(f"__a{k}_{n}") for k in range(len(axes))], F.col("__v").alias(f"__v_{n}"))
            wants = [_fold(fl.value_column(axes[k][2] if back else axes[k][1], df.columns, c), loose) for k, back in enumerate(t)]
            df = df.withColumns({f"__w{k}_{n}": w for k, w in enumerate(wants)})
            on = [F.col(f"__w{k}_{n}") == F.col(f"__a{k}_{n}") for k in range(len(axes))]
            df = df.join(r.catalog.sized(c["doctype"], right), on, "left")
            found.append(F.col(f"__v_{n}"))
        df = df.withColumn(b.variable, F.coalesce(*found)).drop(*[x for x in df.columns if x.startswith(("__w", "__a", "__v_"))])
    return df


@register_source("composite_key_lookup", ("doctype", "value_field", "key_fields", "key_values"), None, casts=True)
def composite_key_lookup(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """Exact over all given dimensions; then each fallback subset among rows whose other dimensions
    are wild (null, '', ANY) or equal. A match on a subset is multiplied by the dropped dimensions'
    multipliers. Every attempt is one join on the subset's key, with the residual test on the rest."""
    for b in bs:
        c = b.config
        dims = list(c["key_fields"])
        table = r.catalog.table(c["doctype"]).filter(fl.constant_condition(c.get("filters"))).filter(F.col(c["value_field"]).isNotNull())
        loose = (c.get("match_mode") or "") in ("case_insensitive", "ci", "insensitive")
        order = r.catalog.ordinal(c["doctype"], table)
        prices = table.select(*[_fold(F.col(d), loose).alias(f"__d{k}") for k, d in enumerate(dims)], order.alias("__o"), F.col(c["value_field"]).alias("__v"))
        df = df.withColumns({f"__q{k}": _fold(fl.value_column(v, df.columns, c), loose) for k, v in enumerate(c["key_values"])}).withColumn("__row", F.struct(*[F.col(f"`{x}`") for x in [r.key]]))
        values = []
        subsets = [list(range(len(dims))), *[[dims.index(d) for d in s if d in dims] for s in (c.get("fallback_keys") or []) if s]]
        for n, subset in enumerate(subsets):
            rest = [k for k in range(len(dims)) if k not in subset] if n else []
            compared = subset if n else list(range(len(dims)))
            right = prices.select(*[F.col(f"__d{k}").alias(f"__d{k}_{n}") for k in range(len(dims))], F.struct(F.col("__o").alias("o"), F.col("__v").alias("v")).alias("__p"))
            # the rows of one key stay together, first row first, so that a document joins one row
            grouped = right.groupBy(*[f"__d{k}_{n}" for k in compared]).agg(F.array_sort(F.collect_list(F.struct(F.col("__p.o").alias("o"), F.col("__p.v").alias("v"), *[F.col(f"__d{k}_{n}").alias(f"r{k}") for k in rest]))).alias(f"__rows_{n}"))
            on = [F.col(f"__q{k}") == F.col(f"__d{k}_{n}") for k in compared]
            df = df.join(r.catalog.sized(c["doctype"], grouped), on, "left")
            fits = F.filter(F.col(f"__rows_{n}"), _fitting(rest))
            value = F.get(fits, F.lit(0))["v"]
            if n:
                for k in rest:
                    m = (c.get("multipliers") or {}).get(dims[k])
                    if m:
                        name = f"__m{n}_{k}"
                        df = _multiplier(r, df, m, name, c, f"__q{k}")
                        value = value * F.coalesce(F.col(name), F.lit(1.0))
            values.append(value)
        df = df.withColumn(b.variable, F.coalesce(*values)).drop(*[x for x in df.columns if x.startswith(("__d", "__q", "__rows", "__m", "__row"))])
    return df


def _fitting(rest: list[int]):
    wild = lambda x: x.isNull() | x.isin("", "ANY", "any")
    return lambda e: _all_of([wild(e[f"r{k}"]) | F.coalesce(e[f"r{k}"] == F.col(f"__q{k}"), F.lit(False)) for k in rest])


def _all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _multiplier(r: Resolver, df: DataFrame, m, name: str, c, asked: str) -> DataFrame:
    table = r.catalog.table(m["doctype"])
    best = table.groupBy(fl.text_key(F.col(m["match_field"])).alias(f"{name}_k")).agg(F.min_by(F.col(m["value_field"]).cast("double"), r.catalog.ordinal(m["doctype"], table)).alias(name))
    want = fl.text_key(fl.value_column(m["match_value"], df.columns, c)) if m.get("match_value") is not None else F.col(asked)
    return df.withColumn(f"{name}_w", want).join(r.catalog.sized(m["doctype"], best), F.col(f"{name}_w") == F.col(f"{name}_k"), "left")


#: Bands that go to every task in one row.
MAX_BANDS = 10_000


@register_source("range_lookup", ("doctype", "value_field", "input_value", "range_from_field", "range_to_field"), None, casts=True)
def range_lookup(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """Inclusive bands, the first in the table's order that holds the value. The bands go to every
    task as rows of MAX_BANDS bands, one after the other; documents are not shuffled."""
    for b in bs:
        c = b.config
        t = r.catalog.table(c["doctype"]).filter(fl.constant_condition(c.get("filters")))
        num = lambda x: F.col(x).cast("string").try_cast("double")
        bands = t.select(num(c["range_from_field"]).alias("lo"), num(c["range_to_field"]).alias("hi"), F.col(c["value_field"]).alias("v"), r.catalog.ordinal(c["doctype"], t).alias("o")).filter("lo IS NOT NULL AND hi IS NOT NULL")
        parts = [bands]
        if bands.limit(MAX_BANDS + 1).count() > MAX_BANDS:
            path = f"{shared_folder(bands.sparkSession, 'bands')}/rows"
            place = F.row_number().over(Window.orderBy("o", "lo", "hi", "v")) - 1
            bands.withColumn("part", F.floor(place / MAX_BANDS)).write.parquet(path)
            placed = bands.sparkSession.read.parquet(path)
            parts = [placed.filter(F.col("part") == k) for k in range(placed.agg(F.max("part")).first()[0] + 1)]
        x = fl.value_column(c["input_value"], df.columns, c).cast("string").try_cast("double")
        df = df.withColumn("__x", x)
        for k, part in enumerate(parts):
            one = part.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "lo", "hi", "v"))), lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), e["v"].alias("v"))).alias("__bands"))
            df = df.join(F.broadcast(one), F.lit(True), "left")  # one row of at most MAX_BANDS bands
            hit = F.get(F.filter("__bands", lambda e: (F.col("__x") >= e["lo"]) & (F.col("__x") <= e["hi"])), F.lit(0))
            df = df.withColumn("__hit", F.coalesce("__hit", hit) if k else hit).drop("__bands")
        df = df.withColumn(b.variable, F.col("__hit")["v"]).drop("__x", "__hit")
    return df


# --- composition


def _inner(step, parent: Binding, name: str) -> Binding:
    return Binding(name, step["source_type"], step.get("source_config") or {}, step.get("data_type"), step.get("default_value"), transform=step.get("transform"))


def _resolve_one(r: Resolver, df: DataFrame, b: Binding) -> DataFrame:
    kept = df.columns
    out = SOURCES[b.source_type].resolve(r, df, [b])
    return out.select(*[F.col(f"`{c}`") for c in kept if c != b.variable], r.finish(out, b))


@register_source("pipeline", ("steps",), None)
def pipeline(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """Steps in order, each seen by the later ones; the last one's value, or all as a struct."""
    for b in bs:
        names = []
        for k, step in enumerate(b.config["steps"]):
            name = step.get("output_as") or f"{b.variable}_step{k}"
            try:
                df = _resolve_one(r, df, _inner(step, b, name))
            except FormulaError:
                if r.strict and step.get("default_value") is None:
                    raise
                df = df.withColumn(name, F.lit(step.get("default_value")))
            names.append(name)
        whole = (b.config.get("merge_strategy") or "last") == "all"
        df = df.withColumn(b.variable, F.struct(*[F.col(f"`{n}`") for n in names]) if whole else F.col(f"`{names[-1]}`"))
        df = df.drop(*[n for n in names if n != b.variable])
    return df


def _common(df: DataFrame, names: list[str]) -> T.DataType:
    out: T.DataType = T.NullType()
    for n in names:
        out = V.unify(out, V.from_column(F.col(n), df.schema[n].dataType).dtype)
    return out


@register_source("conditional", ("branches",), None)
def conditional(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """The first branch whose condition holds; conditions that fail are skipped."""
    for b in bs:
        names, conditions = [], []
        for k, branch in enumerate([*b.config["branches"], *([b.config["default"]] if b.config.get("default") else [])]):
            name = f"__b{k}_{b.variable}"
            df = _resolve_one(r, df, _inner(branch, b, name))
            names.append(name)
            text = branch.get("condition")
            if text is None:
                conditions.append(F.lit(True))
                continue
            text = fl._TEMPLATE.sub(lambda m: m[2], text)
            try:
                v = r.formula(df, text.replace("{{", "").replace("}}", "").strip())
                conditions.append((F.coalesce(v.ok, F.lit(False)) & V.truthy(v)) if v.ok is not None else V.truthy(v))
            except FormulaError:
                conditions.append(F.lit(False))
        t = _common(df, names)
        out = None
        for name, cond in zip(names, conditions, strict=True):
            c = V.cast(V.from_column(F.col(f"`{name}`"), df.schema[name].dataType), t)
            out = F.when(cond, c) if out is None else out.when(cond, c)
        df = df.withColumn(b.variable, out).drop(*names)
    return df


@register_source("fallback_chain", ("chain",), None)
def fallback_chain(r: Resolver, df: DataFrame, bs: list[Binding]) -> DataFrame:
    """The first link that gives a value; each link has its own transform."""
    for b in bs:
        names = []
        for k, link in enumerate(b.config["chain"]):
            name = f"__c{k}_{b.variable}"
            try:
                df = _resolve_one(r, df, _inner(link, b, name))
            except FormulaError:
                if link.get("on_failure") == "raise":
                    break
                continue
            names.append(name)
        t = _common(df, names) if names else V.DOUBLE
        df = df.withColumn(b.variable, F.coalesce(*[V.cast(V.from_column(F.col(f"`{n}`"), df.schema[n].dataType), t) for n in names]) if names else F.lit(None).cast("double")).drop(*names)
    return df

