"""Bindings: variables that look their value up. Each source type is a transform of the DataFrame of
documents; bindings that read the same rows of the same table share one join or one aggregate.

A document has one row and a unique key column; a binding adds one column. Where the reference
model says "first row", the catalog's order of the table decides.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import BindingError, CircularReferenceError, FormulaError
from ledgerloom.expr import parser
from ledgerloom.expr import values as V
from ledgerloom.expr.compiler import Compiler
from ledgerloom.functions.registry import load, spellings
from ledgerloom.plans.dag import Dag
from ledgerloom.sources import filters as fl
from ledgerloom.sources import schema as sc
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.transform import cast_value, transform_value


@dataclass(frozen=True)
class Binding:
    variable: str
    source_type: str
    config: Mapping = field(default_factory=dict)
    data_type: str | None = None
    default: object = None
    priority: int = 10
    batch_group: str | None = None
    transform: Mapping | None = None
    applies_to: str | None = None
    applies_to_field: str | None = None
    is_global: bool = True
    is_active: bool = True

    @staticmethod
    def of(record: Mapping) -> Binding:
        """From a record with the stored field names."""
        config = record.get("source_config") or record.get("config") or {}
        config = json.loads(config) if isinstance(config, str) else config
        return Binding(
            record.get("variable_name") or record["variable"], record["source_type"], config, record.get("data_type"), record.get("default_value", record.get("default")),
            int(record.get("resolve_priority", 10)), record.get("batch_group"), record.get("transform") or config.get("transform"), record.get("applies_to_doctype"), record.get("applies_to_field"),
            bool(record.get("is_global", True)), bool(record.get("is_active", True)),
        )


@dataclass(frozen=True)
class SourceType:
    name: str
    resolve: Callable[[Resolver, DataFrame, list[Binding]], DataFrame]
    required: tuple[str, ...] = ()
    fingerprint: Callable[[Mapping], tuple] | None = None
    casts: bool = False
    schema: Mapping = field(default_factory=dict)
    label: str = ""


SOURCES: dict[str, SourceType] = {}


def register_source(name: str, required: tuple[str, ...] = (), fingerprint=None, casts: bool = False, schema: Mapping | None = None, label: str = ""):
    """Register resolve(resolver, df, bindings) -> df with a column for each binding. Bindings with
    equal fingerprints are resolved together. schema: what a configuration must look like (see
    sources.schema)."""

    def keep(resolve):
        SOURCES[name] = SourceType(name, resolve, required, fingerprint, casts, schema if schema is not None else sc.schema_of(name), label or name.replace("_", " "))
        return resolve

    return keep


def validate(binding: Binding) -> list[str]:
    kind = SOURCES.get(binding.source_type)
    if kind is None:
        return [f"unknown source type {binding.source_type!r}"]
    found = [f"{binding.source_type}: {k} is required" for k in kind.required if binding.config.get(k) in (None, "", [])]
    if binding.source_type == "computed" and binding.variable in (binding.config.get("dependencies") or []):
        found.append("computed: depends on itself")
    return found + [f"{kind.name}: {p}" for p in sc.problems(binding.config, kind.schema) if not (p.endswith(": required") and p[7:-10] in kind.required)]


def discover() -> list[str]:
    """Load the source types that installed packages offer (entry points of `ledgerloom.sources`, each
    a function without arguments that registers them); their names."""
    from importlib.metadata import entry_points

    before = set(SOURCES)
    for point in entry_points(group="ledgerloom.sources"):
        point.load()()
    return sorted(set(SOURCES) - before)


def in_scope(bindings: list[Binding], doctype: str | None = None, field_name: str | None = None) -> list[Binding]:
    """Active bindings that are global, of the doctype, or of the doctype's field; of one variable
    the first counts."""
    out: dict[str, Binding] = {}
    for b in bindings:
        fits = b.applies_to is None and b.is_global or (b.applies_to == doctype and b.applies_to_field in (None, "", field_name))
        if b.is_active and fits:
            out.setdefault(b.variable, b)
    return list(out.values())


def dependency_graph(bindings: list[Binding]) -> Dag:
    names = {b.variable for b in bindings}
    return Dag({b.variable: frozenset(_reads(b)) & names - ({b.variable} if b.source_type != "computed" else set()) for b in bindings})


def _reads(b: Binding) -> set[str]:
    """Variables that a binding reads: declared ones, and those in its templates and conditions."""
    found = set(b.config.get("dependencies") or [])
    text = json.dumps(b.config, default=str)
    found |= {m[2] for m in fl._TEMPLATE.finditer(text) if m[1] in ("resolved", "inputs")}
    if b.source_type == "computed" and b.config.get("formula"):
        try:
            found |= parser.names(parser.parse(b.config["formula"], spellings(load())))
        except FormulaError:
            pass
    if b.source_type == "aggregate_from_items" and b.config.get("rows_source") == "resolved":
        found.add(b.config.get("rows_var"))
    return found


def circular(bindings: list[Binding]) -> str | None:
    try:
        dependency_graph(bindings).order()
    except CircularReferenceError as e:
        return str(e)
    return None


@dataclass
class Resolver:
    """children: child tables by name, with `parent` pointing at the document's key."""

    catalog: Catalog
    key: str = "name"
    children: Mapping[str, DataFrame] = field(default_factory=dict)
    parent: str = "parent"
    strict: bool = True
    registry: Mapping = field(default_factory=load)

    def groups(self, bindings: list[Binding]) -> list[list[Binding]]:
        """Bindings in the order in which they are resolved; those of a group share their scan."""
        by = {b.variable: b for b in bindings}
        graph = dependency_graph(bindings)
        try:
            levels = graph.levels()
        except CircularReferenceError:
            if self.strict:
                raise
            levels = [[b.variable] for b in sorted(bindings, key=lambda b: b.priority)]
        out = []
        for level in levels:
            found: dict[tuple, list[Binding]] = {}
            for b in sorted((by[n] for n in level), key=lambda b: (b.priority, b.variable)):
                kind = SOURCES.get(b.source_type)
                if kind is None:
                    raise BindingError(f"unknown source type {b.source_type!r}")
                print_ = (b.source_type, b.batch_group, *kind.fingerprint(b.config)) if kind.fingerprint else (b.source_type, b.variable)
                found.setdefault(print_, []).append(b)
            out += list(found.values())
        return out

    def preview(self, bindings: list[Binding]) -> dict:
        groups = self.groups(bindings)
        scans = [g for g in groups if SOURCES[g[0].source_type].fingerprint]
        alone = sum(len(g) for g in scans)
        return {
            "groups": [{"source_type": g[0].source_type, "variables": [b.variable for b in g], "strategy": "shared" if len(g) > 1 else "single"} for g in groups],
            "bindings": len(bindings), "scans": len(scans), "scans_alone": alone, "reduction_pct": round(100 * (1 - len(scans) / alone), 1) if alone else 0.0,
        }

    def resolve(self, df: DataFrame, bindings: list[Binding]) -> DataFrame:
        """df with a column for each binding."""
        for b in bindings:
            if problems := validate(b):
                raise BindingError("; ".join(problems))
        for group in self.groups(bindings):
            before = df.columns
            df = SOURCES[group[0].source_type].resolve(self, df, group)
            df = df.select(*[F.col(f"`{c}`") for c in before if c not in {b.variable for b in group}], *[self.finish(df, b) for b in group])
        return df

    def try_binding(self, df: DataFrame, binding: Binding) -> dict:
        """Check a binding, and its value for one row of df: ok, errors, value."""
        if found := validate(binding):
            return {"ok": False, "errors": found, "value": None}
        try:
            row = self.resolve(df.limit(1), [binding]).select(binding.variable).first()
        except FormulaError as e:
            return {"ok": False, "errors": [str(e)], "value": None}
        return {"ok": True, "errors": [], "value": row[0] if row else None}

    def finish(self, df: DataFrame, b: Binding) -> Column:
        """Cast, default and transform of a resolved column."""
        c, t = F.col(f"`{b.variable}`"), df.schema[b.variable].dataType
        if isinstance(t, T.NullType):
            c, t = c.cast("double"), V.DOUBLE
        if SOURCES[b.source_type].casts or b.source_type == "constant":
            kind = b.data_type or b.config.get("type")
            c = cast_value(c, t, kind)
            t = {"Int": V.LONG, "Float": V.DOUBLE, "Currency": V.DOUBLE, "Percent": V.DOUBLE, "Check": V.BOOL, "Bool": V.BOOL}.get(kind or "", t)
        default = b.config.get("default_value", b.default) if b.default is None else b.default
        if default is not None and not isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            c = F.coalesce(c, F.lit(default).cast(t))
        return transform_value(c, t, b.transform).alias(b.variable)

    # --- helpers of the source types

    def formula(self, df: DataFrame, text: str, policy=parser.FORMULA, row: Mapping[str, V.Val] | None = None) -> V.Val:
        env = {f.name: V.from_column(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields} | dict(row or {})
        return Compiler(env, self.registry).compile(parser.parse(text, spellings(self.registry), policy))

    def first_rows(self, table: str, df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        """One row for each key: the first in the catalog's order."""
        if not keys:
            return df.agg(F.min_by(F.struct(*values), self.catalog.ordinal(table, df)).alias("__v")).select(*[F.col(f"__v.{v}").alias(v) for v in values])
        best = df.groupBy(*keys).agg(F.min_by(F.struct(*values), self.catalog.ordinal(table, df)).alias("__v"))
        return best.select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])

    def child(self, name: str) -> DataFrame:
        if name not in self.children:
            raise BindingError(f"unknown child table {name!r}")
        return self.children[name]

    def filtered_rows(self, table: DataFrame, expression: str | None) -> DataFrame:
        """Rows for which an expression over `row` holds; rows where it fails are left out."""
        if not expression:
            return table
        row = V.Val(F.struct(*[F.col(f"`{c}`") for c in table.columns]), table.schema)
        fields = {f.name: V.from_column(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields}
        v = Compiler({"row": row} | fields, self.registry).compile(parser.parse(expression, spellings(self.registry)))
        return table.filter(F.coalesce(v.ok, F.lit(False)) & V.truthy(v) if v.ok is not None else V.truthy(v))


def aggregate_of(kind: str, value: Column, order: Column | None = None, non_null: bool = True) -> Column:
    numeric = value
    if kind in ("sum", "avg", "average"):
        return F.sum(numeric) if kind == "sum" else F.avg(numeric)
    if kind in ("min", "max"):
        return F.min(value) if kind == "min" else F.max(value)
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "list":
        return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda e: e["v"])
    if kind in ("first", "last"):
        at = F.when(value.isNotNull(), order) if non_null else order
        return F.min_by(value, at) if kind == "first" else F.max_by(value, at)
    raise BindingError(f"unknown aggregate {kind!r}")
