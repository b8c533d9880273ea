"""FormulaEngine: a set of named formulas compiled to a stack of projections, one per level of the
dependency graph. No row is ever handled in Python."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ArgumentError, BudgetError, FormulaError, LimitError, StaleContextError, UnknownVariableError
from ledgerloom.expr import parser
from ledgerloom.expr import values as V
from ledgerloom.expr.compiler import Compiler
from ledgerloom.expr.values import Val
from ledgerloom.functions.registry import Function, load, spellings
from ledgerloom.plans.dag import Dag

ON_ERROR, ZERO = ("default", "null", "raise"), ("raise", "warn", "allow")
#: Columns of one projection; wider levels are cut so that generated code stays within JVM limits.
WIDTH = 200


@dataclass(frozen=True)
class Assertion:
    """A condition over inputs and outputs that is checked after rounding and never changes values."""

    name: str
    expression: str
    message: str = ""
    severity: str = "WARNING"
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class InputField:
    name: str
    dtype: str | None = None
    required: bool = False
    default: object = None
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple | None = None


@dataclass(frozen=True)
class OutputField:
    name: str
    unit: str | None = None
    bucket: str | None = None
    primary: bool = False


@dataclass(frozen=True)
class Meta:
    """Identity and validity of a formula set."""

    id: str = ""
    version: str = "1"
    effective_from: str | None = None
    effective_to: str | None = None
    frozen: bool = False

    @property
    def uid(self) -> str:
        return f"{self.id}@{self.version}"

    def is_effective(self, day: str) -> bool:
        return (self.effective_from or "") <= day and (self.effective_to is None or day <= self.effective_to)


@dataclass(frozen=True)
class Compiled:
    """One formula against a schema: its column under the error mode, and where it failed."""

    name: str
    value: Column
    dtype: T.DataType
    failed: Column | None
    zero: Column | None


@dataclass(frozen=True)
class IncrementalContext:
    """A result of apply() with its inputs, one row a key, and the formulas that it came from."""

    data: DataFrame
    key: str
    engine_hash: str


@dataclass
class FormulaEngine:
    """formulas: {"name", "formula", optional "bucket" and "group"}, or a mapping of name to text.

    on_error: an undefined value becomes default_value ("default"), NULL ("null"), or stops the job
    ("raise"). zero_division_policy: a division by zero stops the job ("raise"), becomes
    default_value with a warning ("warn"), or follows on_error ("allow"). functions: more functions
    by name; Column builders over values.
    """

    formulas: Iterable[Mapping] | Mapping[str, str]
    functions: Mapping[str, Function] | None = None
    on_error: str = "default"
    default_value: object = 0
    zero_division_policy: str = "raise"
    rounding_policy: Mapping[str, Mapping] | None = None
    assertions: Iterable[Assertion] = ()
    input_fields: Iterable[InputField] = ()
    output_fields: Iterable[OutputField] = ()
    meta: Meta = Meta()
    deterministic: bool = True
    strict: bool = False
    max_formula_count: int | None = None
    max_dependency_depth: int | None = None
    max_operations: int | None = None
    disabled: frozenset[str] = frozenset()
    aliases: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.on_error not in ON_ERROR or self.zero_division_policy not in ZERO:
            raise ArgumentError(f"on_error is one of {ON_ERROR}, zero_division_policy one of {ZERO}")
        listed = [{"name": k, "formula": v} for k, v in self.formulas.items()] if isinstance(self.formulas, Mapping) else [dict(f) for f in self.formulas]
        self.formulas = listed
        self.assertions, self.input_fields, self.output_fields = tuple(self.assertions), tuple(self.input_fields), tuple(self.output_fields)
        if self.max_formula_count is not None and len(listed) > self.max_formula_count:
            raise LimitError(f"{len(listed)} formulas; at most {self.max_formula_count} are allowed")
        known = {k: f for k, f in load().items() if k not in self.disabled and not (self.deterministic and k in ("now", "today"))}
        known |= {a: known[k] for a, k in self.aliases.items() if k in known}
        self.registry = known | dict(self.functions or {})
        spelled = spellings(self.registry)
        self.texts: dict[str, str] = {}
        for f in listed:
            self.texts[f["name"]] = str(f["formula"])  # a later formula replaces an earlier one
        self.trees = {n: parser.parse(t, spelled) for n, t in self.texts.items()}
        self.reads = {n: frozenset(parser.names(t)) for n, t in self.trees.items()}
        self.dag = Dag({n: r & self.texts.keys() for n, r in self.reads.items()})
        self.topo_order = self.dag.order()
        self.levels = self.dag.levels()
        if self.max_dependency_depth is not None and len(self.levels) > self.max_dependency_depth:
            raise LimitError(f"dependencies are {len(self.levels)} deep; at most {self.max_dependency_depth} are allowed")
        if self.max_operations is not None and len(self.texts) > self.max_operations:
            raise BudgetError(f"{len(self.texts)} operations a row; the budget is {self.max_operations}")

    # --- identity and introspection

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(sorted(self.texts.items()), ensure_ascii=False).encode()).hexdigest()

    @property
    def inputs(self) -> set[str]:
        from ledgerloom.functions.registry import CONSTANTS

        return {n for r in self.reads.values() for n in r} - self.texts.keys() - CONSTANTS.keys()

    def deps_of(self, name: str) -> set[str]:
        return set(self.dag.needs[name])

    def affected(self, *changed: str) -> set[str]:
        """Formulas downstream of inputs or formulas."""
        direct = {n for n, r in self.reads.items() if r & set(changed)} | (set(changed) & self.texts.keys())
        return direct | self.dag.affected(*direct)

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = [(n, d) for n in self.topo_order for d in sorted(self.reads[n])]
        return spark.createDataFrame(rows, "name string, depends_on string")

    def metadata(self) -> dict:
        return {
            "uid": self.meta.uid, "version": self.meta.version, "names": list(self.texts), "topo_order": self.topo_order, "depth": len(self.levels), "hash": self.hash, "inputs": sorted(self.inputs),
            "groups": {f["name"]: f.get("group") for f in self.formulas}, "buckets": {f["name"]: f.get("bucket") for f in self.formulas},
            "limits": {"max_formula_count": self.max_formula_count, "max_dependency_depth": self.max_dependency_depth, "max_operations": self.max_operations},
        }

    def validate(self, text: str, known=None) -> parser.ValidationResult:
        return parser.validate(text, spellings(self.registry), known)

    def validate_all(self, known=None) -> dict[str, parser.ValidationResult]:
        names = None if known is None else set(known) | self.texts.keys()
        return {n: self.validate(t, names) for n, t in self.texts.items()}

    def with_formula(self, name: str, text: str, **extra) -> FormulaEngine:
        """A new engine with one formula added or replaced."""
        if self.meta.frozen:
            raise FormulaError(f"formula set {self.meta.uid} is frozen")
        rest = [f for f in self.formulas if f["name"] != name]
        return FormulaEngine([*rest, {"name": name, "formula": text, **extra}], **self._options())

    def _options(self) -> dict:
        keys = ("functions", "on_error", "default_value", "zero_division_policy", "rounding_policy", "assertions", "input_fields", "output_fields", "meta", "deterministic", "strict", "max_formula_count", "max_dependency_depth", "max_operations", "disabled", "aliases")
        return {k: getattr(self, k) for k in keys}

    def to_dict(self) -> dict:
        return {"formulas": self.formulas, "hash": self.hash, "on_error": self.on_error, "default_value": self.default_value, "zero_division_policy": self.zero_division_policy, "rounding_policy": self.rounding_policy}

    @classmethod
    def from_dict(cls, data: Mapping) -> FormulaEngine:
        engine = cls(data["formulas"], **{k: data[k] for k in ("on_error", "default_value", "zero_division_policy", "rounding_policy") if k in data})
        if data.get("hash") and data["hash"] != engine.hash:
            raise FormulaError("the stored hash doesn't fit the formulas")
        return engine

    # --- compiling

    def _fallback(self, dtype: T.DataType) -> Column:
        if self.on_error == "null" or self.default_value is None:
            return F.lit(None).cast(dtype)
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) or V.is_date(dtype):
            return F.lit(None).cast(dtype)
        if V.is_bool(dtype):
            return F.lit(bool(self.default_value))
        return F.lit(self.default_value).cast(dtype)

    def compile_value(self, name: str, v: Val) -> Compiled:
        dtype = V.STRING if V.is_null(v.dtype) else v.dtype
        value = V.cast(v, dtype) if not V.is_null(v.dtype) else F.lit(None).cast("string")
        happened = None if v.zero is None else F.coalesce(v.zero, F.lit(False))
        if v.ok is not None:
            stop = F.raise_error(F.lit(f"formula {name!r} failed")).cast(dtype)
            value = F.when(v.ok, value).otherwise(stop if self.on_error == "raise" else self._fallback(dtype))
        if happened is not None and self.zero_division_policy == "raise":
            value = F.when(happened, F.raise_error(F.lit(f"division by zero in formula {name!r}")).cast(dtype)).otherwise(value)
        elif happened is not None and self.zero_division_policy == "warn":
            default = F.lit(self.default_value).cast(dtype) if self.default_value is not None else F.lit(None).cast(dtype)
            value = F.when(happened, default).otherwise(value)
        failed = None if v.ok is None else ~F.coalesce(v.ok, F.lit(False))
        return Compiled(name, value, dtype, failed, happened)

    def _missing(self, names: set[str]) -> None:
        if self.on_error == "raise" or self.strict:
            raise UnknownVariableError(f"missing inputs: {', '.join(sorted(names))}")

    def _defaults(self, df: DataFrame) -> DataFrame:
        for f in self.input_fields:
            if f.name not in df.columns:
                if not f.required and f.default is not None:
                    df = df.withColumn(f.name, F.lit(f.default))
                elif f.required and self.strict:
                    raise UnknownVariableError(f"missing required input {f.name!r}")
        return df

    def apply(
        self, df: DataFrame, *, keep_inputs: bool = True, only: Iterable[str] | None = None, errors_col: str | None = None, warnings_col: str | None = None,
        trace_col: str | None = None, trace_fields: Iterable[str] | None = None, violations_col: str | None = None,
    ) -> DataFrame:
        """df with a column for every formula (only: for these, and what they need).

        errors_col: array<string> of the formulas that failed in a row; warnings_col: of those that
        divided by zero under "warn"; trace_col: map of a formula to its text, dependency values and
        result; violations_col: failed assertions. A formula that reads an input which df doesn't
        have fails in every row. keep_inputs=False returns the formulas alone, in topological order.
        """
        wanted = set(self.topo_order) if only is None else set(only) | self.dag.ancestors(*only)
        df = self._defaults(df)
        base_columns = [c for c in df.columns if c not in self.texts]
        env = {f.name: V.from_column(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        failed: dict[str, str] = {}
        warned: dict[str, str] = {}
        out, hidden = df, []
        for level in self.levels:
            names = [n for n in level if n in wanted]
            for start in range(0, len(names), WIDTH):
                made: dict[str, Column] = {}
                fresh: dict[str, Val] = {}
                for n in names[start : start + WIDTH]:
                    c = self._compile_one(n, env)
                    made[n] = c.value
                    fresh[n] = Val(F.col(f"`{n}`"), c.dtype)
                    for flag, store, on in ((c.failed, failed, errors_col), (c.zero if self.zero_division_policy == "warn" else None, warned, warnings_col)):
                        if on and flag is not None:
                            key = f"__{'e' if store is failed else 'w'}_{n}"
                            made[key] = flag
                            store[n] = key
                            hidden.append(key)
                out = out.withColumns(made) if made else out
                env |= fresh
        order = [n for n in self.topo_order if n in wanted]
        if trace_col:
            out = out.withColumn(trace_col, self._trace(order if trace_fields is None else [n for n in order if n in set(trace_fields)], env))
        rounding = {n: F.bround(F.col(f"`{n}`").cast("double"), int(p.get("decimals", 0))).cast(env[n].dtype) for n, p in (self.rounding_policy or {}).items() if n in wanted and V.is_num(env[n].dtype)}
        out = out.withColumns(rounding) if rounding else out
        extra: dict[str, Column] = {}
        listed = lambda store: F.array_compact(F.array(*[F.when(F.col(f"`{k}`"), F.lit(n)) for n, k in store.items()])) if store else F.array().cast("array<string>")
        if errors_col:
            extra[errors_col] = listed(failed)
        if warnings_col:
            extra[warnings_col] = listed(warned)
        checks = self._violations(env)
        if violations_col:
            extra[violations_col] = checks if checks is not None else F.array().cast("array<struct<name:string,severity:string,message:string>>")
        out = out.withColumns(extra) if extra else out
        if checks is not None and self.on_error == "raise" and any(a.severity == "ERROR" for a in self.assertions):
            broken = F.exists(checks, lambda v: v["severity"] == "ERROR")
            out = out.filter(F.when(broken, F.raise_error(F.lit("an assertion failed")).cast("boolean")).otherwise(F.lit(True)))
        keep = (base_columns if keep_inputs else []) + order + [c for c in (trace_col, errors_col, warnings_col, violations_col) if c]
        return out.select(*[F.col(f"`{c}`") for c in keep])

    def _compile_one(self, name: str, env: Mapping[str, Val]) -> Compiled:
        gone = {r for r in self.reads[name] if r not in env}
        try:
            return self.compile_value(name, Compiler(env, self.registry).compile(self.trees[name]))
        except UnknownVariableError:
            if not gone:
                raise
            self._missing(gone)
            return Compiled(name, self._fallback(V.DOUBLE), V.DOUBLE, F.lit(True), None)

    def column(self, df: DataFrame, text: str) -> Val:
        """A single expression over the columns of df."""
        env = {f.name: V.from_column(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        return Compiler(env, self.registry).compile(parser.parse(text, spellings(self.registry)))

    def _trace(self, names: list[str], env: Mapping[str, Val]) -> Column:
        def step(n: str) -> list[Column]:
            deps = [c for d in sorted(self.reads[n]) if d in env for c in (F.lit(d), V.text(env[d]))]
            deps_map = F.create_map(*deps).cast("map<string,string>") if deps else F.create_map().cast("map<string,string>")
            return [F.lit(n), F.struct(F.lit(self.texts[n]).alias("formula"), deps_map.alias("deps"), V.text(env[n]).alias("result"))]

        return F.create_map(*[c for n in names for c in step(n)])

    def _violations(self, env: Mapping[str, Val]) -> Column | None:
        found = []
        for a in self.assertions:
            tree = parser.parse(a.expression, spellings(self.registry))
            if not set(a.depends_on) <= env.keys() or not parser.names(tree) <= env.keys():
                continue
            v = Compiler(env, self.registry).compile(tree)
            ok = F.coalesce(v.ok, F.lit(False)) if v.ok is not None else F.lit(True)
            one = F.struct(F.lit(a.name).alias("name"), F.when(ok, F.lit(a.severity)).otherwise(F.lit("WARNING")).alias("severity"), F.lit(a.message or a.expression).alias("message"))
            found.append(F.when(~(ok & V.truthy(v)), one))
        return F.array_compact(F.array(*found)) if found else None

    # --- governance

    def explain(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """(key, step, name, formula, value, deps, depth, is_root): how a formula came about in each
        row: one row for each formula it rests on, in topological order."""
        depth = {n: d for d, level in enumerate(self.levels) for n in level}
        steps = [n for n in self.topo_order if n == name or n in self.dag.ancestors(name)]
        out = self.apply(df, only=[name])
        types = {f.name: f.dataType for f in out.schema.fields}
        shown = lambda n: V.text(V.from_column(F.col(f"`{n}`"), types[n])) if n in types else F.lit(None).cast("string")
        rows = [
            F.struct(
                F.lit(k).alias("step"), F.lit(n).alias("name"), F.lit(self.texts[n]).alias("formula"), shown(n).alias("value"),
                F.create_map(*[c for d in sorted(self.reads[n]) for c in (F.lit(d), shown(d))]).cast("map<string,string>").alias("deps") if self.reads[n] else F.create_map().cast("map<string,string>").alias("deps"),
                F.lit(depth[n]).alias("depth"), F.lit(n == name).alias("is_root"),
            )
            for k, n in enumerate(steps)
        ]
        return out.select(key, F.explode(F.array(*rows)).alias("s")).select(key, "s.*")

    def create_context(self, df: DataFrame, key: str) -> IncrementalContext:
        """All formulas over df, for apply_changes()."""
        return IncrementalContext(self.apply(df), key, self.hash)

    def apply_changes(self, context: IncrementalContext, changes: DataFrame, *, order_by: str | None = None) -> IncrementalContext:
        """The context after changes (see apply_incremental). StaleContextError if it came from other
        formulas. Plans grow with each call: write the data out between many."""
        if context.engine_hash != self.hash:
            raise StaleContextError("the context comes from other formulas; create a new one")
        return IncrementalContext(self.apply_incremental(context.data, changes, context.key, order_by=order_by), context.key, self.hash)

    def recalculate(self, context: IncrementalContext, df: DataFrame | None = None) -> IncrementalContext:
        """A context of these formulas over df, or over the inputs that the context holds."""
        inputs = df if df is not None else context.data.select(*[F.col(f"`{c}`") for c in context.data.columns if c not in self.texts])
        return self.create_context(inputs, context.key)

    def apply_incremental(self, before: DataFrame, changes: DataFrame, key: str, *, stats: bool = False, order_by: str | None = None):
        """before: a result of apply() with its inputs; changes: key and the changed input columns.
        Rows without a change keep their values; in the others only formulas downstream of the
        changed columns are computed again. A key that before doesn't have becomes a row of its own,
        with all formulas; its other inputs are null, or their InputField's default. Of several
        changes of a key the last by the column order_by counts; without order_by they stop the job.
        Null keys are one key. stats=True: (DataFrame, counts known without a job)."""
        changed = [c for c in changes.columns if c not in (key, order_by)]
        hit = [n for n in self.topo_order if n in self.affected(*changed)]
        values = F.struct(*[F.col(f"`{c}`") for c in changed])
        one = changes.groupBy(key).agg((F.max_by(values, F.struct(order_by, values)) if order_by else F.first(values)).alias("__c"), F.count(F.lit(1)).alias("__n"))
        if not order_by:
            one = one.filter(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"several changes of one {key}: name the column of their order")).cast("boolean")).otherwise(F.lit(True)))
        changes = one.select(F.col(f"`{key}`"), *[F.col(f"__c.`{c}`").alias(c) for c in changed])
        renamed = changes.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in changed])
        joined = before.join(renamed, before[key].eqNullSafe(F.col("__key")), "left")
        inputs = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in changed}
        base = joined.withColumns(inputs).withColumns({f"__old_{n}": F.col(f"`{n}`") for n in hit}).drop(*hit)
        part = FormulaEngine([f for f in self.formulas if f["name"] in hit], **self._options())
        fresh = part.apply(base)
        kept = fresh.withColumns({n: F.when(F.col("__hit"), F.col(f"`{n}`")).otherwise(F.col(f"__old_{n}")) for n in hit})
        result = kept.select(*[F.col(f"`{c}`") for c in before.columns])
        known = before.select(F.col(f"`{key}`").alias("__key"))
        added = changes.join(known, changes[key].eqNullSafe(F.col("__key")), "left_anti")
        defaults = {f.name: f.default for f in self.input_fields}
        blank = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in before.schema.fields if f.name not in {*self.texts, *changes.columns}}
        created = self.apply(added.withColumns(blank) if blank else added)
        result = result.unionByName(created.select(*[F.col(f"`{c}`").cast(before.schema[c].dataType).alias(c) for c in before.columns]))
        counts = {"total": len(self.texts), "recalculated": len(hit), "skipped": len(self.texts) - len(hit), "affected": hit, "changed": changed}
        return (result, counts) if stats else result

    def scenarios(self, df: DataFrame, overrides: Mapping[str, Mapping[str, object]]) -> DataFrame:
        """df once for each scenario (column `scenario`), with its inputs replaced, and the formulas.
        Rows are repeated by an array literal, so nothing is joined or shuffled."""
        names = sorted({c for o in overrides.values() for c in o})
        rows = F.array(*[F.struct(F.lit(s).alias("scenario"), *[F.lit(o.get(c)).cast(dict(df.dtypes).get(c, "double")).alias(c) for c in names], *[F.lit(c in o).alias(f"has_{c}") for c in names]) for s, o in overrides.items()])
        wide = df.withColumn("__s", F.explode(rows)).withColumn("scenario", F.col("__s.scenario"))
        return self.apply(wide.withColumns({c: F.when(F.col(f"__s.has_{c}"), F.col(f"__s.{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c in names}).drop("__s"))

    def compare_scenarios(self, df: DataFrame, overrides: Mapping[str, Mapping[str, object]], base: str, key: str, fields: Iterable[str]) -> DataFrame:
        """(key, scenario, field, base_value, value, delta, pct): pct is null where the base is 0."""
        out = self.scenarios(df, overrides)
        long = out.select(key, "scenario", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("v")).select(key, "scenario", "v.*")
        by = long.groupBy(key, "field").agg(F.max(F.when(F.col("scenario") == base, F.col("value"))).alias("base_value"), F.collect_list(F.struct("scenario", "value")).alias("all"))
        flat = by.select(key, "field", "base_value", F.explode("all").alias("s")).select(key, F.col("s.scenario").alias("scenario"), "field", "base_value", F.col("s.value").alias("value"))
        delta = F.col("value") - F.col("base_value")
        return flat.withColumn("delta", delta).withColumn("pct", F.when(F.col("base_value") != 0, F.bround(delta / F.abs("base_value") * 100, 2)))

    def validate_inputs(self, df: DataFrame, out: str = "issues") -> DataFrame:
        """df with an array of issues: required, type, minimum, maximum, allowed."""
        found = []
        for f in self.input_fields:
            if f.name not in df.columns:
                found.append(F.lit(f"{f.name}: required") if f.required else F.lit(None).cast("string"))
                continue
            c = F.col(f"`{f.name}`")
            if f.required:
                found.append(F.when(c.isNull(), F.lit(f"{f.name}: required")))
            if f.dtype and dict(df.dtypes)[f.name] != f.dtype:
                found.append(F.when(c.isNotNull() & c.cast("string").try_cast(f.dtype).isNull(), F.lit(f"{f.name}: type")))
            if f.minimum is not None:
                found.append(F.when(c < f.minimum, F.lit(f"{f.name}: minimum")))
            if f.maximum is not None:
                found.append(F.when(c > f.maximum, F.lit(f"{f.name}: maximum")))
            if f.allowed is not None:
                found.append(F.when(~c.isin(*f.allowed), F.lit(f"{f.name}: allowed")))
        return df.withColumn(out, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))

    def apply_safe(self, df: DataFrame) -> DataFrame:
        """apply() that never stops: _ok, _error (failed formulas) and _error_type."""
        calm = FormulaEngine(self.formulas, **(self._options() | {"on_error": "null" if self.on_error == "raise" else self.on_error, "zero_division_policy": "warn"}))
        out = calm.apply(df, errors_col="__e", warnings_col="__w")
        bad = F.array_union("__e", "__w")
        return out.withColumns({"_ok": F.size(bad) == 0, "_error": F.when(F.size(bad) > 0, F.array_join(bad, ",")), "_error_type": F.when(F.size("__w") > 0, "zero_division").when(F.size("__e") > 0, "runtime_error")}).drop("__e", "__w")

    def audit(self, df: DataFrame, key: str, rate: float = 0.001) -> DataFrame:
        """A repeatable sample of rows (by a hash of the key) with their full trace."""
        traced = self.apply(df, trace_col="trace")
        return traced.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000)).select(key, F.lit(self.hash).alias("engine_hash"), F.lit(self.meta.uid).alias("engine_uid"), "trace")

    def roll_up(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Sum of the formulas of each bucket over the rows of df: (by..., bucket, amount)."""
        tagged = [(f["name"], f["bucket"]) for f in self.formulas if f.get("bucket")]
        long = df.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"`{n}`").cast("double").alias("amount")) for n, b in tagged])).alias("v"))
        return long.select(*(by or []), "v.*").groupBy(*(by or []), "bucket").agg(F.sum("amount").alias("amount"))


def diff_inputs(df: DataFrame, pairs: Mapping[str, tuple[str, str]], out: str = "changed") -> DataFrame:
    """df with the names whose two columns differ (null-safe): {name: (before, after)}."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(n)) for n, (a, b) in pairs.items()])))


