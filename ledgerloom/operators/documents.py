"""Documents: child tables whose rows carry formula text, and header formulas over them.

Formula text is data, so it differs from row to row; but rows share few different texts. Each text
that occurs becomes one template that is compiled once; a row takes the template that its text
names. Where there are many texts, rows are dealt by theirs, and each share has a plan of its own. Header formulas read child tables as lists and see the values that the rows were given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import FormulaError
from ledgerloom.expr import parser
from ledgerloom.expr import values as V
from ledgerloom.expr.interpret import named, over_arrays, prepared, template
from ledgerloom.operators.graph import shared_folder
from ledgerloom.plans.engine import FormulaEngine

#: Different formula texts that one plan may hold.
MAX_TEMPLATES = 500
#: Cells, or child rows, that one task brings together.
CELLS_A_TASK = 400_000
#: Documents of a batch that differ in numbers only are evaluated as arrays, from so many on.
ALIKE = 8
_NUMBER = re.compile(r"^\s*[-+]?\d+(?:\.\d+)?\s*$")


@dataclass
class ChildTable:
    """formula: the column with formula text. output: the column that its value goes to. fields:
    more columns that hold formula text, each replaced by its value. order: the rows' order. id: the
    column by which other texts read a row's value, as prefix + id (DocumentEngine.graph)."""

    name: str
    formula: str | None = None
    output: str = "amount"
    fields: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    computed: Mapping[str, str] = field(default_factory=dict)
    id: str | None = None
    prefix: str = ""


@dataclass
class DocumentEngine:
    """header: formulas over header columns, child tables (lists of structs) and each other."""

    header: Mapping[str, str] | list[Mapping]
    tables: tuple[ChildTable, ...] = ()
    key: str = "doc_id"
    parent: str = "doc_id"
    on_error: str = "default"
    default_value: object = 0
    zero_division_policy: str = "allow"

    def _engine(self, formulas) -> FormulaEngine:
        return FormulaEngine(formulas, on_error=self.on_error, default_value=self.default_value, zero_division_policy=self.zero_division_policy)

    def _texts(self, rows: DataFrame, column: str) -> DataFrame:
        """t: the different formula texts of a column that aren't plain numbers."""
        text = F.trim(F.col(column))
        return rows.select(text.alias("t")).filter(F.col("t").isNotNull() & (F.col("t") != "") & ~F.col("t").rlike(_NUMBER.pattern)).distinct()

    def templates(self, rows: DataFrame, column: str) -> list[str]:
        """The different formula texts of a column that aren't plain numbers."""
        return sorted(r["t"] for r in self._texts(rows, column).collect())

    def evaluate_text(self, rows: DataFrame, column: str, out: str, dealt: tuple[int, str] | None = None) -> DataFrame:
        """rows with `out`: the value (double) of the formula text in `column` over the row's own
        columns; plain numbers stand for themselves.

        Over MAX_TEMPLATES different texts, rows are written to the shared folder by a hash of their
        text, and so is each share's result: the driver holds one share's texts at a time. dealt:
        tasks and key by which rows lie, so that they lie so again after it.
        """
        few = [r["t"] for r in self._texts(rows, column).limit(MAX_TEMPLATES + 1).collect()]
        if len(few) <= MAX_TEMPLATES:
            return self._with_templates(rows, column, out, sorted(few))
        spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "formula-texts")
        count = self._texts(rows, column).count()
        shares = -(-2 * count // MAX_TEMPLATES)  # about half of MAX_TEMPLATES texts in each
        share = F.coalesce(F.pmod(F.xxhash64(F.trim(F.col(column))), F.lit(shares)), F.lit(0))
        rows.withColumn("__share", share).write.partitionBy("__share").parquet(f"{folder}/rows")
        held = sorted(r["__share"] for r in spark.read.parquet(f"{folder}/rows").select("__share").distinct().collect())
        for k in held:
            mine = spark.read.schema(rows.schema).parquet(f"{folder}/rows/__share={k}")
            done = self._with_templates(mine, column, out, self.templates(mine, column))
            done.write.mode("append").parquet(f"{folder}/out")
        every = spark.read.schema(done.schema).parquet(f"{folder}/out")
        return every.repartition(*dealt) if dealt else every

    def _with_templates(self, rows: DataFrame, column: str, out: str, texts: list[str]) -> DataFrame:
        env_engine = self._engine({})
        value: Column = F.trim(F.col(column)).try_cast("double")
        branches = None
        for text in texts:
            try:
                v = V.number(env_engine.column(rows.drop(out) if out in rows.columns and out != column else rows, text))
                c = env_engine.compile_value(out, V.Val(v.col.cast("double"), V.DOUBLE, v.ok, v.zero)).value
            except FormulaError:
                if self.on_error == "raise":
                    raise
                c = F.lit(None).cast("double") if self.on_error == "null" else F.lit(self.default_value).cast("double")
            cond = F.trim(F.col(column)) == text
            branches = F.when(cond, c) if branches is None else branches.when(cond, c)
        return rows.withColumn(out, value if branches is None else branches.otherwise(value))

    def apply(self, headers: DataFrame, children: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        """(headers with formulas, child tables with values). First the header formulas that rest on
        no child table; then the rows, over their own columns, the header's and those formulas; then
        the lists of each document; then all header formulas."""
        wide, out = self._lists(headers, children)
        done = self._engine(self.header).apply(wide)
        return done.drop(*[t.name for t in self.tables]), out

    def _lists(self, headers: DataFrame, children: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        """(headers with each child table as a list, child tables with values). All are dealt by
        document once, over as many tasks as a count of the largest table asks for."""
        out: dict[str, DataFrame] = {}
        if self.tables:
            tasks = tasks_for(headers.sparkSession, max(df.count() for df in (headers, *[children[t.name] for t in self.tables])))
            headers = headers.repartition(tasks, self.key)
        wide, engine, names = headers, self._engine(self.header), {t.name for t in self.tables}
        early = [n for n in engine.topo_order if not names & {r for m in (n, *engine.dag.ancestors(n)) for r in engine.reads[m]}]
        seen = engine.apply(headers, only=early) if early else headers
        for t in self.tables:
            rows = children[t.name].repartition(tasks, self.parent)
            shared = [c for c in seen.columns if c not in rows.columns and c != self.key]
            if shared:
                side = seen.select(F.col(self.key).alias("__k"), *[F.col(f"`{c}`") for c in shared])
                rows = rows.join(side, rows[self.parent] == F.col("__k"), "left").drop("__k")
            for f in t.fields:
                rows = self.evaluate_text(rows, f, f, (tasks, self.parent))
            if t.formula:
                rows = self.evaluate_text(rows, t.formula, t.output, (tasks, self.parent))
            if t.computed:
                rows = self._engine(t.computed).apply(rows)
            rows = rows.drop(*shared)
            out[t.name] = rows
            order = [F.col(c) for c in t.order] or [F.struct(*[c for c, k in rows.dtypes if not k.startswith("map")])]
            listed = rows.groupBy(F.col(self.parent).alias("__p")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.struct(*rows.columns).alias("r")))), lambda e: e["r"]).alias(t.name))
            wide = wide.join(listed, wide[self.key] == F.col("__p"), "left").drop("__p")
        return wide, out

    def graph(self, headers: DataFrame, children: Mapping[str, DataFrame], default: float = 0.0) -> DataFrame:
        """(doc_id, name, value): one graph a document, of its header formulas and of the formula
        texts of the rows that have an id, named prefix + id. A text reads its row's own columns
        first, then rows and header formulas by name, then numeric header columns. Rows without an
        id or a text take no part. For texts that read other rows; others go through apply()."""
        most = headers.count() * len(self._listed())
        parts = [headers.select(F.col(self.key).alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(f["name"]).alias("name"), F.lit(str(f["formula"])).alias("text")) for f in self._listed()])).alias("c")).select("doc_id", "c.*", F.lit(None).cast("string").alias("own"))] if self._listed() else []
        for t in self.tables:
            if not t.formula or not t.id:
                continue
            rows = children[t.name]
            most += rows.count()
            plain = [c for c, k in rows.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean") and c != t.formula]
            text = F.trim(F.col(t.formula).cast("string"))
            parts.append(rows.filter(F.col(t.id).isNotNull() & (text != "")).select(F.col(self.parent).alias("doc_id"), F.concat(F.lit(t.prefix), F.col(t.id).cast("string")).alias("name"), text.alias("text"), F.to_json(F.struct(*plain)).alias("own")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return evaluate_cells(every, headers, [], self.key, default, cells_at_most=most)

    # --- tooling

    def validate(self, children: Mapping[str, DataFrame] | None = None) -> dict[str, parser.ValidationResult]:
        """Checks of the header formulas, and of the formula texts that child tables hold."""
        engine = self._engine({})
        found = {f["name"]: engine.validate(str(f["formula"])) for f in self._listed()}
        for t in self.tables:
            if children and t.name in children:
                for column in ([t.formula] if t.formula else []) + list(t.fields):
                    found |= {f"{t.name}.{column}: {text}": engine.validate(text) for text in self.templates(children[t.name], column)}
        return found

    def dependency_graph(self) -> dict[str, list[str]]:
        """Header formula to the header formulas and child tables that it reads."""
        engine = self._engine(self.header)
        known = engine.texts.keys() | {t.name for t in self.tables}
        return {n: sorted(engine.reads[n] & known) for n in engine.topo_order}

    def preview(self, children: Mapping[str, DataFrame]) -> dict[str, list[str]]:
        """Formula column of a child table to the templates that it resolves to."""
        return {f"{t.name}.{c}": self.templates(children[t.name], c) for t in self.tables for c in ([t.formula] if t.formula else []) + list(t.fields)}

    def explain(self, headers: DataFrame, children: Mapping[str, DataFrame], name: str) -> DataFrame:
        """How a header formula came about in each document, as FormulaEngine.explain."""
        wide, _ = self._lists(headers, children)
        return self._engine(self.header).explain(wide, name, self.key)

    def scenarios(self, headers: DataFrame, children: Mapping[str, DataFrame], overrides: Mapping[str, Mapping[str, object]]) -> DataFrame:
        """The headers once for each scenario, with header inputs replaced for the rows' formulas too:
        documents are repeated with a key of their own, so nothing is computed a scenario at a time."""
        names = sorted({c for o in overrides.values() for c in o})
        types = dict(headers.dtypes)
        many = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), *[(F.lit(o[c]).cast(types[c]) if c in o else F.lit(None).cast(types[c])).alias(c) for c in names], *[F.lit(c in o).alias(f"has_{c}") for c in names]) for s, o in overrides.items()]))
        of = lambda key: F.struct(F.col("__s.scenario").alias("scenario"), F.col(key).alias("key"))
        wide = headers.withColumn("__s", many).withColumns({c: F.when(F.col(f"__s.has_{c}"), F.col(f"__s.{c}")).otherwise(F.col(c)) for c in names}).withColumn(self.key, of(self.key)).drop("__s")
        labels = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario")) for s in overrides]))
        rows = {n: c.withColumn("__s", labels).withColumn(self.parent, of(self.parent)).drop("__s") for n, c in children.items()}
        done, _ = self.apply(wide, rows)
        return done.select(F.col(f"{self.key}.scenario").alias("scenario"), F.col(f"{self.key}.key").alias(self.key), *[c for c in done.columns if c != self.key])

    def _listed(self) -> list[Mapping]:
        return [{"name": k, "formula": v} for k, v in self.header.items()] if isinstance(self.header, Mapping) else list(self.header)


def cells(rows: DataFrame, table: str, slug: str, fields: list[str], parent: str = "doc_id") -> DataFrame:
    """(doc_id, name, text): a child table's formula cells, named table__slug__field."""
    pieces = [(F.concat(F.lit(f"{table}__"), F.regexp_replace(F.col(slug), r"\W", "_"), F.lit(f"__{f}")).alias("name"), F.col(f).cast("string").alias("text")) for f in fields]
    if len(pieces) == 1:  # rows stay in their order, which an explode hides
        every = rows.select(F.col(parent).alias("doc_id"), *pieces[0])
    else:
        every = rows.select(F.col(parent).alias("doc_id"), F.explode(F.array(*[F.struct(*c) for c in pieces])).alias("c")).select("doc_id", "c.*")
    return every.filter(F.col("text").isNotNull() & (F.col("text") != ""))


@dataclass(frozen=True)
class CellTable:
    """rows: a child table. slug: the column that names a row. fields: columns of formula text."""

    rows: DataFrame
    slug: str
    fields: tuple[str, ...]
    parent: str = "doc_id"


def build_cells(tables: Mapping[str, CellTable], *, normalize: Callable[[Column], Column] | None = None, synthetic: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, name, text) of several child tables, for evaluate_cells. normalize rewrites a text
    column; synthetic adds a formula to every document. Two cells of a document with one name are an
    error."""
    parts = [cells(t.rows, name, t.slug, list(t.fields), t.parent) for name, t in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if normalize:
        every = every.withColumn("text", normalize(F.col("text")))
    if synthetic:
        more = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in synthetic.items()]))
        every = every.unionByName(every.select("doc_id").distinct().select("doc_id", more.alias("c")).select("doc_id", "c.*"))
    if twice := every.groupBy("doc_id", "name").count().filter("count > 1").first():
        raise FormulaError(f"document {twice['doc_id']} has two cells called {twice['name']!r}")
    return every


def scoped(text: str, tables: list[str]) -> str:
    """`table.slug.field` and `table[0].field` as the names that cells() gives."""
    names = "|".join(re.escape(t) for t in tables)
    text = re.sub(rf"\b({names})\.(\w+)\.(\w+)", r"\1__\2__\3", text)
    return re.sub(rf"\b({names})\[(\d+)\]\.(\w+)", r"\1__\2__\3", text)


def evaluate_cells(cell_rows: DataFrame, scalars: DataFrame, tables: list[str], key: str = "doc_id", default: float = 0.0, *, cells_at_most: int | None = None, dealt: bool = False) -> DataFrame:
    """(doc_id, name, value): every document's own graph of cells, which may read each other and the
    document's scalars (numeric columns of `scalars`), and first of all the values in the cell's own
    JSON object, where there is a column `own`.

    Graphs differ by document, so a document's cells are brought together in one task and evaluated
    by functions made once of each checked syntax tree; Python's eval is never used. Documents are
    dealt over as many tasks as a count of the cells asks for (cells_at_most, where the caller has
    one), CELLS_A_TASK in each, and stream through them, a batch of whole documents at a time. dealt:
    a document's cells lie in one task already, as after a window over documents; then nothing is
    counted or shuffled, unless scalars must come to them. Cells that fail, or lie on a cycle, have
    the default.
    """
    spark, kind = cell_rows.sparkSession, cell_rows.schema["doc_id"].dataType
    numeric = [c for c, t in scalars.dtypes if c != key and t in ("int", "bigint", "double", "float", "smallint")]
    rows = cell_rows.select("doc_id", "name", "text")
    if numeric or "own" in cell_rows.columns:
        own = F.col("own") if "own" in cell_rows.columns else F.lit(None).cast("string")
        rows = cell_rows.select("doc_id", "name", "text", own.alias("own"), F.lit(False).alias("head"))
    if numeric:
        packed = F.to_json(F.struct(*[F.col(c).cast("double").alias(c) for c in numeric]))
        none = F.lit(None).cast("string")
        rows = rows.unionByName(scalars.filter(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("doc_id"), none.alias("name"), packed.alias("text"), none.alias("own"), F.lit(True).alias("head")))
    if numeric or not dealt:
        rows = rows.repartition(tasks_for(spark, cell_rows.count() if cells_at_most is None else cells_at_most), "doc_id")
    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
    return rows.sortWithinPartitions("doc_id").mapInArrow(_evaluator(tuple(tables), default), shape)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of CELLS_A_TASK rows; of fewer, while cores are free."""
    return max(-(-rows // CELLS_A_TASK), min(spark.sparkContext.defaultParallelism, 1 + rows // 5_000))


def _evaluator(tables: tuple[str, ...], default: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_documents(batches):
            if whole.num_columns == 3:  # the cells read nothing but each other
                values, done = _alike(whole, tables)
                if done.any():
                    yield pa.RecordBatch.from_arrays([*whole.columns[:2], pa.array(values)], names=["doc_id", "name", "value"]).filter(pa.array(done))
                    whole = whole.filter(pa.array(~done))
            if whole.num_rows:
                yield _one_by_one(whole, tables, default)

    return run


def _starts(docs: pa.Array) -> np.ndarray:
    """The rows where a document begins."""
    if pa.types.is_integer(docs.type) or pa.types.is_string(docs.type):
        after, before = docs[1:], docs[:-1]
        fresh = pc.or_(pc.fill_null(pc.not_equal(after, before), False), pc.xor(pc.is_null(after), pc.is_null(before))).to_numpy(zero_copy_only=False)
    else:
        ids = docs.to_pylist()
        fresh = np.fromiter((a != b and not (a != a and b != b) for a, b in zip(ids[1:], ids, strict=False)), bool, len(ids) - 1)
    return np.concatenate([[0], 1 + np.flatnonzero(fresh)])


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []  # rows of the last document, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_starts(batch.column(0))[-1])
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        elif held and len(_starts(pa.concat_arrays([held[-1].column(0)[-1:], batch.column(0)[:1]]))) > 1:
            yield pa.concat_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _one_by_one(whole: pa.RecordBatch, tables: tuple[str, ...], default: float) -> pa.RecordBatch:
    import json

    columns, out = [c.to_pylist() for c in whole.columns], ([], [], [])
    ends = [*_starts(whole.column(0)).tolist(), whole.num_rows]
    for low, high in zip(ends, ends[1:], strict=False):
        own, heads = {}, []
        if len(columns) == 3:
            texts = dict(zip(columns[1][low:high], columns[2][low:high], strict=True))
        else:
            texts = {}
            for name, text, held, head in zip(*[c[low:high] for c in columns[1:]], strict=True):
                if head:
                    heads.append(json.loads(text))
                else:
                    texts[name] = text
                    if held:
                        own[name] = json.loads(held)
        for head in heads or [{}] if texts else []:
            values = _document(texts, head, tables, default, own)
            out[0].extend([columns[0][low]] * len(values))
            out[1].extend(values)
            out[2].extend(values.values())
    return _answers(out, whole.schema.field(0).type)


def _alike(whole: pa.RecordBatch, tables: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether a row has one). Documents whose cells differ in numbers only are evaluated
    together, a cell of all of them at a time, where arrays and single numbers give the same: texts
    of names, numbers, +, - and *. The other documents, and those with fewer than ALIKE of a kind,
    are left."""
    values, done = np.zeros(whole.num_rows), np.zeros(whole.num_rows, bool)
    starts = _starts(whole.column(0))
    if len(starts) < ALIKE or whole.column(1).null_count or whole.column(2).null_count:
        return values, done
    names, texts = whole.column(1).dictionary_encode(), whole.column(2).dictionary_encode()
    known = [_checked(t, tables)[2] for t in texts.dictionary.to_pylist()]
    kinds: dict = {}
    kind = np.array([kinds.setdefault(t[0], len(kinds)) if t else -1 for t in known])
    numbers = np.zeros((len(known), max((len(t[1]) for t in known if t), default=0)))
    for k, t in enumerate(known):
        if t:
            numbers[k, : len(t[1])] = t[1]
    shapes, called = list(kinds), names.dictionary.to_pylist()
    name, text = (c.indices.to_numpy().astype(np.int64) for c in (names, texts))
    sizes = np.diff([*starts, whole.num_rows])
    document = np.repeat(np.arange(len(starts)), sizes)
    order = np.lexsort((name, document))
    cell, code = name[order], kind[text[order]]
    odd = code < 0
    odd[1:] |= (cell[1:] == cell[:-1]) & (document[1:] == document[:-1])
    fine = np.ones(len(starts), bool)
    fine[document[odd]] = False
    both, groups = cell * (len(shapes) + 1) + code, {}
    for d in np.flatnonzero(fine).tolist():
        groups.setdefault(both[starts[d] : starts[d] + sizes[d]].tobytes(), []).append(d)
    for docs in groups.values():
        if len(docs) < ALIKE:
            continue
        rows = order[starts[docs][:, None] + np.arange(sizes[docs[0]])]
        mine = {called[name[r]]: (k, shapes[kind[text[r]]]) for k, r in enumerate(rows[0].tolist())}
        if (in_turn := _in_turn({n: named(shape) for n, (_, shape) in mine.items()})) is None:
            continue
        found: dict = {}
        with np.errstate(all="ignore"):
            for n in in_turn:
                k, shape = mine[n]
                found[n] = values[rows[:, k]] = over_arrays(shape, numbers[text[rows[:, k]]], found)
        done[rows] = True
    return values, done


def _in_turn(reads: dict[str, frozenset]) -> list[str] | None:
    """Names in the order of their needs; None if one is unknown, or on a cycle."""
    left, users = {n: len(ms) for n, ms in reads.items()}, {}
    for n, ms in reads.items():
        for m in ms:
            if m not in reads:
                return None
            users.setdefault(m, []).append(n)
    ready = [n for n, k in left.items() if not k]
    for n in ready:
        for u in users.get(n, ()):
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    return ready if len(ready) == len(reads) else None


def _answers(out: tuple[list, list, list], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["doc_id", "name", "value"])


@lru_cache(maxsize=20_000)
def _checked(text: str, tables: tuple[str, ...]):
    """(function, names that it reads, template) of a cell's text; (None, none, None) where it can't be parsed."""
    try:
        tree = parser.parse(scoped(text, list(tables)))
        return prepared(tree), frozenset(parser.names(tree)), template(tree)
    except FormulaError:
        return None, frozenset(), None


_NOTHING: dict = {}


def _document(texts: dict[str, str], scalars: Mapping, tables: tuple[str, ...], default: float, own: Mapping[str, Mapping]) -> dict[str, float]:
    """The values of one document's cells, in the order of their needs."""
    env = {k: v for k, v in scalars.items() if v is not None}
    values: dict[str, float] = {}
    checked, left, users, ready = {}, {}, {}, []
    for n, text in texts.items():
        checked[n] = run, names, _ = _checked(text, tables)
        mine, needs = own.get(n, _NOTHING), 0
        for m in names:
            if m in texts and m not in mine:
                needs += 1
                users.setdefault(m, []).append(n)
        if needs:
            left[n] = needs
        else:
            ready.append(n)
    for n in ready:
        run, mine = checked[n][0], own.get(n)
        try:
            value = float(run({**env, **mine} if mine else env)) if run is not None else default
        except (FormulaError, ArithmeticError, TypeError, ValueError, KeyError):
            value = default
        values[n] = env[n] = value
        for u in users.get(n, ()):
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    for n in texts:
        values.setdefault(n, default)
    return values


def calc_table(rows: DataFrame, columns: Mapping[str, str], *, parent: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """rows with a formula for each of `columns`, in that order, null where one fails; with `parent`,
    `items` is the list of the document's rows."""
    base = rows
    if parent:
        listed = rows.groupBy(F.col(parent).alias("__p")).agg(F.array_sort(F.collect_list(F.struct(*(order or ()), *[c for c in rows.columns if c not in order]))).alias("items"))
        base = rows.join(listed, rows[parent] == F.col("__p"), "left").drop("__p")
    out = FormulaEngine(columns, on_error="null", zero_division_policy="allow").apply(base)
    return out.drop("items") if parent else out


def calc_cell(rows: DataFrame, name: str, text: str) -> DataFrame:
    return calc_table(rows, {name: text})


