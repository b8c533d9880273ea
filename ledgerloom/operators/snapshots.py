"""Versioned snapshots of results: append-only Parquet, hashed, with revision chains and diffs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.errors import SnapshotError
from ledgerloom.expr import values as V
from ledgerloom.plans.engine import FormulaEngine

LEVELS = ("full", "cost_only", "summary")


def shown_map(df: DataFrame, columns: list[str]) -> Column:
    """Columns as a map of their texts, in the order of their names."""
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = [c for n in sorted(columns) for c in (F.lit(n), V.text(V.from_column(F.col(f"`{n}`"), types[n])))]
    return F.create_map(*pairs).cast("map<string,string>") if pairs else F.create_map().cast("map<string,string>")


def payload_hash(engine_hash: Column, inputs: Column, outputs: Column) -> Column:
    return F.sha2(F.concat(engine_hash, F.lit("|"), F.to_json(F.map_entries(inputs)), F.lit("|"), F.to_json(F.map_entries(outputs))), 256)


def snapshot(engine: FormulaEngine, df: DataFrame, doc_id: str, *, trace_level: str = "full", reason: str = "") -> DataFrame:
    """One row a document: doc_id, revision 1, engine, inputs and outputs as maps, trace, hashes.
    The result is frozen by being written; times are those of the write."""
    if trace_level not in LEVELS:
        raise SnapshotError(f"trace_level is one of {LEVELS}")
    done = engine.apply(df, trace_col="__trace")
    ins = [c for c in df.columns if c in engine.inputs]
    outs = engine.topo_order
    base = done.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.lit(1).alias("revision"), F.lit(None).cast("string").alias("previous"), F.lit(engine.meta.uid).alias("engine_uid"), F.lit(engine.hash).alias("engine_hash"),
        F.lit(trace_level).alias("trace_level"), F.lit(reason).alias("reason"), F.lit(False).alias("locked"), F.current_timestamp().alias("created_at"),
        shown_map(done, ins).alias("inputs"), shown_map(done, outs).alias("outputs"), F.col("__trace").alias("trace"),
    )
    return _hashed(base)


def _hashed(df: DataFrame) -> DataFrame:
    made = df.withColumns({"payload_hash": payload_hash(F.col("engine_hash"), F.col("inputs"), F.col("outputs")), "trace_hash": F.sha2(F.to_json(F.map_entries("trace")), 256)})
    return made.withColumn("snapshot_id", F.sha2(F.concat_ws("|", "doc_id", F.col("revision").cast("string"), "payload_hash"), 256))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, part, field, before, after, delta, delta_pct) of what differs, null-safe."""

    def long(df: DataFrame, side: str) -> DataFrame:
        parts = [df.select("doc_id", F.lit(part).alias("part"), F.explode(part).alias("field", side)) for part in ("inputs", "outputs")]
        meta = df.select("doc_id", F.lit("meta").alias("part"), F.explode(F.create_map(F.lit("engine_uid"), F.col("engine_uid"), F.lit("engine_hash"), F.col("engine_hash"))).alias("field", side))
        return parts[0].unionByName(parts[1]).unionByName(meta)

    both = long(before, "before").join(long(after, "after"), ["doc_id", "part", "field"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    a, b = F.col("before").try_cast("double"), F.col("after").try_cast("double")
    return both.withColumn("delta", b - a).withColumn("delta_pct", F.when(a != 0, F.bround((b - a) / F.abs(a) * 100, 4)))


def verify(df: DataFrame) -> DataFrame:
    """(snapshot_id, doc_id, intact): whether a row still has its hashes."""
    intact = (payload_hash(F.col("engine_hash"), F.col("inputs"), F.col("outputs")) == F.col("payload_hash")) & (F.sha2(F.to_json(F.map_entries("trace")), 256) == F.col("trace_hash"))
    return df.select("snapshot_id", "doc_id", intact.alias("intact"))


@dataclass
class SnapshotStore:
    """An append-only folder: revisions are new rows, locks are rows of their own."""

    spark: SparkSession
    path: str

    def _read(self, part: str) -> DataFrame | None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.parquet(f"{self.path}/{part}") if there else None

    def create(self, engine: FormulaEngine, df: DataFrame, doc_id: str, **options) -> None:
        """New documents start at revision 1; known ones are revised, unless they are locked."""
        fresh = snapshot(engine, df, doc_id, **options)
        known = self.latest()
        if known is not None:
            old = known.select("doc_id", F.col("revision").alias("__r"), F.col("snapshot_id").alias("__s"), F.col("locked").alias("__l"))
            joined = fresh.join(old, "doc_id", "left")
            stop = F.raise_error(F.concat(F.lit("locked snapshot: "), "doc_id")).cast("boolean")
            joined = joined.filter(F.when(F.coalesce("__l", F.lit(False)), stop).otherwise(F.lit(True)))
            fresh = _hashed(joined.withColumn("revision", F.coalesce(F.col("__r"), F.lit(0)) + 1).withColumn("previous", F.col("__s")).drop("__r", "__s", "__l", "payload_hash", "trace_hash", "snapshot_id"))
        fresh.write.mode("append").parquet(f"{self.path}/snapshots")

    revise = create

    def all(self) -> DataFrame:
        rows = self._read("snapshots")
        if rows is None:
            raise SnapshotError("the store is empty")
        locks = self._read("locks")
        if locks is None:
            return rows
        held = locks.select("snapshot_id").distinct().withColumn("__held", F.lit(True))
        return rows.join(held, "snapshot_id", "left").withColumn("locked", F.coalesce("__held", F.lit(False))).drop("__held").select(*rows.columns)

    def latest(self) -> DataFrame | None:
        if self._read("snapshots") is None:
            return None
        rows = self.all()
        newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("revision")))
        return rows.withColumn("__n", newest).filter("__n = 1").drop("__n")

    def history(self, doc_id: str) -> DataFrame:
        return self.all().filter(F.col("doc_id") == doc_id).orderBy("revision")

    def query(self, condition: str | Column) -> DataFrame:
        return self.all().filter(condition)

    def lock(self, condition: str | Column) -> None:
        self.all().filter(condition).select("snapshot_id", F.current_timestamp().alias("locked_at")).write.mode("append").parquet(f"{self.path}/locks")

    def verify(self) -> DataFrame:
        return verify(self.all())

    def export(self, path: str) -> None:
        self.all().write.json(path)
