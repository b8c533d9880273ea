"""Audit of runs: what a formula set was, what it saw, a repeatable sample of rows, and lineage."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import FormulaError
from ledgerloom.plans.engine import FormulaEngine


@dataclass
class AuditSession:
    """One session audits one or more runs of an engine. The report's counts are an aggregate over
    each run that reads only the formulas' inputs; observed metrics would be cheaper, but a sort of
    the result counts rows twice."""

    engine: FormulaEngine
    rate: float = 0.001
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    ended: datetime | None = None
    _runs: list[tuple[list[str], DataFrame]] = field(default_factory=list)

    def run(self, df: DataFrame) -> DataFrame:
        """The engine's result, noted for the report."""
        if self.ended:
            raise FormulaError("the audit session has ended")
        out = self.engine.apply(df, errors_col="__errors")
        self._runs.append((df.columns, out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("__errors") > 0).alias("failed"))))
        return out.drop("__errors")

    def sample(self, df: DataFrame, key: str) -> DataFrame:
        """Traces of the sampled rows, the same ones in every run."""
        return self.engine.audit(df, key, self.rate)

    def end(self) -> dict:
        """The report: one row of counts a run is brought to the driver."""
        self.ended = self.ended or datetime.now(timezone.utc)
        counts = [c.first().asDict() for _, c in self._runs]
        return {
            "engine_uid": self.engine.meta.uid, "engine_hash": self.engine.hash, "formulas": len(self.engine.texts), "rate": self.rate, "started": self.started.isoformat(), "ended": self.ended.isoformat(),
            "runs": [{"columns": columns, **c} for (columns, _), c in zip(self._runs, counts, strict=True)], "rows": sum(c["rows"] for c in counts), "failed": sum(c["failed"] for c in counts),
        }


def lineage(engine: FormulaEngine, name: str) -> dict:
    """What a formula rests on, as a tree: name, formula (None for inputs), needs."""
    needs = [lineage(engine, n) if n in engine.texts else {"name": n, "formula": None, "needs": []} for n in sorted(engine.reads[name])]
    return {"name": name, "formula": engine.texts[name], "needs": needs}
