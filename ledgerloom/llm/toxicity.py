"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence features (Wang and Manning, "Baselines and Bigrams", 2012): a text's character n-grams,
lower-cased, white space made single and put around, hashed to FEATURES. A feature's scale is its
log-count ratio between toxic and other labelled texts, shrunk by its standard error; the
KEPT_FEATURES with the most evidence enter an L2-regularised logistic regression.

Training sees a bounded sample of labelled rows: MAX_TOXIC and MAX_OTHER of them at most, by hash
order. Scoring sees every text in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZES = (3, 4, 5, 6)
FEATURES = 1 << 20
KEPT_FEATURES = 4096
MAX_TOXIC = 6_000
MAX_OTHER = 12_000
#: Standard errors by which a log-count ratio is shrunk towards 0.
SHRINK = 2.0
L2 = 2e-4
#: A toxic row counts as so many in the loss: toxic rows are few, and to miss one is worse.
TOXIC_WEIGHT = 2.0
FOLDS = 5
#: Characters of a text that are hashed at once.
BLOCK = 1 << 18
#: Features of training rows that are worked on at once.
CHUNK = 1 << 21


@dataclass(frozen=True)
class Model:
    """slots: hashed feature to its weight (log-count ratio times coefficient); bias."""

    features: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float


def hashed(text: str | None):
    """The hashed n-grams of a text (numpy int64), each at least once: BLOCK characters at a time, and
    once from each block."""
    import numpy as np

    spaced = f" {' '.join((text or '').lower().split())} "
    found = []
    for start in range(0, max(1, len(spaced) - max(SIZES) + 1), BLOCK):
        codes = np.frombuffer(spaced[start : start + BLOCK + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out, h = [], codes
        for n in range(2, max(SIZES) + 1):
            if len(codes) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in SIZES:
                out.append((((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64))
        if out:
            found.append(np.concatenate(out))
    if len(found) > 1:
        found = [np.unique(np.concatenate([np.unique(f) for f in found]))]
    return found[0] if found else np.zeros(0, np.int64)


def held_out(ident: Column) -> Column:
    """True for rows that training must not see: crc32(id as text) mod FOLDS is 0. Null ids: true."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> DataFrame:
    """(text, toxic) of the bounded sample. docs(doc_id, text), labels(doc_id, toxic); labels other
    than 0 and 1, and ids that are held out, are left out."""
    ids = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    parts = [ids.filter(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, max_toxic), (0, max_other))]
    bounded = parts[0].unionByName(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    """Train on the bounded sample. Without rows of both labels (empty tables too) the model scores all
    texts by the share of toxic rows (smoothed). The driver holds two bytes a kept feature of a
    sampled row, 147 MB at most."""
    import pyarrow as pa

    from ledgerloom.llm.common import drop_staged, stage

    sample = stage(training_rows(docs, labels, max_toxic, max_other), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seen = np.zeros((2, FEATURES), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic, np.unique(hashed(text))] += 1
        at = np.flatnonzero(seen.any(axis=0))
        for low in range(0, len(at), 100_000):
            part = at[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[1, part].astype(np.int64)), pa.array(seen[0, part].astype(np.int64))], names=["feature", "p", "q"])

    if not n1 or not n0:
        drop_staged(sample)
        import math

        return Model((), (), math.log((n1 + 0.5) / (n0 + 0.5)))
    counts = sample.select("text", "toxic").mapInArrow(tally, "feature long, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    best = ratios(counts, n1, n0).filter("ratio <> 0")
    chosen = {r["feature"]: r["ratio"] for r in best.orderBy(F.desc("evidence"), "feature").limit(KEPT_FEATURES).collect()}
    kept = sorted(chosen)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        slot = np.full(FEATURES, -1, np.int32)
        slot[kept] = np.arange(len(kept))
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                s = slot[hashed(text)]
                rows.append(np.unique(s[s >= 0]).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["slots", "toxic"])

    # MAX_TOXIC + MAX_OTHER rows of at most KEPT_FEATURES two-byte slots: bounded
    rows = sample.select("text", "toxic").mapInArrow(present, "slots binary, toxic int").collect()
    drop_staged(sample)
    rows.sort(key=lambda r: (r["toxic"], bytes(r["slots"])))
    coefficients, bias = _logistic([bytes(r["slots"]) for r in rows], [r["toxic"] for r in rows], [chosen[f] for f in kept])
    return Model(tuple(kept), tuple(float(c * chosen[f]) for c, f in zip(coefficients, kept, strict=True)), float(bias))


def ratios(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """(feature, ratio, evidence) of counts(feature, p, q), the toxic and other rows that have a
    feature, of n1 and n0 rows: the log-count ratio, shrunk by SHRINK standard errors, and how many
    of them it is."""
    p, q = F.col("p") + 1.0, F.col("q") + 1.0
    raw = F.log(p / (n1 + 2.0)) - F.log(q / (n0 + 2.0))
    spread = F.sqrt(1.0 / p - 1.0 / (n1 + 2.0) + 1.0 / q - 1.0 / (n0 + 2.0))
    ratio = F.signum(raw) * F.greatest(F.lit(0.0), F.abs(raw) - SHRINK * spread)
    return counts.select("feature", ratio.alias("ratio"), (F.abs(raw) / spread).alias("evidence"))


def _logistic(slots: list[bytes], toxic: list[int], ratios: list[float], l2: float = L2, steps: int = 400):
    """Coefficients and bias that minimise the mean log loss plus l2 / 2 * |w|^2 (Nesterov's method
    with a step from the largest eigenvalue, so no tuning)."""
    import numpy as np

    scale, y = np.asarray(ratios), np.asarray(toxic, float)
    n, m = len(slots), len(ratios)
    sizes = np.array([len(s) // 2 for s in slots], np.int64)
    ends = np.cumsum(sizes)
    # chunks of whole rows: (first row, sizes, slots as stored, two bytes each)
    cuts = [0, *(np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if n else 0, CHUNK)) + 1).tolist(), n]
    parts = [(a, sizes[a:b], np.frombuffer(b"".join(slots[a:b]), "<u2")) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def times(w):
        out, scaled = np.zeros(n), w * scale
        for first, held, col in parts:
            sums = np.concatenate(([0.0], np.cumsum(scaled[col])))
            ends = np.cumsum(held)
            out[first : first + len(held)] = sums[ends] - sums[ends - held]
        return out

    def back(g):
        out = np.zeros(m)
        for first, held, col in parts:
            out += np.bincount(col, np.repeat(g[first : first + len(held)], held), minlength=m)
        return out * scale

    v = np.ones(m)
    for _ in range(20):  # power method
        v = back(times(v))
        top = np.linalg.norm(v) or 1.0
        v = v / top
    cost = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    cost /= cost.sum()
    rate = 1.0 / (0.25 * (top * cost.max() + 1.0) + l2)
    w, b = np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    w_at, b_at = w, b
    for k in range(1, steps + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(times(w_at) + b_at, -35, 35)))
        g = cost * (p - y)
        w_next, b_next = w_at - rate * (back(g) + l2 * w_at), b_at - rate * float(g.sum())
        pull = (k - 1) / (k + 2)
        w_at, b_at, w, b = w_next + pull * (w_next - w), b_next + pull * (b_next - b), w_next, b_next
    return w, b


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with a last column `toxicity` double from 0 to 1, of the whole text; a column of docs
    that is called toxicity is replaced, others stay whatever their names. Null and empty texts are
    scored as empty ones, very long ones BLOCK characters at a time, repeated rows alike; an empty
    table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # KEPT_FEATURES weights at most

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        m = shared.value
        slot = np.full(FEATURES, -1, np.int32)
        slot[list(m.features)] = np.arange(len(m.features))
        weights = np.asarray(m.weights)

        def one(text):
            s = slot[hashed(text)]
            z = weights[np.unique(s[s >= 0])].sum() + m.bias
            return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=float)

    return docs.withColumn("toxicity", of(F.col(text_col)))
