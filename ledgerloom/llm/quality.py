"""Quality rules: base counts and a hashed n-gram log-likelihood ratio (built-in functions only).

Two multinomials over BUCKETS hashed word 1- and 2-grams: the raw corpus (all documents) and a
trusted target (labelled documents). A document's score is the mean over its n-grams of
log(target / raw); it is kept from THRESHOLD on. The target is smoothed towards the raw corpus, so
an n-gram that neither favours nor disfavours the target adds 0.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import words

BUCKETS = 1 << 14
#: Weight of the raw corpus in the target, as a share of the target's own n-grams.
SMOOTHING = 0.1
THRESHOLD = -0.05
#: At most so many trusted documents, those with the smallest hash of their id, make the target.
MAX_TRUSTED = 20_000
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _ngrams(h: Column, buckets: int) -> Column:
    """Buckets of the 1-grams and 2-grams whose words have the hashes h."""
    pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
    ones = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    twos = F.transform(F.slice(pairs, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    return F.concat(ones, twos)


def repeat_words(h: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, windows compared by 64-bit hashes."""
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = F.filter(
            s,
            lambda e, k: F.coalesce(e["x"] == F.get(s, k - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, k + 1)["x"], F.lit(False)),
        )
        at = F.array_sort(F.transform(same, lambda e: e["i"]))
        steps = _let(at, lambda a: F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(distinct, F.lit(0)).otherwise(_let(ordered, covered)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trusted_ids(labels: DataFrame, bound: int = MAX_TRUSTED) -> DataFrame:
    """At most `bound` ids labelled as of good quality: a bounded sample by hash order."""
    ids = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("trusted_id")).filter(F.col("trusted_id").isNotNull())
    return ids.distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(bound)


def fit(corpus: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """The log ratio of every bucket: `buckets` numbers, whatever the size of the corpus.

    Counts cover all texts of corpus(doc_id, text), nulls as empty ones, repeated rows each; the
    broadcast side has at most max_trusted ids, and null ids are never trusted. Without a trusted
    document (empty tables too), and in buckets that the corpus doesn't use, the ratio is 0.
    """
    marked = corpus.select("doc_id", "text").join(F.broadcast(trusted_ids(labels, max_trusted)), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = (
        marked.select(F.col("trusted_id").isNotNull().alias("trusted"), _hashes(words(F.col("text"))).alias("h"))
        .select("trusted", F.explode(_ngrams(F.col("h"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).cast("double").alias("r"), F.count_if("trusted").cast("double").alias("t"))
    )
    counts = {row["bucket"]: (row["r"], row["t"]) for row in grams.collect()}
    raw, target = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not target:
        return [0.0] * buckets
    share = smoothing * target

    def ratio(b: int) -> float:
        if b not in counts:
            return 0.0
        r, t = counts[b]
        return math.log((t + share * r / raw) / (target + share) / (r / raw))

    return [ratio(b) for b in range(buckets)]


def measure(docs: DataFrame, model: list[float], *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one more column, `quality`: struct of n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept. All columns of docs stay, whatever their names, but one
    that is called quality is replaced.

    Null and empty texts: all counts 0, base_failed. A text of n words with n >= MIN_WORDS whose
    repeated windows cover at most MAX_REPEAT_PERCENT of its words is kept if its score reaches
    the threshold. Very long texts are measured whole; their words' hashes are held in one row.
    Repeated rows are measured alike; an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c != "quality"]
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded to one literal
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    held = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    text = F.col("text")
    hashed = held.withColumn("words", words(text)).withColumn("hashes", _hashes(F.col("words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = hashed.withColumns({"grams": _ngrams(F.col("hashes"), len(model)), "lines": lines, "repeat": repeat_words(F.col("hashes"))})
    step = step.withColumn("score", F.when(F.size("grams") > 0, total(F.col("grams")) / F.size("grams")).otherwise(F.lit(0.0)))
    n = F.size("words").cast("long")
    bad = (n < MIN_WORDS) | (F.col("repeat") * 100 > n * MAX_REPEAT_PERCENT)
    measured = F.struct(
        n.alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeat").alias("n_repeat_words"), bad.alias("base_failed"), "score", (~bad & (F.col("score") >= threshold)).alias("kept"),
    )
    # a generator, so that a filter on the result isn't pushed below it, where it would compute everything again
    return step.select("row", F.explode(F.array(measured)).alias("quality")).select("row.*", "quality")
