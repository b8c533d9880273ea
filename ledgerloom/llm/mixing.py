"""Mixing sources to target weights by Efraimidis-Spirakis sampling (built-in functions only).

Every document draws the key -ln(u) / quality from a hash of its id; in key order the documents of
a source form a weighted sample without replacement. A target above a source's size first takes
complete epochs, and the rest of the target is filled from the sample's prefix.

The prefix sums need no sort of a whole source. A monotone image of the key has BINS * BINS steps;
two grouped sums (BINS rows a source each) find the step where the budget runs out, and only the
rows of that step are ordered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import broadcast_if_small, stage, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BINS = 4096
#: Documents of the lowest quality still have this chance relative to the best.
LEAST_QUALITY = 0.1


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def regularity(text: Column, size: Column) -> Column:
    """Default quality weight: 1 where words take about six characters with their separator, less
    the further from it, LEAST_QUALITY at least; empty texts have LEAST_QUALITY."""
    apart = F.abs(F.length(text).cast("double") / F.when(size > 0, size.cast("double")) - F.lit(6.0))
    return F.coalesce(F.greatest(F.lit(LEAST_QUALITY), F.lit(1.0) / (F.lit(1.0) + apart)), F.lit(LEAST_QUALITY))


def uniform(ident: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, from the first 52 bits of a digest of the id; of the
    text where there is none."""
    without = F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), without)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add rank, weight and target to totals(src, source, source_size), one row a source.

    Targets are cap * source_size or level * weight, whichever is less, where one level makes them
    sum to share of all sizes: what repeated resharing of the excess by weight ends with. The
    windows see one row a source.
    """
    order = Window.orderBy("src")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    )
    level = (
        ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("step", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    holds = level.withColumn("held", F.when(F.col("ratio") >= F.col("step"), F.col("step")))
    first = F.first("held", ignorenulls=True).over(
        Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return holds.withColumn("level", first).select(
        "src", "source", "source_size", "rank", "weight",
        F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 7,
    quality: Column | None = None,
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, epochs, taken, copies.

    size: words; taken: words that the mix takes, epochs * size plus what the fractional pass takes
    (the document on which the budget ends gives only the words that are left); copies: taken as
    whole documents, the last one's share rounded. quality: weights above 0 (others and nulls count
    as LEAST_QUALITY); by default regularity().

    Null text: size 0, nothing to take. Null source: a source of its own, after all others. Null id:
    drawn by the text. Equal keys go by id, then size; rows that are equal in all three are
    interchangeable, so reruns agree. Very long texts are counted whole. Other columns of docs,
    whatever their names, are not read. An empty table gives an empty result.
    """
    mixed = _mix(docs, id_col, text_col, source_col, weights, share, cap, seed, quality)
    return mixed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "epochs", "taken", "copies")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, quality: Column | None) -> DataFrame:
    """(id, source, size, key) and `row`, the whole row of docs."""
    text, size = docs[text_col], F.col("size")
    sized = docs.select(
        docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), text.alias("text"), word_count(text).alias("size"),
        (quality if quality is not None else F.lit(None)).cast("double").alias("given"), F.struct(*[docs[c] for c in docs.columns]).alias("row"),
    )
    weight = regularity(F.col("text"), size) if quality is None else F.col("given")
    good = (F.col("quality") > 0) & (F.col("quality") < float("inf"))
    key = -F.log(uniform(F.col("id"), F.col("text"), seed)) / F.when(good, F.col("quality")).otherwise(F.lit(LEAST_QUALITY))
    return sized.withColumn("quality", weight).select("id", "source", "size", key.alias("key"), "row")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, cap: float, seed: int, quality: Column | None) -> DataFrame:
    """mix() with its key, and the columns called id and source."""
    drawn = _keyed(docs, id_col, text_col, source_col, seed, quality)
    place = F.least(F.floor(F.col("key") / (F.col("key") + 1.0) * float(BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")
    rows = stage(
        drawn.withColumn("place", place).select(
            "id", "source", "size", "key",
            F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("src"),
            F.shiftright("place", 12).alias("upper"), F.col("place").bitwiseAND(F.lit(BINS - 1)).alias("lower"),
        ),
        "mix-keys",
    )
    totals = rows.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        targets(totals, weights, share, cap)
        .withColumn("epochs", whole)
        .withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("src", "source_size", "target", "epochs", "budget")
    )
    plan = stage(plan, "mix-plan")
    plan = broadcast_if_small(plan)
    upper = stage(_boundary(rows.groupBy("src", "upper").agg(F.sum("size").alias("n")).join(plan.select("src", "budget"), "src"), "upper"), "mix-upper")
    upper = broadcast_if_small(upper)
    inside = rows.join(upper, ["src", "upper"]).groupBy("src", "upper", "lower", "budget").agg(F.sum("size").alias("n"))
    lower = stage(_boundary(inside, "lower", "upper"), "mix-lower")
    lower = broadcast_if_small(lower.select("src", F.col("upper").alias("at_upper"), F.col("lower").alias("at_lower"), F.col("budget").alias("left_over")))
    placed = rows.join(plan, "src", "left").join(lower, "src", "left")
    here = (F.col("upper") == F.col("at_upper")) & (F.col("lower") == F.col("at_lower"))
    before = F.coalesce((F.col("upper") < F.col("at_upper")) | ((F.col("upper") == F.col("at_upper")) & (F.col("lower") < F.col("at_lower"))), F.lit(False))
    clear = placed.filter(~F.coalesce(here, F.lit(False))).withColumn("more", F.when(before, F.col("size")).otherwise(F.lit(0)))
    in_order = Window.partitionBy("src").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter(here).withColumn("sum_before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_over") - F.col("sum_before")))).drop("sum_before")
    both = clear.unionByName(edge)
    return both.select(
        "id", "source", "size", "key", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken"),
        (F.col("epochs") + F.when((F.col("size") > 0) & (F.col("more") * 2 >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )


def _boundary(sums: DataFrame, step: str, *above: str) -> DataFrame:
    """The first step of each source at which the running sum passes the budget, and what of the
    budget is left there. sums has at most BINS rows a source."""
    running = Window.partitionBy("src").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = sums.withColumn("upto", F.sum("n").over(running)).filter(F.col("upto") > F.col("budget"))
    return passed.groupBy("src", *above).agg(
        F.min(step).alias(step), F.min_by(F.col("budget") - (F.col("upto") - F.col("n")), step).alias("budget")
    )


def materialize(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7,
    quality: Column | None = None,
) -> DataFrame:
    """The mix as documents: every row of docs as often as mix() has `copies` of it, columns as they
    are, whatever their names.

    Rows that share source, id, size and key take each other's place: their copies are added and
    dealt out evenly again. Nulls, empty and very long texts and empty tables are as in mix(); a
    document of no words is never taken.
    """
    mixed = _mix(docs, id_col, text_col, source_col, weights, share, cap, seed, quality)
    # joined without nulls, so that the join's partitioning serves the window too
    named = lambda df: df.withColumns({"id": F.coalesce(F.concat(F.lit("0"), F.col("id").cast("string")), F.lit("1")), "source": F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))})
    alike = ["id", "source", "size", "key"]
    dealt = named(mixed).groupBy(*alike).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).filter("copies > 0")
    joined = named(_keyed(docs, id_col, text_col, source_col, seed, quality)).join(dealt, alike)
    place = F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0)))
    mine = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("place") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    repeated = joined.withColumn("place", place).select("row", F.explode(F.array_repeat(F.lit(0), mine.cast("int"))).alias("copy"))
    return repeated.select("row.*")
