"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its text as the
only trainable part. Turns after the last assistant turn (or all, if there is none) go into one more
example without a trainable part, so the output holds every turn.

A turn is written `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside roles and texts every `<`, then
tildes, then an optional n, then `|` gets one more tilde, so no control string is left; a line feed
in a role is written `<n|`. unescape() takes one tilde off again.

An example's size is bounded by its conversation's; rows of one conversation are brought together,
as its turns follow on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*n?\|)", "<~$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*n?\|)", "<$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<n|"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"<n\|", "\n"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example int from 0, text, loss_start int, loss_chars int) of turns(conv_id, turn,
    role, text).

    loss_start and loss_chars mark the trainable code points of text (from 0); both are null where
    nothing is trainable. Turns go by turn (null first), then role, then text, so ties and repeated
    rows have an order. Null roles and texts count as empty. Rows with a null conv_id aren't known to
    belong together: each is a conversation of one turn. Very long texts and conversations are formatted whole: the output of a conversation
    grows with the square of its turns. Other columns of turns, whatever their names, are not read. An
    empty table gives no examples.
    """
    rows = turns.select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turn = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text")
    whole = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    written = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, i: F.struct(i.alias("at"), (t["role"] == TRAINED_ROLE).alias("trained"), head(t).alias("head"), escape(t["text"]).alias("body")),
        ).alias("turns"),
    )
    ends = F.filter("turns", lambda t: t["trained"] | (t["at"] == F.size("turns") - 1))
    one = written.select("conv_id", "turns", F.posexplode(ends).alias("example", "target"))
    joined = lambda array: F.array_join(F.transform(array, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    built = one.select(
        "conv_id", "example", "target", joined(F.slice("turns", F.lit(1), F.col("target.at"))).alias("context")
    )
    start = F.length("context") + F.length("target.head")
    return built.select(
        "conv_id", F.col("example").cast("int").alias("example"),
        F.concat("context", "target.head", "target.body", F.lit(END)).alias("text"),
        F.when(F.col("target.trained"), start).alias("loss_start"),
        F.when(F.col("target.trained"), F.length("target.body")).alias("loss_chars"),
    )


def masked(text: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped; null where there is none."""
    return unescape(F.substring(text, start + 1, chars))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    parts = F.slice(F.split(text, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(text, r"<\|im_end\|>\n")) - 1)
    bare = F.transform(parts, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    pair = lambda p: F.split(p, "\n", 2)
    return F.transform(bare, lambda p: F.struct(_unescape_role(F.get(pair(p), F.lit(0))).alias("role"), unescape(F.get(pair(p), F.lit(1))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation of examples(): conv_id, turns array<struct<role, text>>, trained
    array<string> (each trainable text once, in order), formatted_chars long."""
    last, chars = F.max_by("text", "example"), F.length("text").cast("long")
    piece = F.when(F.col("loss_start").isNotNull(), F.struct("example", masked(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("text")))
    merged = formatted.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(last.alias("last"), F.collect_list(piece).alias("pieces"), F.sum(chars).alias("formatted_chars"))
    merged = merged.unionByName(formatted.filter("conv_id IS NULL").select("conv_id", F.col("text").alias("last"), F.array_compact(F.array(piece)).alias("pieces"), chars.alias("formatted_chars")))
    return merged.select(
        "conv_id", read_turns(F.col("last")).alias("turns"), F.transform(F.array_sort("pieces"), lambda p: p["text"]).alias("trained"), "formatted_chars"
    )
