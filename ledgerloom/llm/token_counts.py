"""Token counts by a two-tier lookup that shuffles no pre-token.

Tier 1 is a compact hash table, broadcast: the token counts of the most frequent pre-tokens of a
sample of texts (TABLE_ENTRIES pre-tokens; SAMPLE_TEXTS texts on average, drawn where they are read). Tier 2 is a
bounded cache in every worker, filled by encoding what tier 1 misses. Both only save work: a count
is the same whatever they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import Splitter, TwoGenerations, newer_code_points

TABLE_ENTRIES = 32_768
SAMPLE_TEXTS = 2_000
LIMIT = 1024
#: Pre-tokenisation of the byte-level files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Counts as the tokenizers library gives them for one byte-level .json file."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import json

        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            added = [t["content"] for t in json.load(file)["added_tokens"]]
        #: Special strings count as one token each, as is the library's default.
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.marks = added

        def matches(kind: str):
            one = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), behavior="removed", invert=True)
            return lambda text: "".join(piece for piece, _ in one.pre_tokenize_str(text))

        self.split = Splitter(PATTERN, {k: newer_code_points(matches(k), rf"\p{{{k}}}") for k in "LN"})
        letters = _byte_letters()
        model = tokenizer.model

        def count(piece: str) -> int:
            return len(model.tokenize(piece.encode().decode("latin-1").translate(letters)))

        self.of_piece = count
        self.pieces = TwoGenerations(count)
        self.frequent = _Tier(frequent or {}, self.pieces)

    def __call__(self, text: str) -> int:
        if self.special is not None and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.frequent.__getitem__, self.split(text)))


class _Tier(dict):
    def __init__(self, table: dict[str, int], then: dict):
        super().__init__(table)
        self.then = then

    def __missing__(self, key):
        return self.then[key]


def _byte_letters() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is
    printable Latin-1, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + k for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _load(path: str) -> Counter:
    return Counter(path)


def frequent_pieces(docs: DataFrame, path: str, *, text_col: str = "text", texts: int = SAMPLE_TEXTS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the pre-tokens that occur most often in a sample of about `texts` texts. Each
    task sends at most `entries` counts, no texts."""
    import pyarrow as pa

    rows = docs.count()
    if not rows:
        return {}
    sample = docs.select(docs[text_col].alias("text"))
    if rows > texts:
        sample = sample.sample(fraction=texts / rows, seed=7)
    sample = sample.filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter as Tally

        counter, tally = _load(path), Tally()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.update(p for p in counter.split(text) if len(p) <= 32)
        best = tally.most_common(entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64()), pa.array([counter.of_piece(p) for p, _ in best], pa.int64())],
            names=["piece", "times", "tokens"],
        )

    found = sample.mapInArrow(run, "piece string, times long, tokens long").groupBy("piece", "tokens").agg(F.sum("times").alias("times"))
    rows = found.orderBy(F.desc("times"), "piece").limit(entries).collect()
    return {r["piece"]: r["tokens"] for r in rows}


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """The columns `keep` of docs with n_bytes long (UTF-8), n_tokens long, over_limit boolean.

    Null texts count as empty: 0 bytes, 0 tokens. Very long texts are counted whole, a pre-token at a
    time. Rows stay as they are, repeated ones too; other columns, whatever their names, are not read
    (`keep` may not name one of the three made here). An empty table gives an empty result.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_pieces(docs, path, text_col=text_col))
    taken = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    names = [*keep, "n_bytes", "n_tokens", "over_limit"]
    out = T.StructType([*taken.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _load(path)
        if not counter.frequent:
            counter.frequent.update(table.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(batch.num_columns - 1).slice(start, 256).to_pylist():
                    n_bytes.append(len(text.encode()) if text else 0)
                    n_tokens.append(counter(text) if text else 0)
            columns = [*batch.columns[:-1], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return taken.mapInArrow(run, out)
