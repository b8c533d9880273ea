"""Byte-level BPE encoding and decoding with public rank files.

A text is cut into pre-tokens; a pre-token's bytes are merged lowest rank first, leftmost first
among equals. The queue of a pre-token's pairs is a hierarchical bitmap over the ranks: a bucket
per rank holds linked-list positions, find-first-set over two levels of bits picks the next rank, and entries that a merge has made stale are skipped. A pre-token of n bytes costs
O(n log n), so one of a million bytes is no special case.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Ids of so many different pre-tokens of at most MAX_CACHED characters are kept by a worker.
CACHE_ENTRIES = 600_000
MAX_CACHED = 64
#: Texts that are handed to Spark together.
BATCH_TEXTS = 256


class Merger:
    """Ids of one pre-token. ranks: bytes of every token to its rank, which is its id.

    The queue's parts: low, a word of 64 ranks each; top, one bit for each word that isn't 0, as one
    integer, whose lowest set bit is found as fast as that of a machine word; buckets, the positions
    of each rank: one number, or a heap from the second position on.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * ((max(ranks.values(), default=0) >> 6) + 1)
        #: Rank of two bytes by their values.
        self.two = [[ranks.get(bytes((a, b))) for b in range(256)] for a in range(256)]
        #: Word and bit of each rank.
        self.place = [(r >> 6, 1 << (r & 63)) for r in range(64 * len(self.low))]

    def ids(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        two, rank_of, low, place, top, buckets = self.two, ranks.get, self.low, self.place, 0, {}
        pair = [two[a][b] for a, b in zip(piece, piece[1:])]  # noqa: B905
        pair.append(None)
        end = [*range(1, n + 1)]  # of the token that starts at i; also the next token's start
        before = [*range(-1, n)]
        i = 0
        for rank in pair:
            if rank is not None:
                if rank in buckets:
                    self._push(buckets, rank, i)
                else:
                    buckets[rank] = i
                    word, bit = place[rank]
                    low[word] |= bit
                    top |= 1 << word
            i += 1
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            i = buckets[rank]
            if type(i) is int:
                del buckets[rank]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    top &= top - 1
            else:
                bucket, i = i, heappop(i)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            if pair[i] != rank:
                continue  # stale: one of the two tokens has been merged otherwise
            j = end[i]
            stop = end[i] = end[j]
            pair[j] = None
            if stop < n:
                before[stop] = i
                pair[i] = got = rank_of(piece[i : end[stop]])
                if got is not None:
                    if got in buckets:
                        self._push(buckets, got, i)
                    else:
                        buckets[got] = i
                        word, bit = place[got]
                        low[word] |= bit
                        top |= 1 << word
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = got = rank_of(piece[h:stop])
                if got is not None:
                    if got in buckets:
                        self._push(buckets, got, h)
                    else:
                        buckets[got] = h
                        word, bit = place[got]
                        low[word] |= bit
                        top |= 1 << word
        out, i = [], 0
        while i < n:
            stop = end[i]
            out.append(ranks[piece[i:stop]])
            i = stop
        return out

    @staticmethod
    def _push(buckets: dict, rank: int, i: int) -> None:
        bucket = buckets[rank]
        if type(bucket) is int:
            buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
        else:
            heappush(bucket, i)


class TwoGenerations(dict):
    """A bounded cache: full, it becomes the old generation, whose entries return when used."""

    def __init__(self, make, entries: int = CACHE_ENTRIES, longest: int = MAX_CACHED):
        super().__init__()
        self.make, self.half, self.longest, self.old = make, max(1, entries // 2), longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def newer_code_points(matches, spelled: str) -> set[str]:
    """Code points in the class `spelled` of Python's regex module that the tokenizer's own regular
    expressions don't have there yet: matches(text) gives those of text that they have."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    mine = "".join(regex.findall(spelled, every))
    return set(mine) - set(matches(mine))


class Splitter:
    """Pre-tokens of a text, as the tokenizer's own Unicode tables class its characters.

    newer: by class, `L` and `N`, what newer_code_points() found. A text without such code points
    is split by the pattern as it is, any other by the pattern with them taken out of the classes.
    """

    def __init__(self, pattern: str, newer: dict[str, set[str]]):
        import regex

        self.fast = regex.compile(pattern)
        self.odd = self.slow = None
        late = sorted(set().union(*newer.values()))
        if late:
            spelled = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _runs(late))
            self.odd = regex.compile(f"[{spelled}]")
            exact = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[LATE])")
            exact = exact.replace(r" ?\p{L}+", r" ?(?:(?![LATE])\p{L})+").replace(r" ?\p{N}+", r" ?(?:(?![LATE])\p{N})+")
            self.slow = regex.compile(exact.replace("LATE", spelled))

    def __call__(self, text: str) -> list[str]:
        if self.odd is not None and not text.isascii() and not _latin(text) and self.odd.search(text):
            return self.slow.findall(text)
        return self.fast.findall(text)


def _latin(text: str) -> bool:
    """Whether all characters are among the first 256, which no Unicode version has changed."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _runs(chars: list[str]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for c in map(ord, chars):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return [(a, b) for a, b in runs]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        import tiktoken

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        single = {bytes([b]): b for b in range(256)}

        def matches(kind: str):
            plain = tiktoken.Encoding(f"class-{kind}", pat_str=rf"\p{{{kind}}}+", mergeable_ranks=single, special_tokens={})
            return lambda text: bytes(plain.encode_ordinary(text)).decode()

        self.split = Splitter(pattern, {k: newer_code_points(matches(k), rf"\p{{{k}}}") for k in "LN"})
        merger = Merger(ranks)

        def packed(piece: str) -> bytes:
            ids = merger.ids(piece.encode())
            return pack(f"<{len(ids)}I", *ids)

        self.pieces = TwoGenerations(packed, cache_entries)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One coder a worker process."""
    return ByteBPE(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns `keep` of docs with n_tokens long and ids_le binary (ids as little-endian
    unsigned 32-bit integers). Null texts count as empty: 0 tokens, no bytes. Rows stay as they
    are, repeated ones too; other columns of docs, whatever their names, are not read (`keep` may not
    name one that is made here). Very long texts are encoded whole, a pre-token at a time. An empty
    table gives an empty result.

    decoded=True adds decode()'s column in the same pass: one worker process a task instead of two
    that both hold the vocabulary."""
    import pyarrow as pa

    taken = docs.select(*keep, docs[text_col].alias("__text"))
    out = T.StructType([*taken.schema.fields[:-1], T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_le", T.BinaryType(), False)])
    if decoded:
        out = out.add("decoded", T.BinaryType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(ranks_path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(start, BATCH_TEXTS)
                packed = [coder.encode_packed(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
                columns = [*batch.columns[:-1], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([coder.decode_packed(p) for p in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return taken.mapInArrow(run, out)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids_le") -> DataFrame:
    """encoded with a last column `decoded` binary: the bytes that the ids stand for; null for null."""
    import pyarrow as pa

    at = encoded.columns.index(ids_col)
    out = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(ranks_path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(start, BATCH_TEXTS)
                texts = [None if p is None else coder.decode_packed(p) for p in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=out.names)

    return encoded.mapInArrow(run, out)
