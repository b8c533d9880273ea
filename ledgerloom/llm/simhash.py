"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of segments, one more than the distance. If two differ
in at most `distance` bits, some segment starts a chain such that, for every length l, its first l
segments together differ in at most floor(l * distance / segments) bits (Qin and Xiao, "Pigeonring",
2018): the first segment is equal, the first two differ in at most one bit, the first three in at
most two. So of the four halves of the second and third segment two are equal, one of them in the
second. Pairs meet in buckets keyed by (start, which two halves, the first segment, the two halves),
32 bits for a distance of 3; there the whole chain is tested before the full Hamming check.

Equal fingerprints are one node from the start. A bucket gives no pairs but a spanning forest of
its links: small buckets are compared a batch at a time, in large ones a breadth-first walk compares
each node with those not reached yet, so a dense bucket of n nodes costs about n comparisons a
reached node and n - 1 rows, and a node in memory is 8 bytes.

groups() links by the fingerprint alone. similar_groups() links texts whose 5-word shingles have a
Jaccard similarity of 0.8 or more: two fingerprints over word pairs and a wider distance find the
candidates, and the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import broadcast_if_small, drop_staged, is_small, stage
from ledgerloom.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: similar_groups: shingles and similarity of near-duplicates; what its two fingerprints are made of,
#: and the distance at which one of them makes a candidate.
WORDS = 5
SIMILARITY = 0.8
PAIR = 2
WIDE = 7
#: Buckets of up to so many fingerprints are compared a batch at a time.
SMALL = 64
#: Texts, and bytes of their shingles, that a task compares at once (twice as many of a large family).
BLOCK_TEXTS, BLOCK_BYTES = 4096, 32 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' XXH64. No words: 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() knows the six separators
    if not found:
        return 0
    if len(found) <= shingle:
        return xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    n = len(found) - shingle + 1
    for low in range(0, n, 65536):
        high = min(n, low + 65536)
        hashes = np.fromiter(
            (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[low:high].tolist(), ends[low + shingle - 1 : high + shingle - 1].tolist(), strict=True)),
            np.uint64, high - low,
        )
        counts += _bits(hashes)
    return _majority(counts, n)


def _bits(hashes):
    """How many of the hashes have each of the 64 bits."""
    import numpy as np

    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts, n: int) -> int:
    import numpy as np

    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with fp long: the fingerprint's 64 bits. Null text: fp 0."""
    import pyarrow as pa

    taken = docs.select(*keep, docs[text_col].alias("__text"))
    names = [*keep, "fp"]
    out = taken.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = np.fromiter((fingerprint(texts[i].as_py()) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], names=names)

    return taken.mapInArrow(run, out)


class Ring:
    """The chains of one distance. keys: five buckets a start, one for each two halves of the four."""

    #: Halves of the second (0, 1) and the third segment (2, 3) that may be the equal ones.
    EQUAL = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))

    def __init__(self, distance: int):
        import numpy as np

        if distance not in (3, 7):
            raise ValueError("segments of whole bytes need a distance of 3 or 7")
        self.distance, self.segments = distance, distance + 1
        self.width = 64 // self.segments
        whole = (1 << self.width) - 1
        masks = [[sum(whole << ((start + k) % self.segments * self.width) for k in range(length)) for length in range(1, self.segments)] for start in range(self.segments)]
        self.masks = np.array(masks, np.uint64)
        self.budgets = [length * distance // self.segments for length in range(1, self.segments)]

    def buckets(self, fps: DataFrame) -> DataFrame:
        """(bucket, fp): five buckets for each start and fingerprint."""
        w, h = self.width, self.width // 2
        keys = []
        for start in range(self.segments):
            cut = lambda k, s=start: F.shiftrightunsigned("fp", (s + k) % self.segments * w).bitwiseAND(F.lit((1 << w) - 1))
            halves = [F.shiftright(cut(1 + k // 2), k % 2 * h).bitwiseAND(F.lit((1 << h) - 1)) for k in range(4)]
            for n, (a, b) in enumerate(self.EQUAL):
                keys.append(F.lit(8 * start + n) + cut(0) * 64 + halves[a] * (64 << w) + halves[b] * (64 << (w + h)))
        return fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp")

    def near(self, x, start):
        """Places of the differences x (uint64) that pass the chain from `start` (a number, or one
        for each x) and the full check."""
        import numpy as np

        at = np.arange(len(x))
        for k, budget in enumerate(self.budgets):
            fits = np.bitwise_count(x & (self.masks[start, k] if np.isscalar(start) else self.masks[start[at], k])) <= budget
            at, x = at[fits], x[fits]
        return at[np.bitwise_count(x) <= self.distance]

    def forest(self, start: int, fps):
        """Edges of a spanning forest over the links among fps that the chain from `start` shows."""
        import numpy as np

        rest, edges, queue = fps, [], []
        while len(rest) or queue:
            if not queue:
                if len(rest) < 2:
                    break
                queue.append(rest[0])
                rest = rest[1:]
            at = queue.pop()
            if not len(rest):
                continue
            found = self.near(rest ^ at, start)
            if len(found):
                edges += [(int(at), int(f)) for f in rest[found]]
                queue.extend(rest[found])
                rest = np.delete(rest, found)
        return edges

    def batch(self, key, fp):
        """(a, b): edges of spanning forests over the links among fp in equal runs of key."""
        import numpy as np

        n = len(key)
        run = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [n]))
        left = np.repeat(run[1:], np.diff(run)) - np.arange(n) - 1  # how many follow in the run
        start = (key & 63) >> 3
        one, two = [], []
        at = np.flatnonzero(left > 0)
        for step in range(1, int(left.max(initial=0)) + 1):
            at = at[left[at] >= step]
            hit = at[self.near(fp[at] ^ fp[at + step], start[at])]
            one.append(hit)
            two.append(hit + step)
        if not one:
            return fp[:0], fp[:0]
        i, j = np.concatenate(one), np.concatenate(two)
        label, before = np.arange(n), None
        while before is None or (label != before).any():
            before = label.copy()
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            label = label[label]
        reached, via, new = label == np.arange(n), [], []
        while True:  # one step away from each component's first node after the other
            cross = reached[i] != reached[j]
            far, first = np.unique(np.where(reached[i], j, i)[cross], return_index=True)
            if not len(far):
                break
            via.append(np.where(reached[i], i, j)[cross][first])
            new.append(far)
            reached[far] = True
        none = np.zeros(0, np.int64)
        return fp[np.concatenate([none, *via])], fp[np.concatenate([none, *new])]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fps(fp), all different, that differ
    in at most `distance` bits (3 or 7)."""
    import pyarrow as pa

    ring = Ring(distance)
    dealt = ring.buckets(fps).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        def compared(key, fp):
            """Edges of whole buckets."""
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            size = np.repeat(np.diff(cuts), np.diff(cuts))
            small = (size > 1) & (size <= SMALL)
            if small.any():
                a, b = ring.batch(key[small], fp[small])
                if len(a):
                    yield out(a, b)
            for k in np.flatnonzero(np.diff(cuts) > SMALL):
                edges = ring.forest(int(key[cuts[k]] & 63) >> 3, fp[cuts[k] : cuts[k + 1]])
                if edges:
                    yield out(*np.array(edges, dtype=np.uint64).T)

        keys, held = [], []  # of the bucket that may go on in the next batch
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
            if not len(key):
                continue
            if held and keys[-1][-1] == key[-1]:
                keys.append(key.copy())
                held.append(fp.copy())
                continue
            key, fp = np.concatenate([*keys, key]), np.concatenate([*held, fp])
            last = int(np.searchsorted(key, key[-1]))
            yield from compared(key[:last], fp[:last])
            keys, held = [key[last:]], [fp[last:]]
        if held:
            yield from compared(np.concatenate(keys), np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row a document: id, fp long, component_id (the smallest id reachable over links of
    fingerprints).

    Null and empty texts have fingerprint 0 and link like any other; very long texts are hashed
    65,536 shingles at a time. A null id never is a component_id unless its whole component has no
    other. Repeated rows give repeated results; other columns of docs, whatever their names, are not
    read; an empty table gives an empty result.
    """
    rows = stage(fingerprints(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), keep=("id",)), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"), distance))
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp):
    """A fingerprint column as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Words:
    """Hashes of a text's words and of what follows from them; words are kept for the next text."""

    def __init__(self, keep: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.keep = keep

    def __call__(self, text: str | None):
        import numpy as np
        from xxhash import xxh64_intdigest

        if len(self.known) > self.keep:
            self.known.clear()
        found, known = (text or "").encode().lower().split(), self.known
        for w in found:
            if w not in known:
                known[w] = xxh64_intdigest(w, SEED)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingle_hashes(h, size: int, seed: int = 0):
    """64-bit hashes of the runs of `size` word hashes; of fewer words, of all of them; none of none."""
    import numpy as np

    size = max(1, min(size, len(h)))
    n = len(h) - size + 1
    x = np.full(max(n, 0), size + (seed << 8), np.uint64)
    for k in range(size if n > 0 else 0):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_fingerprints(h) -> tuple[int, int]:
    """Two fingerprints over the runs of PAIR words with the hashes h, from two hashes of each run."""
    import numpy as np

    if not len(h):
        return 0, 0
    out = []
    for seed in (1, 2):
        x, counts = shingle_hashes(h, PAIR, seed), np.zeros(64, np.int64)
        for low in range(0, len(x), 65536):
            counts += _bits(x[low : low + 65536])
        out.append(_majority(counts, len(x)))
    return out[0], out[1]


def _sketches(texts: DataFrame) -> DataFrame:
    """(digest, id, fp, fp2) of texts(digest, id, text)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words = Words()
        for batch in batches:
            got = np.array([pair_fingerprints(words(t.as_py())) for t in batch.column(2)], np.uint64).reshape(-1, 2)
            both = [pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], names=["digest", "id", "fp", "fp2"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("digest", "id", "text").mapInArrow(run, f"digest string, id {kind}, fp long, fp2 long")


def _families(nodes: DataFrame) -> DataFrame:
    """(fp, family) of nodes(fp, fp2): what links of either fingerprint connect, a superset of the
    groups."""
    first = nodes.groupBy("fp2").agg(F.min("fp").alias("owner"))
    first = stage(first, "simhash-owners")
    side = lambda name: first.select(F.col("fp2").alias(name), F.col("owner").alias(f"{name}_owner"))
    second = links(first.select(F.col("fp2").alias("fp")), WIDE).join(side("a"), "a").join(side("b"), "b").select(F.col("a_owner").alias("a"), F.col("b_owner").alias("b"))
    shared = nodes.join(first, "fp2").filter("fp <> owner").select(F.col("fp").alias("a"), F.col("owner").alias("b"))
    edges = links(nodes.select("fp").distinct(), WIDE).unionByName(second).unionByName(shared)
    return components(edges).select(F.col("node").alias("fp"), F.col("root").alias("family"))


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of digests whose components are those of all pairs of members(digest, family,
    parts, fp, fp2, text) that lie in one family, are WIDE or less apart in one fingerprint, and
    have the similarity.

    A family of several parts is compared two parts at a time, so a task holds two parts.
    """
    import pyarrow as pa

    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")).otherwise(F.lit(0))
    others = F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))).otherwise(F.array(F.lit(0)))
    dealt = members.withColumn("part", part).withColumn("other", F.explode(others)).select(
        "family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "digest", "fp", "fp2", "shingles"
    )
    dealt = dealt.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names, prints, sets, key = [], [], [], None

        def closed():
            if len(names) < 2:
                return None
            edges = _similar(np.array(prints, np.int64).view(np.uint64), [np.frombuffer(s, "<u8") for s in sets], similarity)
            if not edges:
                return None
            return pa.RecordBatch.from_arrays([pa.array([names[e[k]] for e in edges], pa.string()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for family, low, high, digest, fp, fp2, shingles in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (family, low, high) != key:
                    if (made := closed()) is not None:
                        yield made
                    names, prints, sets, key = [], [], [], (family, low, high)
                names.append(digest)
                prints.append((fp, fp2))
                sets.append(shingles)
        if (made := closed()) is not None:
            yield made

    return dealt.mapInArrow(run, "a string, b string")


def _similar(prints, sets: list, similarity: float) -> list[tuple[int, int]]:
    """Edges (places) of a spanning forest over the similar pairs of one comparison. prints: two
    fingerprints each; sets: sorted hashes of their shingles."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    rest, queue, edges = np.arange(len(sets)), [], []
    while len(rest) or queue:
        if not queue:
            if len(rest) < 2:
                break
            queue.append(rest[0])
            rest = rest[1:]
        at = queue.pop()
        if not len(rest):
            continue
        close = (np.bitwise_count(prints[rest] ^ prints[at]) <= WIDE).any(axis=1)
        close &= np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at])
        found = []
        places = np.flatnonzero(close)
        for low in range(0, len(places), 512):
            mine = places[low : low + 512]
            ends = np.cumsum(sizes[rest[mine]])
            every = np.concatenate([sets[k] for k in rest[mine]]) if len(mine) else np.zeros(0, np.uint64)
            if not sizes[at]:
                common = np.zeros(len(mine), np.int64)
            else:
                where = np.minimum(np.searchsorted(sets[at], every), sizes[at] - 1)
                sums = np.concatenate(([0], np.cumsum(sets[at][where] == every)))
                common = sums[ends] - sums[ends - sizes[rest[mine]]]
            union = sizes[rest[mine]] + sizes[at] - common
            found += mine[common >= similarity * union - 1e-9].tolist()
        if found:
            edges += [(int(at), int(k)) for k in rest[found]]
            queue.extend(rest[found])
            rest = np.delete(rest, found)
    return edges


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: id, component_id, the smallest id reachable over links. Texts link if the
    sets of their shingles of `words` words (A-Z in lower case; fewer words: all of them) have a
    Jaccard similarity of at least `similarity`, and one of two 64-bit fingerprints over their word
    pairs differs in at most WIDE bits.

    Equal texts are one node. The fingerprints' links give families; only texts of families of
    several are brought together with their shingles, which decide. Texts without words (null and
    empty ones too) link to one another. A null id never is a component_id unless its whole
    component has no other. Repeated rows give repeated results; other columns of docs, whatever
    their names, are not read; an empty table gives an empty result. Very long texts count as any
    other; a part of a family is bounded by the bytes of its shingles.
    """
    import pyarrow as pa

    text = F.coalesce(docs[text_col], F.lit(""))
    bare = F.when(F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) == 0, F.lit("")).otherwise(text)
    texts = docs.select(F.md5(bare.cast("binary")).alias("digest"), docs[id_col].alias("id"), bare.alias("text"))
    rows = stage(_sketches(texts), "simhash-rows")
    nodes = stage(rows.groupBy("digest").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2")), "simhash-nodes")
    families = stage(_families(nodes.select("fp", "fp2").distinct()), "simhash-families")
    named = nodes.join(families, "fp", "left").select("digest", "fp", "fp2", F.coalesce("family", "fp").alias("family"))
    # equal fingerprints need no link to be a family
    sized = named.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(named.join(sized, "family").select("digest", "family", "fp", "fp2", "n"), "simhash-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = Words()
        for batch in batches:
            made = [np.unique(shingle_hashes(hashes(t.as_py()), words)).astype("<u8").tobytes() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=["digest", "family", "fp", "fp2", "n", "shingles"])

    if is_small(members):  # then no other text is shuffled
        texts = texts.join(F.broadcast(members.select("digest")), "digest", "left_semi")
    # every task drops its own repeats of a text before the shuffle
    once = texts.groupBy("digest").agg(F.first("text").alias("text"))
    held = once.join(members, "digest").select("digest", "family", "fp", "fp2", "n", "text").mapInArrow(run, "digest string, family long, fp long, fp2 long, n long, shingles binary")
    held = stage(held, "simhash-shingles")
    weights = held.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("int").alias("parts")).filter("parts > 1")
    split = held.join(broadcast_if_small(weights), "family", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    roots = components(_verified(split, similarity))
    linked = nodes.join(roots, nodes["digest"] == roots["node"], "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(smallest, "root").select("digest", "component_id")
    out = rows.join(classes, "digest").select(F.col("id").alias(id_col), "component_id")
    drop_staged(held)
    return out


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is their component's component_id in similar_groups(), columns as
    they are: one document of each group. Of rows that share that id, one stays; rows with a null id
    stay only where their component has no other, one of them."""
    found = similar_groups(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    stay = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("id")).distinct()
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return held.join(stay, held["row"][id_col].eqNullSafe(stay["id"])).withColumn("id", F.col(f"row.`{id_col}`")).dropDuplicates(["id"]).select("row.*")
