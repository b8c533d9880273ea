"""Connected components of a graph given as edges, without bringing edges or labels together.

Rounds of large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every step hangs a node's neighbours onto the least of them, until each node hangs
on the least node of its component. A round's edges are written to the shared folder, so a lost
executor costs one round at most.

Before the first round each task replaces the edges that it reads, CHUNK at a time, by stars that
connect the same nodes: a chunk leaves one edge a node at most, however often its nodes are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_staged, stage

MAX_ROUNDS = 60
#: Edges that a task holds and contracts at once.
CHUNK = 1 << 18


def stars(a, b):
    """(node, least): for the nodes of the edges (a[k], b[k]), arrays of one kind, the least node of
    their component among these edges; least nodes themselves make no row."""
    import numpy as np

    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:  # labels only fall, and always name a node of the same component
        one, two = label[i], label[j]
        if (one == two).all():
            break
        low = np.minimum(one, two)
        for at in (one, two, i, j):
            np.minimum.at(label, at, low)
        while (label[label] != label).any():
            label = label[label]
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a > b) with the components of a staged table of edges."""
    import pyarrow as pa

    kind = edges.schema["a"].dataType.simpleString()
    tasks = -(-edges.count() // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def made(held):
            both = [np.concatenate([h.column(k).to_numpy(zero_copy_only=False) for h in held]) for k in (0, 1)]
            arrays = [pa.array(x, held[0].schema.field(0).type) for x in stars(*both)]
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return edges.select("a", "b").coalesce(max(1, tasks)).mapInArrow(run, f"a {kind}, b {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").filter("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.union(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), longs or strings: root is the least node of its component.

    Edges may be repeated, in either direction or of a node with itself (such an edge is dropped:
    alone, it makes no row). No edges: no rows.
    """
    given = stage(edges.filter("a <> b").select("a", "b"), "links")
    now = stage(_contracted(given).distinct(), "edges")
    drop_staged(given)
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        step = stage(_small_star(_large_star(now).distinct()).distinct(), "edges")
        after = _state(step)
        drop_staged(now)
        now, done = step, after == state
        state = after
        if done:
            break
    else:
        raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0
