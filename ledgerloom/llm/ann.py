"""Approximate nearest neighbours by a forest of random-projection trees.

TREES trees are built on a bounded sample (SAMPLE vectors by hash order). A tree splits at the
median of the projections onto the difference of two sampled vectors, as deep as leaves of about
LEAF_ROWS vectors need, DEEPEST levels at most. Every vector is indexed: it lies in one leaf of each
tree. A query visits leaves of all trees in the order of one shared priority queue, keyed by the
squared distances from the splitting planes that it would have to cross, added up, until it has seen
SHARE of all leaves (more where those hold too few vectors); the candidates there are reranked by
their exact distance.

Rows are made distinct first. Beyond DEEPEST levels leaves grow with the input; one of over BLOCK vectors is split
into blocks by a hash of id and vector, and its queries go to each block. A task holds one block at a
time and answers for all its blocks at once: at most k rows a query, of different ids (more often only
where it has over HELD of them), so neither pairs nor visits become rows. TASKS tasks answer, more
where each would get over TASK_ROWS rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import broadcast_if_small, stage

TREES = 6
SHALLOWEST, DEEPEST = 7, 10
LEAF_ROWS = 128
SHARE = 0.17
SAMPLE = 16_384
LEAF = 12
BLOCK = 32_768
TASKS, TASK_ROWS, HELD = 16, 1_000_000, 2_000_000
K = 10


@dataclass
class Tree:
    """Node 0 is the root. normals, offsets: of inner nodes; left, right: child nodes, or ~leaf."""

    normals: object
    offsets: object
    left: list[int]
    right: list[int]
    leaves: int


def depth_for(rows: int) -> int:
    return min(DEEPEST, max(SHALLOWEST, math.ceil(math.log2(max(1, rows) / LEAF_ROWS))))


def build_tree(sample, rng, depth: int = SHALLOWEST, leaf: int = LEAF) -> Tree:
    """sample: float64 matrix; a tree of at most 2 ** depth leaves."""
    import numpy as np

    normals, offsets, left, right, leaves = [], [], [], [], 0

    def grow(rows, level: int) -> int:
        nonlocal leaves
        plane = _plane(sample[rows], rng) if level and len(rows) > leaf else None
        if plane is None:
            leaves += 1
            return ~(leaves - 1)
        normal, offset, below = plane
        at = len(normals)
        normals.append(normal)
        offsets.append(offset)
        left.append(0)
        right.append(0)
        left[at] = grow(rows[below], level - 1)
        right[at] = grow(rows[~below], level - 1)
        return at

    grow(np.arange(len(sample)), depth)
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(normals).reshape(-1, width), np.array(offsets), left, right, leaves)


def _plane(points, rng):
    """Normal, offset and mask of the points below; None if three draws find no two different ones
    that divide them."""
    import numpy as np

    for _ in range(3):
        a, b = points[rng.choice(len(points), 2, replace=False)]
        normal = a - b
        length = np.linalg.norm(normal)
        if not length:
            continue
        normal = normal / length
        at = points @ normal
        offset = float(np.median(at))
        below = at <= offset
        if below.any() and not below.all():
            return normal, offset, below
    return None


def leaves_of(tree: Tree, points):
    """The leaf of each point."""
    import numpy as np

    if not len(tree.left):
        return np.zeros(len(points), np.int64)
    left, right = np.array(tree.left), np.array(tree.right)
    node = np.zeros(len(points), np.int64)
    out = np.full(len(points), -1, np.int64)
    open_ = np.arange(len(points))
    while len(open_):
        at = node[open_]
        side = np.einsum("ij,ij->i", points[open_], tree.normals[at]) <= tree.offsets[at]
        after = np.where(side, left[at], right[at])
        done = after < 0
        out[open_[done]] = ~after[done]
        node[open_[~done]] = after[~done]
        open_ = open_[~done]
    return out


def visits(forest: list[Tree], point, budget: int, sizes: list[dict[int, int]], need: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue: `budget` of them, and more until the leaves of
    some tree hold `need` ids. sizes: ids in each tree's leaves, or fewer."""
    margins = [(t.normals @ point - t.offsets).tolist() if t.left else [] for t in forest]
    queue = [(0.0, k, k, 0) for k in range(len(forest))]
    heapq.heapify(queue)
    count, found, held = len(queue), [], [0] * len(forest)
    while queue and (len(found) < budget or max(held) < need):
        far, _, k, node = heapq.heappop(queue)
        tree = forest[k]
        if not tree.left:
            node = ~0
        while node >= 0:
            margin = margins[k][node]
            near, other = (tree.left[node], tree.right[node]) if margin <= 0 else (tree.right[node], tree.left[node])
            count += 1
            heapq.heappush(queue, (far + margin * margin, count, k, other))
            node = near
        leaf = ~node
        found.append((k, leaf))
        held[k] += sizes[k].get(leaf, 0)
    return found


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame, query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    trees: int = TREES, depth: int | None = None, share: float = SHARE, sample: int = SAMPLE, block: int = BLOCK, seed: int = 7,
) -> DataFrame:
    """query_id, rank int from 1, vec_id, score double: of every row for which `query` holds, the k
    nearest rows found (all, if there are fewer) by Euclidean distance in double precision, ties to
    the smaller id.

    A query's own id is no candidate. Rows with a null id and vectors that aren't usable() take no
    part, nor do vectors of another length than most have. Repeated rows (id and vector) count once;
    of an id with several vectors, the nearest counts. Vectors of any length fit; a task holds a
    block of them. Other columns, whatever their names, are not read. An empty table gives an empty
    result. depth: of the trees, by default from the number of rows.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    chosen = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(query, F.lit(False)).alias("query")
    ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = chosen.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lengths["n"] if lengths else 0
    depth = depth if depth is not None else depth_for(lengths["count"] if lengths else 0)
    distinct = stage(chosen.filter(F.size("vector") == width).groupBy("id", "vector").agg(F.max("query").alias("query")), "ann-vectors")
    several = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("vector").alias("least")).filter("n > 1").select("id", "least")
    if several.isEmpty():
        rows = distinct.withColumn("first", F.lit(True))
    else:  # one vector of each id is its first
        several = stage(several, "ann-several")
        rows = distinct.join(broadcast_if_small(several), "id", "left").withColumn("first", F.col("least").isNull() | (F.col("vector") == F.col("least"))).drop("least")

    def matrix(column: pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))

    taken = rows.filter("first").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    points = matrix(taken.column(0).combine_chunks()) if width else np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    forest = [build_tree(points, rng, depth) for _ in range(trees)] if width else []
    planted = spark.sparkContext.broadcast(forest)  # trees * 2 ** DEEPEST planes at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, list[int]] = {}
        for batch in batches:
            x, first = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for t, tree in enumerate(planted.value):
                leaf = leaves_of(tree, x)
                n, firsts = np.bincount(leaf, minlength=tree.leaves), np.bincount(leaf[first], minlength=tree.leaves)
                for k in np.flatnonzero(n).tolist():
                    held = tally.setdefault(t << 32 | k, [0, 0])
                    held[0] += int(n[k])
                    held[1] += int(firsts[k])
        columns = [list(tally), [v[0] for v in tally.values()], [v[1] for v in tally.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cell", "n", "firsts"])

    # at most trees * 2 ** depth rows
    counts = rows.select("vector", "first").mapInArrow(count, "cell long, n long, firsts long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts")).collect() if width else []
    sizes: list[dict[int, int]] = [{} for _ in range(trees)]
    firsts: list[dict[int, int]] = [{} for _ in range(trees)]
    for r in counts:
        sizes[r["cell"] >> 32][r["cell"] & 0xFFFFFFFF] = r["n"]
        firsts[r["cell"] >> 32][r["cell"] & 0xFFFFFFFF] = r["firsts"]
    budget = max(1, math.ceil(share * sum(t.leaves for t in forest)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_, parts = planted.value, [{leaf: -(-n // block) for leaf, n in s.items()} for s in sizes]

        def out(cells, ids, asks, raw):
            return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(ids, pa.int64()), pa.array(asks, pa.bool_()), pa.array(raw, pa.binary())], names=["cell", "id", "query", "vector"])

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                piece = batch.slice(start, 2000)
                ids = piece.column(0).to_numpy(zero_copy_only=False)
                x = matrix(piece.column(1))
                raw = [v.tobytes() for v in np.ascontiguousarray(x, "<f8")]
                mixed = (np.ascontiguousarray(x, "<f8").view("<u8") * (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))).sum(axis=1, dtype=np.uint64)
                mixed ^= mixed >> np.uint64(32)
                mixed = (mixed + ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for t, tree in enumerate(trees_):
                    leaf = leaves_of(tree, x)
                    n = np.array([parts[t].get(int(v), 1) for v in leaf])
                    part = mixed.astype(np.int64) % n
                    yield out((np.int64(t) << 44) | (leaf << 24) | part, ids, np.zeros(len(ids), bool), raw)
                for i in np.flatnonzero(piece.column(2).to_numpy(zero_copy_only=False)):
                    cells = [t << 44 | leaf << 24 | p for t, leaf in visits(trees_, x[i], budget, firsts, k + 1) for p in range(parts[t].get(leaf, 1))]
                    yield out(cells, [int(ids[i])] * len(cells), [True] * len(cells), [raw[i]] * len(cells))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held = None, [], []
        base = None
        got = ([], [], [])
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            who = batch.column(1).to_numpy(zero_copy_only=False)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<f8").reshape(-1, width)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, ids, held, base = cells[a], [], [], None
                if not asks[a]:
                    ids.append(who[a:b].copy())
                    held.append(x[a:b].copy())
                    continue
                if not held:
                    continue
                if base is None:
                    base = (np.concatenate(ids), np.concatenate(held))
                    order = np.argsort(base[0], kind="stable")
                    base = (base[0][order], base[1][order])
                    starts = np.flatnonzero(np.diff(base[0], prepend=base[0][0] - 1))
                    base = (*base, np.einsum("ij,ij->i", base[1], base[1]), starts)
                for low in range(a, b, 64):
                    _nearest(who[low : min(b, low + 64)], x[low : min(b, low + 64)], base, k, got)
            if len(got[0]) > HELD:
                best = _best(got, k)
                if len(best[0]) > HELD // 2:
                    yield answers(best)
                got = ([], [], []) if len(best[0]) > HELD // 2 else tuple(c.tolist() for c in best)
        if got[0]:
            yield answers(_best(got, k))

    def answers(best):
        return pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], names=["query_id", "vec_id", "score"])

    sent = trees * sum(sizes[0].values()) + budget * rows.filter("query").count() if width else 0
    tasks = max(TASKS, -(-sent // TASK_ROWS))
    dealt = rows.select("id", "vector", "query").mapInArrow(deal, "cell long, id long, query boolean, vector binary").repartition(tasks, "cell").sortWithinPartitions("cell", "query")
    near = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(got, k: int) -> tuple:
    """Of (query ids, ids, distances) the k nearest ids of each query, each once, ties to the smaller id."""
    import numpy as np

    ask, ids, far = np.array(got[0], np.int64), np.array(got[1], np.int64), np.array(got[2], np.float64)
    at = np.lexsort((far, ids, ask))
    ask, ids, far = ask[at], ids[at], far[at]
    once = np.ones(len(at), bool)
    once[1:] = (ask[1:] != ask[:-1]) | (ids[1:] != ids[:-1])
    ask, ids, far = ask[once], ids[once], far[once]
    at = np.lexsort((ids, far, ask))
    ask, ids, far = ask[at], ids[at], far[at]
    near = np.arange(len(at)) - np.searchsorted(ask, ask) < k
    return ask[near], ids[near], far[near]


def _nearest(who, x, base, k: int, got) -> None:
    """Append to got (query ids, ids, distances) the k nearest ids of base for each query, each by
    its nearest vector. The product form picks candidates with a margin for its rounding; their
    distances are then taken exactly. base: ids in order, their vectors, squared lengths, and where
    each id starts."""
    import numpy as np

    ids, points, norms, starts = base
    square = norms[None, :] - 2.0 * (x @ points.T)
    own = np.einsum("ij,ij->i", x, x)
    for i in range(len(x)):
        row = np.where(ids == who[i], np.inf, square[i])
        if len(starts) > k:
            bound = np.partition(row if len(starts) == len(row) else np.minimum.reduceat(row, starts), k - 1)[k - 1]
            slack = 1e-9 * (abs(bound) + own[i] + 1e-300)
            at = np.flatnonzero((row <= bound + slack) & np.isfinite(row))
        else:
            at = np.flatnonzero(np.isfinite(row))
        exact = np.sqrt(((points[at] - x[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], exact))
        _, first = np.unique(ids[at][order], return_index=True)
        for j in order[np.sort(first)[:k]]:
            got[0].append(int(who[i]))
            got[1].append(int(ids[at[j]]))
            got[2].append(float(exact[j]))
