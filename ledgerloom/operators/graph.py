"""Dependency graphs as DataFrames: levels, order, strongly connected components, linear systems.

nodes(id), edges(id, dep_id[, coeff]): id depends on dep_id. Unknown dependencies, self loops and
repeated edges don't count for order. Rounds of joins run until nothing changes; each round is
written out, so its plan stays short; a graph that needs more than MAX_ROUNDS is an error. Graphs that a count shows to have at most DRIVER_EDGES edges
and as many nodes are handled on the driver instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import LimitError

MAX_ROUNDS = 10_000
#: A strongly connected component of over so many nodes is solved, with a warning.
LARGE = 15
#: Up to so many nodes, and edges, a graph is small enough for the driver.
DRIVER_EDGES = 50_000
#: A component of up to so many nodes is solved as a dense matrix, a larger one by sparse elimination,
#: of which at most FILL coefficients are held.
DENSE, FILL = 1_000, 4_000_000


def _small_graph(ids: DataFrame, edges: DataFrame) -> tuple[list, dict] | None:
    """Nodes and their dependencies on the driver, if a count shows that they are few."""
    if ids.limit(DRIVER_EDGES + 1).count() > DRIVER_EDGES or edges.limit(DRIVER_EDGES + 1).count() > DRIVER_EDGES:
        return None
    needs: dict = {r["id"]: [] for r in ids.collect()}
    for r in edges.collect():
        needs[r["id"]].append(r["dep_id"])
    return list(needs), needs


def _small_levels(needs: dict) -> list[tuple]:
    users: dict = {n: [] for n in needs}
    open_ = {n: len(ds) for n, ds in needs.items()}
    for n, ds in needs.items():
        for m in ds:
            users[m].append(n)
    level = {n: 0 for n, k in open_.items() if not k}
    queue = list(level)
    for n in queue:
        for u in users[n]:
            open_[u] -= 1
            if not open_[u]:
                level[u] = 1 + max(level[m] for m in needs[u])
                queue.append(u)
    return [(n, level.get(n, -1)) for n in needs]


def _small_scc(needs: dict) -> list[tuple]:
    """Two depth-first passes: finishing order, then the reversed graph in its reverse."""
    users: dict = {n: [] for n in needs}
    for n, ds in needs.items():
        for m in ds:
            users[m].append(n)
    order, seen = [], set()
    for start in needs:
        stack = [(start, iter(needs[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            n, rest = stack[-1]
            m = next((x for x in rest if x not in seen), None)
            if m is None:
                order.append(n)
                stack.pop()
            else:
                seen.add(m)
                stack.append((m, iter(needs[m])))
    out, placed = [], set()
    for start in reversed(order):
        if start in placed:
            continue
        group, queue = [], [start]
        placed.add(start)
        while queue:
            n = queue.pop()
            group.append(n)
            fresh = [u for u in users[n] if u not in placed]
            placed |= set(fresh)
            queue += dict.fromkeys(fresh)
        least = min(group)
        out += [(n, least) for n in group]
    return out


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under spark.checkpoint.dir (a temporary folder where none is set in local
    mode, as in tests; an error on a cluster), deleted when the session ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            if not spark.sparkContext._jsc.sc().isLocal():
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(jvm)
    system.deleteOnExit(jvm)
    return path


def _staged(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    path = f"{shared_folder(df.sparkSession, 'graph')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles: over many rounds, broadcasts add up at the driver."""
    return left.join(right.hint("merge"), on, how)


def _union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _compact(parts: list[DataFrame]) -> list[DataFrame]:
    """parts, or one for all where they would make a long plan."""
    return parts if len(parts) < 50 else [_staged(_union(parts))]


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = nodes.select("id").distinct()
    e = edges.select("id", "dep_id").filter("id <> dep_id").distinct()
    return _joined(_joined(e, known, "id", "left_semi"), known.withColumnRenamed("id", "dep_id"), "dep_id", "left_semi").select("id", "dep_id")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest path below a node; nodes on or above a cycle have level -1.

    Peels off nodes without open dependencies, one level a round: each edge is read until its
    dependency is placed. What is left goes to the driver once a count shows that it is small.
    """
    ids = nodes.select("id").distinct()
    left, open_ = _staged(clean_edges(nodes, edges)), _staged(ids)
    placed: list[DataFrame] = []
    for level in range(MAX_ROUNDS + 1):
        if small := _small_graph(open_, left):
            rows = [(n, k if k < 0 else level + k) for n, k in _small_levels(small[1])]
            return _union([*placed, nodes.sparkSession.createDataFrame(rows, f"id {dict(nodes.dtypes)['id']}, level int")])
        marked = _staged(_joined(open_, left.select("id", F.lit(True).alias("waits")).distinct(), "id", "left"))
        free, open_ = marked.filter("waits IS NULL").select("id"), marked.filter("waits").select("id")
        if free.isEmpty():
            break
        placed = _compact([*placed, free.withColumn("level", F.lit(level))])
        left = _staged(_joined(left, free.withColumnRenamed("id", "dep_id"), "dep_id", "left_anti").select("id", "dep_id"))
    else:
        raise LimitError(f"levels: not settled after {MAX_ROUNDS} rounds")
    return _union([*placed, open_.withColumn("level", F.lit(-1))])


def topo_order(nodes: DataFrame, edges: DataFrame, order_by: str = "id") -> DataFrame:
    """(id, level, position): dependencies first, nodes of cycles last; within a level by order_by.
    Positions are counted from the sizes of the levels, so no task sorts all nodes."""
    from pyspark.sql import Window

    ranked = levels(nodes, edges).join(nodes.select("id", *([order_by] if order_by != "id" else [])).dropDuplicates(["id"]), "id")
    ranked = _staged(ranked.withColumn("__l", F.when(F.col("level") < 0, F.lit(2**31 - 1)).otherwise(F.col("level"))))
    sizes = ranked.groupBy("__l").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("__l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__l").orderBy(order_by, "id"))
    return ranked.withColumn("__n", within).join(sizes.select("__l", "before"), "__l").select("id", "level", (F.col("before") + F.col("__n")).alias("position"))


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): scc is the least id of the node's strongly connected component.

    Forward-backward colouring. Trivial components are trimmed first; then every node takes the
    greatest id that reaches it as its colour, and what reaches the colour's own node backwards
    within the colour is its component.
    """
    ids = _staged(nodes.select("id").distinct())
    live = _staged(clean_edges(nodes, edges))
    if small := _small_graph(ids, live):
        id_type = dict(nodes.dtypes)["id"]
        return nodes.sparkSession.createDataFrame(_small_scc(small[1]), f"id {id_type}, scc {id_type}")
    done = []
    for _ in range(MAX_ROUNDS):
        # trim: nodes without edges in or out are alone
        while (held := live.count()) > DRIVER_EDGES:
            both = _joined(live.select("id").distinct(), live.select(F.col("dep_id").alias("id")).distinct(), "id", "left_semi")
            trimmed = _staged(_joined(_joined(live, both, "id", "left_semi"), both.withColumnRenamed("id", "dep_id"), "dep_id", "left_semi").select("id", "dep_id"))
            if trimmed.count() == held:
                break
            live = trimmed
        if held <= DRIVER_EDGES:
            done.append(_few_components(live))
            break
        colour = _staged(live.select(F.explode(F.array("id", "dep_id")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            sent = _joined(live, colour.withColumnRenamed("id", "dep_id"), "dep_id").groupBy("id").agg(F.max("c").alias("m"))
            new = _staged(_joined(colour, sent, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.col("m") > F.col("c")).alias("new")))
            colour = new.select("id", "c")
            if new.filter("new").isEmpty():
                break
        inside = _joined(_joined(live, colour, "id"), colour.select(F.col("id").alias("dep_id"), F.col("c").alias("d")), "dep_id").filter("c = d").select("id", "dep_id", "c")
        inside = _staged(inside)
        found = _staged(colour.filter("id = c").select("id", "c"))
        frontier = found
        while True:
            # backwards: dependencies of found nodes that have the same colour
            ahead = _joined(_joined(inside, frontier.select("id", F.col("c").alias("fc")), "id").select(F.col("dep_id").alias("id"), "c").distinct(), found, ["id", "c"], "left_anti")
            frontier = _staged(ahead)
            if frontier.isEmpty():
                break
            found = _staged(found.unionByName(frontier))
        done.append(found)
        live = _staged(_joined(_joined(live, found.select("id"), "id", "left_anti"), found.select(F.col("id").alias("dep_id")), "dep_id", "left_anti").select("id", "dep_id"))
    else:
        if not live.isEmpty():
            raise LimitError(f"scc: not settled after {MAX_ROUNDS} rounds")
    if not done:
        return ids.withColumn("scc", F.col("id"))
    every = _union(done)
    least = every.groupBy("c").agg(F.min("id").alias("scc"))
    named = _joined(every, least, "c").select("id", F.col("scc"))
    return _joined(ids, named, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def _few_components(live: DataFrame) -> DataFrame:
    """(id, c) of the nodes of a few edges, by the driver."""
    needs: dict = {}
    for r in live.collect():
        needs.setdefault(r["id"], []).append(r["dep_id"])
        needs.setdefault(r["dep_id"], [])
    kind = dict(live.dtypes)["id"]
    return live.sparkSession.createDataFrame(_small_scc(needs), f"id {kind}, c {kind}")


def scc_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, members, is_self_loop): components of more than one node, and self loops."""
    groups = scc(nodes, edges).groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("members")).filter(F.size("members") > 1).withColumn("is_self_loop", F.lit(False))
    loops = edges.filter("id = dep_id").select(F.col("id").alias("scc"), F.array("id").alias("members"), F.lit(True).alias("is_self_loop")).distinct()
    return groups.unionByName(loops)


def solve_linear(nodes: DataFrame, edges: DataFrame, *, b: str = "b", coeff: str = "coeff", clamp: bool = True, epsilon: float = 1e-9, iterations: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(id, x, method, scc, warning): x = b + sum over dependencies of coeff * x.

    Components are solved in the order of the condensed graph, a level a round: single nodes
    directly, cycles by elimination with partial pivoting (over DENSE nodes: sparse elimination); a
    singular system, or one that fills up under sparse elimination, by Gauss-Seidel, or b if that
    diverges. A null b or coeff is 0; of a repeated id the greatest b counts, coeffs of a repeated
    edge are added; null ids, and edges from or to unknown nodes, don't count, nor do edges whose
    coeffs add up to 0: no x rests on them. clamp: no x is below 0. A component is solved by one task.
    """
    nodes = nodes.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.coalesce(F.col(b).cast("double"), F.lit(0.0))).alias("b"))
    edges = edges.filter("id IS NOT NULL AND dep_id IS NOT NULL").groupBy("id", "dep_id").agg(F.sum(F.coalesce(F.col(coeff).cast("double"), F.lit(0.0))).alias("coeff")).filter("coeff <> 0")
    if small := _small_system(nodes, edges):
        return _solve_small(nodes, *small, clamp, epsilon, iterations, tolerance)
    kind = dict(nodes.dtypes)["id"]
    shape = f"id {kind}, x double, method string, scc {kind}, warning string"
    limits = (clamp, epsilon, iterations, tolerance)
    ids = nodes.select("id")
    links = _staged(_joined(_joined(edges, ids, "id", "left_semi"), ids.withColumnRenamed("id", "dep_id"), "dep_id", "left_semi").select("id", "dep_id", "coeff"))
    open_ = _staged(nodes.select("id", "b"))
    direct = [(F.greatest("b", F.lit(0.0)) if clamp else F.col("b")).alias("x"), F.lit("direct").alias("method")]
    solved: list[DataFrame] = []
    for _ in range(MAX_ROUNDS + 1):  # nodes that rest on no cycle
        if small := _small_system(open_, links):
            return _union([*solved, _solve_small(nodes, *small, *limits)])
        marked = _staged(_joined(open_, links.select("id", F.lit(True).alias("waits")).distinct(), "id", "left"))
        free = marked.filter("waits IS NULL").select("id", *direct, F.col("id").alias("scc"), F.lit(None).cast("string").alias("warning"))
        if free.isEmpty():
            break
        solved = _compact([*solved, free])
        open_, links = _pushed(marked.filter("waits").select("id", "b"), links, free)
    else:
        raise LimitError(f"solve_linear: not settled after {MAX_ROUNDS} rounds")
    comp = _staged(scc(open_, links))
    named = _joined(_joined(links, comp, "id"), comp.select(F.col("id").alias("dep_id"), F.col("scc").alias("dep_scc")), "dep_id")
    links, open_ = _staged(named.select("id", "dep_id", "coeff", "scc", "dep_scc")), _staged(_joined(open_, comp, "id"))
    for _ in range(MAX_ROUNDS + 1):  # components, each once those that it needs are solved
        if small := _small_system(open_, links):
            return _union([*solved, _solve_small(nodes, *small, *limits)])
        needy = links.filter("scc <> dep_scc").select("scc", F.lit(True).alias("waits")).distinct()
        marked = _staged(_joined(open_, needy, "scc", "left"))
        loops = links.filter("scc = dep_scc").groupBy("id").agg(F.collect_list(F.struct("dep_id", "coeff")).alias("inside"))
        ready = _joined(marked.filter("waits IS NULL").select("id", "scc", "b"), loops, "id", "left")
        alone = ready.filter("inside IS NULL").select("id", *direct, "scc", F.lit(None).cast("string").alias("warning"))
        dealt = ready.filter("inside IS NOT NULL").select("id", "scc", "b", "inside").repartition("scc").sortWithinPartitions("scc", "id")
        done = _staged(alone.unionByName(dealt.mapInArrow(_cycle_solver(*limits), shape)))
        if done.isEmpty():
            return _union(solved)
        solved = _compact([*solved, done])
        open_, links = _pushed(marked.filter("waits").select("id", "scc", "b"), links, done)
    raise LimitError(f"solve_linear: not settled after {MAX_ROUNDS} rounds")


def _pushed(open_: DataFrame, links: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """open_ with what it needs of done added to b, and the links to nodes that aren't done."""
    reached = _staged(_joined(links, done.select(F.col("id").alias("dep_id"), "x"), "dep_id", "left"))
    extra = reached.filter("x IS NOT NULL").groupBy("id").agg(F.sum(F.col("coeff") * F.col("x")).alias("extra"))
    more = _joined(open_, extra, "id", "left").withColumn("b", F.col("b") + F.coalesce("extra", F.lit(0.0))).select(open_.columns)
    return _staged(more), reached.filter("x IS NULL").drop("x")


def _small_system(nodes: DataFrame, edges: DataFrame) -> tuple[dict, dict] | None:
    """b of each node and the coefficients of its dependencies, if a count shows that both are few."""
    if nodes.limit(DRIVER_EDGES + 1).count() > DRIVER_EDGES or edges.limit(DRIVER_EDGES + 1).count() > DRIVER_EDGES:
        return None
    base = {r["id"]: r["b"] for r in nodes.collect()}
    weights: dict = {n: {} for n in base}
    for r in edges.collect():
        if r["id"] in base and r["dep_id"] in base:
            weights[r["id"]][r["dep_id"]] = r["coeff"]
    return base, weights


def _solve_small(nodes: DataFrame, base: dict, weights: dict, clamp: bool, *limits) -> DataFrame:
    named = dict(_small_scc({n: [m for m in ds if m != n] for n, ds in weights.items()}))
    members: dict = {}
    for n, c in named.items():
        members.setdefault(c, []).append(n)
    condensed = {c: list({named[m] for n in ns for m in weights[n] if named[m] != c}) for c, ns in members.items()}
    x: dict = {}
    rows = []
    for c, _ in sorted(_small_levels(condensed), key=lambda t: t[1]):
        group = sorted(members[c])
        eff = {n: base[n] + sum(w * x[m] for m, w in weights[n].items() if named[m] != c) for n in group}
        inside = {n: [(m, w) for m, w in weights[n].items() if named[m] == c] for n in group}
        if not any(inside.values()):
            solved = [(n, max(0.0, eff[n]) if clamp else eff[n], "direct", c, None) for n in group]
        else:
            found, method, warning = _solved_cycle(group, [eff[n] for n in group], [inside[n] for n in group], clamp, *limits)
            solved = [(n, float(v), method, c, warning) for n, v in zip(group, found, strict=True)]
        x |= {s[0]: s[1] for s in solved}
        rows += solved
    kind = dict(nodes.dtypes)["id"]
    return nodes.sparkSession.createDataFrame(rows, f"id {kind}, x double, method string, scc {kind}, warning string")


def _solved_cycle(ids: list, eff, inside: list, clamp: bool, epsilon: float, iterations: int, tolerance: float) -> tuple:
    """(x, method, warning) of one component. inside: each node's (dep_id, coeff) pairs within it."""
    import numpy as np

    place = {v: k for k, v in enumerate(ids)}
    n = len(ids)
    v = np.asarray(eff, float)
    links: list[dict] = [{} for _ in range(n)]
    for i, pairs in enumerate(inside):
        for dep, coeff in pairs:
            links[i][place[dep]] = links[i].get(place[dep], 0.0) + coeff
    warning = f"component of {n} nodes" if n > LARGE else None
    x = None
    if n > DENSE:
        x, method = _eliminated(links, v, epsilon), "gaussian"
    else:
        m = np.eye(n)
        for i, row in enumerate(links):
            for j, c in row.items():
                m[i, j] -= c
        if n and np.linalg.cond(m) < 1 / epsilon:
            x, method = np.linalg.solve(m, v), "gaussian"
    if x is None:
        x, method, warning = v.copy(), "gauss_seidel", "singular system"
        limit = 100 * max(1.0, float(np.abs(v).max(initial=0)))
        for _ in range(iterations):
            before = x.copy()
            for i in range(n):
                rest, own = sum(c * x[j] for j, c in links[i].items() if j != i), 1 - links[i].get(i, 0.0)
                x[i] = (v[i] + rest) / own if abs(own) > epsilon else v[i] + rest
            if np.abs(x).max() > limit:
                x, method, warning = v.copy(), "b", "diverged"
                break
            if np.abs(x - before).max() < tolerance:
                break
    return (np.maximum(x, 0.0) if clamp else x), method, warning


def _eliminated(links: list[dict], v, epsilon: float):
    """x = v + links x, by elimination of the node with the fewest open coefficients first; None if a
    pivot vanishes or over FILL coefficients come up."""
    import heapq

    import numpy as np

    n, x = len(links), np.array(v, float)
    rows = [{j: -c for j, c in row.items()} for row in links]
    users: list[set] = [set() for _ in range(n)]
    for i, row in enumerate(rows):
        row[i] = row.get(i, 0.0) + 1.0
        for j in row:
            users[j].add(i)
    cost = lambda k: (len(rows[k]) - 1) * (len(users[k]) - 1)
    heap, order, done, held = [(cost(k), k) for k in range(n)], [], [False] * n, sum(map(len, rows))
    heapq.heapify(heap)
    while heap:
        guess, k = heapq.heappop(heap)
        if done[k]:
            continue
        if guess < cost(k):
            heapq.heappush(heap, (cost(k), k))
            continue
        pivot = rows[k].get(k, 0.0)
        if abs(pivot) <= epsilon or held > FILL:
            return None
        done[k] = True
        order.append(k)
        for j in rows[k]:
            users[j].discard(k)
        for i in users[k]:
            factor = rows[i].pop(k) / pivot
            held -= 1
            for j, c in rows[k].items():
                if j != k:
                    held += j not in rows[i]
                    rows[i][j] = rows[i].get(j, 0.0) - factor * c
                    users[j].add(i)
            x[i] -= factor * x[k]
            heapq.heappush(heap, (cost(i), i))
    for k in reversed(order):
        x[k] = (x[k] - sum(c * x[j] for j, c in rows[k].items() if j != k)) / rows[k][k]
    return x


def _cycle_solver(*limits):
    """Rows of whole components, in order, a batch at a time: those of one size are one stack of matrices."""

    def rows_of(whole):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, keys, b = whole.column("id").to_pylist(), whole.column("scc").to_pylist(), whole.column("b").to_numpy(zero_copy_only=False)
        inside = whole.column("inside")
        pairs, owner = inside.flatten(), np.repeat(np.arange(len(ids)), pc.list_value_length(inside).to_numpy(zero_copy_only=False))
        place = {v: k for k, v in enumerate(ids)}
        deps = np.fromiter((place[v] for v in pairs.field("dep_id").to_pylist()), np.int64, len(pairs))
        coeffs = pairs.field("coeff").to_numpy(zero_copy_only=False)
        starts = np.array([k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]])
        sizes = np.diff([*starts, len(ids)])
        component = np.repeat(np.arange(len(starts)), sizes)
        x, method, warning = _solved_stacks(b, starts, sizes, component, owner, deps, coeffs, limits)
        return pa.RecordBatch.from_arrays([whole.column("id"), pa.array(x, pa.float64()), pa.array(method, pa.string()), whole.column("scc"), pa.array(warning, pa.string())], names=["id", "x", "method", "scc", "warning"])

    def solve(batches):
        import pyarrow as pa

        held: list = []  # the rows of the last component, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("scc").to_pylist()
            last = next((k for k in range(len(keys) - 1, 0, -1) if keys[k] != keys[k - 1]), 0)
            if not last and held and held[-1].column("scc")[0].as_py() != keys[0]:
                yield rows_of(pa.concat_batches(held))
                held = []
            elif last:
                yield rows_of(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield rows_of(pa.concat_batches(held))

    return solve


def _solved_stacks(b, starts, sizes, component, owner, deps, coeffs, limits: tuple) -> tuple:
    """(x, method, warning) of components that lie one after the other. owner, deps, coeffs: links
    between rows. The results are those of _solved_cycle, which solves what a stack can't hold."""
    import numpy as np

    clamp, epsilon = limits[0], limits[1]
    x, method, warning = np.array(b, float), np.full(len(b), "gaussian", object), np.full(len(b), None, object)
    by_hand = []
    of_link, finite = component[owner], np.ones(len(starts), bool)
    finite[component[~np.isfinite(x)]] = False
    finite[of_link[~np.isfinite(coeffs)]] = False
    for n in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == n)
        if n > LARGE:
            by_hand += mine.tolist()
            continue
        by_hand += mine[~finite[mine]].tolist()
        mine = mine[finite[mine]]
        rank = np.full(len(starts), -1)
        rank[mine] = np.arange(len(mine))
        at = rank[of_link] >= 0
        m = np.tile(np.eye(n), (len(mine), 1, 1))
        np.subtract.at(m, (rank[of_link[at]], owner[at] - starts[of_link[at]], deps[at] - starts[of_link[at]]), coeffs[at])
        fine = np.linalg.cond(m) < 1 / epsilon
        by_hand += mine[~fine].tolist()
        rows = starts[mine[fine]][:, None] + np.arange(n)
        found = np.linalg.solve(m[fine], x[rows][..., None])[..., 0]
        x[rows] = np.maximum(found, 0.0) if clamp else found
    if by_hand:
        order = np.argsort(of_link, kind="stable")
        first = np.searchsorted(of_link[order], np.arange(len(starts) + 1))
    for c in by_hand:
        low, n = int(starts[c]), int(sizes[c])
        inside: list[list] = [[] for _ in range(n)]
        for k in order[first[c] : first[c + 1]]:
            inside[owner[k] - low].append((int(deps[k]) - low, float(coeffs[k])))
        x[low : low + n], method[low : low + n], warning[low : low + n] = _solved_cycle(list(range(n)), x[low : low + n], inside, *limits)
    return x, method, warning


def scc_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc, level, position): components in the order of the condensed graph, their members
    together. Nodes of cycles have level -1, as in levels(), but stand where their component does;
    ties are by component, then id."""
    from pyspark.sql import Window

    named = _staged(scc(nodes, edges))
    other = named.select(F.col("id").alias("dep_id"), F.col("scc").alias("dep_scc"))
    across = clean_edges(nodes, edges).join(named, "id").join(other, "dep_id").filter("scc <> dep_scc").select(F.col("scc").alias("id"), F.col("dep_scc").alias("dep_id"))
    depth = levels(named.select(F.col("scc").alias("id")), across).select(F.col("id").alias("scc"), F.col("level").alias("__d"))
    sizes = named.groupBy("scc").agg(F.count(F.lit(1)).alias("__n"))
    ranked = _staged(named.join(depth, "scc").join(sizes, "scc"))
    before = ranked.groupBy("__d").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__d").orderBy("scc", "id"))
    placed = ranked.withColumn("__k", within).join(before.select("__d", "before"), "__d")
    return placed.select("id", "scc", F.when(F.col("__n") > 1, F.lit(-1)).otherwise(F.col("__d")).alias("level"), (F.col("before") + F.col("__k")).alias("position"))
