"""Contraction of links: the stars that a task makes connect what its edges connect."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import components as C


def roots(edges):
    """(node, least node of its component) by union-find, without the least nodes themselves."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent if find(x) != x}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=60), st.booleans())
def test_stars_connect_what_the_edges_connect(edges, text):
    if text:
        edges = [(f"n{a}", f"n{b}") for a, b in edges]
    kind = object if text else np.int64
    x, y = C.stars(np.array([a for a, _ in edges], kind), np.array([b for _, b in edges], kind))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == roots(edges)
    assert len(x) == len(set(x.tolist()))


def test_components_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 50)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b]
    frame = spark.createDataFrame(edges + edges[:20], "a long, b long").repartition(4)
    got = {(r["node"], r["root"]) for r in C.components(frame).collect()}
    assert {(n, r) for n, r in got if n != r} == roots(edges)


def test_no_links_no_rows(spark):
    assert C.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
