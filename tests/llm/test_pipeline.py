"""run() of the pipeline, stage by stage, against plain Python; only the two fitted models are the
operators' own, and the mix is the SQL of op1."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pandas as pd
import xxhash

import corpus_pipeline
from ledgerloom.llm import quality, queries, toxicity
from ledgerloom.llm.common import stage
from tests.llm.test_operators import brute_similar_groups, spark_pair, tik

SF = "/root/testdata/sf0.01"


def good(text, model):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            marked |= {i, i + 1, i + 2}
    if len(w) < 50 or 100 * len(marked) > 50 * len(w):
        return False
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    buckets = [h % quality.BUCKETS for h in signed] + [spark_pair(a, b) % quality.BUCKETS for a, b in zip(signed, signed[1:], strict=False)]
    return math.fsum(model[b] for b in buckets) / len(buckets) >= quality.THRESHOLD


def mixed(rows):
    """doc_id of every row of the mix, of `rows` (doc_id, source, text)."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "source", "text"]))
    out = []
    for doc_id, size, source_size, target, taken in con.execute(queries.ORACLE_SQL["op1_mix"]).fetchall():
        epochs = math.floor(target / source_size) if source_size else 0
        out += [doc_id] * (epochs + (size > 0 and 2 * (taken - epochs * size) >= size))
    return out


def test_run_keeps_what_the_stages_should(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    seen = {}

    def held(df, name):
        seen[name] = stage(df, name)
        return seen[name]

    monkeypatch.setattr(corpus_pipeline, "stage", held)
    result = corpus_pipeline.run(spark, SF)
    names = list(seen)
    assert len(names) == 5
    got = [sorted(r["doc_id"] for r in seen[n].select("doc_id").collect()) for n in names]
    for n in names[:4]:
        assert seen[n].columns == docs.columns
        assert all(r == rows[r["doc_id"]] for r in seen[n].collect())

    model = quality.fit(docs, labels)
    want = [i for i in rows if good(rows[i]["text"], model)]
    assert got[0] == sorted(want)

    learnt = toxicity.fit(docs, labels)
    weight = dict(zip(learnt.features, learnt.weights, strict=True))
    want = [i for i in want if math.fsum(weight.get(f, 0.0) for f in set(toxicity.hashed(rows[i]["text"]).tolist())) + learnt.bias < 0]
    assert got[1] == sorted(want)

    want = sorted(want)
    first = brute_similar_groups([rows[i]["text"] for i in want])
    want = [i for k, i in enumerate(want) if first[k] == k]
    assert got[2] == sorted(want) and len(got[2]) < len(got[1]) < len(got[0]) < len(rows)

    want = mixed([(i, rows[i]["source"], rows[i]["text"]) for i in want])
    assert got[3] == sorted(want) and len(got[3]) > len(set(got[3]))

    library, coded = tik(), {}
    for i in set(want):
        text = rows[i]["text"] or ""
        ids = library.encode_ordinary(text)
        coded[i] = (i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert sorted(tuple(r) for r in result.collect()) == sorted(coded[i] for i in want)
