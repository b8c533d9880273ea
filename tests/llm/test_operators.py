"""Every operator against a brute-force version, on small fixtures with nulls, empty and long texts,
ties, repeated rows and clashing columns, and on the smallest test tables."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bpe, chat, components, licenses, mixing, quality, queries, simhash, token_counts, toxicity, warc
from tests.conftest import SF, same

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "a", "the end", "The the THE the", "x" * 5000, "ab" * 3000, " \n\t  \x0b word\r\n", "naïve café – “quotes” 東京 🎉 \U000323b0\U000323b1 x",
    "1234567 don't we'll I'M <|endoftext|> it's", "\x00\x1c\x85  !", "a b c " * 200, "same line\nsame line\n\nother\nsame line", "aaaa" * 2500 + " tail",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 400))) for _ in range(30)]
    rows = [(k, t, rng.choice(["s1", "s2", None, ""]), -1, "clash") for k, t in enumerate(texts)]
    rows += [rows[20], (None, "no id here", "s1", -1, "clash"), (20, "same id, other text", "s1", -1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, n_tokens string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op3_chat" else 0)


# 1


def test_mix_takes_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped) if len(capped) < len(order) else 0
        over = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * sizes[s] if s in capped else level * weight[s] for s in order}
    for s in order:
        mine = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mix_prefers_quality(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    d = d.unionByName(spark.range(4000, 5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("t").alias("source")))
    r = mixing.mix(d, share=0.5, weights=(1, 9), quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    got = r.filter("source = 's'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    by = {x["odd"]: x["n"] for x in got}
    assert by[0] > 2.5 * by[1] > 0


def test_materialized_mix_keeps_columns(spark, docs):
    clashing = docs.withColumns({c: F.lit("keep me") for c in ("id", "key", "copies", "row", "copy", "place", "__id", "__size_here")})
    out = mixing.materialize(clashing)
    assert out.columns == clashing.columns
    assert {r["id"] for r in out.collect()} == {"keep me"}
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"], r["size"]] = copies.get((r["doc_id"], r["size"]), 0) + r["copies"]
    got = {(r["doc_id"], r["size"]): r["n"] for r in out.withColumn("size", mixing.word_count(F.col("text"))).groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: n for k, n in copies.items() if n}


def test_mix_of_rows_without_ids(spark):
    """Every text draws its own key, and copies of equal rows are dealt out without loss."""
    d = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b "), (F.col("id") % 500).cast("string")).alias("text"), F.lit("s").alias("source"))
    d = d.unionByName(spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x y z").alias("text"), F.lit("t").alias("source")))
    rows = mixing.mix(d, share=0.7, weights=(1, 1)).collect()
    taken = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in "st"}
    assert taken == {s: next(round(r["target"]) for r in rows if r["source"] == s) for s in "st"}
    out = mixing.materialize(d, share=0.7, weights=(1, 1)).collect()
    assert len(out) == sum(r["copies"] for r in rows) and len({r["text"] for r in out if r["source"] == "s"}) > 200


# 2 and 9


def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, docs):
    library = tik()
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN, keep=("doc_id", "text")), PATH, PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert np.frombuffer(bytes(r["ids_le"]), "<u4").tolist() == library.encode_ordinary(text), text[:50]
        assert bytes(r["decoded"]) == text.encode() and r["n_tokens"] * 4 == len(r["ids_le"])
    at_once = bpe.encode(docs, PATH, PATTERN, keep=("doc_id", "text"), decoded=True)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, rows))


def test_merger_handles_ranks_out_of_training_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 300, b"abab": 258, b"aa": 301}
    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    merger = bpe.Merger(ranks)
    rng = random.Random(2)
    for k in range(500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14) if k else 3000))
        if piece not in ranks:
            assert merger.ids(piece) == plain(piece)


def test_small_cache_gives_the_same_ids():
    coder = bpe.ByteBPE(bpe.read_ranks(PATH), PATTERN, cache_entries=4)
    text = " ".join(f"word{k % 7}x{k}" for k in range(200))
    assert coder.encode(text) == tik().encode_ordinary(text)


def test_token_counts_equal_library(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path, keep=("doc_id", "text")).collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024), text[:50]


# 3


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<~|x", "<~~n|", "a\nb<", "<n|", "|>", "", None, "é<|im_start|>user\nhi<|im_end|>\n"]
    rows = [(c, t, r, x, "clash") for c, (t, r, x) in itertools.product([1, 2], [(0, "system", "s"), (1, "user", nasty[0])])]
    rows += [(3, t, r, x, "") for t, (r, x) in enumerate(itertools.product(["user", "assistant", "we\nird<|", None], nasty))]
    rows += [(4, 0, "assistant", "only", ""), (4, 0, "assistant", "only", ""), (None, None, "assistant", "no id", ""), (5, None, "user", "first", ""), (5, 0, "assistant", "then", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(turns)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [m[1:] for m in mine]
        assert list(back[conv]["trained"]) == [m[2] for m in mine if m[1] == "assistant"]
    loose = spark.createDataFrame([(None, 1, "user", "hi", ""), (None, 0, "assistant", "yes", ""), (None, 0, "assistant", "yes", "")], turns.schema)
    alone = sorted(([tuple(t) for t in r["turns"]], list(r["trained"])) for r in chat.read_back(chat.examples(loose)).collect())
    assert alone == [([("assistant", "yes")], ["yes"])] * 2 + [([("user", "hi")], [])]
    texts = [r for r in made.collect() if r["conv_id"] == 3]
    assert len(texts) == len(nasty) + 1 and sum(r["loss_start"] is None for r in texts) == 1


def test_chat_long_conversation(spark):
    turns = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.col("id").cast("string"), F.lit(40)).alias("text"))
    back = chat.read_back(chat.examples(turns.repartition(3))).first()
    assert [t["text"] for t in back["turns"]] == [str(k) * 40 for k in range(300)] and list(back["trained"]) == [str(k) * 40 for k in range(1, 300, 2)]


# 4


def test_license_rules(spark):
    mit = "MIT License\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file'
    rows = [(1, mit, ""), (2, "Text.\nReleased under the MIT License.", ""), (3, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", ""), (4, None, ""), (5, apache, ""), (6, "All rights reserved. " * 3000, "")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert [got[k]["licenses"] for k in range(1, 7)] == ["MIT", "MIT", "Apache-2.0,CC-BY-NC-4.0", "", "Apache-2.0", "Proprietary"]
    assert got[1]["sentence_ids"] == "mit-title,mit-notice" and got[6]["n_known"] == 3000 and got[4]["n_sentences"] == 0


MIT = """MIT License

Copyright (c) 2020 A. N. Author

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
APACHE = """Copyright 2020 A. N. Author

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
BSD = """Copyright 2020 A. N. Author

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD + """

3. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
CC = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
NOTICES = [
    (MIT, "MIT", "mit-title,mit-grant,mit-notice"), (APACHE, "Apache-2.0", "apache-head,apache-use,apache-copy,apache-dist,apache-see"),
    (GPL, "GPL-3.0-or-later", "GPL-3.0-later,gnu-hope,GPL-copy"), (GPL.replace("software:", "software;"), "GPL-3.0-or-later", "GPL-3.0-later,gnu-hope,GPL-copy"),
    (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later", "GPL-2.0-later,gnu-hope,GPL-copy"),
    (GPL.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1").replace("program", "library"), "LGPL-2.1-or-later", "LGPL-2.1-later,gnu-hope,LGPL-copy"),
    (GPL.replace("GNU", "GNU Affero"), "AGPL-3.0-or-later", "AGPL-3.0-later,gnu-hope,AGPL-copy"),
    (BSD, "BSD-2-Clause", "bsd-grant,bsd-source,bsd-binary"), (BSD3, "BSD-3-Clause", "bsd-grant,bsd-source,bsd-binary,bsd-endorse,bsd-as-is"),
    (BSD3.replace("the Example Project", "<organization>"), "BSD-3-Clause", "bsd-grant,bsd-source,bsd-binary,bsd-endorse,bsd-as-is"),
    (MPL, "MPL-2.0", "mpl-head,mpl-obtain"), (ISC, "ISC", "isc-grant,isc-as-is"), (UNLICENSE, "Unlicense", "unlicense-free,unlicense-anyone"), (CC, "CC-BY-SA-4.0", "ref-CC-BY-SA-4.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later", "spdx-GPL-2.0-or-later"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause", "spdx-BSD-3-Clause"),
]


@pytest.mark.parametrize("width", [None, 40, 72])
@pytest.mark.parametrize("prefix", ["", " * ", "# "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_full_license_notices(spark, width, prefix, end):
    wrap = lambda t: end.join(prefix + line for part in t.split("\n") for line in (textwrap.wrap(part, width) if width else [part]) or [""])
    rows = [(k, f"Some words{end}{wrap(t)}{end}more words") for k, (t, _, _) in enumerate(NOTICES)]
    rows.append((99, "This work is licensed. Under the MIT license. Released under\nthe MIT license of. All\nrights! Reserved"))
    got = {r["doc_id"]: (r["licenses"], r["sentence_ids"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (name, ids) for k, (_, name, ids) in enumerate(NOTICES)} | {99: ("", "")}


def brute_sentences(text, known):
    """Identifiers of known sentences: the longest run of whole pieces without a full stop inside, from
    left to right, by comparing lists of words."""
    table = {tuple(s.split()): i for i, s in known}
    pieces, closed = [], True  # (words, whether a full stop is before them)
    for part in re.split(r"([.;:!?]+(?=[ \t\n\r]|\Z)|[\n\r]+)", (text or "").lower()):
        if re.fullmatch(r"[.;:!?]+|[\n\r]+", part):
            closed |= bool(re.search("[.!?]", part))
        elif found := re.findall("[a-z0-9]+", part):
            pieces.append((found, closed))
            closed = False
    out, k = [], 0
    while k < len(pieces):
        run, best = [], None
        for j in range(k, len(pieces)):
            if j > k and pieces[j][1]:
                break
            run = run + pieces[j][0]
            if tuple(run) in table:
                best = (j, table[tuple(run)])
        if best:
            out.append(best[1])
        k = best[0] + 1 if best else k + 1
    return out


def test_license_sentences_equal_brute_force(spark):
    rng = random.Random(9)
    known = licenses.known_sentences()
    parts = [s for _, s in known[:: len(known) // 60]] + [s.capitalize() for _, s in licenses.SENTENCES] + ["some other words", "copyright 2020", "x"]
    rows = []
    for k in range(150):
        text = "".join(rng.choice(parts) + rng.choice([". ", "\n", "; ", " ", ": ", "\n\n", "!\r\n", ".\n * "]) for _ in range(rng.randint(1, 12)))
        rows.append((k, " ".join(w if rng.random() > 0.05 else w + "\n" for w in text.split(" "))))
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: ",".join(brute_sentences(t, known)) for k, t in rows}


# 5


def test_toxicity_learns_only_its_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = labels.filter(toxicity.held_out(F.col("doc_id")))
    rows = toxicity.score(docs.join(held.select("doc_id", "toxic"), "doc_id"), model).select("toxic", "toxicity").collect()
    hit = sum(r["toxicity"] >= 0.5 for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["toxicity"] >= 0.5 for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    assert hit >= 0.85 and wrong <= 0.01, (hit, wrong)
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, changed) == model


def test_toxicity_odd_texts_and_labels(spark, docs):
    assert {r["h"] for r in spark.range(300).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h")).filter("h").select(F.col("id").alias("h")).collect()} == {k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0}
    one_class = spark.createDataFrame([(k, 0) for k in range(5)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, one_class)).collect()
    assert len(scored) == docs.count() and all(0 <= r["toxicity"] < 0.5 for r in scored)


def test_toxicity_ratios_and_scores_equal_brute_force(spark):
    """Features, ratios and scores against plain Python; only the coefficients are the fit's own."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}

    def brute(text):
        spaced, found = f" {' '.join(text.lower().split())} ", set()
        for n in (3, 4, 5, 6):
            for k in range(len(spaced) - n + 1):
                h = 0
                for c in spaced[k : k + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                found.add((((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) % 2**64) >> 44)
        return found

    for text in list(texts.values())[:25]:
        assert brute(text[:2000]) == set(toxicity.hashed(text[:2000]).tolist())
    p, q = {}, {}
    for i, y in toxic.items():
        for f in set(toxicity.hashed(texts[i]).tolist()):
            held = p if y else q
            held[f] = held.get(f, 0) + 1
    n1, n0 = sum(toxic.values()), sum(1 - y for y in toxic.values())
    counts = spark.createDataFrame([(f, p.get(f, 0), q.get(f, 0)) for f in sorted(p.keys() | q.keys())][::97], "feature long, p long, q long")
    for r in toxicity.ratios(counts, n1, n0).collect():
        a, b = p.get(r["feature"], 0) + 1, q.get(r["feature"], 0) + 1
        raw, spread = math.log(a / (n1 + 2)) - math.log(b / (n0 + 2)), math.sqrt(1 / a - 1 / (n1 + 2) + 1 / b - 1 / (n0 + 2))
        assert r["ratio"] == pytest.approx(math.copysign(max(0.0, abs(raw) - 2 * spread), raw), abs=1e-9)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features, model.weights, strict=True))
    for r in queries.op5_toxicity(spark, "/root/testdata/sf0.01").collect():
        z = sum(weight.get(f, 0.0) for f in set(toxicity.hashed(texts[r["doc_id"]]).tolist())) + model.bias
        want = 1 / (1 + math.exp(-max(-35, min(35, z))))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_long_text_in_blocks(monkeypatch):
    text = " ".join(f"word{k % 700} Émile" for k in range(9000))
    whole = set(toxicity.hashed(text).tolist())
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    assert set(toxicity.hashed(text).tolist()) == whole
    for short in ("", "a", "ab", "x" * 1003, "x" * 996):
        assert set(toxicity.hashed(short).tolist()) == {f for f in (lambda b: (monkeypatch.setattr(toxicity, "BLOCK", 1 << 18), toxicity.hashed(short).tolist(), monkeypatch.setattr(toxicity, "BLOCK", b))[1])(1000)}


def test_logistic_in_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    slots = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).astype("<u2").tobytes() for _ in range(300)]
    toxic, scale = [int(s[:2] < b"\x14\x00") for s in slots], rng.normal(size=40).tolist()
    w, b = toxicity._logistic(slots, toxic, scale)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    w2, b2 = toxicity._logistic(slots, toxic, scale)
    assert np.allclose(w, w2, atol=1e-9) and abs(b - b2) < 1e-9


# 6


def test_warc_archive(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "u1", big, "c"), (5, "u5", big, "c"), (3, None, big, "c"), (7, "a\r\nb", "small", "c"), (8, "u", "small", "c"), (9, "u", None, "c"), (None, "u", big, "c"), (5, "again", big, "c"), (10, "é", "é" * 600, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string")
    folder = str(tmp_path / "archive")
    warc.write(pages, folder)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] in (1, 3, None):
            assert (r["record_type"], r["refers_to"]) == ("revisit", 5)
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
    by = {r["page_id"]: r for r in got}
    assert by[10]["payload_bytes"] == 1200 and by[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and by[9]["payload_bytes"] == 0
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    for r in warc.records(spark, folder).collect():
        raw = bytes(r["record"])
        head, _, block = raw.partition(b"\r\n\r\n")
        assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(block) - 4 and raw.endswith(b"\r\n\r\n")


def test_warc_detects_damage(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(spark.createDataFrame([(1, "u", "x" * 1500)], "page_id long, url string, html string"), folder)
    spark.createDataFrame([(hashlib.sha256(b"x" * 1500).hexdigest(), b"y" * 1500)], "sha256 string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="doesn't match"):
        warc.read(spark, folder).collect()


def test_warc_loses_no_record_silently(spark, tmp_path):
    folder = str(tmp_path / "a")
    rows = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (3, "v", "y" * 1500), (4, "w", "small"), (4, "w", "small"), (None, "w", "small")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    records = [bytes(r["record"]) for r in warc.records(spark, folder).collect()]
    ids = [re.search(rb"\r\nWARC-Record-ID: (<[^>]*>)\r\n", r)[1] for r in records]
    assert len(set(ids)) == len(rows)
    referred = re.search(rb"\r\nWARC-Refers-To: (<[^>]*>)\r\n", next(r for r in records if b"revisit" in r))[1]
    assert referred in ids and b":2:" in referred
    whole = spark.read.parquet(f"{folder}/payloads").collect()
    for lost in ("x" * 1500, "small"):
        spark.createDataFrame([r for r in whole if bytes(r["payload"]) != lost.encode()], "sha256 string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
        with pytest.raises(Exception, match="has no payload"):
            warc.read(spark, folder).collect()
        with pytest.raises(Exception, match="has no payload"):
            warc.records(spark, folder).collect()


def test_warc_often_used_small_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "OFTEN", 5)
    folder = str(tmp_path / "a")
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "short").otherwise(F.col("id").cast("string")).alias("html"))
    warc.write(pages, folder)
    got = {r["page_id"]: r for r in warc.read(spark, folder).collect()}
    for r in pages.collect():
        assert (got[r["page_id"]]["record_type"], got[r["page_id"]]["payload_digest"]) == ("response", hashlib.sha1(r["html"].encode()).hexdigest())


# 7


def nearest(rows, q, k=10):
    valid = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for i, v in valid)[: k + 1]


def test_ann_small_is_exact_and_skips_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(60)]
    rows += [(100, None), (200, [0.0] * 8), (300, [float("nan")] * 8), (301, [float("inf")] + [1.0] * 7), (302, [None] + [1.0] * 7), (400, [1.0]), (None, [1.0] * 8)] + [(500 + k, rows[0][1]) for k in range(20)] + [rows[3]]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, score string")
    got = ann.search(df, F.col("vec_id") % 50 == 0, share=1.0).collect()
    unique = list({i: v for i, v in rows if i is not None}.items())
    for q in (0, 50, 500):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = [(d, i) for d, i in nearest(unique, np.array(dict(unique)[q]), 11) if i != q][:10]
        assert [(d, i) for _, i, d in mine] == want and [m[0] for m in mine] == list(range(1, 11))
    assert {r["query_id"] for r in got} == {0, 50, 500, 550} & {i for i, _ in unique} | {0, 50, 500}


@pytest.mark.parametrize("block", [ann.BLOCK, 40])
def test_ann_repeated_ids_take_one_place(spark, block):
    """Each row twice, near rows 20 times, and an id with 300 different vectors: all as if it had
    been there once."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(1500)]
    at = np.array(rows[0][1])
    near = sorted(range(1, 1500), key=lambda k: ((np.array(rows[k][1]) - at) ** 2).sum())[:3]
    many = [(2000, (at + 0.01 * rng.normal(size=8)).tolist()) for _ in range(300)]
    rows += many
    df = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    found = lambda r: sorted(tuple(x) for x in ann.search(df(r), F.col("vec_id") % 100 == 0, block=block).filter("query_id < 2000").collect())
    once = found(rows)
    assert found(rows * 2 + [rows[k] for k in [0, *near] for _ in range(20)]) == once
    by_query = {}
    for q, rank, v, score in once:
        by_query.setdefault(q, []).append((rank, v, score))
    assert len(by_query) == 15 and all([r for r, _, _ in sorted(x)] == list(range(1, 11)) for x in by_query.values())
    assert {v for _, v, _ in by_query[0]} >= {2000, *near}
    assert min(by_query[0])[1:] == (2000, min(float(np.sqrt(((np.array(v) - at) ** 2).sum())) for _, v in many))


@pytest.mark.parametrize("block", [32_768, 100])
def test_ann_recall(spark, block):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, matrix = np.array(list(x)), np.stack(list(x.values()))
    hits = []
    for q in (i for i in x if i % 100 == 0):
        d = np.sqrt(((matrix - x[q]) ** 2).sum(axis=1))
        want = [i for _, i in sorted(zip(d.tolist(), ids.tolist(), strict=True)) if i != q][:10]
        assert len(got[q]) == 10
        hits.append(len({i for _, i, _ in got[q]} & set(want)) / 10)
        assert all(s == d[list(ids).index(i)] for _, i, s in got[q])
    assert np.mean(hits) >= 0.9


def rows_scored(x, share=ann.SHARE):
    """Share of all rows that a query's visited leaves hold, in one tree or more, and evaluations of a
    distance by rows: both 1 for brute force."""
    rng = np.random.default_rng(7)
    forest = [ann.build_tree(x[rng.permutation(len(x))[: ann.SAMPLE]], rng, ann.depth_for(len(x))) for _ in range(ann.TREES)]
    leaves = [ann.leaves_of(t, x) for t in forest]
    sizes = [dict(enumerate(np.bincount(leaf, minlength=t.leaves).tolist())) for leaf, t in zip(leaves, forest, strict=True)]
    union, all_ = [], []
    for q in x[::100]:
        seen = ann.visits(forest, q, math.ceil(share * sum(t.leaves for t in forest)), sizes, 11)
        held = np.array([np.isin(leaves[k], [leaf for t, leaf in seen if t == k]) for k in range(len(forest))])
        union.append(held.any(axis=0).mean())
        all_.append(held.sum() / len(x))
    return float(np.mean(union)), float(np.mean(all_))


@pytest.mark.parametrize("held", [ann.HELD, 50, 3000])
def test_ann_answers_are_one_a_task(spark, monkeypatch, held):
    monkeypatch.setattr(ann, "HELD", held)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, share=1.0)
    found: dict = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 3000, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        assert [v for _, v in sorted(found[q])] == np.argsort(far)[:10].tolist()
    todo, made = [got._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "MapInArrowExec" and "score" in node.output().toString():
            made.append(node.metrics().apply("pythonNumRowsReceived").value())
        children = node.children()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [children.apply(k) for k in range(children.size())]
    assert len(made) == 1 and (held != ann.HELD or made[0] <= 30 * ann.TASKS * ann.K)


def test_ann_rows_scored():
    """What the README states: little is pruned among vectors without structure."""
    x = np.random.default_rng(1).normal(size=(4000, 64))
    some, evaluations = rows_scored(x / np.linalg.norm(x, axis=1)[:, None])
    assert 0.55 < some < 0.75 and 0.9 < evaluations < 1.15


# 8


def test_quality_counts(spark, docs):
    model = quality.fit(docs, spark.createDataFrame([(25, 1), (26, 1), (27, 0)], "doc_id long, quality int"))
    assert len(model) == quality.BUCKETS
    rows = quality.measure(docs, model).select("text", "quality.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        marked = [False] * len(w)
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                marked[i : i + 3] = [True] * 3
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(marked))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text[:60]
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(marked) > 50 * len(w))
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
        buckets = [h % quality.BUCKETS for h in signed] + [spark_pair(a, b) % quality.BUCKETS for a, b in itertools.pairwise(signed)]
        score = sum(model[b] for b in buckets) / len(buckets) if buckets else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_quality_fit_equals_brute_force(spark, docs):
    labels = spark.createDataFrame([(25, 1), (26, 1), (27, 0), (20, 1), (None, 1)], "doc_id long, quality int")
    model, counts = quality.fit(docs, labels, buckets=64), {False: [0] * 64, True: [0] * 64}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
        for b in [h % 64 for h in signed] + [spark_pair(a, b) % 64 for a, b in itertools.pairwise(signed)]:
            counts[False][b] += 1
            counts[True][b] += r["doc_id"] in (20, 25, 26)
    raw, target = sum(counts[False]), sum(counts[True])
    for b, got in enumerate(model):
        p = counts[False][b] / raw
        want = math.log((counts[True][b] + 0.1 * target * p) / (1.1 * target) / p) if p else 0.0
        assert got == pytest.approx(want, abs=1e-9)


def test_quality_leaves_columns_alone(spark, docs):
    names = ("__w", "__h", "__g", "__lines", "__repeat", "__score", "row", "words", "hashes", "grams", "lines", "repeat", "score", "kept")
    clashing = docs.withColumns({n: F.lit("keep me") for n in names}).withColumn("quality", F.lit("replaced"))
    out = quality.measure(clashing, [0.0] * 8)
    assert set(out.columns) == set(clashing.columns) and out.filter(F.greatest(*names) != "keep me").count() == 0
    assert out.select("quality.n_words", *docs.columns).count() == docs.count()


def spark_pair(a, b):
    """xxhash64(a, b) of two longs: each hashed with the hash so far as its seed."""
    seed = 42
    for x in (a, b):
        seed = xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def test_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.measure(docs, model).select("doc_id", F.col("quality").alias("m")).join(labels, "doc_id").filter("not m.base_failed")
    kept = {r["quality"]: r["share"] for r in got.groupBy("quality").agg(F.avg(F.col("m.kept").cast("double")).alias("share")).collect()}
    assert kept[1] >= 0.995 and kept[0] <= 0.1, kept


# 10


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}
    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 3:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {f: root(f) for f in parent}


def test_fingerprints(docs):
    for r in docs.collect():
        assert simhash.fingerprint(r["text"]) == brute_fingerprint(r["text"])


def test_simhash_groups(spark, docs):
    rows = simhash.groups(docs).collect()
    fp = {i: brute_fingerprint(t) for i, t in enumerate(r["text"] for r in docs.collect())}
    ids = [r["doc_id"] for r in docs.collect()]
    roots = brute_components(set(fp.values()))
    least = {}
    for i, f in fp.items():
        if ids[i] is not None:
            least[roots[f]] = min(least.get(roots[f], 10**9), ids[i])
    want = sorted((str(ids[i]), f, str(least.get(roots[f]))) for i, f in fp.items())
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in rows) == want


def test_links_find_every_component(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(150):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randint(0, 8)):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << bit
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(40), 2)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(frame).collect()
    assert all(((e["a"] ^ e["b"]) & (2**64 - 1)).bit_count() <= 3 for e in edges) and len(edges) < 12 * len(fps)
    roots = brute_components(fps)
    got = {r["node"] & (2**64 - 1): r["root"] for r in components.components(simhash.links(frame)).collect()}
    groups, mine = {}, {}
    for f in fps:
        groups.setdefault(roots[f], set()).add(f)
        mine.setdefault(got.get(f, f"alone {f}"), set()).add(f)
    # the root itself isn't listed: it hangs on itself
    for r in set(got.values()):
        own = r & (2**64 - 1)
        mine.pop(f"alone {own}", None)
        mine[r].add(own)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.components(edges).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_representatives_keep_one_row_a_group(spark, docs):
    out = simhash.representatives(docs)
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    want = {r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_similarity(a, b):
    sets = []
    for w in (words_of(a), words_of(b)):
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else 1.0


def brute_similar_groups(texts):
    """Place of the first text of each text's group: similar, and 7 bits or less apart in one of the
    operator's two fingerprints."""
    words = simhash.Words()
    prints = [simhash.pair_fingerprints(words(t)) for t in texts]
    parent = list(range(len(texts)))
    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i, j in itertools.combinations(range(len(texts)), 2):
        if min((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= 7 and brute_similarity(texts[i], texts[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(k) for k in range(len(texts))]


def near_copies(rng, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def family_texts():
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(3000)]
    texts = []
    for size, n, edits in ((300, 40, 5), (300, 40, 7), (60, 20, 1), (2000, 6, 30), (100, 1, 0)):
        first = " ".join(rng.choices(vocabulary, k=size))
        texts += [first, *near_copies(rng, first, n, edits), first.upper()]
    return texts + [None, "", " \n", "one two", "One  two", "one two three"]


def test_pair_fingerprints_are_majorities(docs):
    for text in [r["text"] for r in docs.collect()][:30]:
        h = simhash.Words()(text)
        runs = [h[k : k + 2] for k in range(max(1, len(h) - 1))] if len(h) else []
        for seed, got in zip((1, 2), simhash.pair_fingerprints(h), strict=True):
            hashes = [int(simhash.shingle_hashes(r, 2, seed)[0]) for r in runs]
            assert got == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


@pytest.mark.parametrize("block", [4096, 8])
def test_similar_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    texts = family_texts()
    frame = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(texts)], "doc_id long, text string, digest string, fp long, family string")
    want = brute_similar_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame).collect()}
    assert [got[k] for k in range(len(texts))] == want
    kept = simhash.representatives(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.representatives(frame.limit(0)).count() == 0
    close = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if brute_similarity(texts[i], texts[j]) >= 0.8]
    # the fingerprints are a filter: on check_s one of the two is 7 bits or less apart in 98 % of such pairs
    assert sum(want[i] == want[j] for i, j in close) >= 0.97 * len(close)


# what the queries return


def test_bpe_and_counts_of_the_queries(spark):
    from tokenizers import Tokenizer

    library, counter = tik(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: library.encode_ordinary(t) for i, t in texts.items()}
    want = {i: (len(v), hashlib.sha256(np.array(v, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, v in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op2_bpe(spark, SF).collect()} == want
    sizes = {i: len(counter.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op9_token_counts(spark, SF).collect()}
    assert got == {i: (len(texts[i].encode()), n, n > 1024) for i, n in sizes.items()}


def test_simhash_of_the_query(spark):
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    roots, least = brute_components(set(fp.values())), {}
    for i, f in fp.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", least[roots[f]]) for i, f in fp.items()}


def test_ann_of_the_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]}
    got = queries.op7_ann(spark, SF).collect()
    assert {r["query_id"] for r in got} == {i for i in rows if i % 100 == 0}
    for q in {r["query_id"] for r in got}:
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, min(10, len(rows) - 1) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        assert all(s == float(np.sqrt(((rows[v] - rows[q]) ** 2).sum())) and v != q for _, s, v in mine)


def test_bpe_very_long_pre_token():
    """Letters without a break, one pre-token: against the library as far as it goes, and a million."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    coder, text = bpe.ByteBPE(bpe.read_ranks(PATH), PATTERN), letters(30_000)
    assert coder.encode(text) == tik().encode_ordinary(text)
    text = letters(1_000_000)
    ids = coder.encode(text)
    assert coder.decode(ids) == text.encode() and len(ids) < 600_000
