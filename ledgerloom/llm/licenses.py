"""License scans by sentence rules (built-in functions only).

A text's sentences are normalised and mapped to the identifiers of known licence sentences. Pieces
end at line ends and at . ; : ! ? before white space; a known sentence is a run of whole pieces with
no full stop between them, so wrapped notices, comment marks and ';' or ':' inside are the same
sentence. The sequence of identifiers (unknown sentences left out) is matched against ordered rules,
the most specific first. A rule consumes the identifiers that it matches, so the full text of a
licence is not reported again by a rule for one of its sentences.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and sentence of public licences and notices, normalised as marked() does.
SENTENCES = (
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-title", "the mit license mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-title", "apache license"),
    ("apache-title", "apache license version 2 0 january 2004"),
    ("apache-head", "licensed under the apache license version 2 0 the license"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("apache-dist", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mpl-head", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl-obtain", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-obtain", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib-origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost-grant", "distributed under the boost software license version 1 0"),
    ("reserved", "all rights reserved"),
)
#: SPDX identifier, and how a reference names the licence.
NAMES = (
    ("MIT", ("the mit license", "mit license", "the mit licence", "the expat license")),
    ("Apache-2.0", ("the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license", "apache license 2 0", "apache 2 0")),
    ("GPL-2.0-only", ("the gnu general public license version 2", "the gnu gpl version 2", "the gplv2")),
    ("GPL-3.0-only", ("the gnu general public license version 3", "the gnu gpl version 3", "the gnu general public license v3 0", "the gplv3")),
    ("LGPL-2.1-only", ("the gnu lesser general public license version 2 1", "the gnu lgpl version 2 1")),
    ("LGPL-3.0-only", ("the gnu lesser general public license version 3", "the gnu lgpl version 3")),
    ("AGPL-3.0-only", ("the gnu affero general public license version 3", "the gnu agpl version 3")),
    ("BSD-2-Clause", ("the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license")),
    ("BSD-3-Clause", ("the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license")),
    ("MPL-2.0", ("the mozilla public license version 2 0", "the mozilla public license 2 0")),
    ("ISC", ("the isc license",)),
    ("Unlicense", ("the unlicense",)),
    ("Zlib", ("the zlib license",)),
    ("BSL-1.0", ("the boost software license version 1 0",)),
    ("CC0-1.0", ("cc0 1 0", "the cc0 1 0 universal license")),
)
SUBJECTS = ("", "this work is ", "this software is ", "this project is ", "this program is ", "this code is ", "this file is ", "this library is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ")
#: Names of the GNU licences, and their versions by SPDX name.
GNU = (("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2 1", "3")), ("AGPL", "gnu affero general public license", ("3",)))
#: The terms of Creative Commons licences, and their full names.
TERMS = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))


def _spoken(spdx: str) -> str:
    return spdx.lower().replace("-", " ").replace(".", " ")


def _references() -> list[tuple[str, str, str]]:
    """(licence, identifier, sentence) of one-line references: by name, by Creative Commons terms, by
    SPDX line."""
    out = [(spdx, f"ref-{spdx}", f"{subject}{verb}{name}") for spdx, names in NAMES for name in names for subject in SUBJECTS for verb in VERBS]
    for terms, full in TERMS:
        for version in ("3.0", "4.0"):
            spdx, v = f"CC-{terms.upper()}-{version}", version.replace(".", " ")
            port = "international" if version == "4.0" else "unported"
            names = [f"cc {_spoken(terms)} {v}", f"a creative commons {full} {v} license", f"a creative commons {full} {v} {port} license", f"the creative commons {full} {v} {port} license"]
            out += [(spdx, f"ref-{spdx}", f"{subject}{verb}{name}") for name in names for subject in SUBJECTS for verb in VERBS]
    every = dict.fromkeys([spdx for spdx, _, _ in out] + [f"{k}-{v.replace(' ', '.')}{'' if '.' in v or ' ' in v else '.0'}-or-later" for k, _, vs in GNU for v in vs])
    return out + [(spdx, f"spdx-{spdx}", f"spdx license identifier {_spoken(spdx)}") for spdx in every]


def _gnu() -> list[tuple[str, tuple[str, ...], list[tuple[str, str]]]]:
    """(licence, the identifiers of its notice, (identifier, sentence)...) of the GNU notices."""
    out = []
    for kind, full, versions in GNU:
        for v in versions:
            spdx = f"{kind}-{v.replace(' ', '.')}{'' if ' ' in v else '.0'}"
            for noun in ("program", "library", "software", "file"):
                free = f"this {noun} is free software you can redistribute it and or modify it under the terms of the {full}"
                later, only, hope, copy = f"{spdx}-later", f"{spdx}-only", f"{kind}-hope", f"{kind}-copy"
                known = [
                    (later, f"{free} as published by the free software foundation either version {v} of the license or at your option any later version"),
                    (only, f"{free} as published by the free software foundation version {v} of the license"),
                    (only, f"{free} version {v} as published by the free software foundation"),
                    (hope, f"this {noun} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
                    (copy, f"you should have received a copy of the {full} along with this {noun}"),
                ]
                out.append((f"{spdx}-or-later", (later, hope, copy), known))
                out.append((f"{spdx}-only", (only, hope, copy), known))
    return out


def known_sentences() -> tuple[tuple[str, str], ...]:
    """(identifier, sentence), each sentence once."""
    every = [*SENTENCES, *[(i, s) for _, i, s in _references()], *[x for _, _, known in _gnu() for x in known]]
    # "hope" is the same sentence in all GNU notices
    one = {s: ("gnu-hope" if i.endswith("-hope") else i) for i, s in reversed(every)}
    return tuple((i, s) for s, i in sorted(one.items()))


def ordered_rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(licence, sequence of identifiers) in the order in which rules are tried."""
    rules = [
        ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
        ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
        ("MIT", ("mit-grant", "mit-notice")),
        ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
        ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
        ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
        ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
        ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
        ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
        ("Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-dist", "apache-see")),
        ("Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-dist")),
        ("Apache-2.0", ("ref-Apache-2.0", "apache-use", "apache-copy", "apache-dist")),
        ("Apache-2.0", ("apache-head", "apache-use")),
        ("Apache-2.0", ("ref-Apache-2.0", "apache-use")),
    ]
    for spdx, (grant, hope, copy), _ in _gnu():
        rules += [(spdx, (grant, "gnu-hope", copy)), (spdx, (grant, "gnu-hope"))]
    rules += [(spdx, (sequence[0],)) for spdx, sequence, _ in _gnu()]
    rules += [
        ("MPL-2.0", ("mpl-head", "mpl-obtain")), ("MPL-2.0", ("mpl-obtain",)), ("MPL-2.0", ("mpl-head",)),
        ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant", "isc-as-is")), ("0BSD", ("0bsd-grant",)),
        ("Unlicense", ("unlicense-free", "unlicense-anyone")), ("Unlicense", ("unlicense-free",)),
        ("Zlib", ("zlib-grant", "zlib-origin")), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("boost-grant",)),
        ("Apache-2.0", ("apache-head",)), ("MIT", ("mit-title", "mit-notice")), ("MIT", ("mit-notice",)), ("MIT", ("mit-grant",)),
    ]
    rules += [(spdx, (ident,)) for spdx, ident, _ in _references()]
    rules.append(("Proprietary", ("reserved",)))
    return tuple(dict.fromkeys(rules))


#: Maps in the table of sentences; a power of two.
TABLE = 1024
#: A full stop before white space or the text's end; no known sentence runs over it. Regular
#: expressions are those that Java and RE2 read alike.
FULL_STOP = r"[.;:!?]*[.!?][.;:!?]*(?:[ \t\n\r]+|\z)"
#: Other ends of a piece.
SOFT_END = r"[\n\r]+|[;:]+(?:[ \t\n\r]+|\z)"
#: The clause that names a holder: the name is replaced by x.
HOLDER, HELD = r"neither[ <>]+the[ <>]+name[ <>]+of[ <>]+(?:[a-z0-9]+[ <>]+){1,12}nor[ <>]+the[ <>]+names[ <>]+of[ <>]+(?:its|their)[ <>]+contributors", "neither the name of x nor the names of its contributors"


def marked(text: Column) -> Column:
    """Lower-case a-z and digits, everything else a single space; a piece in < >, with . between
    pieces that a full stop divides."""
    ends = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), FULL_STOP, "H"), SOFT_END, "S")
    bare = F.regexp_replace(ends, "[^a-z0-9HS]+", " ")
    return F.concat(F.lit("<"), F.replace(F.replace(bare, F.lit("S"), F.lit("><")), F.lit("H"), F.lit(">.<")), F.lit(">"))


def sentence_pattern(known) -> str:
    """A regular expression for the sentences, as a tree of their words: at a piece's start, each word
    is tried once, and longer sentences before shorter ones."""
    tree: dict = {}
    for _, sentence in known:
        at = tree
        for word in sentence.split():
            at = at.setdefault(word, {})
        at[""] = {}

    def joined(at: dict) -> str:
        """The tree below a word, with the separator before each next word."""
        words = sorted((w for w in at if w), reverse=True)
        options = ["[ <>]+" + w + joined(at[w]) for w in words]
        if "" in at:
            options.append("")
        return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

    roots = "|".join(w + joined(tree[w]) for w in sorted(tree, reverse=True))
    return f"< ?({roots}) ?>"


def _hash_table(known) -> str:
    """The map of sentences to identifiers as JSON: TABLE maps, by the sentence's hash, so that a
    look-up costs the same for any number of sentences."""
    from xxhash import xxh64_intdigest

    table: list[dict] = [{} for _ in range(TABLE)]
    for ident, sentence in known:
        table[xxh64_intdigest(sentence.encode(), 42) % TABLE][sentence] = ident  # a power of two: sign doesn't matter
    return json.dumps(table)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known=None, rules=None) -> DataFrame:
    """One row a document: id, n_sentences long (pieces between sentence ends), n_known long,
    sentence_ids string (identifiers in the text's order, comma-separated), licenses string (of the
    rules that match, each once, in the order of the rules; "" if none).

    Null and empty texts: no sentence, no licence. Very long texts are scanned whole, in one pass.
    Repeated rows are scanned alike; other columns of docs, whatever their names, are not read; an
    empty table gives an empty result.
    """
    known, rules = known or known_sentences(), rules or ordered_rules()
    named = lambda s: F.try_element_at(F.get(F.from_json(F.lit(_hash_table(known)), "array<map<string,string>>"), F.pmod(F.xxhash64(s), F.lit(TABLE)).cast("int")), s)
    pattern = F.lit(sentence_pattern(known))
    text = F.regexp_replace(marked(F.col(text_col)), HOLDER, HELD)
    found = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    listed = found.select(
        "id", F.regexp_count("text", F.lit("< ?[a-z0-9]")).cast("long").alias("n_sentences"),
        F.transform(F.regexp_extract_all("text", pattern, F.lit(1)), lambda s: named(F.regexp_replace(s, "[ <>]+", " "))).alias("ids"),
    )
    tried = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{ident}," for ident in sequence)).alias("ids")) for name, sequence in rules])
    start = F.struct(F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("hits"))

    def step(acc: Column, rule: Column) -> Column:
        taken = F.struct(F.replace(acc["left"], rule["ids"], F.lit(",#,")).alias("left"), F.array_append(acc["hits"], rule["name"]).alias("hits"))
        return F.when(F.contains(acc["left"], rule["ids"]), taken).otherwise(acc)

    hits = F.when(F.size("ids") > 0, F.array_join(F.array_distinct(F.aggregate(tried, start, step, lambda acc: acc["hits"])), ",")).otherwise(F.lit(""))
    return listed.select(F.col("id").alias(id_col), "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), hits.alias("licenses"))


def oracle_sql(known=None, rules=None) -> str:
    """scan() of documents in DuckDB's SQL: sentences by a join with the table of known ones, rules by
    a chain of replacements."""
    known, rules = known or known_sentences(), rules or ordered_rules()
    sentences = ", ".join(f"('{s}', '{i}')" for i, s in known)
    steps, last = [], "l0"
    for k, (_, sequence) in enumerate(rules):
        pattern = "".join(f",{ident}," for ident in sequence)
        steps.append(f"l{k + 1} AS (SELECT * EXCLUDE (lft, hits), replace(lft, '{pattern}', ',#,') AS lft, CASE WHEN contains(lft, '{pattern}') THEN hits || ['{rules[k][0]}'] ELSE hits END AS hits FROM {last})")
        last = f"l{k + 1}"
    return f"""
WITH known(sentence, ident) AS (VALUES {sentences}),
t AS (SELECT doc_id, row_number() OVER () AS n, regexp_replace('<' || replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{FULL_STOP}', 'H', 'g'), '{SOFT_END}', 'S', 'g'), '[^a-z0-9HS]+', ' ', 'g'), 'S', '><'), 'H', '>.<') || '>', '{HOLDER}', '{HELD}', 'g') AS text FROM documents),
m AS (SELECT n, doc_id, unnest(regexp_extract_all(text, '{sentence_pattern(known)}', 1)) AS s, generate_subscripts(regexp_extract_all(text, '{sentence_pattern(known)}', 1), 1) AS k FROM t),
i AS (SELECT n, list(ident ORDER BY k) AS ids FROM m JOIN known ON sentence = regexp_replace(s, '[ <>]+', ' ', 'g') GROUP BY n),
l0 AS (SELECT i.n, ids, ',' || array_to_string(ids, ',,') || ',' AS lft, CAST([] AS VARCHAR[]) AS hits FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(regexp_extract_all(text, '< ?[a-z0-9]')) AS BIGINT) AS n_sentences, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce((SELECT string_agg(h, ',' ORDER BY k) FROM (SELECT h, min(k) AS k FROM (SELECT unnest(hits) AS h, generate_subscripts(hits, 1) AS k) GROUP BY h)), '') AS licenses
FROM t LEFT JOIN {last} USING (n)"""
