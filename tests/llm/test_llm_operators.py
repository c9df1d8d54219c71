"""Small brute-force checks of every training-data operator, and its edge cases."""

import base64
import collections
import random
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratalog.llm import (bin_packing, byte_bpe, chat_format, hashing, jaccard_join, license_scan, nearest, quality_classifier, quality_rules,
                           substring_dedup, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, None) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empties, copies, near copies, a long text, odd characters."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (5, 6, 30, 60, 120, 300)]
    near = [" ".join(w if k % 40 != 7 else "changed" for k, w in enumerate(t.split())) for t in base]
    return [None, "", "   \n\t", "one", "one two", "ONE two", "a\x0bb é É\x00 x", *base, *base, *near, prose(rng, 4000), "same same same same same same same same same same same same"]


def test_hashing(odd):
    ids = {}
    old, hashing.BLOCK = hashing.BLOCK, 64
    try:
        for i, j, w in hashing.chunks(pa.array(odd), 300):
            owner, keys = hashing.distinct(*hashing.shingles(w))
            for r in range(i, j):
                ws = words((odd[r] or "").translate(FOLD))
                want = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}
                assert w.counts[r - i] == len(ws) and (owner == r - i).sum() == len(want)
                if len(want) == 1:
                    assert ids.setdefault(next(iter(want)), keys[owner == r - i][0]) == keys[owner == r - i][0]
    finally:
        hashing.BLOCK = old


def test_quality_rules(spark, odd):
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, odd)).collect()}
    assert len(got) == len(odd)
    for i, t in enumerate(odd):
        w = words(t)
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {x for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not r.base_failed or not r.kept)
    assert quality_rules.quality_rules(frame(spark, odd).limit(0)).count() == 0


def test_sketch_buckets(spark):
    b = quality_rules.bucket(F.col("id"))
    rows = spark.range(5000).select("id", b.alias("b"), quality_rules.floor_of(b).alias("f")).collect()
    assert all(r.f <= r.id <= r.f * (1 + 2**-4) for r in rows) and all(x.b <= y.b for x, y in zip(rows, rows[1:]))


def test_license_scan(spark):
    docs = frame(spark, ["Text. Released under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0. All rights reserved.\nYou may not use this file except in compliance with the License.",
                         None, "", "a. Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."])
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [got[i].licenses for i in range(5)] == ["MIT", "Apache-2.0 proprietary", "", "", "CC-BY-NC-4.0"]
    assert got[4].n_sentences == 2 and got[1].sentence_ids == "A1 R1 A2"


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
"""


def test_license_scan_of_wrapped_texts(spark):
    texts = [MIT, APACHE, BSD, GPL, GPL.replace("version 3", "version 2"), MPL, APACHE.replace(";\n# you may", "; you may\n#"), MIT.replace("\n", "\r\n"),
             "Released under\n\nthe MIT License."]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert [got[i].licenses for i in range(len(texts))] == [
        "MIT-full", "Apache-2.0-notice", "BSD", "GPL-3.0-notice", "GPL-2.0-notice", "MPL-2.0-notice", "Apache-2.0-notice", "MIT-full", ""]
    assert got[0].sentence_ids == "M2 M3 M4" and got[1].sentence_ids == got[6].sentence_ids == "A1 A2 A3"


BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE
"""
AGPL = GPL.replace("General Public License as", "Affero General Public License as")
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def test_license_scan_of_more_licenses_and_tags(spark):
    texts = [BSD3, BSD3.replace("3. Neither", "3. Not even"), AGPL, ZLIB, "//          Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file", "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-or-later\n",
             "/* SPDX-License-Identifier: MIT */", "SPDX-License-Identifier: MIT OR ISC"]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert [got[i].licenses for i in range(len(texts))] == ["BSD-3-Clause", "BSD-2-Clause", "AGPL-3.0-notice", "Zlib", "BSL-1.0", "GPL-2.0-or-later", "MIT", ""]
    assert got[0].sentence_ids == "B1 B2 B3 B4 B5" and got[3].sentence_ids == "Z1 Z2" and got[2].kinds == "copyleft"
    names = {k for k, _ in license_scan.FORMS} | set(license_scan.SENTENCES)
    assert all(len(x) == license_scan.ID for n in names for x in n.split()) and len({v for _, v in license_scan.FORMS}) == len(license_scan.FORMS)


def test_best_fit(spark):
    rng = random.Random(1)
    rows = [(i, f"s{rng.randrange(4)}" if i % 9 else None, rng.randrange(200) if i % 7 else None, rng.randrange(0, 260)) for i in range(800)]
    items = spark.createDataFrame(rows, "doc_id long, source string, cluster long, length long")
    out = bin_packing.pack(items, 100, 64).collect()
    assert sum(r.length for r in out) == sum(r[3] for r in rows)
    bins = collections.defaultdict(list)
    for r in out:
        if r.bin is not None:
            bins[r.bin].append(r)
    src, cl = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert sum(r.length for r in b) <= 100 and all(x.offset + x.length == y.offset for x, y in zip(b, b[1:]))
        assert len({src[r.doc_id] for r in b}) == len(b)
        known = [cl[r.doc_id] for r in b if cl[r.doc_id] is not None]
        assert len(set(known)) == len(known)
    assert bin_packing.pack(items.limit(0), 100).count() == 0
    # a piece goes to the tightest compatible bin
    assert bin_packing.best_fit([70, 60, 30, 30], [0, 1, 0, 2], [-1] * 4, 100) == ([0, 1, 1, 0], [0, 0, 60, 70])


def test_rotation(spark):
    rows = [(1, 0, "system", "Be"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, None, "ann", None), (None, 0, "x", "y"), (2, 0, "system", "only"), (1, 2, "bob", "yo")]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = {(r.conv_id, r.speaker): r for r in chat_format.rotate(t).collect()}
    assert set(got) == {(1, "ann"), (1, "bob")}
    r = got[1, "ann"]
    assert r.n_turns == 5 and r.text.startswith("<|im_start|>system\nBe<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo")
    assert [r.text[s.start : s.end] for s in r.mask] == ["hi<|im_end|>\n", "<|im_end|>\n"]
    parts = chat_format.rotate(t, 2).filter("speaker = 'ann'").orderBy("segment").collect()
    assert "".join(p.text for p in parts) == r.text


LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=400):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        w = prose(rng, 40).split()
        if toxic:
            w[rng.randrange(40)] = rng.choice(["idiot", "id1ot", "іdiot", "grumpfel", "grumpfen"])
        if bad:
            w = [x + "***" for x in w]
        texts.append(" ".join(w))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, texts), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], LABELS), labels


def test_quality_classifier(spark):
    docs, labels, truth = labelled(spark)
    m = quality_classifier.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, m).collect()}
    assert all((got[i] >= 0.5) == bool(q) for i, q, _ in truth)
    empty = quality_classifier.classify(frame(spark, [None, ""]), m).collect()
    assert all(0 <= r.score <= 1 for r in empty)
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.classify(docs.limit(3), none).collect()} == {0.5}
    # the identity against the sum over pairs
    rng = np.random.default_rng(0)
    m.factor = rng.normal(size=m.factor.shape).astype(np.float32)
    w = next(iter(hashing.chunks(pa.array(["a b c a d", ""]))))[2]
    words_, stats = quality_classifier.inputs(w), quality_classifier.statistics(w)
    x = np.zeros((2, quality_classifier.BUCKETS + quality_classifier.N_STATS))
    x[words_[0], words_[1]] = words_[2]
    x[:, quality_classifier.BUCKETS :] = (stats - m.mean) / m.scale
    for r in range(2):
        on = np.flatnonzero(x[r])
        pairs = sum(float(m.factor[i] @ m.factor[j]) * x[r, i] * x[r, j] for a, i in enumerate(on) for j in on[a + 1 :])
        assert m.raw(words_, stats)[0][r] == pytest.approx(m.bias + m.weight @ x[r] + pairs, rel=1e-3, abs=1e-3)


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    lex = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs.select("doc_id", "text"), lex).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in truth)
    assert lex.score("an 1D1OT here") >= 0.5 > lex.score("an idiotic plan") and lex.score("") < 0.5
    hole = toxicity.Lexicon(lex.weights, ("idiot proof",), lex.coef)
    assert hole.score("it is idiot proof now") < 0.5 <= hole.score("idiot proof idiot")
    assert toxicity.learn(docs, labels.limit(0)).score("x") == 0.5


def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = words((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("blocks", [False, True])
def test_jaccard_join(spark, odd, blocks, monkeypatch):
    rng = random.Random(3)
    texts = list(odd)
    for _ in range(6):  # families of near copies that link in chains
        t = prose(rng, 90).split()
        for _ in range(25):
            t = list(t)
            for _ in range(rng.choice([1, 1, 2])):
                t[rng.randrange(len(t))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(t))
    if blocks:
        monkeypatch.setattr(jaccard_join, "TREE", 8)
        monkeypatch.setattr(jaccard_join, "FAMILY", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_without_rows(spark):
    assert jaccard_join.jaccard_join(frame(spark, ["a"]).limit(0)).count() == 0
    assert jaccard_join.jaccard_join(frame(spark, [None, ""])).count() == 2


def test_jaccard_join_with_null_ids(spark):
    rng = random.Random(11)
    text = prose(rng, 60)
    rows = [(None, text), (1, text), (2, " ".join([*text.split()[:-1], "edited"])), (None, prose(rng, 40)), (None, None), (3, prose(rng, 50))]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], DOCS).coalesce(1)  # the null id comes first
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    assert got == sorted([(None, None)] * 3 + [(1, 1), (2, 1), (3, 3)], key=str)
    kept = jaccard_join.stage(spark, docs, "").collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, None, None, None] and {r.text for r in kept if r.doc_id is None} == {rows[0][1], rows[3][1], None}


def test_tree_join_finds_all():
    rng = np.random.default_rng(4)
    sets = [set(rng.choice(3000, rng.integers(1, 300), replace=False)) for _ in range(120)]
    sets += [set(list(s)[: max(1, int(len(s) * 0.95))]) for s in sets]
    size = np.array([len(s) for s in sets])
    points = []
    for s in sets:
        g = int(jaccard_join.groups(np.array(len(s))))
        points.append(np.bincount(np.array(list(s)) % g, minlength=g))
    up = jaccard_join.Forest(len(sets))
    for a, b in jaccard_join.tree_join(size, points):
        up.join(a, b)
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert up.find(i) == up.find(j)


def test_substring_dedup(spark):
    rng = random.Random(6)
    passage = prose(rng, 55)
    line = prose(rng, 80)
    close = " ".join("edited" if k == 40 else w for k, w in enumerate(line.split()))
    texts = [prose(rng, 200) for _ in range(8)] + [None, "", prose(rng, 3000)]
    texts[1] = f"{prose(rng, 33)} {passage} {prose(rng, 21)}"
    texts[4] = f"{prose(rng, 90)}\n{prose(rng, 7)} {passage} {prose(rng, 50)}"
    texts[5] = f"{prose(rng, 40)}\n{line}"
    texts[7] = f"{prose(rng, 30)}\n{close}\n{prose(rng, 20)}"
    docs = frame(spark, texts)
    spans = substring_dedup.repeats(docs)
    got = {r.doc_id: r for r in spans.collect()}
    assert set(got) == {4, 7} and (got[4].kept_doc, got[7].kept_doc) == (1, 5) and got[4].n_words >= 20 and got[7].n_words == 80
    out = {r.doc_id: r.text for r in substring_dedup.cut(docs, spans).collect()}
    assert out[8] is None and out[9] == "" and all(out[i] == texts[i] for i in (0, 1, 2, 3, 5, 6, 10))
    assert "edited" not in out[7] and len(words(out[4])) == len(words(texts[4])) - got[4].n_words
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


def test_substring_dedup_links_variants_without_their_oldest(spark):
    rng = random.Random(9)
    lines, texts = [], []
    for _ in range(3):  # chains of variants; the ends of a chain are far from each other
        t = prose(rng, 90).split()
        for _ in range(30):
            t = list(t)
            t[rng.randrange(90)] = f"new{rng.randrange(9999)}"
            lines.append(" ".join(t))
    texts = [f"{prose(rng, 20)}\n{x}" for x in lines]
    want = {i for i, (_, c) in brute_components(lines).items() if c != i}
    got = {r.doc_id for r in substring_dedup.repeats(frame(spark, texts)).filter("first = 20 and n_words = 90").collect()}
    assert len(want) > 60 and got == want


def test_substring_dedup_of_short_lines_and_passages(spark):
    rng = random.Random(10)
    texts, want = [], {}
    for n in range(30, 50):  # near copies of short paragraphs
        t = prose(rng, n).split()
        texts += [f"{prose(rng, 12)}\n{' '.join(t)}", f"{prose(rng, 15)}\n{' '.join(['edited', *t[1:]])}"]
        want[len(texts) - 1] = (15, 15 + n)
    at = len(texts)
    for _ in range(40):  # passages in the middle of lines
        t = prose(rng, 42)
        texts += [f"{prose(rng, 60)} {t} {prose(rng, 60)}", f"{prose(rng, 70)} {t} {prose(rng, 50)}"]
    got = {r.doc_id: (r.first, r.last) for r in substring_dedup.repeats(frame(spark, texts)).collect()}
    assert {i: v for i, v in got.items() if i < at} == want
    assert {i for i in got if i >= at} == set(range(at + 1, len(texts), 2))
    assert all(got[i][0] - 70 <= 11 and 112 - got[i][1] <= 11 for i in range(at + 1, len(texts), 2))


def test_byte_bpe(spark, odd):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    c = byte_bpe.codec(path, public.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert all(c.leaf(t) == [r] for t, r in c.ranks.items())
    rng = random.Random(7)
    parts = ["a", "the", "ing", " ", "\n", "!", "_", "1", "²", "é", "中", "😀", "\x1c", "\x85", "\xa0", "'s", "***", "Ⅷ", "\t", "<|endoftext|>"]
    texts = [*odd, *("".join(rng.choice(parts) for _ in range(rng.choice([5, 60, 500]))) for _ in range(300)), "a" * 5000, " " * 3000, "".join(rng.choice("abcde") for _ in range(4000))]
    rows = {r.doc_id: r for r in byte_bpe.byte_bpe(frame(spark, texts), path, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == e.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()
    assert base64.b64decode(b"IQ==") == c.tokens[0]


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, size=(900, 1))
    x[40:70] = x[40]
    rows = [(i, [float(y) for y in v], "c") for i, v in enumerate(x)]
    rows += [(1000, None, "c"), (1001, [0.0] * 16, "c"), (1002, [1.0, None] + [1.0] * 14, "c"), (1003, [float("nan")] * 16, "c"), (1004, [1.0], "c"), (None, [1.0] * 16, "c")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    out = nearest.nearest(v, F.col("vec_id") % 20 == 0, 20).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    hits = []
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        hits.append(len({r.vec_id for r in got[q]} & set(best.tolist())) / 20)
        assert [r.rank for r in got[q]] == list(range(1, 21)) and all(abs(s[r.vec_id] - r.score) < 1e-9 for r in got[q])
    assert set(got) == set(range(0, 900, 20)) and np.mean(hits) >= 0.9
    few = nearest.nearest(v.filter("vec_id < 5"), F.col("vec_id") == 0, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert nearest.nearest(v.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_search_reaches_clusters_without_links():
    rng = np.random.default_rng(12)
    of = np.repeat(np.arange(100), 30)[rng.permutation(3000)]  # more clusters than entries
    center = 10 * rng.normal(size=(100, 32))
    x = center[of] + rng.normal(size=(3000, 32))
    near = [np.flatnonzero(of == c) for c in of]  # every link stays inside its cluster
    graph = pd.DataFrame({"rep": np.arange(3000), "embedding": list(x), "near": near})
    for ids, y in ((np.arange(0, 3000, 20), x[::20]), (np.arange(5000, 5100), center)):  # in the shard, and of other shards
        out = nearest._search(20)((0, 0), graph, pd.DataFrame({"query": ids, "embedding": list(y)}))
        for q, v in zip(ids, y):
            assert set(out[out["query"] == q]["rep"]) == set(np.argsort(-(x @ v), kind="stable")[:20].tolist())
