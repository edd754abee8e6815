"""The training-data operators against brute force, on the smallest tables and on a fixture of odd rows."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tidebar.llm import binary, bpe, embeddings, langid, licenses, minhash, packing, quality, sharding, suffix  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"Wort{i * 7919 % 1013} naïve x y  <|endoftext|>, 's don't" for i in range(1500))
PASSAGE = " ".join(f"shared{i * 31 % 97}" for i in range(40))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, LONG), (7, LONG), (7, LONG), (8, LONG + " tail"),
    (9, "a" * 900), (10, "\n\n  lead  and trail \n\n"), (11, "xé 中文 \U0001f600 \x1c\x1f o'clock ΣΣ İ"), (None, "no id at all"), (-5, "negative id"),
    (12, "prefix one " + PASSAGE + " suffix one"), (13, "quite another " + PASSAGE + " ending"), (14, "12345 !!! ---"), (15, "line\nline\nline\n\nline"), (16, "a b c a b c a b c d"),
    (17, "ab " * 400), (18, "\r\n tab\there \x85 nel"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from pyspark.sql import functions as F

    for c in ("size", "shard", "slot", "n_words", "kept", "score", "ids", "th", "node", "__sub"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(params=["odd", "sf", "empty"])
def docs(spark, request):
    rows = {"odd": ODD, "empty": [], "sf": None}[request.param]
    if rows is None:
        rows = [tuple(r) for r in table(spark).select("doc_id", "text").collect()]
    return frame(spark, rows), rows


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, cols, expected):
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert got == sorted(expected, key=key)


# 7 sharding


def jump_hash(k, n):
    k, b, j = (k or 0) % 2**64, -1, 0
    while j < n:
        b, k = j, (k * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_sharding(docs):
    df, rows = docs
    out = sharding.assign_shards(df, 40)
    same(out, ["doc_id", "size", "text_crc32", "law", "shard", "grown_shard"], [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", jump_hash(i, 40), jump_hash(i, 41)) for i, t in rows])
    by = defaultdict(list)
    for r in out.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_jump_values(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    out = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump(__import__("pyspark").sql.functions.col("k"), n).alias("j")).collect()
    assert all(r["j"]["small"] == jump_hash(r["k"], n) and r["j"]["large"] == jump_hash(r["k"], n + 1) for r in out)


# 2 quality


def features(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_quality_features(docs):
    df, rows = docs
    same(quality.with_features(df), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], [(i, *features(t)) for i, t in rows])


def bound(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def statistics(t):
    n, chars, symbols, dup, rep, failed = features(t)
    lines = sum(bool(WORDS.search(x)) for x in (t or "").split("\n"))
    per = lambda x, of: x * 1000 // max(of, 1)
    return failed, {"symbols": per(symbols, n), "long_words": per(chars, n), "dup_lines": per(dup, lines), "repeats": per(rep, n)}


def quality_expected(rows, labels):
    """Cutoffs of each stratum and the rows that stay, rule by rule as the method is described."""
    said = defaultdict(set)
    for i, q in labels:
        said[i].add(q)
    odd, even = defaultdict(list), defaultdict(list)
    judged = [(i, lang, *statistics(t)) for i, t, lang in rows]
    for i, lang, failed, stats in judged:
        if not failed and i is not None and said.get(i) in ({0}, {1}):
            (odd if zlib.crc32(str(i).encode()) % 2 else even)[lang].append((stats, said[i] == {1}))
    paths = {}
    for lang, known in even.items():
        best = []
        for at, (rule, (_, cuts)) in enumerate(quality.RULES.items()):
            gain, lenient = max((sum((-quality.COST if good else 1) * (st[rule] > c) for st, good in known), c) for c in cuts)
            if gain > 0:
                best.append((-gain, at, rule, lenient))
        if best:
            paths[lang] = [(rule, cut) for _, _, rule, cut in sorted(best)]
    certified = {}
    for lang, path in paths.items():
        good = [st for st, ok in odd[lang] if ok]
        for n in range(1, len(path) + 1):
            k = sum(any(st[r] > c for r, c in path[:n]) for st in good)
            if not good or bound(k, len(good), quality.ALPHA) > quality.DELTA / len(paths):
                break
            certified[lang] = dict(path[:n])
    return certified, [(i, not failed and not any(stats[r] > c for r, c in certified.get(lang, {}).items())) for i, lang, failed, stats in judged]


def test_quality_rules_by_hand(spark):
    """Two strata: in one, good documents outnumber what the bound needs; in the other they don't."""
    words = " ".join(f"w{i}" for i in range(60))
    rows, labels = [], []
    for i in range(3000):
        bad = i % 4 == 0
        rows.append((i, words + ("".join(f" #{j}" for j in range(200)) if bad else "") + f" x{i}", "en" if i % 20 else None))
        labels += [(i, 0 if bad else 1)] * (1 + i % 2)
    rows += [(i, words + " ###" * 90 if i % 3 else None, "xx") for i in range(5000, 5060)] + [(None, words, "en"), (7, "short", "en")]
    labels += [(5, None), (None, 1), (9, 0), (9, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    cut, kept = quality_expected(rows, labels)
    assert set(cut) == {"en"} and cut["en"]["symbols"] == 500
    same(quality.score(docs, lab), ["doc_id", "kept"], kept)
    same(quality.score(docs, lab.limit(0)), ["doc_id", "kept"], [(i, not statistics(t)[0]) for i, t, _ in rows])
    assert quality.score(docs.limit(0), lab).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_rules(spark, sf, monkeypatch):
    """The whole table against the method in plain Python; on the smallest one with a limit that its few labels can meet."""
    monkeypatch.setattr(quality, "ALPHA", 0.2 if sf == "sf0.001" else quality.ALPHA)
    docs, lab = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    cut, kept = quality_expected([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in lab.select("doc_id", "quality").collect()])
    same(quality.score(docs, lab, keep=["doc_id"]), ["doc_id", "kept"], kept)
    found = quality.thresholds(quality.with_features(docs.select("doc_id", "text", "lang")), lab).collect()
    assert {(r["stratum"], r["rule"]): r["cutoff"] for r in found} == {(s, r): c for s, rules in cut.items() for r, c in rules.items()}


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    for k, n, p in [(0, 0, 0.01), (0, 100, 0.01), (3, 250, 0.02), (9, 1000, 0.01)]:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


# 3 byte-level BPE, 8 files, 10 packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (200, 40)])
def test_byte_bpe(docs, chunk, overlap):
    import tiktoken

    df, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bpe.digest(bpe.encode(df, RANKS, P.PATTERN, chunk, overlap), RANKS), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], expected)


@pytest.mark.parametrize("text", ["x" * 3000 + " y" * 900, "12345 " * 3 + "9" * 2500 + " and so on, " * 90, "中文没有空格" * 400 + " " * 700 + "!" * 900 + "\n\n\n a\r\n" * 200, "a!b?c;" * 700, " " * 4000 + "z" + " " * 300])
def test_chunks_without_shared_boundaries(spark, text):
    """Long runs, long white space and texts without blanks: chunks that can't be stitched become one piece."""
    test_byte_bpe((frame(spark, [(1, text), (2, text + "é"), (None, None)]), [(1, text), (2, text + "é"), (None, None)]), 400, 50)


def word_ids(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in rows]


def test_word_ids_of_odd_words():
    from tidebar.llm.tokens import WordTokenizer

    t = WordTokenizer(WORD_BPE)
    texts = ["A <|endoftext|> B <|ENDOFTEXT|> c<|startoftext|>D. <|endoftext| >", "gezube$$$ x*** ab.,! don't. they're's naïve, ÑANDÚ; ß ŒUVRE İstanbul ǅ ﬁne e\u0301te\u0301 ªº x1% 12# <|endoftext|>. a|b a<b> ... #x ΣΑΣ. 中文, \u0149a k\u212a", "MÉLANGE ÿ. µm", "'s 't. x's&"]
    for text in [*texts, *" ".join(texts).split()]:
        assert t.encode(text) + b"\2\0\0\0" == word_ids([(None, text)], 2)[0][1].tobytes()


@pytest.mark.parametrize("file_ids", [binary.FILE_IDS, 500])
def test_packed_files(docs, file_ids, monkeypatch):
    monkeypatch.setattr(binary, "FILE_IDS", file_ids)
    df, rows = docs
    got = [tuple(r) for r in binary.read(*binary.write(df, WORD_BPE, 1)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()]
    got.sort()
    ids = word_ids(rows, 1)
    assert Counter((d, n, c) for _, d, n, c in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    order = [d for _, d, _, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    parts = [rng.integers(0, 2**bits, n).astype("<u4").tobytes() for n in (0, 1, 5000, 8, 4096, 9000)]
    f = binary.PackedFile(binary.build_file([3, None, 5, 6, 7, 8], parts, bits))
    assert all(f.document(i).tobytes() == p for i, p in enumerate(parts))


def test_packing(docs):
    df, rows = docs
    packed = packing.pack(df, WORD_BPE, 2, with_ids=True)
    got = packed.collect()
    want = Counter()
    for i, x in word_ids(rows, 2):
        for at in range(0, len(x), 4096):
            want[i, at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes()), len(x)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    assert sorted(by) == list(range(len(by)))
    if got:
        used = {k: sum(n for _, n in v) for k, v in by.items()}
        assert {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packed).collect()} == {k: n if n & (n - 1) == 0 else 4096 for k, n in used.items()}


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 101, int(rng.integers(1, 300))).tolist(), reverse=True)
        bins = []
        for n in lengths:
            fits = [b for b in bins if b[0] >= n]
            best = min(fits, key=lambda b: b[0]) if fits else None
            if best is None:
                bins.append(best := [100])
            best[0] -= n
        runs = packing.plan(Counter(lengths), 100)
        room, where = defaultdict(lambda: 100), Counter()
        for n, lo, hi, seq, each, off in runs:
            for r in range(hi - lo):
                room[seq + r // each] -= n
                assert 0 <= off + r % each * n <= 100 - n
                where[n] += 1
        assert sorted(room.values()) == sorted(b[0] for b in bins) and where == Counter(lengths)


# 4 licences


def test_licenses(spark):
    mit = licenses.SENTENCES["mit-grant"] + "\n\n" + licenses.SENTENCES["mit-notice"]
    wrapped = mit.replace(" of ", " of\n")
    bsd = "\n".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"))
    rows = [(1, mit), (2, wrapped), (3, "\n".join(reversed(mit.split("\n\n")))), (4, bsd), (5, bsd.rsplit("\n", 1)[0]), (6, "Licensed under CC BY-NC 4.0. And so on.\nReleased under the MIT License."), (7, None), (8, "no licence"), (8, "no licence")]
    rows += [(9, "word " * 200_000 + "\nReleased under the MIT License.\n" + "line\n" * 50_000), (None, "Licensed under CC0 1.0.")]
    got = sorted(((r["doc_id"] or 0, r["licenses"], r["clean"]) for r in licenses.scan(frame(spark, rows)).collect()))
    assert got == sorted([(9, "MIT", False), (0, "CC0-1.0", False), (1, "MIT", False), (2, "MIT", False), (3, "", True), (4, "BSD-3-Clause", False), (5, "BSD-2-Clause", False), (6, "MIT|CC-BY-NC-4.0", False), (7, "", True), (8, "", True), (8, "", True)])
    assert licenses.scan(frame(spark, [])).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Foo Research Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
MIT0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
GPL = """This {w} is free software; you can redistribute it and/or
modify it under the terms of the GNU {k}General Public License
as published by the Free Software Foundation; either version {v}
of the License, or (at your option) any later version.

This {w} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_licenses_as_published(spark):
    texts = [(ZLIB, "Zlib"), (MIT0, "MIT-0"), ("Eclipse Public License - v 2.0\n", "EPL-2.0"), ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.\n", "CC-BY-SA-4.0"), ("Distributed under the Boost Software License, Version 1.0.\n", "BSL-1.0")]
    texts += [(APACHE, "Apache-2.0"), (MIT, "MIT"), (ISC, "ISC"), (BSD3, "BSD-3-Clause"), (BSD3[: BSD3.index("3. N")], "BSD-2-Clause")]
    kinds = [("program", "", "2", "GPL-2.0"), ("program", "", "3", "GPL-3.0"), ("library", "Lesser ", "2.1", "LGPL-2.1"), ("library", "Lesser ", "3", "LGPL-3.0"), ("program", "Affero ", "3", "AGPL-3.0")]
    texts += [(GPL.format(w=w, k=k, v=v), name) for w, k, v, name in kinds]
    texts += [("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"), ("This project is licensed under the terms of the\nMIT license.", "MIT"), ("// SPDX-License-Identifier: LGPL-2.1-or-later\n", "LGPL-2.1")]
    forms = [lambda t: t, lambda t: "Copyright 2020 Foo Authors\n\n" + t, lambda t: "Copyright (c) 2020 Jane Doe\n" + t, lambda t: "".join(f" * {x}\n" for x in ("Copyright 2020 Foo", "", *t.splitlines())), lambda t: "Copyright 2020 Foo\r\n\r\n" + t.replace("\n", "\r\n"), lambda t: "Words before.\n\n" + " ".join(t.split())]
    rows, want = [], {}
    for t, name in texts:
        for form in forms:
            want[len(rows)] = name
            rows.append((len(rows), form(t)))
    for t in (MIT[:-60], APACHE[:-250], "This program is free software; buy it.", "It was not released under the MIT License.", "a licence under the\nMIT license or not"):
        want[len(rows)] = ""
        rows.append((len(rows), t))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, rows)).collect()}
    assert {i: (got[i], n, rows[i][1]) for i, n in want.items() if got[i] != n} == {}


# 5 language ID


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.evaluate(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == 1000 and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    test = out[out["held_out"]]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.97


def counted(text):
    """How often each bucket's n-grams (1 to 3 characters) occur in a text between spaces, one at a time."""
    codes, n = [ord(c) for c in f" {text.lower()} "], len(f" {text.lower()} ")
    out = Counter()
    for i in range(n):
        h = 0
        for k in range(langid.N_MAX):
            c = codes[i + k] if i + k < n else ord(" ")
            h = (h + c + k + 1) * int(langid._MULT[k]) % 2**64
            h ^= h >> 29
            out[(h * int(langid._MULT[0]) % 2**64) >> (64 - langid.BUCKETS.bit_length() + 1)] += 1
    return out


def test_language_id_brute_force(spark):
    """Counts, probabilities and scores of naive Bayes in plain Python."""
    rows = [tuple(r) for r in table(spark).select("doc_id", "text", "lang").orderBy("doc_id").limit(70).collect()] + [(9001, None, "en"), (9002, "12 34", None), (9003, "ein Satz ohne Angabe", None)]
    counts, prior = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang] += counted(t)
            prior[lang] += 1
    logp = {x: (lambda total, c=c: lambda k: math.log(c[k] + langid.SMOOTH) - math.log(total + langid.SMOOTH * langid.BUCKETS))(sum(c.values())) for x, c in counts.items()}
    want = {}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            want[i] = ("und", 0.0)
            continue
        score = {x: math.log(prior[x] / sum(prior.values())) + sum(n * p(k) for k, n in counted(t).items()) for x, p in logp.items()}
        best = max(sorted(score), key=score.get)
        want[i] = (best, 1 / sum(math.exp(s - score[best]) for s in score.values()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.evaluate(docs).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)


def test_language_id_bounds(spark, monkeypatch):
    """Copies of one text don't defeat the bound of rows, and rare language names beyond the bound aren't learned."""
    from pyspark.sql import functions as F

    rows = [(i, "the same english text again", "en") for i in range(900)] + [(1000 + i, f"der deutsche text {i}", "de") for i in range(30)] + [(2000 + i, f"x{i}", f"l{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    model = langid.fit(docs, max_rows=100)
    assert model["langs"] == ["de", "en"]
    out = langid.predict(docs.withColumns({"score": F.lit("own"), "lang_pred": F.lit("own")}), model).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in out if r["lang"] in ("de", "en")} == {("de", "de"), ("en", "en")}


def test_language_id_odd(spark):
    train = [(100 + i, t, lang) for i in range(8) for t, lang in ((f"the cat sat on mat number {i}", "en"), (f"der hund ist im haus {i} und", "de"))]
    rows = [(i, t, "en" if i == 4 else None) for i, t in ODD] + train
    out = {}
    for r in langid.evaluate(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect():
        out.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert out[1] == out[2] == out[3] == out[14] == [("und", 0.0)] and len(out[7]) == 2 and out[6][0][0] in ("en", "de")
    assert langid.evaluate(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert langid.evaluate(none).first()["lang_pred"] == "und"


def test_long_text_in_parts():
    text = ("der hund und die katze " * 9000)[:200_001]
    a = np.zeros(langid.BUCKETS, dtype=int)
    b = a.copy()
    for out, size in ((a, 1 << 22), (b, 1000)):
        for _, starts, codes in langid._pieces([text], size):
            body = langid._body(starts, len(codes))
            for h in langid._hashes(codes):
                out += np.bincount(h[body], minlength=len(out))
    assert (a == b).all()


# 6 near-duplicates


def shingles(t, k):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORDS.findall(w)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near_expected(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    ids = {i for i, _ in rows if i is not None}
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and None not in (a, b) and 100 * len(x & y) >= 80 * len(x | y)]
    comp = groups(ids, pairs)
    return [(i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets]


def variants(n, words=120, change=9, seed=0):
    rng = np.random.default_rng(seed)
    base = [f"tok{x}" for x in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, words, int(rng.integers(0, change))):
            w[j] = f"v{i}x{j}"
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("which,progress", [("odd", 0.02), ("sf", 0.02), ("empty", 0.02), ("group", 0.02), ("group", 2.0), ("loose", 2.0)])
def test_near_duplicates(spark, which, progress, monkeypatch):
    """Small limits, so that hubs have several tasks and families several blocks; progress 2 leaves all but one round to the families."""
    for name, value in {"BLOCK_BYTES": 30_000, "SMALL": 3, "FOLLOWERS": 8, "PROGRESS": progress}.items():
        monkeypatch.setattr(minhash, name, value)
    rows = {"loose": variants(120, 90, 16, 4), "odd": ODD, "empty": [], "group": variants(90) + [(5000 + i, "tiny text of five words " + "xyz"[i % 3]) for i in range(9)]}.get(which)
    if rows is None:
        rows = [tuple(r) for r in table(spark).select("doc_id", "text").collect()]
    same(minhash.near_duplicates(frame(spark, rows), 4, 80), ["doc_id", "n_shingles", "component_id", "kept"], near_expected(rows, 4))


def test_keep_one_and_repeats(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline

    text = lambda n: " ".join(f"w{n}x{i * 37 % 101}" for i in range(80))
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (3, text(2) + " end"), (None, text(3)), (None, text(3)), (4, text(4)), (5, text(4)), (5, text(5)), (None, text(6)), (7, text(6)), (None, text(7)), (8, None), (8, None), (9, " \n"), (10, " \n")]
    want = [(1, text(1)), (2, text(2)), (None, text(3)), (4, text(4)), (5, text(5)), (7, text(6)), (None, text(7))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    same(kept, ["doc_id", "text"], want + rows[12:])
    same(corpus_pipeline.repeated_passages(spark, corpus_pipeline.near_duplicates(spark, docs, ""), ""), ["doc_id", "text"], want + rows[14:])
    assert minhash.keep_one(docs.limit(0)).count() == 0


def stage_rows(spark):
    """Documents of the smallest table with odd rows, and extra columns whose names the stages use themselves."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(i, t, None if k % 3 else "de", "odd", len(t or "")) for k, (i, t) in enumerate(ODD)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    for c in ("score", "lang_pred", "n_words", "kept", "n_bytes", "kept_text", "th", "spots"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return docs


def plain(df):
    return [r.asDict() for r in df.collect()]


def unclashed(rows):
    return all(r[c] == f"{c} of {'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in ("score", "lang_pred", "n_words", "kept", "n_bytes", "kept_text", "th", "spots"))


def counts_of(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stage(spark, stage):
    """Each stage on its own input against plain Python: which rows stay, with which text, and that no column is replaced."""
    import corpus_pipeline as cp

    docs = stage_rows(spark).repartition(3).cache()
    rows = plain(docs)
    out = cp.STAGES[stage][1](spark, docs, SF)
    if stage == 4:
        ids = Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in word_ids([(r["doc_id"], r["text"]) for r in rows], 2) if len(x) <= 4096)
        got = plain(out)
        assert Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got if r["doc_tokens"] <= 4096) == ids and all(0 <= r["offset"] <= 4096 - r["length"] for r in got)
        return
    got = plain(out)
    assert out.columns == docs.columns and unclashed(got)
    if stage == 0:
        letters = re.compile(r"[^\W\d_]")
        want = [r for r in rows if r["text"] and letters.search(r["text"])]
        assert counts_of(got) <= counts_of(want) and len(want) - len(got) <= 0.02 * len(want)
        assert all(r["lang"] is not None for r in got)
    elif stage == 1:
        labels = [tuple(r) for r in table(spark, "labels").select("doc_id", "quality").collect()]
        _, kept = quality_expected([(r["doc_id"], r["text"], r["lang"]) for r in rows], labels)
        assert counts_of(got) == counts_of(r for r, (_, k) in zip(rows, kept, strict=True) if k)
    elif stage == 2:
        sets = [shingles(r["text"], 5) for r in rows]
        comp = groups(range(len(rows)), [(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)])
        first = {}
        for i, r in enumerate(rows):
            if sets[i]:
                first.setdefault(comp[i], []).append((r["doc_id"] is None, r["doc_id"] or 0))
        words = [r for r in got if shingles(r["text"], 5)]
        assert len(words) == len(first) and Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in words) == Counter(min(v) for v in first.values())
        assert counts_of(r for r in got if not shingles(r["text"], 5)) == counts_of(r for r, s in zip(rows, sets, strict=True) if not s)
    else:
        texts = [(r["text"] or "").encode() for r in rows]
        seen = Counter(t[j : j + 200] for t in texts for j in range(len(t) - 199))
        want = Counter()
        for r, t in zip(rows, texts, strict=True):
            gone = np.zeros(len(t) + 1, dtype=bool)
            for j in range(len(t) - 199):
                if seen[t[j : j + 200]] > 1:
                    gone[j : j + 200] = True
            left = bytes(x for x, g in zip(t, gone, strict=False) if not g).decode("utf-8", "ignore")
            if left.strip(" "):
                want[r["doc_id"], left] += 1
        assert counts_of(got) == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_pipeline_on_nothing(spark):
    """Empty tables pass through every stage."""
    import corpus_pipeline as cp

    docs = stage_rows(spark).limit(0).cache()
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_runs(spark):
    """run() is its stages one after another; every document that is left is packed whole."""
    import corpus_pipeline as cp

    got = plain(cp.run(spark, SF))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        assert [o for o, _ in sorted(v)] == list(itertools.accumulate([0, *(n for _, n in sorted(v))]))[:-1] and sum(n for _, n in v) <= 4096
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert got and all(total[r["doc_id"]] == r["doc_tokens"] for r in got)


def test_estimate_is_corrected():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    a, b = np.unique(both[:3600]), np.unique(both[400:])
    est = minhash.estimate(np.array([(minhash.registers(a) == minhash.registers(b)).sum()]))[0]
    assert abs(est - 0.8) < 0.12
    c = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    assert minhash.estimate(np.array([(minhash.registers(a) == minhash.registers(c)).sum()]))[0] < 0.03


# 1 embeddings


def vec_expected(rows):
    ok = {}
    for i, e, label in rows:
        if i is not None and e is not None and label is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e):
            ok[i] = (np.array(e, float) / np.linalg.norm(np.array(e, float)), label)
    ids = {r[0] for r in rows if r[0] is not None}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(ok), 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.98]
    comp, deg = groups(ids, pairs), Counter(itertools.chain(*pairs))
    return [(i, deg[i], comp[i], comp[i] == i) for i in ids]


@pytest.mark.parametrize("window,kind", [(64, "float"), (16, "double")])
def test_embeddings(spark, window, kind):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table(spark, "embeddings").collect()]
    base = rng.standard_normal(64)
    rows += [(9000 + i, (base + 0.12 * rng.standard_normal(64)).tolist(), 3) for i in range(150)]
    rows += [(9500, rows[0][1], None), (9501, None, 3), (9502, [], 3), (9503, [0.0] * 64, 3), (9504, [float("nan")] * 64, 3), (9505, [1.0, None], 3), (9506, [float("inf"), 1.0], 3), (9507, [1.0, 2.0], 3), (9508, [2.0, 4.0], 3), (9509, [1e-30, 2e-30], 3), (9510, rows[0][1], rows[0][2])]
    rows += [(9600 + i, base.tolist(), 3) for i in range(20)] + [(9700 + i, (2 * base).tolist(), 3) for i in range(5)] + [(9800, base.tolist(), 2)]
    rows += [(None, base.tolist(), 3), (9801, base.tolist(), 2), (9801, base.tolist(), 2)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    for c in ("id", "e", "size", "key", "rank", "component", "node"):
        df = df.withColumn(c, F.lit("clash"))
    if kind == "float":
        rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]
    same(embeddings.near_duplicates(df, 0.98, window), ["vec_id", "n_links", "component_id", "kept"], [*vec_expected(rows), (None, 0, None, True)])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_schedule():
    """Every label has several passes and a bounded window; the chance of a miss at the threshold stays below the limit."""
    for size in (1, 59, 218, 512, 513, 10**5, 10**10):
        bits, passes = embeddings.schedule(size, 0.98)
        p = (1 - math.acos(0.98) / math.pi) ** bits
        assert bits >= 4 and passes >= 9 and (1 - p) ** passes <= 1e-6 and next(s for s in embeddings._schedules(0.98, 64) if size <= s[0])[1:] == (bits, passes)


# 9 repeated passages


def removed_expected(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, dtype=bool)
        for j in range(len(d) - length + 1):
            if count[d[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(x for x, g in zip(d, gone, strict=False) if not g)
        spans = sum(bool(gone[j]) and (j == 0 or not gone[j - 1]) for j in range(len(d)))
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which,block", [("odd", 512), ("sf", 512), ("empty", 512), ("hot", 4), ("hot", 512)])
def test_repeated_passages(spark, which, block, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "DEAL", 2)
    rng = np.random.default_rng(2)
    rows = {"odd": ODD, "empty": []}.get(which)
    if which == "hot":
        junk = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
        passage, half = junk(520), junk(150)
        rows = [(i, junk(int(rng.integers(0, 300))) + passage[: 520 - i % 7] + junk(int(rng.integers(0, 300)))) for i in range(60)]
        rows += [(100 + i, (half + junk(1)[:1]) * (i % 4)) for i in range(12)] + [(200, passage[:199]), (201, passage[5:205])]
    if rows is None:
        rows = [tuple(r) for r in table(spark).select("doc_id", "text").collect()]
    same(suffix.remove_repeats(frame(spark, rows)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], removed_expected(rows, 200))


def test_long_text_anchors(monkeypatch):
    rng = np.random.default_rng(4)
    data = bytes(rng.integers(97, 100, 30_000).astype(np.uint8))
    want = suffix.anchors(data, 200, 32)
    monkeypatch.setattr(suffix, "PART", 1000)
    got = suffix.anchors(data, 200, 32)
    expand = lambda a: {(w, p, h) for h, p, lo, hi in zip(*(x.tolist() for x in a), strict=True) for w in range(lo, hi + 1)}
    assert expand(got) == expand(want)


def test_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    from tidebar.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        same(QUERIES[name](spark, SF), cols, [tuple(r) for r in want.fetchall()])

