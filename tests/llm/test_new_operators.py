"""Whitening, spelling variants and piece encoding: odd tables, and brute force over whole tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import re
import sentencepiece

from geoloom.llm import passages, pieces, registry, variants, whitening

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


# Whitening


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, N string, x string")


def whitened_plainly(rows, k=16):
    """Rows of whiten() from numpy's own eigenvectors, up to sign: (vec_id, component) -> n, deviation, |whitened|, explained."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    different = sorted({tuple(x) for _, x in good})
    n, d = len(different), len(different[0])
    totals = [sum(x[j] for x in different) for j in range(d)]
    fit = np.array([[float(a) - s / n for a, s in zip(x, totals, strict=True)] for x in different])
    matrix = fit.T @ fit / n
    values, vectors = np.linalg.eigh(matrix)
    out = []
    for i, x in good:
        y = np.array([a - s / n for a, s in zip(x, totals, strict=True)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, totals, strict=True))
        for c in range(1, min(k, d) + 1):
            if values[-c] > 1e-9 * values[-1]:
                out.append((i, c, n, deviation, float(y @ vectors[:, -c] / values[-c] ** 0.5), float(values[-c] / np.trace(matrix))))
    return out


def assert_whitened(got, want):
    """Equal in all, whitened up to one sign for each component; the covariance is the identity."""
    assert len(got) == len(want)
    order = lambda rows: sorted(rows, key=lambda r: (r[1], r[0], r[3], abs(r[4])))
    got, want = order([tuple(r) for r in got]), order(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert_whitened(registry.queries()["op11_feast_whitening"](spark, SF).collect(), whitened_plainly(rows))


def test_whitening_of_odd_vectors(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1 + k) for k in range(5)]) for i in range(60)]
    odd = [(1, rows[0][1]), (None, rows[1][1]), (200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [1.0, math.nan, 1.0, 1.0, 1.0]), (204, [math.inf] * 5), (205, [1.0, 2.0])]
    table = _vectors(spark, [(i, v, "c", "n", "x") for i, v in rows + odd])
    got = whitening.whiten(table)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {x.n for x in got.collect()} == {60}
    assert_whitened([(x[0] if x[0] is not None else -1, *x[1:]) for x in got.collect()], whitened_plainly([(i if i is not None else -1, v) for i, v in rows + odd if i != 205]))
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0], "", "", ""), (2, [1.0, 2.0], "", "", "")])).count() == 0
    flat = whitening.whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 0.0], "", "", "") for i in range(9)]))
    assert {x.component for x in flat.collect()} == {1}
    wide = whitening.whiten(_vectors(spark, [(i, [1e30 * (i % 3), float(i)], "", "", "") for i in range(9)])).collect()
    assert {x.deviation for x in wide} == {None}


@pytest.mark.parametrize("case", ["random", "equal", "two_levels", "low_rank", "close"])
def test_components_of_any_spectrum(case):
    r = np.random.default_rng(3)
    d = 40
    spectrum = {"random": r.uniform(1, 100, d), "equal": np.ones(d), "two_levels": np.repeat([9.0, 2.0], [10, d - 10]), "low_rank": np.repeat([5.0, 0.0], [7, d - 7]), "close": 50 + np.arange(d) * 1e-5}[case]
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    matrix = (q * spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_components(matrix)
    want = np.sort(spectrum)[::-1][: 7 if case == "low_rank" else 16]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-11 * spectrum.max()
    inertia = whitening.Inertia(matrix)
    assert all(inertia.above(s) == (spectrum > s).sum() for s in np.linspace(0.5, 101, 50) if np.abs(spectrum - s).min() > 1e-9)


# Spelling variants


def _variants(counts, ratio=2):
    def edits(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in alphabet if i + k <= len(w)}

    alphabet = {c for w in counts for c in w}
    near = {w: {v for v in edits(w) if v in counts and v != w} for w in counts}
    form = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= ratio * counts[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def _words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_variants_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in registry.queries()["op12_spelling_variants"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == _variants(_words(rows))


def test_variants_of_odd_texts(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in variants.word_counts(odd).collect()} == set(_words(rows).items())
    assert variants.variant_groups(variants.word_counts(empty)).count() == 0
    assert {tuple(r) for r in variants.variant_groups(variants.word_counts(odd)).collect()} == _variants(_words(rows))


def test_variants_of_dense_words(spark):
    r = random.Random(2)
    counts = {"".join(r.choice("abÀé") for _ in range(r.randrange(5, 8))): r.choice([3, 6, 12, 24, 48]) for _ in range(700)}
    counts |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "z" * 3000: 5, "z" * 3001: 10}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(x) for x in variants.variant_groups(table).collect()} == _variants(counts)


def test_words_of_long_texts(spark):
    text = "abcde " * 200_000 + "fghij" * 200_000
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {tuple(r) for r in variants.word_counts(table, damage=0, least_count=1).collect()} == {("abcde", 200_000), ("fghij" * 200_000, 1)}


# Pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_of_the_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.queries()["op13_sentencepiece"](spark, SF).collect()
    want = {i: library.encode(t, add_eos=True) for i, t in texts.items()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(texts)
    assert {tuple(r) for r in got} == {(i, len(w), digest(" ".join(map(str, w))), digest(library.decode(w))) for i, w in want.items()}


def test_pieces_of_odd_texts(spark, odd, empty, library):
    rows = odd.collect()
    coded = pieces.encode(odd)
    got = Counter((r.doc_id, tuple(r.ids)) for r in coded.collect())
    assert got == Counter((r.doc_id, tuple(library.encode(r.text or "", add_eos=True))) for r in rows)
    assert Counter((r.doc_id, r.text) for r in pieces.decode(coded).collect()) == Counter((r.doc_id, r.text or "") for r in rows)
    assert pieces.encode(empty).count() == 0 and pieces.decode(pieces.encode(empty)).count() == 0
    assert {tuple(r.ids) for r in pieces.encode(odd.where("text is null"), end=False).collect()} == {()}
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decode(nothing).collect()] == [None]


ALPHABETS = [
    ["▁", " ", "  ", "a", "e", "t", "the", "in", "0", "1", "é", "ß", "日", "本", "\n", "\t", "\x00", "🙂", "ment", "ing", "aaa", "--", "==", "<s>", "</s>", "<0x41>", "́", "ب", "и"],
    ["a", "a", "b", " "],
    [chr(c) for c in [*range(32, 127), *range(0xA0, 0x180), *range(0x400, 0x450), *range(0x4E00, 0x4E80), *range(0x1F600, 0x1F640)]],
]


@pytest.mark.parametrize("alphabet", range(len(ALPHABETS)))
def test_pieces_of_random_texts(model, library, alphabet):
    r = random.Random(alphabet)
    texts = ["".join(r.choice(ALPHABETS[alphabet]) for _ in range(r.randrange(80))) for _ in range(4000)]
    assert_pieces(model, library, texts)


def test_pieces_of_long_words_and_blanks(model, library):
    r = random.Random(4)
    texts = [" " * n for n in range(70)] + [" " * 5000 + "x", "a" * 20_000, "ab" * 9000, "=" * 9999, "".join(r.choice("abcdefgh0123") for _ in range(30_000)), "x y " * 300_000, None, "", "\n" * 900 + " " * 900]
    assert_pieces(model, library, texts)


def assert_pieces(model, library, texts):
    ids, counts = model.encode(texts)
    at = np.cumsum(np.append(0, counts))
    for k, text in enumerate(texts):
        want = library.encode(text or "")
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert model.decode(np.array(want, int)) == library.decode(want)


def test_any_ids_are_decoded_like_the_library(model, library):
    r = random.Random(6)
    for _ in range(3000):
        ids = [r.choice([0, 1, 2, 3 + r.randrange(256), 3 + r.randrange(128, 256), 259, 29871, r.randrange(260, 32000)]) for _ in range(r.randrange(9))]
        assert model.decode(np.array(ids, int)) == library.decode(ids)


# Near-copied stretches inside lines


@pytest.mark.parametrize("length,changes,ended,least_pairs,least_words", [(60, 1, True, 0.95, 0.95), (90, 1, True, 0.95, 0.95), (160, 3, False, 0.9, 0.5), (200, 2, True, 0.9, 0.6), (30, 0, True, 0.95, 0.95)])
def test_near_copied_stretches_inside_lines(spark, length, changes, ended, least_pairs, least_words):
    """Pairs of one-line texts with a stretch in common that differs by a few words, its place known here and not to the code."""
    draw = random.Random(length)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(4, 9)))
    sentences = lambda: " ".join(" ".join(word() for _ in range(draw.randrange(9, 20))) + "." for _ in range(5))
    rows, spans = [], {}
    for pair in range(40):
        stretch = [word() for _ in range(length)]
        for copy in (0, 1):
            mine = list(stretch)
            for k in range(changes if copy else 0):
                mine[(k + 1) * length // (changes + 1)] = word()
            if ended:
                mine[-1] += "."
            before = sentences()
            spans[2 * pair + copy] = (len(before.split()), length)
            rows.append((2 * pair + copy, " ".join([before, *mine, sentences()])))
    found = passages.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()
    out = {d: set() for d in spans}
    for r in found:
        out[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    held = {d: set(range(a, a + n)) for d, (a, n) in spans.items()}
    shares = [len((out[2 * p] & held[2 * p]) | (out[2 * p + 1] & held[2 * p + 1])) / length for p in range(40)]
    print(length, changes, sum(s > 0 for s in shares) / 40, sum(shares) / 40)
    assert sum(s > 0 for s in shares) >= least_pairs * 40 and sum(shares) >= least_words * 40
    assert sum(len(out[d] - held[d]) for d in out) <= 0.02 * 40 * length


# Licences of named holders and programs, in texts that are not taken from the module

_TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_END = """
THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
_THIRD = """{mark} Neither the name of {who} nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""
_CASES = [
    *[("BSD-3-Clause", _TWO + _THIRD.format(mark="3.", who=who) + _END.format(who="THE REGENTS AND CONTRIBUTORS")) for who in ("the University", "Google Inc.", "the copyright holder", "Sun Microsystems, Inc.", "Willow Garage")],
    ("BSD-3-Clause", _TWO + "3. The name of John Doe may not be used to endorse or promote products derived from this software without specific prior written permission.\n" + _END.format(who="JOHN DOE")),
    ("BSD-2-Clause", _TWO + _END.format(who="THE FREEBSD PROJECT")),
    ("BSD-4-Clause", _TWO + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software developed by the University of California.\n" + _THIRD.format(mark="4.", who="the University") + _END.format(who="THE REGENTS")),
    ("GPL-3.0-or-later", "Foobar is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "/* GNU Zed is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */"),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\npackage main"),
    ("MIT", "# SPDX-License-Identifier: MIT\nimport os"),
    ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0 */\n#include <a.h>"),
    ("", "The name of the town is free software of a kind, as is the river."),
]


def test_licences_of_named_holders(spark):
    from geoloom.llm import licences

    rows = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(_CASES)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan_licences(rows).collect()}
    assert [got[i] for i in range(len(_CASES))] == [name for name, _ in _CASES]
