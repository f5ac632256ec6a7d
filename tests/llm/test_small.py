"""Each operator on small odd tables: defined results for nulls, empty, long and repeated texts, ties and clashing names."""

import itertools
import random
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import decontamination, fixity, langid, licences, minhash, packing, passages, quality, sharding, simhash, toxicity
from geoloom.llm import runs as runs_
from geoloom.llm import words as words_
from tests.llm.conftest import PROSE, make


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_language_id(spark, odd, empty):
    model = langid.fit_languages(odd)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "fr"), (6, "und"), (8, "en"), (None, "de"), (None, "und")} <= got
    assert all(0 <= r.score <= 1 for r in langid.identify(odd, model).collect())
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit_languages(empty)).collect()} == {"und"}
    kept = langid.keep_identified(odd, odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 5, 8} and not {2, 3, 4, 6} & {r.doc_id for r in kept.collect()}


def _simhash(t):
    w = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, odd, empty):
    got = simhash.near_groups(odd).collect()
    assert len(got) == 11
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint & (1 << 64) - 1 == _simhash(texts[r.doc_id])
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in got if r.doc_id in (1, 8)} == {1}
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()].count(1) == 1 and 8 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("dense", [32, 1])
def test_links_of_dense_fingerprints(spark, dense):
    """Clusters of near fingerprints, directly and through hubs, against all pairs."""
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(4)]
    points = {c ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(5))}) for c in centres for _ in range(60)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), dense=dense).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    mine = {p: p for p in signed}

    def at(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for r in links:
        mine[max(at(r.a), at(r.b))] = min(at(r.a), at(r.b))
    assert all(at(p) == find(p) for p in signed)


@pytest.mark.parametrize("block,broadcast", [(4096, 500_000), (7, 500_000), (4096, 0)])
def test_decontamination(spark, odd, empty, monkeypatch, block, broadcast):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    passage = PROSE["en"][4:80]
    bench = _bench(spark, [(10, passage), (2, "word4998 word4999 word0 word1"), (None, "rivière traverse"), (3, ""), (4, None), (10, passage)])
    docs = odd.withColumn("__row", F.monotonically_increasing_id())
    got = {(r.doc_id, r.n_words): r for r in decontamination.contamination(docs, bench, "__row", ("doc_id",)).collect()}
    one = got[(1, 26)]
    assert one.n_items == 1 and one.contaminated and one.n_hit >= 10 and one.hit_spans[0].first == 1
    assert got[(7, 60_000)].n_hit == 4 * 11 and got[(5, 27)].n_hit == 2
    assert not got[(2, 0)].contaminated and got[(2, 0)].items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert {r.doc_id for r in decontamination.drop_contaminated(odd, bench).collect()} == {2, 3, 4, 6, None}
    assert decontamination.drop_contaminated(odd, bench).columns == odd.columns
    assert decontamination.drop_contaminated(odd, bench.limit(0)).count() == 11 and decontamination.drop_contaminated(empty, bench).count() == 0


def test_packing_is_a_round_trip_without_padding(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(odd).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for r in odd.collect():
        want = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[(r.doc_id, len(want))], key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in {(p.start): p for p in pieces}.values()])
        assert ids.tolist() == want
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, capacity=1000)


@pytest.mark.parametrize("text", ["a  b", "a \n b", "a\n \n b ", " lead", "x\t y", "tail ", "it's 12 o'clock\r\n\r\nnow", "<|endoftext|> é b", "日本 語  x"])
def test_words_have_the_ids_of_the_whole_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._with_added(packing._encoder(None), packing.added_tokens())
    assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_harmonic_classes_cut_little(spark):
    """Bins of class k hold k rests of that class and what closes them; documents are cut only to close a bin."""
    draw = random.Random(6)
    bins, rows, lengths = packing._Bins(64, 8, 0), [], [draw.randrange(1, 200) for _ in range(500)]
    for i, n in enumerate(lengths):
        rows += bins.add(i, np.arange(n, dtype="<u4"))
    rows += bins.rest()
    by_doc, by_sequence = {}, {}
    for doc_id, start, length, ids, n, sequence, offset in rows:
        by_doc.setdefault(doc_id, []).append((start, np.frombuffer(ids, "<u4")))
        by_sequence.setdefault(sequence, []).append((offset, length))
        assert n == lengths[doc_id] and length == len(ids) // 4
    assert all(np.concatenate([x for _, x in sorted(by_doc[i], key=lambda x: x[0])]).tolist() == list(range(n)) for i, n in enumerate(lengths))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    totals = [sum(n for _, n in parts) for parts in by_sequence.values()]
    assert all(t & (t - 1) == 0 and t <= 64 for t in totals) and sum(t < 64 for t in totals) <= 6
    assert len(rows) <= sum(n // 64 + 1 for n in lengths) + len(totals)


def test_sharding_moves_few_rows(spark, odd, empty):
    placed = sharding.assign_shards(spark.range(3000).withColumnRenamed("id", "doc_id"), 10).collect()
    moved = [r for r in placed if r.shard != r.grown_shard]
    assert all(r.grown_shard == 10 for r in moved) and 150 < len(moved) < 420
    heavy = sharding.assign_shards(spark.range(3000).withColumnRenamed("id", "doc_id"), 3, {0: 2.0}).collect()
    assert 1300 < sum(r.shard == 0 for r in heavy) < 1700
    again = sharding.with_slots(sharding.assign_shards(odd, 4), "shard", ["doc_id", "text"], 3, F.concat_ws("|", "doc_id", "text")).collect()
    for shard in {r.shard for r in again}:
        assert sorted(r.slot for r in again if r.shard == shard) == list(range(sum(r.shard == shard for r in again)))
    assert sharding.assign_shards(empty, 4).count() == 0
    hot = sharding.with_slots(spark.range(250_000).selectExpr("1 AS shard", "id % 2 * (id % 1000) AS doc_id"), "shard", ["doc_id"], 4, F.col("doc_id").cast("string"))
    assert hot.agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).first() == (0, 249_999, 250_000)


def test_licences(spark, odd, empty):
    texts = ["Foo bar Released under the MIT License. More", "x\nThis work is licensed under the GNU General Public License, version 3.\ny", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "the license of words", "", None, "All  rights   reserved."]
    got = {r.doc_id: r for r in licences.scan_licences(make(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i].licences for i in range(7)] == ["MIT", "GPL-3.0-only", "Apache-2.0", "", "", "", "LicenseRef-All-Rights-Reserved"]
    assert got[2].n_licence_sentences == 2 and got[5].n_licence_sentences == 0
    assert licences.scan_licences(empty).count() == 0
    own = odd.withColumns({"licences": F.lit("own"), "ids": F.lit("kept"), "c0": F.lit("kept")})
    assert {(r.licences, r.ids, r.c0) for r in licences.scan_licences(own).collect()} == {("", "kept", "kept")}


def _gnu(name, mark, version, work="program"):
    return f"This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{version}"


def test_whole_licence_texts(spark):
    """Public texts, on one line for each paragraph, wrapped, and wrapped in comments; in very long surroundings too."""
    later = "either version {} of the License, or (at your option) any later version."
    lc = licences
    cases = [
        ("MIT", "Copyright (c) 2020 A. N. Other\n\n" + lc.MIT),
        ("BSD-2-Clause", "Copyright (c) 2020, A. N. Other. All rights reserved.\n\n" + lc.BSD_CONDITIONS + "\n\n" + lc.BSD_DISCLAIMER),
        ("BSD-3-Clause", "Copyright (c) 2020, A. N. Other\nAll rights reserved.\n\n" + lc.BSD_CONDITIONS + "\n\n" + lc.BSD_NAMES + "\n\n" + lc.BSD_DISCLAIMER),
        ("ISC", lc.ISC), ("Apache-2.0", lc.APACHE), ("MPL-2.0", lc.MPL), ("Zlib", lc.ZLIB), ("Unlicense", lc.UNLICENSE), ("BSL-1.0", lc.BOOST),
        ("GPL-2.0-or-later", _gnu("GNU General Public License", ";", "; " + later.format(2))),
        ("GPL-2.0-only", _gnu("GNU General Public License", ";", "; version 2.")),
        ("GPL-3.0-or-later", _gnu("GNU General Public License", ":", ", " + later.format(3))),
        ("GPL-3.0-only", _gnu("GNU General Public License", ":", ", version 3 of the License.")),
        ("LGPL-2.1-or-later", _gnu("GNU Lesser General Public License", ";", "; " + later.format("2.1"), "library")),
        ("LGPL-3.0-only", _gnu("GNU Lesser General Public License", ":", ", version 3.", "library")),
        ("AGPL-3.0-or-later", _gnu("GNU Affero General Public License", ":", ", " + later.format(3))),
    ]
    rows, want = [], {}
    for licence, text in cases:
        wrapped = "\n".join("\n".join(textwrap.wrap(p, 62)) for p in text.split("\n"))
        commented = "\n".join(f" * {line}" for line in wrapped.split("\n"))
        for form in (text, wrapped, f"/*\n{commented}\n */\nint x;", "lorem ipsum dolor. " * 4000 + "\n\n" + wrapped):
            want[len(rows)] = licence
            rows.append((len(rows), form, None))
    got = {r.doc_id: r.licences for r in licences.scan_licences(make(spark, rows)).collect()}
    assert got == want
    assert all(any(c in s for c in licences.CUES) for s in [*licences.SENTENCES, *licences.SHORT])


def test_quality(spark, odd, empty):
    lines = "a b c d e f g h\na b c d e f g h\n\n  \n# x | y"
    docs = make(spark, [(1, PROSE["en"], "en"), (2, None, None), (3, "", None), (4, lines, None), (5, " ".join(["tick tock"] * 40), None), (1, PROSE["en"], "en")])
    labels = _labels(spark, [(1, 1, 0), (1, 1, 0), (None, 1, 0), (5, 0, 0)])
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert (got[4].n_words, got[4].n_dup_lines, got[4].n_symbols, got[4].n_repeat_words, got[4].word_chars) == (20, 1, 2, 16, 20)
    assert got[5].n_repeat_words == 80 and got[5].base_failed and not got[5].kept
    assert got[1].kept and got[2].base_failed and got[3].n_words == 0
    assert quality.quality_rules(empty, labels).count() == 0
    none = {r.doc_id: r for r in quality.quality_rules(docs, labels.limit(0)).collect()}
    assert none[1].score == 0 and none[1].kept


@pytest.mark.parametrize("seed", range(3))
def test_repeated_words_against_brute_force(spark, seed):
    draw = random.Random(seed)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(60))) for _ in range(40)]
    got = {r.doc_id: r.n_repeat_words for r in quality.base_counts(quality.with_grams(make(spark, [(i, t, None) for i, t in enumerate(texts)]))).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        assert got[i] == len({p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 8)})


def test_fixity(spark):
    rows = [(i, f"u{i}", "x" * i) for i in range(50)] + [(7, "u7", "x" * 7)] * 30 + [(None, None, None), (51, "u51", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    leaves = fixity.manifest(pages, ["page_id", "url"], ["url", "html"], archive_records=8)
    assert leaves.count() == 52 and leaves.where("copies = 31").count() == 1
    assert fixity.locate(leaves, leaves, 2).count() == 0
    bad = leaves.withColumn("digest", F.when(F.col("page_id") == 3, F.lit("0")).otherwise(F.col("digest"))).where("page_id is null or page_id <> 9")
    assert {(r.page_id, r.issue) for r in fixity.locate(leaves, bad, 2).collect()} == {(3, "changed"), (9, "missing")}
    assert {r.issue for r in fixity.locate(bad, leaves, 2).collect()} == {"changed", "surplus"}
    assert fixity.locate(leaves.limit(0), leaves.limit(0)).count() == 0


def test_toxicity(spark, odd, empty):
    draw = random.Random(1)
    vocabulary = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(300):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(3, 60))]
        if i % 3 == 0:
            words[draw.randrange(len(words))] = f"grobol{draw.choice(['ak', 'en', 'ist', 'um'])}"
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(i % 3 == 0)))
    learn = make(spark, rows[:200])
    model = toxicity.fit_toxicity(learn, _labels(spark, labels[:200] + [(None, 1, 1), (5, None, None)]), langid.fit_languages(learn))
    got = {r.doc_id: r for r in toxicity.score_toxicity(make(spark, rows[200:]), model).collect()}
    assert sum((r.predicted == 1) == (i % 3 == 0) for i, r in got.items()) >= 95
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    out = toxicity.score_toxicity(odd, model).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.text in (None, "")}) == 1
    assert toxicity.score_toxicity(empty, model).count() == 0
    unlearned = toxicity.fit_toxicity(learn, _labels(spark, []), langid.fit_languages(learn))
    assert {r.predicted for r in toxicity.score_toxicity(odd, unlearned).collect()} == {0}


def test_toxicity_learns_from_all_labelled_texts(spark):
    """However many they are: shards hold every labelled text once, and the model of many shards tells the held-out texts apart."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(draw.choices(words, k=30) + (["vile", f"slur{k % 7}"] if k % 4 == 0 else [])), "en") for k in range(900)]
    docs, marks = make(spark, rows), [(k, 1, int(k % 4 == 0)) for k in range(700)]
    texts = toxicity.labelled_texts(docs, _labels(spark, marks))
    got = texts.collect()
    assert len(got) == 700 and sum(r.toxic for r in got) == 175 and sum(r.apart for r in got) == 140
    model = toxicity.fit_toxicity(docs, _labels(spark, marks), langid.fit_languages(docs), shard_documents=90)
    found = {r.doc_id: r.predicted for r in toxicity.score_toxicity(make(spark, rows[700:]), model).collect()}
    assert sum(found[k] == int(k % 4 == 0) for k in found) >= 190
    seen = np.zeros((2, toxicity.VOCABULARY))
    for r in got:
        if not r.apart:
            seen[r.toxic, np.unique(toxicity.word_rows(sorted(set(toxicity.text_words(r.text))))[0])] += 1
    whole, sharded = toxicity.ConvolutionalClassifier.start(), toxicity.ConvolutionalClassifier.start()
    n = np.array([sum(not r.apart and r.toxic == t for r in got) for t in (0, 1)])
    whole.associate(seen, n)
    learn = texts.where("not apart").select(F.pmod("h", F.lit(7)).alias("shard"), "h", "toxic", "text").repartition(7, "shard").sortWithinPartitions("shard", "h")
    toxicity._train(sharded, learn, n, 7)
    still = ~seen.any(axis=0)
    assert np.array_equal(whole.embeddings[still], sharded.embeddings[still]) and np.abs(whole.embeddings - sharded.embeddings)[~still].max() < 0.5



def _sentence(draw, n=12):
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("crowded", [64, 2])
def test_passages(spark, monkeypatch, crowded):
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    draw = random.Random(5)
    passage = " ".join(_sentence(draw) for _ in range(6))
    edited = passage.split()
    edited[30] = "changed"
    docs, clean = [], []
    for i in range(12):
        own = [_sentence(draw) for _ in range(5)]
        if i % 2:
            body = passage if i % 4 == 1 else " ".join(edited)
            docs.append((i, f"{own[0]} begins w1 w2 {body} and goes on. {own[1]} {own[2]}", "en"))
        else:
            clean.append(i)
            docs.append((i, " ".join(own), "en"))
    docs += [(50, None, None), (51, "", None), (52, "short text", None), (None, passage, None), (1, docs[1][1], "en")]
    table = make(spark, docs)
    got = passages.repeated_paragraphs(table).collect()
    assert {r.doc_id for r in got} == {1, 3, 5, 7, 9, 11, None}
    assert {r.doc_id for r in got if not r.removed} == {1, 3}
    left = {r.doc_id: r.text for r in passages.drop_repeated_passages(table).collect()}
    texts = {i: t for i, t, _ in docs}
    assert all(left[i] == texts[i] for i in clean) and left[1] == texts[1] and left[50] is None and left[52] == "short text"
    assert all(len(left[i].split()) < len(texts[i].split()) - 40 for i in (5, 9))
    assert passages.drop_repeated_passages(table).columns == table.columns
    assert passages.drop_repeated_passages(table.limit(0)).count() == 0 and passages.repeated_paragraphs(table.limit(0)).count() == 0


def test_similarity_is_exact():
    a, b = np.arange(10, dtype="<u4"), np.arange(1, 11, dtype="<u4")
    assert minhash.jaccard_reaches(a, b, 0.8) and not minhash.jaccard_reaches(a, b, 0.82)
    assert minhash.jaccard_reaches(a[:8], a, 0.8) and not minhash.jaccard_reaches(a[:7], a, 0.8)
    assert zlib.crc32(a.tobytes()) != zlib.crc32(b.tobytes())


def test_runs_of_fifty_words_against_brute_force(spark):
    """Passages in mid-sentence and in short lines, nested, periodic and whole, against all windows of 50 words.

    Nothing that stands nowhere else goes; of each run, only words at its ends may stay.
    """
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(9000)}"
    passages_ = [[word() + draw.choice(["", "", "", ".", "\n"]) for _ in range(n)] for n in (52, 60, 80, 120)]
    passages_.append([word() + ("\n" if k % 4 == 3 else "") for k in range(55)])
    rows = []
    for i in range(40):
        own = [word() + draw.choice(["", "", "", ",", "."]) for _ in range(draw.randrange(5, 90))]
        put = draw.randrange(len(own))
        p = passages_[i % 5] if i % 3 else passages_[3][20:90]
        rows.append((i if i % 7 else None, " ".join(own[:put] + p + own[put:]), "en"))
    rows += [(60, rows[1][1], "en"), (61, "tick tock " * 90, "en"), (62, None, None), (63, "few words", None), (1, rows[1][1], "en")]
    table = make(spark, rows)
    found = runs_.repeated_runs(table).where("removed").collect()
    keys = {(r.doc_id, r.text): r.k for r in table.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()}
    order = sorted({(i is None, i or 0, keys[i, t], t) for i, t, _ in rows if t})
    first, seen, repeated, stayed = {}, {}, 0, 0
    for doc, (_, _, key, text) in enumerate(order):
        words = text.lower().split()
        gone = set()
        for p in range(len(words) - 49):
            d, f = first.setdefault(tuple(words[p : p + 50]), (doc, p))
            if (d, f) != (doc, p):
                gone |= set(range(max(p, f + 50) if d == doc else p, p + 50))
        out = {k for r in found if r.row_key == key for k in range(r.first_word, r.first_word + r.n_words)}
        grams = [tuple(words[p : p + runs_.GRAM]) for p in range(len(words) - runs_.GRAM + 1)]
        elsewhere = {k for p, g in enumerate(grams) for k in range(p - 20, p + runs_.GRAM + 20) if seen.setdefault(g, (doc, p)) != (doc, p)}
        assert out <= elsewhere
        for _, part in itertools.groupby(sorted(gone), lambda k, c=itertools.count(): k - next(c)):
            part = list(part)
            stay = [k for k in part if k not in out]
            assert all(k < part[0] + runs_.WINDOW or k > part[-1] - runs_.WINDOW for k in stay)
            repeated, stayed = repeated + len(part), stayed + len(stay)
    assert repeated > 2000 and stayed < 0.06 * repeated
    left = {r.doc_id: r.text for r in passages.drop_repeated_passages(table).collect()}
    assert 60 not in left and left[63] == "few words"


def test_paragraphs_keep_every_word():
    text = "one two three.\nfour\n five six seven eight nine ten.\n\n" + " ".join(f"v{i}" for i in range(200)) + ". end\nlast words\n"
    hashes, bounds, ends = words_.word_hashes(["", text, None, " \n ", text], sentences=True)
    assert bounds.tolist() == [0, 0, 213, 213, 213, 426] and hashes[:213].tolist() == hashes[213:].tolist()
    own = passages.paragraphs_of(hashes, ends, 0, 213)
    assert own[0] == (0, 10) and own[-1][1] == 213 and len(own) > 4 and all(a[1] == b[0] for a, b in itertools.pairwise(own)) and all(b - a >= passages.MIN_WORDS for a, b in own)
    assert passages.paragraphs_of(hashes, ends, 213, 426) == [(a + 213, b + 213) for a, b in own]
    assert passages.paragraphs_of(hashes, ends, 213, 213) == []
    assert len(set(hashes[:213].tolist())) == len(set(text.split()))
    assert words_.word_hashes([" x\u00a0TWO\u2003three "])[0].tolist() == words_.word_hashes(["X", "two three"])[0].tolist()


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = "one two " * 30 + "x" * 50 + " three"
    whole = words_.word_hashes([text])[0]
    monkeypatch.setattr(words_, "BLOCK", 20)
    assert words_.word_hashes([text])[0].tolist() == whole.tolist() and words_.word_hashes([None])[0].size == 0
    assert words_.grams(whole, 3)[0] == words_.grams(whole, 3)[2] != words_.grams(whole, 3)[1]


def test_words_are_cut_with_their_white_space():
    text = " a b  c\n\nd e"
    assert passages.without_words(text, [(1, 2)]) == " a d e" and passages.without_words(text, [(0, 3), (1, 1), (4, 1)]) == " d "
    assert passages.without_words(text, [(0, 5)]) == " "


@pytest.mark.parametrize("doc_id", [7, None])
def test_one_text_of_a_shared_doc_id_keeps_the_passage(spark, doc_id):
    draw = random.Random(2)
    passage = " ".join(_sentence(draw) for _ in range(3))
    table = make(spark, [(doc_id, f"{passage}\n{_sentence(draw)}", "en") for _ in range(4)])
    got = passages.similar_paragraphs(table, 0.8, 20).collect()
    # Each of the three sentences is a paragraph; the text that keeps one keeps all.
    assert len(got) == 12 and len({r.class_id for r in got}) == 3
    kept = [r for r in got if not r.removed]
    assert len(kept) == 3 and len({r.class_id for r in kept}) == 3 and len({r.row_key for r in kept}) == 1
    assert len({r.row_key for r in got if not r.removed}) == 1
    assert sum(passage in r.text for r in passages.drop_repeated_passages(table).collect()) == 1


def test_near_copies_of_four_fifths_go(spark):
    """Edited copies about the threshold, against the Jaccard of all pairs."""
    draw = random.Random(4)
    texts = []
    for _ in range(25):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(60, 160))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4):
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(4000)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    kept = {r.doc_id for r in simhash.drop_near_copies(make(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert len(set(root)) < 90 and kept == set(root)


def test_added_tokens_have_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> é b", "one <|endoftext|>two  <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "a b"]
    rows = packing.pack(make(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    for i, t in enumerate(texts):
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def _prose(draw, lang, n):
    return " ".join(draw.choice(PROSE[lang].split()) for _ in range(n))


def test_languages_reject_what_is_of_none(spark):
    """Noise of 200 characters and more goes, and so do foreign scripts; short and long prose stays."""
    draw = random.Random(8)
    learn = make(spark, [(i, _prose(draw, lang, draw.randrange(8, 200)), lang) for i in range(600) for lang in PROSE])
    model = langid.fit_languages(learn)
    noise = ["".join(draw.choice(s) for _ in range(n)) for n in (200, 2000) for s in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789abcdef", "бвгджзклмнпрстфхцчшщ аеиоу", "的一是不了人我在有他这中大来上") for _ in range(20)]
    assert sum(r[2] for r in model.predict(noise)) == len(noise)
    clean = [_prose(draw, lang, n) for lang in PROSE for n in (5, 12, 40, 150) for _ in range(25)]
    assert sum(r[2] for r in model.predict(clean)) <= 0.04 * len(clean)


def test_a_language_of_few_texts_is_learned(spark):
    """Many rows of few texts: each language has its different texts, once each."""
    rows = [(i, f"{PROSE['de']} {i % 3}", "de") for i in range(3000)] + [(i, f"{PROSE['en']} {i}", "en") for i in range(300)]
    model = langid.fit_languages(make(spark, rows), most=20)
    assert model.languages == ["de", "en"] and [r[0] for r in model.predict([PROSE["de"], PROSE["en"]])] == ["de", "en"]


CLASHING = {"Score": "a", "__words": "b", "__Ones": "c", "_draws": "d", "draws": "e", "own_1": "f", "Rejected": "g", "LANG_PRED": "h", "__own_Score": "i"}


@pytest.mark.parametrize("name", ["keep_identified", "quality_rules", "assign_shards"])
def test_clashing_names_in_any_letter_case_stay(spark, name):
    docs = make(spark, [(i, PROSE[k], k) for i, k in enumerate(("en", "de", "fr") * 3)] + [(20, None, None), (None, "12", "en")])
    odd = docs.select("doc_id", "text", "lang", *[F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c, v in CLASHING.items()])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    out = {"keep_identified": lambda: langid.keep_identified(odd, odd), "quality_rules": lambda: quality.quality_rules(odd, labels), "assign_shards": lambda: sharding.assign_shards(odd, 4)}[name]()
    # quality_rules has a result named score, which takes the place of the caller's.
    kept = [c for c in CLASHING if not (name == "quality_rules" and c == "Score")]
    assert [c for c in out.columns if c in kept] == kept
    rows = out.select("doc_id", *kept).collect()
    assert all(r[c] == CLASHING[c] + ("null" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in kept)
    assert len(rows) == (9 if name == "keep_identified" else 11)
    plain = {"keep_identified": lambda: langid.keep_identified(docs, docs), "quality_rules": lambda: quality.quality_rules(docs, labels), "assign_shards": lambda: sharding.assign_shards(docs, 4)}[name]()
    results = {"keep_identified": [], "quality_rules": ["score", "kept", "n_words"], "assign_shards": ["shard", "grown_shard"]}[name]
    assert sorted(map(str, out.select("doc_id", *results).collect())) == sorted(map(str, plain.select("doc_id", *results).collect()))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95, 1.0])
def test_links_of_crowded_blocks_join_what_all_pairs_join(similarity):
    draw = np.random.default_rng(int(similarity * 100))
    for _ in range(60):
        seeds = [np.unique(draw.integers(0, 400, draw.integers(1, 40))) for _ in range(6)]
        sets = []
        for _ in range(int(draw.integers(1, 50))):
            s = seeds[draw.integers(len(seeds))]
            s = np.union1d(s[draw.random(len(s)) > draw.choice([0, 0.05, 0.3])], draw.integers(0, 400, draw.integers(0, 3)))
            sets.append(s if len(s) else np.array([7]))
        own = draw.integers(0, draw.integers(1, 3), len(sets))
        mixed = len(set(own.tolist())) < 2
        pairs = [(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if (mixed or own[x] != own[y]) and len(np.intersect1d(sets[x], sets[y])) >= similarity * len(np.union1d(sets[x], sets[y]))]

        def groups(links, n=len(sets)):
            label = list(range(n))
            for a, b in links:
                label = [label[b] if v == label[a] else v for v in label]
            return {frozenset(i for i in range(n) if label[i] == v) for v in label}

        links = minhash.forest_links(sets, own, similarity)
        assert groups(links) == groups(pairs) and {tuple(sorted(p)) for p in links} <= set(pairs)
        assert len(links) == len(sets) - len(groups(pairs))


def test_candidates_of_near_copies_are_fingerprints(spark, monkeypatch):
    """Without MinHash bands, texts whose fingerprints link still meet, and are held to the exact Jaccard."""
    draw = random.Random(8)
    base = [f"w{draw.randrange(4000)}" for _ in range(1500)]
    copy = base[:700] + ["changed"] + base[701:]
    loop = ["x", "y", "z"] * 400
    texts = [" ".join(base), " ".join(copy), " ".join(base[:-1]), " ".join(loop), " ".join(loop + [f"v{k}" for k in range(30)])]
    prints = [simhash.fingerprint(t.encode()) & (1 << 64) - 1 for t in texts]
    bits = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    assert min(bits(0, 1), bits(0, 2), bits(1, 2)) <= 3 and bits(3, 4) <= 3
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    pairs = simhash._print_pairs(simhash._named(make(spark, rows).select("doc_id", "text")).select("h", "fp").distinct()).collect()
    assert len(pairs) >= 2
    whole = simhash._whole_texts
    monkeypatch.setattr(simhash, "_whole_texts", lambda docs, full: whole(docs, full) if full else whole(docs, full).where("false"))
    kept = {r.doc_id for r in simhash.drop_near_copies(make(spark, rows)).collect()}
    assert {3, 4} <= kept and len(kept) < len(texts)
