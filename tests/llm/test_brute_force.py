"""Registered queries and pipeline stages that SQL can't express, over whole tables, against plain Python versions."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from geoloom.llm import langid, passages, quality, registry, runs, toxicity
from geoloom.llm.words import word_hashes

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    rows = docs.select("doc_id", "text").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text for r in rows}


def query(spark, name):
    return registry.queries()[name](spark, SF).collect()


def components(names, linked):
    """The smallest name that each name reaches, from all pairs."""
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(names, 2):
        if linked(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in names}


def shingles(words):
    return {tuple(words[p : p + 5]) for p in range(len(words) - 4)}


def similar(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


# Substring dedup


def cut_paragraphs(text):
    """(first word, its words) of each paragraph: sentences and lines, those of under MIN_WORDS words joined to the one before, the first ones to the next; long ones cut by word hashes."""
    out, first = [], 0
    for words in (piece.lower().split() for piece in re.split(r"(?<=[.!?])\s+|\n", text or "")):
        if out and (len(words) < passages.MIN_WORDS or len(out[-1]) < passages.MIN_WORDS):
            out[-1] = out[-1] + words
        else:
            out.append(words)
    for words in out:
        begin = 0
        if len(words) > passages.LONG_WORDS:
            h, local = word_hashes([" ".join(words)])[0].tolist(), passages.LOCAL
            for k in range(passages.MIN_WORDS - 1, len(h) - passages.MIN_WORDS):
                if h[k] < min(h[max(0, k - local) : k], default=2**64) and h[k] <= min(h[k + 1 : k + 1 + local], default=2**64):
                    yield first + begin, words[begin : k + 1]
                    begin = k + 1
        if len(words) - begin >= 5:
            yield first + begin, words[begin:]
        first += len(words)


def repeated_words(texts):
    """For each text, the words of 50-word windows that stand in an earlier text or earlier in it."""
    first, out = {}, {}
    for doc in sorted(texts):
        words = (texts[doc] or "").lower().split()
        out[doc] = set()
        for p in range(len(words) - 49):
            d, f = first.setdefault(tuple(words[p : p + 50]), (doc, p))
            if (d, f) != (doc, p):
                out[doc] |= set(range(max(p, f + 50) if d == doc else p, p + 50))
    return out


def test_substring_dedup(spark, texts):
    found = query(spark, "op1_substring_dedup")
    of = {(doc, first): tuple(words) for doc in texts for first, words in cut_paragraphs(texts[doc])}
    counted = Counter(of.values())
    tables = {words: shingles(words) for words in counted}
    classes = components(sorted(counted), lambda a, b: similar(tables[a], tables[b]))
    sizes = Counter(classes.values())
    repeated = {place for place, words in of.items() if counted[words] > 1 or sizes[classes[words]] > 1}
    want = set()
    for doc in texts:
        own = [(first in {f for d, f in repeated if d == doc}, doc, first, len(words)) for first, words in cut_paragraphs(texts[doc])]
        for hit, run in itertools.groupby(own, lambda x: x[0]):
            run = list(run)
            if hit and sum(n for *_, n in run) >= passages.PASSAGE_WORDS:
                want |= {(doc, first, n) for _, doc, first, n in run}
    got = {(r.doc_id, r.first_word, r.n_words): r for r in found if r.at is not None}
    assert want and got.keys() <= want and len(got) >= 0.99 * len(want)
    pairs = {(r.class_id, classes[of[r.doc_id, r.first_word]]) for r in got.values()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all(r.copies == counted[of[r.doc_id, r.first_word]] for r in got.values())
    out = {doc: set() for doc in texts}
    for r in found:
        if r.removed:
            out[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    total = left = 0
    for doc, gone in repeated_words(texts).items():
        for _, part in itertools.groupby(sorted(gone), lambda k, c=itertools.count(): k - next(c)):
            part = list(part)
            stay = [k for k in part if k not in out[doc]]
            assert all(k < part[0] + runs.WINDOW or k > part[-1] - runs.WINDOW for k in stay)
            total, left = total + len(part), left + len(stay)
    assert left <= 0.06 * total


# Language identification


def gram_counts(text, features):
    blanked = []
    for before, c in zip(" " + text.lower(), text.lower(), strict=False):
        if c.isalpha():
            blanked.append(ord(c))
        elif before.isalpha():
            blanked.append(32)
    code, seen, full = [32, *blanked, 32], Counter(), 1 << 32
    for n in (1, 2, 3):
        for p in range(len(code) - n + 1):
            h = code[p]
            for c, factor in zip(code[p + 1 : p + n], (0x9E3779B1, 0x85EBCA6B), strict=False):
                h = (h * factor + c) % full
            h = h * 0xC2B2AE35 % full
            seen[(h ^ h >> 15) % features] += 1
    return seen


def nearest_language(text, model):
    """Language, cosine and rejection by one dot product after another."""
    if not text or not any(c.isalpha() for c in text.lower()):
        return "und", 0.0, True
    seen = gram_counts(text, len(model.idf))
    vector = {p: math.log1p(n) * float(model.idf[p]) for p, n in seen.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    score, centroid = max((sum(v * float(row[p]) for p, v in vector.items()) / norm, -k) for k, row in enumerate(model.centroids))
    lang = int(model.of[-centroid])
    return model.languages[lang], min(1.0, max(0.0, score)), score < model.floors[lang, sum(sum(seen.values()) > n for n in langid.LENGTHS)]


def test_language_id(spark, docs, texts):
    found = {r.doc_id: r for r in query(spark, "op2_language_id")}
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    model = langid.fit_languages(docs.where(langid.remainder("doc_id", 4) != 2))
    for i, text in texts.items():
        lang, score, rejected = nearest_language(text, model)
        assert found[i].lang_pred == lang and abs(found[i].score - score) < 1e-4
        assert found[i].rejected == rejected


# SimHash near-dedup


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(UPPER).encode())
    hs = [xxhash.xxh64_intdigest(b" ".join(words[p : p + 3]), 42) for p in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_near_dedup(spark, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    groups = components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in query(spark, "op3_simhash_near_dedup")}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


# Packing


def check_packing(rows, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0, *[n for _, n in parts[:-1]]]))
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0


def test_harmonic_packing(spark, texts):
    check_packing(query(spark, "op5_harmonic_packing"), texts)


# Quality rules


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, signed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def text_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def hashed_grams(text):
    words = text_words(text)
    ones = [spark_hash(w) for w in words]
    return [h % quality.BUCKETS for h in [*ones, *[spark_hash(a, b) for a, b in itertools.pairwise(ones)], *[spark_hash(w[-2:], "$") for w in words]]]


def test_quality_rules(spark, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    trusted = {r.doc_id for r in labels if r.quality == 1}
    assert len(trusted) <= quality.TRUSTED_DOCUMENTS
    grams = {i: hashed_grams(t) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    base = math.log((sum(raw.values()) + quality.BUCKETS) / (sum(target.values()) + quality.BUCKETS))
    found = {r.doc_id: r for r in query(spark, "op8_quality_rules")}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        words, r = text_words(text), found[i]
        lines = [line for line in (text or "").split("\n") if text_words(line)]
        windows = Counter(tuple(words[p : p + 8]) for p in range(len(words) - 7))
        hit = {k for p in range(len(words) - 7) if windows[tuple(words[p : p + 8])] > 1 for k in range(p, p + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        score = sum(math.log((target[g] + 1) / (raw[g] + 1)) + base for g in grams[i]) / max(1, len(grams[i]))
        assert abs(r.score - score) < 1e-9 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


# Toxicity


def toxicity_score(text, model):
    """One filter at one place after another, in double precision."""
    c = model.classifier
    vectors = []
    for word in toxicity.text_words(text):
        rows, _ = toxicity.word_rows([word])
        vectors.append(c.embeddings[rows].astype(float).mean(axis=0))
    pooled = []
    for bank, bias in zip(c.banks, c.biases, strict=True):
        values = [np.einsum("wd,wdf->f", np.array(vectors[p : p + len(bank)]), bank.astype(float)) for p in range(len(vectors) - len(bank) + 1)]
        pooled.append(np.maximum(np.max(values, axis=0) + bias, 0))
    cut = model.cuts.get(model.languages.predict([text])[0][0], model.cuts[langid.UNDETERMINED])
    logit = float(np.concatenate(pooled) @ c.weights + c.bias) - cut + math.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def test_toxicity(spark, docs, texts):
    found = {r.doc_id: r for r in query(spark, "op10_toxicity")}
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(langid.remainder("doc_id", 3) != 1)
    learn = docs.select("doc_id", "text", "lang").where(langid.remainder("doc_id", 3) != 1)
    model = toxicity.fit_toxicity(learn, labels, langid.fit_languages(learn))
    for i in sorted(texts)[::4]:
        assert abs(found[i].score - toxicity_score(texts[i], model)) < 1e-3
    assert all(r.predicted == int(r.score >= 0.7) for r in found.values())


# Pipeline


def window_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    words = cut(text)
    wanted = {tuple(w[p : p + 10]) for w in map(cut, items) if w for p in range(max(1, len(w) - 9))}
    return any(tuple(words[p : p + n]) in wanted for n in {len(w) for w in wanted} for p in range(len(words) - n + 1))


def test_pipeline(spark, docs, texts):
    """Each stage on what its predecessor kept, then run() as a whole."""
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    told = stages["language_id"](spark, docs, SF)
    model = langid.fit_languages(docs)
    held = kept(told)
    assert held == {i: t for i, t in texts.items() if not nearest_language(t, model)[2]}

    unlike = stages["simhash_near_dedup"](spark, told, SF)
    words = {i: t.lower().split() for i, t in held.items()}
    tables = {i: shingles(w) for i, w in words.items()}
    groups = components(sorted(held), lambda a, b: words[a] == words[b] or similar(tables[a], tables[b]))
    single = kept(unlike)
    assert single == {i: held[i] for i in set(groups.values())}

    cut = stages["substring_dedup"](spark, unlike, SF)
    left = kept(cut)
    assert not any(repeated_words(left).values())
    own = Counter(g for i in single for g in {tuple(words[i][p : p + 5]) for p in range(len(words[i]) - 4)})
    alone = [i for i in single if len(words[i]) == len(set(words[i])) or all(own[g] == 1 for g in shingles(words[i])) and len(shingles(words[i])) == len(words[i]) - 4]
    assert alone and all(left[i] == single[i] for i in alone)
    assert all(not text or " ".join(text.split()) == " ".join(single[i].split()) or len(text) < len(single[i]) for i, text in left.items())

    pure = stages["benchmark_decontamination"](spark, cut, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = kept(pure)
    assert clean == {i: t for i, t in left.items() if not window_hits(t, items)}
    check_packing(corpus_pipeline.run(spark, SF).collect(), clean)
