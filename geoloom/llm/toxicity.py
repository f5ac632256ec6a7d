"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.llm.langid import UNDETERMINED, LanguageModel, fit_languages, remainder, small
from geoloom.session import ship_package, stored

#: Rows of the hashed embedding table. A word is the mean of its own row and those of its 4- and 5-letter stretches.
VOCABULARY = 1 << 16
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled documents and bytes of their texts that one worker learns from at a time, about; beyond it there are more shards.
SHARD_DOCUMENTS, SHARD_BYTES = 3000, 8_000_000
#: One in so many labelled documents of each label is kept apart to calibrate.
OUT_OF = 5
#: Passes over the texts that are learned from, and steps at least.
EPOCHS, STEPS = 4, 160
#: Texts of one step.
BATCH = 32
#: Embedding rows of one part of a model when shards are summed.
PART_ROWS = 2048
#: Logits of the texts kept apart are counted in steps of one over this, up to LOGITS.
GRID, LOGITS = 256, 30.0
#: Standard errors by which a word's share of the toxic texts is over that of the others, for a start value of 1.
STRENGTH = 8.0
#: What the share of clean texts over the cut weighs, against the share of toxic texts under it.
ALARM = 2.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Words whose vectors a worker keeps before it starts anew.
CACHED_WORDS = 150_000
#: Characters of the texts that are scored together (at least one text).
GROUP_CHARACTERS = 500_000
#: Words that are convolved at a time; blocks overlap by the widest filter.
BLOCK_WORDS = 16384

_WORD = re.compile(r"\w+")
_PAD = ""


def text_words(text: str | None) -> list[str]:
    """The text's lower-cased words, padded to the widest filter."""
    found = _WORD.findall((text or "").lower())
    return found + [_PAD] * (max(WIDTHS) - len(found))


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of all words, one word after another, and how many each has; row 0 is the padding's."""
    from xxhash import xxh64_intdigest

    own = np.array([1 + xxh64_intdigest(w) % (VOCABULARY - 1) if w else 0 for w in words], np.int64)
    sizes = np.array([len(w) + 1 for w in words])
    of = np.repeat(np.arange(len(words)), sizes)
    code = np.frombuffer("".join("<" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows, ofs = [own], [np.arange(len(words))]
    for n in (4, 5):
        h = np.zeros(max(0, len(code) - n + 1), np.uint32)
        for j in range(n):
            h = h * np.uint32(0x9E3779B1) + code[j : j + len(h)]
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inside = of[: len(h)] == of[n - 1 :]
        rows.append(1 + (h[inside] % np.uint32(VOCABULARY - 1)).astype(np.int64))
        ofs.append(of[: len(h)][inside])
    rows, ofs = np.concatenate(rows), np.concatenate(ofs)
    return rows[np.argsort(ofs, kind="stable")], np.bincount(ofs, minlength=len(words))


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every stretch, one after another."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class ConvolutionalClassifier:
    """Embeddings, one filter bank per width (width x dimensions x filters), its biases, and the output layer."""

    embeddings: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float

    @classmethod
    def start(cls, seed: int = 7) -> ConvolutionalClassifier:
        draw = np.random.default_rng(seed)
        table = draw.normal(0, 0.02, (VOCABULARY, DIMENSIONS)).astype(np.float32)
        table[0] = 0
        banks = [draw.normal(0, 0.4 / math.sqrt(w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        weights = draw.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        for k, bank in enumerate(banks):  # half of the filters begin with the first dimension, that of associate()
            bank[:, 0, : FILTERS // 2] = 1 / len(bank)
            weights[k * FILTERS : k * FILTERS + FILTERS // 2] = 1
        return cls(table, banks, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weights, 0.0)

    def associate(self, seen: np.ndarray, n: np.ndarray) -> None:
        """Start the first dimension of every embedding row by how much oftener the toxic texts have it, in standard errors.

        `seen` are the texts of each label that have a row, `n` the texts of each label.
        """
        n = np.maximum(1, n)[:, None]
        share = (seen.sum(axis=0) + 0.5) / (n.sum() + 1)
        z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[1] + 1 / n[0]))
        self.embeddings[:, 0] = np.clip(z / STRENGTH, -1, 1)
        self.embeddings[0] = 0

    def word_vectors(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.embeddings[rows], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None].astype(np.float32)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Word vectors under every slice of every bank: what a word adds to a filter at each of its places."""
        return np.concatenate([vectors @ bank[j] for bank in self.banks for j in range(len(bank))], axis=1)

    def pooled(self, places: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of every filter over the whole text, before ReLU, and where it begins."""
        best = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
        where = np.zeros(len(best), np.int64)
        for begin in range(0, max(1, len(places) - max(WIDTHS) + 1), BLOCK_WORDS):
            part = table[places[begin : begin + BLOCK_WORDS + max(WIDTHS) - 1]]
            column = 0
            for k, width in enumerate(WIDTHS):
                n = len(part) - width + 1
                total = part[:n, column : column + FILTERS].copy()
                for j in range(1, width):
                    total += part[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
                column += width * FILTERS
                at = total.argmax(axis=0)
                top = total[at, np.arange(FILTERS)] + self.biases[k]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                better = top > best[own]
                best[own] = np.where(better, top, best[own])
                where[own] = np.where(better, at + begin, where[own])
        return best, where

    def logit(self, places: np.ndarray, table: np.ndarray) -> float:
        return float(np.maximum(self.pooled(places, table)[0], 0) @ self.weights + self.bias)

    def train(self, texts: Iterable[list[str]], labels: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.003, batch: int = BATCH, seed: int = 11) -> None:
        """Adam on the logistic loss; `weight` is that of a text by its label. Through max pooling, only the words under each filter's best place learn."""
        known: dict[str, int] = {}
        numbered = [np.array([known.setdefault(w, len(known)) for w in t]) for t in texts]
        all_rows, sizes = word_rows(list(known))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        draw = np.random.default_rng(seed)
        params = {"w": self.weights, **{f"k{k}": b for k, b in enumerate(self.banks)}, **{f"b{k}": b for k, b in enumerate(self.biases)}}
        first, second = ({k: np.zeros_like(v) for k, v in {**params, "e": self.embeddings}.items()} for _ in range(2))
        bias_first = bias_second = 0.0
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(numbered))
            for begin in range(0, len(order), batch):
                chosen = order[begin : begin + batch]
                words, inverse = np.unique(np.concatenate([numbered[i] for i in chosen]), return_inverse=True)
                vectors = self.word_vectors(all_rows[_stretches(starts[words], sizes[words])], sizes[words])
                table = self.project(vectors)
                grads = {k: np.zeros_like(v) for k, v in params.items()}
                own = np.zeros_like(vectors)
                bias_grad, at = 0.0, 0
                for i in chosen:
                    places = inverse[at : at + len(numbered[i])]
                    at += len(places)
                    best, where = self.pooled(places, table)
                    active = np.maximum(best, 0)
                    error = float(_sigmoid(np.array(active @ self.weights + self.bias)) - labels[i]) * float(weight[int(labels[i])]) / len(chosen)
                    grads["w"] += error * active
                    bias_grad += error
                    back = error * self.weights * (best > 0)
                    for k, width in enumerate(WIDTHS):
                        g, begins = back[k * FILTERS : (k + 1) * FILTERS], where[k * FILTERS : (k + 1) * FILTERS]
                        grads[f"b{k}"] += g
                        for j in range(width):
                            read = places[begins + j]
                            grads[f"k{k}"][j] += vectors[read].T * g
                            np.add.at(own, read, (self.banks[k][j] * g).T)
                step += 1
                scale = rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    params[k] -= scale * first[k] / (np.sqrt(second[k]) + 1e-8)
                moved = np.flatnonzero(own.any(axis=1))
                n = sizes[words[moved]]
                rows, to = np.unique(all_rows[_stretches(starts[words[moved]], n)], return_inverse=True)
                by_row = np.zeros((len(rows), DIMENSIONS), np.float32)
                np.add.at(by_row, to, np.repeat(own[moved] / n[:, None], n, axis=0))
                first["e"][rows] += 0.1 * (by_row - first["e"][rows])
                second["e"][rows] += 0.001 * (by_row * by_row - second["e"][rows])
                self.embeddings[rows] -= scale * first["e"][rows] / (np.sqrt(second["e"][rows]) + 1e-8)
                self.embeddings[0] = 0
                bias_first += 0.1 * (bias_grad - bias_first)
                bias_second += 0.001 * (bias_grad**2 - bias_second)
                self.bias -= scale * bias_first / (math.sqrt(bias_second) + 1e-8)

    def logits(self, texts: list[str | None], cache: WordCache) -> np.ndarray:
        """The logit of every text; words are looked up in the worker's cache, group by group."""
        out, begin = [], 0
        while begin < len(texts):
            end, characters = begin, 0
            while end < len(texts) and (end == begin or characters + len(texts[end] or "") <= GROUP_CHARACTERS):
                characters += len(texts[end] or "")
                end += 1
            placed = cache.places([text_words(t) for t in texts[begin:end]], self)
            out += [float(np.maximum(self.pooled(p, cache.table)[0], 0) @ self.weights + self.bias) for p in placed]
            begin = end
        return np.array(out, np.float64)


class WordCache:
    """Projected vectors of the words met so far; started anew beyond CACHED_WORDS."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, FILTERS * sum(WIDTHS)), np.float32)

    def places(self, texts: list[list[str]], classifier: ConvolutionalClassifier) -> list[np.ndarray]:
        if len(self.known) > CACHED_WORDS:
            self.__init__()
        known, old = self.known, len(self.known)
        out = [np.array([known.setdefault(w, len(known)) for w in t]) for t in texts]
        if len(known) > old:
            new = list(known)[old:]
            if len(known) > len(self.table):
                self.table = np.concatenate([self.table[:old], np.zeros((len(known) * 2 - old, self.table.shape[1]), np.float32)])
            self.table[old : len(known)] = classifier.project(classifier.word_vectors(*word_rows(new)))
        return out


@dataclass
class ToxicityModel:
    """The classifier, a language model of texts, and for each language the logit that is to score THRESHOLD."""

    classifier: ConvolutionalClassifier
    languages: LanguageModel
    cuts: dict[str, float]

    def score(self, texts: list[str | None], cache: WordCache) -> np.ndarray:
        shift = math.log(THRESHOLD / (1 - THRESHOLD))
        cuts = [self.cuts.get(lang, self.cuts[UNDETERMINED]) for lang, _, _ in self.languages.predict(texts)]
        return _sigmoid(self.classifier.logits(texts, cache) - np.array(cuts, np.float64) + shift)


def _cut(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit between two neighbouring ones of the least sum of missed and, ALARM times, false shares; the middle of the widest of equal gaps.

    `x` are the different logits in order, `toxic` and `clean` the texts of each.
    """
    missed = np.concatenate(([0], np.cumsum(toxic))) / max(1, toxic.sum())
    alarms = ALARM * (1 - np.concatenate(([0], np.cumsum(clean))) / max(1, clean.sum()))
    edges = np.concatenate(([x[0] - 2], x, [x[-1] + 2]))
    best = np.flatnonzero(np.isclose(missed + alarms, (missed + alarms).min()))
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the vectors of each part over all shards, in order of the shards: `parts` are (part, shard, h, values) of 64-bit floats."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in small(batches, 16):
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(values.as_buffer(), np.float64)
                total[part] = total[part] + v if part in total else v.copy()
        for part, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["part", "values"])

    dealt = parts.repartition("part").sortWithinPartitions("part", "shard", "h").select("part", "values")
    return {r.part: np.frombuffer(r["values"], np.float64) for r in dealt.mapInArrow(added, "part int, values binary").collect()}


def _batch_of_parts(vectors: list[np.ndarray], shard: int, h: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(vectors)), pa.int32()), pa.array([shard] * len(vectors), pa.int64()), pa.array([h] * len(vectors), pa.int64()), pa.array([v.astype(np.float64).tobytes() for v in vectors], pa.binary())],
        ["part", "shard", "h", "values"],
    )


_PARTS = "part int, shard long, h long, values binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """`(shard, h of its first row, texts, labels)` of rows (shard, h, toxic, text) in order of the shards."""
    shard, first, texts, toxic = None, None, [], []
    for batch in small(batches, 64):
        for own, h, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != shard and texts:
                yield shard, first, texts, np.array(toxic)
                texts, toxic = [], []
            if not texts:
                shard, first = own, h
            texts.append(text)
            toxic.append(label)
    if texts:
        yield shard, first, texts, np.array(toxic)


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(h, toxic, text, apart)`: all rows of `docs` that `labels` marks, one for each doc_id; of each label, every OUT_OF-th in the order of a hash is kept apart.

    A document with several labels counts as toxic if one of them says so; of several texts under a doc_id, the least counts.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marked.hint("merge"), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("h"), "toxic", "text")
    rows = stored(rows.withColumn("bucket", F.shiftright("h", 56)))
    # The place of a row among those of its label: the rows in the buckets before its own, and those before it there.
    sizes = {(r.toxic, r.bucket): r["count"] for r in rows.groupBy("toxic", "bucket").count().collect()}
    before, total = [], {0: 0, 1: 0}
    for toxic, bucket in sorted(sizes):
        before.append((toxic, bucket, total[toxic]))
        total[toxic] += sizes[toxic, bucket]
    offsets = rows.sparkSession.createDataFrame(before, "toxic int, bucket long, before long") if before else rows.select("toxic", "bucket", F.lit(0).cast("long").alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("toxic", "bucket").orderBy("h", "text"))
    return rows.join(F.broadcast(offsets), ["toxic", "bucket"]).select("h", "toxic", "text", (place % OUT_OF == 0).alias("apart"))


def _train(classifier: ConvolutionalClassifier, learn: DataFrame, n: np.ndarray, shards: int) -> None:
    """Learn from all texts of `learn` (shard, h, toxic, text): one shard as it is, several by rounds.

    In each round the workers pass once over their shards from the same model. What they changed is averaged: by texts for
    the filters and the output layer, for an embedding row over the shards that moved it.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, h, texts, toxic in _shards(batches):
            seen = np.zeros((2, VOCABULARY))
            for text, label in zip(texts, toxic, strict=True):
                seen[label, np.unique(word_rows(sorted(set(text_words(text))))[0])] += 1
            yield _batch_of_parts(list(seen), shard, h)

    seen = _summed(learn.mapInArrow(counted, _PARTS))
    classifier.associate(np.array([seen[0], seen[1]]), n)
    weight = n.sum() / (2 * np.maximum(1, n))
    rounds, epochs = (EPOCHS, 1) if shards > 1 else (1, max(EPOCHS, -(-STEPS * BATCH // int(n.sum()))))
    for turn in range(rounds):

        def learned(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for shard, h, texts, toxic in _shards(batches):
                own = copy.deepcopy(classifier)
                own.train(map(text_words, texts), toxic.astype(np.float32), weight, epochs, seed=11 + turn)
                moved = own.embeddings.astype(np.float64) - classifier.embeddings
                touched = moved.any(axis=1, keepdims=True)
                rows = np.concatenate([moved, touched], axis=1)
                dense = np.concatenate([own.weights, [own.bias], *(b.ravel() for b in own.banks), *own.biases, [1.0]]) * len(texts)
                yield _batch_of_parts([*rows.reshape(-1, PART_ROWS * (DIMENSIONS + 1)), dense], shard, h)

        got = _summed(learn.mapInArrow(learned, _PARTS))
        rows = np.concatenate([got[k] for k in range(VOCABULARY // PART_ROWS)]).reshape(VOCABULARY, DIMENSIONS + 1)
        dense = got[VOCABULARY // PART_ROWS]
        dense = (dense / dense[-1])[:-1]
        classifier.embeddings = (classifier.embeddings + rows[:, :-1] / np.maximum(1, rows[:, -1:])).astype(np.float32)
        at = len(classifier.weights)
        classifier.weights, classifier.bias, at = dense[:at].astype(np.float32), float(dense[at]), at + 1
        for arrays in (classifier.banks, classifier.biases):
            for k, old in enumerate(arrays):
                arrays[k] = dense[at : at + old.size].reshape(old.shape).astype(np.float32)
                at += old.size


def fit_toxicity(docs: DataFrame, labels: DataFrame, languages: LanguageModel, shard_documents: int = SHARD_DOCUMENTS, shard_bytes: int = SHARD_BYTES) -> ToxicityModel:
    """Learn from all rows of `docs` that `labels` marks, dealt over shards of about `shard_documents` texts and `shard_bytes` bytes.

    The workers learn from their shards, and only sums of models and counts of logits come to the driver. The cut of each
    language, as `languages` reads it from the text, comes from the fifth of the rows that is not trained on (those of at
    least 10 of each label; else the cut over all). Without both labels, every score is that of a cut no text reaches.
    """
    ship_package(docs.sparkSession)
    classifier = ConvolutionalClassifier.start()
    found = {r.toxic for r in labels.where("toxic is not null and doc_id is not null").select((F.col("toxic") > 0).cast("int").alias("toxic")).distinct().collect()}
    if found != {0, 1}:
        return ToxicityModel(classifier, languages, {UNDETERMINED: 1e3})
    rows = stored(labelled_texts(docs, labels))
    sizes = {r.toxic: r for r in rows.where("not apart").groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    n = np.array([sizes[t].n if t in sizes else 0 for t in (0, 1)])
    if n.sum():
        shards = int(max(1, -(-int(n.sum()) // shard_documents), -(-sum(r.bytes for r in sizes.values()) // shard_bytes)))
        shard = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards))
        learn = rows.where("not apart").select(shard.alias("shard"), "h", "toxic", "text")
        learn = stored(learn.repartition(shards, "shard").sortWithinPartitions("shard", "h", "text"))
        _train(classifier, learn, n, shards)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            langs = pa.array([lang for lang, _, _ in languages.predict(texts)], pa.string())
            steps = np.round(np.clip(classifier.logits(texts, cache), -LOGITS, LOGITS) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([langs, batch.column(0), pa.array(steps, pa.int32())], ["lang", "toxic", "step"])

    logits = rows.where("apart").select("toxic", "text").mapInArrow(judged, "lang string, toxic int, step int")
    steps = logits.groupBy("lang", "step").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).collect()

    def counts(lang: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by_step: dict[int, np.ndarray] = {}
        for r in steps:
            if lang is None or r.lang == lang:
                by_step[r.step] = by_step.get(r.step, 0) + np.array([r.toxic, r.clean])
        both = np.array([by_step[k] for k in sorted(by_step)])
        return np.array(sorted(by_step)) / GRID, both[:, 0], both[:, 1]

    cuts = {UNDETERMINED: _cut(*counts(None)) if steps else 0.0}
    for lang in sorted({r.lang for r in steps}):
        own = counts(lang)
        if min(own[1].sum(), own[2].sum()) >= 10:
            cuts[lang] = _cut(*own)
    return ToxicityModel(classifier, languages, cuts)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from THRESHOLD), from the whole text alone.

    A null or empty text is scored like padding; ties and repeated rows get equal scores; an empty table gives none;
    other columns stay, unless they bear these names.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for batch in small(batches):
            scores = model.score(batch.column(at).to_pylist(), cache)
            predicted = pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), predicted], [*names, "score", "predicted"])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("score double, predicted int").fields])
    return docs.mapInArrow(scored, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels of documents of remainder 1 take no part in learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", remainder("doc_id", 3) == 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 3) != 1)
    learn = held.where("not held_out")
    model = fit_toxicity(learn, labels, fit_languages(learn))
    return score_toxicity(held.select("doc_id", "held_out", "text"), model).drop("text")
