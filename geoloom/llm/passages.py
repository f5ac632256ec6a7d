"""Substring dedup: passages that repeat across documents, by MinHash banding of paragraphs and the exact runs beside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.llm.minhash import SHINGLE, SIMILARITY, marks, shingles, similar_links
from geoloom.llm.runs import repeated_runs
from geoloom.llm.words import range_hashes, sliced, together, word_hashes
from geoloom.operators.components import connected_components
from geoloom.session import ship_package, stored

#: Shorter sentences and lines are joined with their neighbours; a text of fewer than SHINGLE words has no paragraph.
MIN_WORDS = 8
#: Longer ones are cut after words whose hash is the least of LOCAL words on either side.
LONG_WORDS, LOCAL = 96, 12
#: Words of a run of repeated paragraphs from which it is a passage.
PASSAGE_WORDS = 20


def local_cuts(words: np.ndarray) -> np.ndarray:
    """Places in a long sentence (word hashes) at which it is cut: whether one is a cut hangs on LOCAL words on either side alone."""
    n, most = len(words), np.full(LOCAL, 2**64 - 1, np.uint64)
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate((most, words, most)), LOCAL).min(axis=1)
    least = (words < near[:n]) & (words <= near[LOCAL + 1 :])
    return np.flatnonzero(least[MIN_WORDS - 1 : n - MIN_WORDS]) + MIN_WORDS


def paragraphs_of(words: np.ndarray, ends: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """First word and word after the last of each paragraph of the words from `first` to before `last`.

    Paragraphs are sentences and lines, which end at `ends`; those of under MIN_WORDS words join the one before, the first
    ones the next. Those of over LONG_WORDS words are cut by their content, so a stretch that is copied into another
    sentence is cut alike there.
    """
    out, stop = [], first
    for end in [*ends[np.searchsorted(ends, first, "right") : np.searchsorted(ends, last)].tolist(), last]:
        if stop - first >= MIN_WORDS and end - stop >= MIN_WORDS:
            out.append((first, stop))
            first = stop
        stop = end
    if stop > first:
        out.append((first, stop))
    if all(b - a <= LONG_WORDS for a, b in out):
        return out
    cut = []
    for a, b in out:
        places = [a, *(local_cuts(words[a:b]) + a).tolist(), b] if b - a > LONG_WORDS else [a, b]
        cut += zip(places, places[1:], strict=False)
    return cut


def _cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts; then, for each paragraph of SHINGLE words or more, its text, its ends (in all words; the first in its text) and a hash."""
    words, bounds, ends = word_hashes(texts, sentences=True)
    found = [(k, *x) for k in range(len(texts)) for x in paragraphs_of(words, ends, int(bounds[k]), int(bounds[k + 1])) if x[1] - x[0] >= SHINGLE]
    of, first, stop = np.array(found, np.int64).reshape(-1, 3).T
    return words, of, np.stack((first, stop, first - bounds[of])), range_hashes(words, first, stop).view(np.int64)


def _marks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    words, _, (first, stop, _), hs = _cut(texts)
    table = shingles(words)
    yield from ((h, table[a : b - SHINGLE + 1]) for h, a, b in zip(hs.tolist(), first.tolist(), stop.tolist(), strict=True))


def _marked(docs: DataFrame, with_shingles: bool) -> DataFrame:
    ship_package(docs.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from marks((m for _, texts in together(batches, 0) for m in _marks(texts)), with_shingles)

    return docs.select("text").mapInArrow(mark, "h long, shingles binary" if with_shingles else "key long, h long")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Every paragraph of SHINGLE words or more: doc_id, row_key, at, first_word, n_words, h.

    `at` counts them in the text, first_word its words, cut at white space; row_key is a hash of doc_id and text, h one of
    the paragraph's lower-cased words. A null text has none.
    """
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in together(batches, 2):
            _, of, (first, stop, own), hs = _cut(texts)
            at = np.arange(len(of)) - np.searchsorted(of, of)
            places = [pa.array(x.astype(np.int32)) for x in (at, own, stop - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), *places, pa.array(hs)], ["doc_id", "row_key", "at", "first_word", "n_words", "h"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(cut, "doc_id long, row_key long, at int, first_word int, n_words int, h long")


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Stretches of texts that belong to passages found elsewhere: one row for each occurrence, with its class.

    doc_id, row_key, at, first_word, n_words, class_id, copies (occurrences of the same words), passage_words (words of
    the run of repeated paragraphs that it lies in, at least `passage_words`) and removed: false for the occurrence of the
    smallest (doc_id, at) of its class, nulls last, which stays; true for all others. Texts that share a doc_id, or have
    none, come one after the other in the order of row_key.

    Paragraphs of equal lower-cased words are one; those of exact Jaccard `similarity` over five-word shingles are
    linked; classes are the components. Rows that repeat a doc_id and its text are one document. Empty tables, null and
    short texts give no row; extra columns are left out. Runs of equal words that begin or end within a paragraph have
    rows of their own (repeated_runs; `at` is null); they may overlap paragraphs.
    """
    return similar_paragraphs(docs, similarity, passage_words).unionByName(repeated_runs(docs))


def similar_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """The rows of repeated_paragraphs that are paragraphs."""
    links = similar_links(_marked(docs, False), _marked(docs, True), similarity)
    labels = stored(connected_components(links, "a", "b").select(F.col("node").alias("h"), "component"))
    whole = paragraphs(docs)
    known = whole.groupBy("h").agg(F.count("*").alias("copies")).join(labels, "h", "left").where("copies > 1 or component is not null")
    known = stored(known.select("h", "copies", F.coalesce("component", "h").alias("class_id")))
    found = stored(whole.join(known.hint("merge"), "h").dropDuplicates(["doc_id", "row_key", "at"]))
    keeper = stored(found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key", "at")).alias("keeper")))
    found = found.join(keeper, "class_id")
    of_doc = Window.partitionBy("doc_id", "row_key")
    found = found.withColumn("run", F.col("at") - F.row_number().over(of_doc.orderBy("at")))
    found = found.withColumn("passage_words", F.sum("n_words").over(Window.partitionBy("doc_id", "row_key", "run"))).where(F.col("passage_words") >= passage_words)
    kept = (F.col("row_key") == F.col("keeper.row_key")) & (F.col("at") == F.col("keeper.at"))
    return found.select("doc_id", "row_key", "at", "first_word", "n_words", "class_id", "copies", "passage_words", (~kept).alias("removed"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words of `spans` (first word, words), each with the white space after it; spans may overlap."""
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    out, kept = [], 0
    for first, n in sorted(spans):
        begin, stop = starts[first], starts[first + n] if first + n < len(starts) else len(text)
        if begin > kept:
            out.append(text[kept:begin])
        kept = max(kept, stop)
    return "".join([*out, text[kept:]])


def drop_repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """`docs` with all but one occurrence of each repeated passage cut from the texts; other columns stay as they are.

    Rows that keep no word of a text that had one are dropped; rows without a repeated passage stay untouched, null and
    empty texts among them. An empty table stays empty; columns of any name are kept.
    """
    ship_package(docs.sparkSession)
    found = repeated_paragraphs(docs, passage_words=passage_words).where("removed")
    spans = found.groupBy("row_key").agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans"))
    names = docs.columns
    wide = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    text = f"c{names.index('text')}"
    joined = wide.withColumn("row_key", F.xxhash64(f"c{names.index('doc_id')}", text)).join(spans.hint("shuffle_hash"), "row_key", "left").drop("row_key")
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held = batch.column(len(names)).to_pylist()
            texts = [t.as_py() if s is None else without_words(t.as_py(), [(x["first_word"], x["n_words"]) for x in s]) for t, s in zip(batch.column(at), held, strict=True)]
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            stay = pa.array([s is None or bool(t.strip()) for t, s in zip(texts, held, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(stay)

    whole = StructType(docs.schema.fields)
    return joined.mapInArrow(cut, whole)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence, in all documents, of a stretch that belongs to a passage found elsewhere."""
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
