"""Exact repeats: runs of words that stand elsewhere too, wherever sentences and lines begin and end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.words import grams, range_hashes, sliced, together, word_hashes
from geoloom.session import ship_package, stored

RUN_WORDS = 50
#: Words of an anchor: in each run of RUN_WORDS words, the anchor of the least hash is kept, so equal runs share it.
GRAM = 30
WINDOW = RUN_WORDS - GRAM + 1
#: Words by which a run is carried on past its outermost anchors, and how often: up to WINDOW - 1 words.
STEP, STEPS = 5, 4

def _anchors(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the least of every WINDOW neighbouring anchors of a text, the last one of equals; and its first and last one.

    `h` has the hashes of all stretches of GRAM words, texts one after another from each of `bounds` on.
    """
    long = np.flatnonzero(np.diff(bounds) >= RUN_WORDS)
    found = [bounds[long], bounds[long + 1] - GRAM]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for begin in range(0, len(h) - WINDOW + 1, 1 << 15):
        view = np.lib.stride_tricks.sliding_window_view(h[begin : begin + (1 << 15) + WINDOW - 1], WINDOW)
        at = begin + np.arange(len(view))
        inside = text[at] == text[at + RUN_WORDS - 1]
        found.append((at + WINDOW - 1 - view[:, ::-1].argmin(axis=1))[inside])
    return np.unique(np.concatenate(found))


def _sides(words: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes of the STEP, 2 * STEP, ... words before each anchor, and of those after it; 0: too few in its text."""
    out = np.zeros((2, len(at)), np.uint64)
    text = np.searchsorted(bounds, at, "right") - 1
    for k in range(STEPS):
        n = STEP * (k + 1)
        for side, first in ((0, at - n), (1, at + GRAM)):
            inside = np.flatnonzero((first >= bounds[text]) & (first + n <= bounds[text + 1]))
            h = range_hashes(words, first[inside], first[inside] + n) >> np.uint64(48)
            out[side, inside] |= np.maximum(h, np.uint64(1)) << np.uint64(16 * k)
    return out[0].view(np.int64), out[1].view(np.int64)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """`(g, doc_id, row_key, pos, before, after)` for each anchor of a text of RUN_WORDS words or more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in together(batches, 2):
            words, bounds, _ = word_hashes(texts)
            h = grams(words, GRAM)
            at = _anchors(h, bounds)
            text = np.searchsorted(bounds, at, "right") - 1
            of = pa.array(text)
            sides = [pa.array(side) for side in _sides(words, bounds, at)]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array((at - bounds[text]).astype(np.int32)), *sides], ["g", "doc_id", "row_key", "pos", "before", "after"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(cut, "g long, doc_id long, row_key long, pos int, before long, after long")


def _merged(spans: list[tuple]) -> list[list]:
    """Unions of (first, stop, name, copies) that meet; the name is the first one's."""
    out: list[list] = []
    for x in sorted(spans):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
            out[-1][3] = max(out[-1][3], x[3])
        else:
            out.append(list(x))
    return out


def _labelled(spans: list[dict]) -> list[tuple]:
    """Runs of one text as (first_word, n_words, class_id, copies, removed): those that go, and the rest of the first ones."""
    gone = _merged([(s["first"], s["stop"], s["g"], s["copies"]) for s in spans if s["removed"] and s["first"] < s["stop"]])
    out = [(*x, True) for x in gone]
    for a, b, name, copies in _merged([(s["first"], s["stop"], s["g"], s["copies"]) for s in spans if not s["removed"]]):
        for x in gone:
            if a < x[1] and x[0] < b:
                if a < x[0]:
                    out.append((a, x[0], name, copies, False))
                a = x[1]
        if a < b:
            out.append((a, b, name, copies, False))
    return [(a, b - a, name, copies, removed) for a, b, name, copies, removed in out]


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs of words that stand elsewhere too, as rows of repeated_paragraphs; every run of RUN_WORDS equal words is found.

    Texts are lower-cased and cut at white space. Anchors are stretches of GRAM words: the one of the least hash in every
    RUN_WORDS words (winnowing), so equal runs share anchors, and the first and last one of each text. An anchor that
    stands in several places stays in the first of them, by (doc_id, row_key, place), nulls last, and goes from all
    others; so do up to STEP * STEPS words beside it, in steps, that equal those beside the first one, by 16-bit hashes. Of a run,
    at most STEP - 1 words stay at either end where its anchors' first places hold all of it, else WINDOW - 1. Where a
    stretch overlaps its own repeat, as in periodic text, the first GRAM words stay.

    `at` is null; class_id is a hash of an anchor's words. Anchors are counted with a map-side combine before they are
    joined, and the first places are summed alike, so no task holds all places of a stretch that many texts share.
    """
    ship_package(docs.sparkSession)
    rows = _anchor_rows(docs.where("text is not null"))
    many = stored(rows.groupBy("g").agg(F.count("*").alias("copies")).where("copies > 1"))
    held = stored(rows.join(many.hint("merge"), "g").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key", "pos")
    firsts = stored(held.groupBy("g").agg(F.min(F.struct(place.alias("place"), F.col("before"), F.col("after"))).alias("f")))
    same_row = F.col("row_key") == F.col("f.place.row_key")
    removed = ~(same_row & (F.col("pos") == F.col("f.place.pos")))
    meets = same_row & removed & (F.col("pos") < F.col("f.place.pos") + GRAM)

    def beside(side: str):
        part = lambda c, k: F.shiftrightunsigned(c, 16 * k).bitwiseAND(0xFFFF)
        equal = [(part(side, k) == part(f"f.{side}", k)) & (part(side, k) != 0) for k in range(STEPS)]
        reached = F.lit(0)
        for k in reversed(range(STEPS)):
            reached = F.when(equal[k], STEP + reached).otherwise(0)
        return F.when(same_row | ~removed, 0).otherwise(reached)

    span = F.struct(
        removed.alias("removed"),
        F.when(meets, F.col("f.place.pos") + GRAM).otherwise(F.col("pos") - beside("before")).alias("first"),
        (F.col("pos") + GRAM + beside("after")).alias("stop"),
        "g",
        "copies",
    )
    of_row = held.join(firsts.hint("merge"), "g").groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.collect_list(span).alias("spans"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["doc_id", "row_key", "first_word", "n_words", "class_id", "copies", "removed"]
        for batch in sliced(batches):
            out = []
            for doc_id, key, spans in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                out += [(doc_id, key, *x) for x in _labelled(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)

    found = of_row.select("doc_id", "row_key", "spans").mapInArrow(label, "doc_id long, row_key long, first_word int, n_words int, class_id long, copies long, removed boolean")
    return found.select("doc_id", "row_key", F.lit(None).cast("int").alias("at"), "first_word", "n_words", "class_id", "copies", F.col("n_words").cast("long").alias("passage_words"), "removed")
