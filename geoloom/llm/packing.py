"""Harmonic packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import ship_package

CAPACITY = 2048
#: Reciprocal classes; the last one takes all shorter lengths too.
CLASSES = 64
#: Id that ends each document.
END_ID = 1
#: Words whose ids a worker remembers; beyond it, new words are encoded each time.
CACHED_WORDS = 120_000
#: Ids in one output batch.
BATCH_IDS = 1 << 18

_ENCODERS: dict[str, WordEncoder] = {}
#: White space round a single blank on both sides: there, a text can't be cut at blanks without changing its ids.
_ENTANGLED = re.compile(r"[^\S ] [^\S ]|  | $")


class WordEncoder:
    """Byte-level BPE ids of whole texts, word by word.

    The vocabulary's pattern never lets a token span a single blank, so a text cut before each blank has the ids of its
    pieces in turn, and frequent pieces are remembered. Texts where blanks touch other white space on both sides are
    encoded whole. Strings of special tokens are ordinary text here; pack() gives those of the default vocabulary their ids.
    """

    def __init__(self, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self._whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, np.ndarray] = {}

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if _ENTANGLED.search(text):
            return np.array(self._whole(text), np.uint32)
        known, whole, out = self._known, self._whole, []
        first, *rest = text.split(" ")
        for word in ([first] if first else []), rest:
            blank = " " if word is rest else ""
            for piece in word:
                if (ids := known.get(blank + piece)) is None:
                    ids = whole(blank + piece)
                    if len(known) < CACHED_WORDS:
                        known[blank + piece] = ids
                out += ids
        return np.array(out, np.uint32)


def _encoder(ranks_path: str | None) -> WordEncoder:
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = WordEncoder(ranks_path)
    return _ENCODERS[ranks_path]


def _with_added(encode: WordEncoder, added: dict[str, int]) -> Callable[[str], np.ndarray]:
    """`encode` for the parts between the strings of `added` tokens, which get their own ids."""
    if not added:
        return encode
    parts = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")

    def whole(text: str) -> np.ndarray:
        cut = parts.split(text)
        if len(cut) == 1:
            return encode(text)
        return np.concatenate([np.array([added[x]], np.uint32) if k % 2 else encode(x) for k, x in enumerate(cut)])

    return whole


def added_tokens() -> dict[str, int]:
    """Ids of the tokens that byte_bpe_50k.json adds to its ranks, by their strings."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as held:
        return {x["content"]: x["id"] for x in json.load(held)["added_tokens"]}


Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


class _Bins:
    """One worker's open bins, one for each class; sequence ids count up from `first`.

    Class k takes k pieces of lengths over capacity / (k + 1) up to capacity / k, the last class all shorter ones too. A
    bin that has its k pieces is closed by cutting what it lacks from the documents that come next, so it has no padding.
    """

    def __init__(self, capacity: int, classes: int, first: int):
        self.capacity, self.classes, self.next = capacity, classes, first
        self.open: dict[int, list[Piece]] = {}
        self.closing: list[Piece] = []
        self.lacks = 0

    def sequence(self, pieces: list[Piece]) -> list[tuple]:
        """Rows of a finished sequence."""
        rows, used = [], 0
        for doc_id, start, ids, doc_tokens in pieces:
            rows.append((doc_id, start, len(ids), ids.tobytes(), doc_tokens, self.next, used))
            used += len(ids)
        self.next += 1
        return rows

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        """Place a document; the rows of the sequences that this finishes."""
        rows, start, n = [], 0, len(ids)

        def cut(length: int) -> Piece:
            nonlocal start
            start += length
            return doc_id, start - length, ids[start - length : start], n

        if self.closing:
            piece = cut(min(n, self.lacks))
            self.closing.append(piece)
            self.lacks -= len(piece[2])
            if not self.lacks:
                rows += self.sequence(self.closing)
                self.closing = []
        while n - start >= self.capacity:
            rows += self.sequence([cut(self.capacity)])
        if start < n:
            k = min(self.capacity // (n - start), self.classes)
            bin_ = self.open.setdefault(k, [])
            bin_.append(cut(n - start))
            if len(bin_) == k:
                del self.open[k]
                self.lacks = self.capacity - sum(len(p[2]) for p in bin_)
                if self.lacks:
                    self.closing = bin_
                else:
                    rows += self.sequence(bin_)
        return rows

    def rest(self) -> list[tuple]:
        """What open bins hold in the end: poured into full sequences, the last tokens into sequences of powers of two."""
        waiting = [p for pieces in (self.closing, *self.open.values()) for p in pieces]
        left = sum(len(p[2]) for p in waiting)
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 2, -1, -1) if left % self.capacity >> b & 1]
        rows = []
        for size in sizes:
            pieces: list[Piece] = []
            while size:
                doc_id, start, ids, n = waiting.pop(0)
                pieces.append((doc_id, start, ids[:size], n))
                if len(ids) > size:
                    waiting.insert(0, (doc_id, start + size, ids[size:], n))
                size -= len(pieces[-1][2])
            rows += self.sequence(pieces)
        return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None, classes: int = CLASSES) -> DataFrame:
    """Pieces of all `docs` in sequences of `capacity` tokens (a power of two), with no padding at all.

    A document of `capacity` tokens or more gives full sequences first. Lengths, and what is left of such documents, fall
    into the reciprocal classes capacity / k for k = 1 to `classes`, and a bin of class k takes k of them; a bin is closed
    by cutting what it lacks from the next documents, the only other cuts. Each worker fills its own bins, so nothing is
    shuffled; what its open bins hold in the end is poured together. Every sequence holds `capacity` tokens or, at the end
    of a worker's rows, a power of two of them. A worker holds `classes` open bins at most.

    Returns doc_id, start, length, ids (the piece as little-endian unsigned 32-bit ids), doc_tokens, sequence_id and
    offset. A null or empty text is the end id alone. Repeated rows, tied lengths and null doc_ids are packed like any
    other row; an empty table gives no piece. Other columns of `docs` are left out. `ranks_path`: the vocabulary, by
    default the installed byte_bpe_50k.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity has to be a power of two")
    ship_package(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _with_added(_encoder(ranks_path), added_tokens() if ranks_path is None else {})
        bins = _Bins(capacity, classes, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = bins.add(doc_id.as_py(), np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4"))
                rows += found
                held += sum(r[2] for r in found)
                if held >= BATCH_IDS:
                    yield _batch(rows)
                    rows, held = [], 0
        yield _batch(rows + bins.rest())

    return docs.select("doc_id", "text").mapInArrow(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids; a digest in place of each piece's ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("bigint").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
