"""Words of texts as hashes, without a Python string for each: arrays of character codes, cut at white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters whose words are hashed at a time, and of the texts that are taken together (at least one text).
BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE: list[np.ndarray] = []


def _is_space() -> np.ndarray:
    if not _SPACE:
        _SPACE.append(np.array([chr(c).isspace() for c in range(0x110000)]))
    return _SPACE[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ h >> np.uint64(29)


def range_hashes(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range values[first:stop], from sums of values times powers of an odd base: equal ranges have equal hashes."""
    n = len(values)
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, base, np.uint64))), dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _POWERS[0][:n], dtype=np.uint64, out=sums[1:])
    return mixed((sums[stop] - sums[first]) * _POWERS[1][first])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n neighbouring word hashes; none for fewer words."""
    at = np.arange(max(0, len(words) - n + 1))
    return range_hashes(words, at, at + n) if len(at) else np.empty(0, np.uint64)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few values are Python objects at a time."""
    for batch in batches:
        yield from (batch.slice(begin, rows) for begin in range(0, batch.num_rows, rows))


def together(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The rows in slices with the texts of `column`: up to BLOCK characters, or one longer text, at a time."""
    for batch in batches:
        begin, size, texts = 0, 0, []
        for k, text in enumerate(batch.column(column)):
            text = text.as_py()
            if texts and size + len(text or "") > BLOCK:
                yield batch.slice(begin, k - begin), texts
                begin, size, texts = k, 0, []
            texts.append(text)
            size += len(text or "")
        if texts:
            yield batch.slice(begin), texts


def word_hashes(texts: list[str | None], sentences: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of the lower-cased words of all texts, as white space parts them, one text after another.

    And the place of each text's first word, with one more at the end; and the words before each line end (of a sentence
    too, if `sentences`: a word that ends in a full stop, exclamation or question mark).
    """
    low = [(t or "").lower() for t in texts]
    offsets = np.cumsum([0, *[len(x) + 1 for x in low]])
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = np.concatenate(([False], ~_is_space()[code], [False]))
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    starts, stops = turns[::2], turns[1::2]
    parts, begin = [], 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + BLOCK)))
        base = starts[begin]
        x = code[base : stops[end - 1]] * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        parts.append(range_hashes(x, starts[begin:end] - base, stops[begin:end] - base))
        begin = end
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    ends = np.searchsorted(starts, np.flatnonzero(code == 10))
    if sentences:
        ends = np.union1d(ends, np.flatnonzero(np.isin(code[stops - 1], [33, 46, 63])) + 1)
    return hashes, np.searchsorted(starts, offsets), ends
