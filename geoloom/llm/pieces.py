"""SentencePiece byte-pair encoding and decoding of whole texts by vectorised merge rounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.words import BLOCK, range_hashes, together
from geoloom.session import ship_package

#: The blank of pieces.
SPACE = "▁"
#: Merge rounds of a word; what has pairs left then (very long words, long runs of blanks) is merged pair by pair from a heap.
ROUNDS = 64

_NONE = np.int32(2**31 - 1)
_MODELS: dict[str, PieceModel] = {}


class PieceModel:
    """A byte-pair model whose normaliser changes nothing but blanks; raises ValueError for any other.

    Two neighbouring characters that no piece holds side by side are never merged, so texts fall into words there, and
    equal words have equal ids. Within a word, pairs are merged by rank of the piece that they give, the leftmost first.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as held:
            model.ParseFromString(held.read())
        normal, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or not model.trainer_spec.byte_fallback or set(kinds) - {1, 2, 3, 6} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with byte fallback, plain pieces and no normalisation are known here")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.end = model.trainer_spec.eos_id
        self.pieces = [p.piece for p in model.pieces]
        self.bytes_at = np.full(256, -1, np.int32)
        surface = []
        for i, (piece, kind) in enumerate(zip(self.pieces, kinds, strict=True)):
            if kind == 6:
                self.bytes_at[int(piece[3:5], 16)] = i
            surface.append({1: piece.replace(SPACE, " ").encode(), 2: model.trainer_spec.unk_surface.encode(), 3: b"", 6: bytes([int(piece[3:5], 16)]) if kind == 6 else b""}[kind])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surface)])
        self.kinds = np.array(kinds)
        self.spaced = np.array([k == 1 and p.startswith(SPACE) for p, k in zip(self.pieces, kinds, strict=True)])
        normal_ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        self.rank = np.unique(-np.array([p.score for p in model.pieces], np.float32), return_inverse=True)[1].astype(np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        beside, pairs = set(), {}
        for piece, i in normal_ids.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
            beside |= {piece[k : k + 2] for k in range(len(piece) - 1)}
            for k in range(1, len(piece)):
                if piece[:k] in normal_ids and piece[k:] in normal_ids:
                    pairs[normal_ids[piece[:k]] << 32 | normal_ids[piece[k:]]] = i
        chars = sorted({c for two in beside for c in two})
        if any(self.char_id[ord(c)] < 0 for c in chars):
            raise ValueError("a piece holds a character that is no piece")
        self.dense = np.zeros(0x110000, np.int32)
        self.dense[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.met = np.zeros(self.width * self.width, bool)
        self.met[[self.dense[ord(a)] * self.width + self.dense[ord(b)] for a, b in beside]] = True
        self.pairs = pairs
        self._fill_table()
        blank = self.dense[ord(SPACE)]
        #: Whether a text can be cut before the first blank of each run.
        self.cuts_at_blanks = not any(self.met[k * self.width + blank] for k in range(self.width) if k != blank)

    def _fill_table(self) -> None:
        """The pairs in an open hash table, at most an eighth full: a lookup takes one probe, seldom two."""
        self.table_bits = max(4, (8 * len(self.pairs)).bit_length())
        self.table_keys = np.full(1 << self.table_bits, -1, np.int64)
        self.table_ids = np.full(1 << self.table_bits, -1, np.int32)
        keys = np.array(list(self.pairs), np.int64)
        ids = np.array(list(self.pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.table_keys[slot] == -1)
            slots, pick = np.unique(slot[free], return_index=True)
            self.table_keys[slots], self.table_ids[slots] = keys[free[pick]], ids[free[pick]]
            rest = np.ones(len(keys), bool)
            rest[free[pick]] = False
            keys, ids, slot = keys[rest], ids[rest], slot[rest] + 1 & (1 << self.table_bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of pieces gives, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        there = self.table_keys[slot]
        found = np.where(there == key, self.table_ids[slot], np.int32(-1))
        rest = np.flatnonzero((there != key) & (there != -1))
        while len(rest):
            slot[rest] = slot[rest] + 1 & (1 << self.table_bits) - 1
            there = self.table_keys[slot[rest]]
            hit = there == key[rest]
            found[rest[hit]] = self.table_ids[slot[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return found

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, _NONE, self.rank[ids])

    def merge_words(self, symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (`symbols` one after another, each from its place in `firsts`), and their counts.

        A round takes the best pair of each word and merges its places from the left, until one of them makes a pair that
        is no worse than the best: merging one at a time would go there next. Words without a pair are taken out.
        """
        n = len(firsts)
        counts = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # ids and the words that they belong to
        word = np.repeat(np.arange(n), np.diff(np.append(firsts, len(symbols))))
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            pair = np.full(len(symbols), -1, np.int32)
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair[inner] = self.merged(symbols[inner], symbols[inner + 1])
            rank = self._ranks(pair)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            of = np.repeat(best, lengths)
            over = of == _NONE
            if over.any():
                done.append((symbols[over], word[over]))
                symbols, word, pair, rank, of = symbols[~over], word[~over], pair[~over], rank[~over], of[~over]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == of)
            # Of pairs that overlap, every other one from the left.
            run = np.concatenate(([True], np.diff(chosen) > 1))
            chosen = chosen[(np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            made, limit = pair[chosen], of[chosen]
            worse = np.zeros(len(chosen), bool)
            right = np.flatnonzero((chosen + 2 < len(symbols)) & (word[np.minimum(chosen + 2, len(symbols) - 1)] == word[chosen]))
            worse[right] = self._ranks(self.merged(made[right], symbols[chosen[right] + 2])) <= limit[right]
            before = symbols[np.maximum(chosen - 1, 0)]
            follows = np.flatnonzero(np.concatenate(([False], np.diff(chosen) == 2)))
            before[follows] = made[follows - 1]
            left = np.flatnonzero((chosen > 0) & (word[np.maximum(chosen - 1, 0)] == word[chosen]))
            worse[left] |= self._ranks(self.merged(before[left], made[left])) <= limit[left]
            if worse.any():
                earlier = np.cumsum(worse) - worse
                first = np.concatenate(([True], np.diff(word[chosen]) > 0))
                stay = earlier == earlier[np.flatnonzero(first)[np.cumsum(first) - 1]]
                chosen, made = chosen[stay], made[stay]
            symbols = symbols.copy()
            symbols[chosen] = made
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        if len(symbols):
            for group in np.split(np.arange(len(symbols)), np.flatnonzero(np.diff(word)) + 1):
                ids = self._by_heap(symbols[group].tolist())
                done.append((np.array(ids, np.int32), np.full(len(ids), word[group[0]])))
        ids, of = (np.concatenate([d[k] for d in done]) if done else np.empty(0, np.int64) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        counts += np.bincount(of.astype(np.int64), minlength=n)
        return ids[order].astype(np.int32), counts

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """One word merged pair by pair, the best and then the leftmost first."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pairs = self.pairs
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (made := pairs.get(symbols[a] << 32 | symbols[b])) is not None:
                heapq.heappush(heap, (int(self.rank[made]), a, b, symbols[a], symbols[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or symbols[a] != x or symbols[b] != y or after[a] != b:
                continue
            symbols[a] = pairs[x << 32 | y]
            alive[b] = False
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s, here in zip(symbols, alive, strict=True) if here]

    def _parts(self, text: str) -> Iterator[str]:
        """A text with the blanks of pieces, long ones cut before the first blank of a run."""
        text = self.prefix + text.replace(" ", SPACE) if text else ""
        begin = 0
        while self.cuts_at_blanks and len(text) - begin > 2 * BLOCK:
            end = text.find(SPACE, begin + BLOCK)
            while end > 0 and text[end - 1] == SPACE:
                end = text.find(SPACE, end + 1)
            if end < 0:
                break
            yield text[begin:end]
            begin = end
        yield text[begin:] if begin else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each one's count; no ids for null and empty texts."""
        ids, counts, held, owners, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            nonlocal held, owners, size
            got, n = self._encode_parts(held)
            ids.append(got)
            np.add.at(counts, owners, n)
            held, owners, size = [], [], 0

        for k, text in enumerate(texts):
            for part in self._parts(text or ""):
                if held and size + len(part) > 2 * BLOCK:
                    flush()
                held.append(part)
                owners.append(k)
                size += len(part)
        if held:
            flush()
        return np.concatenate(ids) if ids else np.empty(0, np.int32), counts

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, parts)])
        if not len(code):
            return np.empty(0, np.int32), np.zeros(len(parts), np.int64)
        dense = self.dense[code]
        fresh = np.ones(len(code), bool)
        fresh[1:] = ~self.met[dense[:-1] * self.width + dense[1:]]
        fresh[bounds[:-1][bounds[:-1] < len(code)]] = True
        first = np.flatnonzero(fresh)
        length = np.diff(np.append(first, len(code)))
        single = length == 1
        # Single characters: their own id, or those of their bytes.
        points, one = np.unique(code[first[single]], return_inverse=True)
        table = [np.array([i] if (i := self.char_id[p]) >= 0 else self.bytes_at[np.frombuffer(chr(p).encode(), np.uint8)], np.int32) for p in points]
        sizes = [len(t) for t in table]
        # Longer words: each different one is merged once.
        many = np.flatnonzero(~single)
        begin, n = first[many], length[many]
        _, pick, inverse = np.unique(range_hashes(code.astype(np.uint64), begin, begin + n), return_index=True, return_inverse=True)
        if not self._same(code, begin, n, begin[pick][inverse], n[pick][inverse]):
            pick = inverse = np.arange(len(many))
        ids, counts = self.merge_words(self.char_id[code[_spans(begin[pick], n[pick])]], np.cumsum(n[pick]) - n[pick]) if len(many) else (np.empty(0, np.int32), np.empty(0, np.int64))
        flat = np.concatenate([*table, ids])
        lengths = np.concatenate((np.array(sizes, np.int64), counts))
        at = np.cumsum(lengths) - lengths
        entry = np.empty(len(first), np.int64)
        entry[single], entry[many] = one, inverse + len(points)
        out = lengths[entry]
        totals = np.concatenate(([0], np.cumsum(out)))[np.searchsorted(first, bounds)]
        return flat[_spans(at[entry], out)], np.diff(totals)

    @staticmethod
    def _same(code: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> bool:
        """Whether each range of `code` from a has the characters of that from b: equal hashes are not taken on trust."""
        return bool((n == m).all() and (code[_spans(a, n)] == code[_spans(b, n)]).all())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks for the blanks of pieces, but for the one that encoding put first; bytes that are no UTF-8 are U+FFFD each."""
        kinds = self.kinds[ids]
        shown = np.flatnonzero(kinds != 3)
        if not len(shown):
            return ""
        lead = int(bool(self.prefix) and self.spaced[ids[shown[0]]])
        begin, end = self.surface_at[ids], self.surface_at[ids + 1]
        if (kinds == 6).any():
            turns = np.flatnonzero(np.diff(kinds == 6)) + 1
            runs = np.split(np.arange(len(ids)), turns)
            texts = [self.surface[_spans(begin[r], end[r] - begin[r])].tobytes() for r in runs]
            return "".join(_bytes_text(t) if kinds[r[0]] == 6 else t.decode() for r, t in zip(runs, texts, strict=True))[lead:]
        return self.surface[_spans(begin, end - begin)].tobytes().decode()[lead:]


def _bytes_text(held: bytes) -> str:
    try:
        return held.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(held):
            for n in (1, 2, 3, 4):
                try:
                    out.append(held[k : k + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            k += n
        return "".join(out)


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(total)


def _model(path: str | None) -> PieceModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str | None = None, end: bool = True) -> DataFrame:
    """`(doc_id, ids)` of each row of `docs`: the ids of its whole text, and the end id if `end`.

    Nothing is shuffled; a worker holds the characters of BLOCK or of one longer text, which it merges in parts. A null or
    empty text has no ids but the end id. Rows with null or repeated doc_ids are encoded like any other; an empty table
    gives no row; other columns, whatever their names, are left out. `model_path`: by default the installed piece_bpe_32k.
    """
    ship_package(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch, texts in together(batches, 1):
            ids, counts = model.encode(texts)
            if end:
                ids, counts = np.insert(ids, np.cumsum(counts), np.int32(model.end)), counts + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(table: DataFrame, model_path: str | None = None) -> DataFrame:
    """`(doc_id, ids, text)` of each row of `table` (doc_id, ids): the text that its ids stand for.

    Null ids have a null text, no ids an empty one; a null among ids, or an id that the model doesn't have, is an error.
    """
    ship_package(table.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [None if row.values is None else model.decode(row.values.to_numpy()) for row in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return table.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids array<int>, text string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text of `documents`, end id included, and of the text that they decode to."""
    texts = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    joined: Column = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return texts.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(joined).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
