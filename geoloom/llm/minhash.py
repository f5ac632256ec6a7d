"""MinHash banding of word sequences: candidates meet in bands, exact Jaccard over five-word shingles verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.words import sliced
from geoloom.session import stored

SHINGLE = 5
SIMILARITY = 0.8
#: Rows of a band, and bands: at the threshold, a pair meets in some band with probability 1 - (1 - 0.8^2)^5 = 0.994.
ROWS, BANDS = 2, 5
#: Members of a band bucket up to which pairs are joined; beyond it, they are compared block by block.
CROWDED = 64
BLOCK = 256
#: Sequences that a task remembers, so as not to give their repeats again.
REMEMBERED = 200_000

_ODD = [np.uint64(2 * k + 1) for k in (0x4F1BBCDCBFA53E0A, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x0D6E8FEB86659FD9, 0x369DEA0F31A53F85)]
_PERMUTATIONS = np.array([[2654435761, 40503], [2246822519, 97], [3266489917, 7919], [668265263, 104729], [374761393, 15485863], [2869860233, 32452843], [3644798167, 49979687], [4101842887, 67867967], [1274126177, 86028121], [1103515245, 122949823]], np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every five neighbouring word hashes; none for fewer words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, "<u4")
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h += words[j : j + n] * _ODD[j]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(32)).astype("<u4")


def band_keys(tables: list[np.ndarray]) -> np.ndarray:
    """For each non-empty shingle table, the hash of its MinHash values in every band: BANDS x tables, signed."""
    values = np.concatenate(tables)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in tables])[:-1]))
    keys = np.empty((BANDS, len(tables)), np.int64)
    for band in range(BANDS):
        key = np.full(len(tables), band + 1, np.uint64)
        for multiplier, shift in _PERMUTATIONS[band * ROWS : (band + 1) * ROWS]:
            x = values * multiplier + shift
            x ^= x >> np.uint32(15)
            x *= multiplier
            x ^= x >> np.uint32(13)
            key = (key ^ np.minimum.reduceat(x, starts).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[band] = key.view(np.int64)
    return keys


def marks(sequences: Iterator[tuple[int, np.ndarray]], with_shingles: bool) -> Iterator[pa.RecordBatch]:
    """`(key, h)` for each band of every different sequence of a task, or `(h, shingles)`; those without shingles: none.

    `sequences` gives a hash and the shingles of each. One that this task has met among its last ones is not given again:
    a map-side combine.
    """
    met: set[int] = set()
    hs: list[int] = []
    tables: list[np.ndarray] = []
    size = 0

    def batch() -> pa.RecordBatch:
        if with_shingles:
            return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array([t.tobytes() for t in tables], pa.binary())], ["h", "shingles"])
        keys = band_keys(tables) if tables else np.empty((BANDS, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.array(hs, np.int64), BANDS))], ["key", "h"])

    for h, table in sequences:
        if not len(table) or h in met:
            continue
        if len(met) >= REMEMBERED:
            met.clear()
        met.add(h)
        hs.append(h)
        tables.append(table)
        size += len(table)
        if size > 500_000:
            yield batch()
            hs, tables, size = [], [], 0
    yield batch()


def distinct_values(table: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(table, "<u4"))


def jaccard_reaches(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted arrays of different values, not empty, is `similarity` or more."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < similarity * len(y):
        return False
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return both >= similarity * (len(x) + len(y) - both)


def forest_links(sets: list[np.ndarray], own: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of pairs of Jaccard `similarity` or more, enough of them to link all that such pairs link; exact.

    `sets` are sorted arrays of different values, not empty. If `own` has more than one value, only pairs of different ones
    count. Two such sets share at least `similarity` of each one's values, so among the first `1 - similarity` of the
    values of each (and one more) there is one in common: only sets that share one of those are compared, and of them
    only those of a fitting size that nothing has linked yet.
    """
    sizes, label, any_own = np.array([len(s) for s in sets]), np.arange(len(sets)), len(np.unique(own)) < 2
    firsts = sizes - np.ceil(similarity * sizes - 1e-9).astype(int) + 1
    holders: dict[int, list[int]] = {}
    links: list[tuple[int, int]] = []
    for x, values in enumerate(sets):
        heads = values[: firsts[x]].tolist()
        met = np.array(sorted({y for v in heads for y in holders.get(v, ())}), int)
        met = met[(label[met] != label[x]) & (any_own | (own[met] != own[x])) & (np.minimum(sizes[met], sizes[x]) >= similarity * np.maximum(sizes[met], sizes[x]))]
        for y in met.tolist():
            if label[y] != label[x] and jaccard_reaches(values, sets[y], similarity):
                label[label == label[x]] = label[y]
                links.append((x, y))
        for v in heads:
            holders.setdefault(v, []).append(x)
    return links


def _verified_pairs(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    left = held.select(F.col("h").alias("a"), F.col("shingles").alias("sa"))
    right = held.select(F.col("h").alias("b"), F.col("shingles").alias("sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            good = pa.array([jaccard_reaches(distinct_values(a), distinct_values(b), similarity) for a, b in pairs], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _block_links(members: DataFrame, sizes: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links within crowded buckets, exact: every pair of blocks is one group, which gives at most a forest of links."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "h", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = dealt.join(held, "h").select("key", "h", "own", "i", "j", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        hs, own = table.column("h").to_pylist(), np.array(table.column("own").to_pylist())
        found = forest_links([distinct_values(s.as_buffer()) for s in table.column("shingles")], own, similarity)
        return pa.table({"a": pa.array([hs[x] for x, _ in found], pa.int64()), "b": pa.array([hs[y] for _, y in found], pa.int64())})

    return full.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def similar_links(keys: DataFrame, tables: DataFrame, similarity: float = SIMILARITY, also: DataFrame | None = None) -> DataFrame:
    """Links `(a, b)` between different sequences of exact Jaccard `similarity` or more that meet in a band, or are a pair of `also`.

    `keys` has (key, h), `tables` (h, shingles), as marks() gives them; rows may repeat. A first pass finds the keys that
    different sequences share, by their least and greatest h, with a map-side combine; only their members go on, so of
    all other sequences nothing but the keys is shuffled. Buckets of up to CROWDED members are joined with themselves;
    in larger ones, blocks of about BLOCK members are compared pair by pair of blocks, so that no task holds a bucket
    and no list of all pairs is made. Both sides of the joins grow with the input, so they are merged at every size.
    """
    shared = stored(keys.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least < most").select("key"))
    members = stored(keys.join(shared.hint("merge"), "key").distinct())
    sizes = stored(members.groupBy("key").agg(F.count("*").alias("n")))
    wanted = members.select("h")
    if also is not None:
        also = stored(also.where("a < b").distinct())
        wanted = wanted.union(also.select("a")).union(also.select("b"))
    held = stored(tables.join(wanted.distinct().hint("merge"), "h").groupBy("h").agg(F.first("shingles").alias("shingles")))
    few = members.join(sizes.where(F.col("n") <= CROWDED), "key").select("key", "h")
    pairs = few.withColumnRenamed("h", "a").join(few.withColumnRenamed("h", "b"), "key").where("a < b").select("a", "b")
    pairs = (pairs if also is None else pairs.union(also)).distinct()
    links = _verified_pairs(pairs, held, similarity)
    crowded = sizes.where(F.col("n") > CROWDED)
    if not crowded.isEmpty():
        links = links.union(_block_links(members.join(crowded.select("key"), "key"), crowded, held, similarity))
    return links
