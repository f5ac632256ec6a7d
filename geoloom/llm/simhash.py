"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.minhash import SHINGLE, SIMILARITY, marks, shingles, similar_links
from geoloom.llm.words import range_hashes, together, word_hashes
from geoloom.operators.components import connected_components
from geoloom.session import checkpoint, ship_package, stored

DISTANCE = 3
#: Fingerprints that share a 32-bit half: up to so many are compared one by one, more are linked through hubs.
DENSE = 32
#: Texts whose fingerprints a task remembers for their copies.
REMEMBERED_PRINTS = 50_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.array([[byte >> (7 - bit) & 1 for bit in range(8)] for byte in range(256)])


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed integer.

    A-Z are lower-cased, words are runs without ASCII white space; a shingle is hashed with XXH64, seed 42, each time it
    occurs. A bit is set if it is set in over half of the hashes. No word: zero.
    """
    from xxhash import xxh64_digest

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = max(0, len(words) - words_per_shingle)
    starts = [0, *ends[:last]]
    stops = ends[min(words_per_shingle, len(words)) - 1 :]
    digests = b"".join([xxh64_digest(joined[a : b - 1], 42) for a, b in zip(starts, stops, strict=True)])
    table = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(table[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(table)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, row: str | None = None) -> DataFrame:
    """`(doc_id, fingerprint)` with the fingerprint as a long, for every row; a null text is an empty one.

    `row`: a long column of `docs` that is carried along as `row`.
    """
    ship_package(docs.sparkSession)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "row", "fingerprint"])

    carried = F.col(row) if row else F.lit(None).cast("long")
    read = docs.select("doc_id", carried.alias("row"), F.col("text").cast("binary").alias("text"))
    out = read.mapInArrow(marked, "doc_id long, row long, fingerprint long")
    return out if row else out.drop("row")


def _masks(bits: int) -> Column:
    return F.array(*[F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("bigint") for b in range(bits)])


def _halves(prints: DataFrame) -> DataFrame:
    """The table: each fingerprint under either half, `(half, value, fp)`."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("value")),
        F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(low).alias("value")),
    )
    return prints.select("fp", F.inline(halves)).select("half", "value", "fp")


def _probes(table: DataFrame) -> DataFrame:
    """Each half's Hamming ball of radius 1, upward: the value and what setting one more bit makes of it.

    Of two halves that differ in one bit, one has it clear; its ball holds the other. So no pair is missed.
    """
    ball = F.array_distinct(F.transform(F.array_append(_masks(32), F.lit(0).cast("bigint")), lambda m: F.col("value").bitwiseOR(m)))
    return table.select("half", F.explode(ball).alias("value"), "fp")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _hub_links(prints: DataFrame) -> DataFrame:
    """Links among fingerprints of dense halves, with rows in proportion to the fingerprints, not to the pairs.

    Two fingerprints within distance 3 meet at a hub: one reaches it by at most one flip (near), the other by at most
    one flip or by clearing two of its set bits (far); of three differing bits, one of the two has two set. A near one
    is within 3 of all at the hub, so all are tied to the least near one. A hub has at most 1 + 64 + 2016 members.
    """
    flips = F.transform(F.array_append(_masks(64), F.lit(0).cast("bigint")), lambda m: F.col("fp").bitwiseXOR(m))
    ones = F.filter(_masks(64), lambda m: F.col("fp").bitwiseAND(m) != 0)
    near = prints.select("fp", F.lit(True).alias("near"), F.explode(flips).alias("hub"))
    paired = prints.select("fp", F.posexplode(ones).alias("at", "first"), ones.alias("ones"))
    rest = F.slice("ones", F.col("at") + 2, F.size("ones"))
    far = paired.select("fp", F.lit(False).alias("near"), F.explode(F.transform(rest, lambda m: F.col("fp").bitwiseXOR(m).bitwiseXOR(F.col("first")))).alias("hub"))
    at_hub = near.union(far)
    from pyspark.sql import Window

    centre = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("hub"))
    tied = at_hub.withColumn("centre", centre).where("centre is not null and centre <> fp").select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    return tied.where(_distance("a", "b") <= DISTANCE)


def near_links(prints: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Links `(a, b)` between distinct fingerprints (column `fp`) that give the components of distance <= 3.

    Multi-index hashing: of two fingerprints within 3, one half differs by at most one bit. Each half's ball of radius 1
    is looked up in the table of that half, and full distances are verified. Where over `dense` fingerprints share a
    half exactly, as in large groups of near copies, links go through hubs, and their full distances are verified too.
    """
    if distance != 3:
        raise ValueError("the balls and hubs are those of distance 3")
    table = _halves(prints)
    probes = _probes(table)
    crowded = checkpoint(table.groupBy("half", "value").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("half", "value"))
    any_crowded = not crowded.isEmpty()
    single = table.join(crowded, ["half", "value"], "left_anti") if any_crowded else table
    left, right = probes.select("half", "value", F.col("fp").alias("a")), single.select("half", "value", F.col("fp").alias("b"))
    met = left.join(right, ["half", "value"]).where((F.col("a") != F.col("b")) & (_distance("a", "b") <= distance))
    links = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if any_crowded:
        members = checkpoint(probes.join(crowded, ["half", "value"], "left_semi").select("fp").distinct())
        parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each makes some 500 rows: a small table, but much work
        links = links.union(_hub_links(members.repartition(parts, "fp")))
    return links.distinct()


def _components(marked: DataFrame) -> DataFrame:
    """`(fingerprint, component)` of every distinct fingerprint, under any stable name of its component."""
    nodes = checkpoint(marked.select(F.col("fingerprint").alias("fp")).distinct())
    labels = connected_components(near_links(nodes), "a", "b").withColumnRenamed("node", "fingerprint")
    return nodes.select(F.col("fp").alias("fingerprint")).join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def near_groups(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """`(doc_id, fingerprint, component_id)` for every row: the groups that links within 3 bits make.

    component_id is the smallest doc_id reachable, the row's own included; null doc_ids don't count as smallest, and a
    group of nothing else has null. Equal fingerprints, among them those of texts without a word, are one node. Repeated
    rows fall into one group; an empty table gives no row. Extra columns are left out.
    """
    marked = checkpoint(fingerprints(docs, words_per_shingle))
    of_print = checkpoint(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))).join(_components(marked), "fingerprint")
    ids = of_print.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(of_print.join(ids, "component").select("fingerprint", "component_id"), "fingerprint")


def _whole_texts(docs: DataFrame, with_shingles: bool) -> DataFrame:
    """marks() of the lower-cased words of whole texts."""
    ship_package(docs.sparkSession)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for _, texts in together(batches, 0):
            words, bounds, _ = word_hashes(texts)
            table = shingles(words)
            hs = range_hashes(words, bounds[:-1], bounds[1:]).view(np.int64)
            yield from ((h, table[a : max(a, b - SHINGLE + 1)]) for h, a, b in zip(hs.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))

    return docs.select("text").mapInArrow(lambda batches: marks(sequences(batches), with_shingles), "h long, shingles binary" if with_shingles else "key long, h long")


def _named(docs: DataFrame) -> DataFrame:
    """`(doc_id, row_key, h, fp)` of every row: row_key is a hash of doc_id and text, h one of the lower-cased words, fp the fingerprint."""
    ship_package(docs.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}  # texts of equal words come in groups: each is taken once
        for batch, texts in together(batches, 2):
            words, bounds, _ = word_hashes(texts)
            hs = range_hashes(words, bounds[:-1], bounds[1:]).view(np.int64)
            if len(known) > REMEMBERED_PRINTS:
                known.clear()
            for h, text in zip(hs.tolist(), texts, strict=True):
                if h not in known:
                    known[h] = fingerprint((text or "").encode())
            prints = pa.array([known[h] for h in hs.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hs), prints], ["doc_id", "row_key", "h", "fp"])

    named = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return named.mapInArrow(mark, "doc_id long, row_key long, h long, fp long")


def _print_pairs(texts: DataFrame) -> DataFrame:
    """Pairs `(a, b)` of texts (h, fp) whose fingerprints link: a row for each text beyond the first of a fingerprint, and for each link.

    The first text of a fingerprint stands for it, so rows grow with the texts and the links, not with pairs of copies.
    """
    first = stored(texts.groupBy("fp").agg(F.min("h").alias("first")))
    same = texts.join(first.hint("merge"), "fp").where("h <> first").select(F.col("h").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"h_{c}")).hint("merge")
    near = near_links(first.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each group, that of the smallest doc_id; its columns stay as they are.

    Texts of equal lower-cased words are one, those without a word (null ones too) among them; those of exact Jaccard
    `similarity` over five-word shingles are linked, and groups are the components. Candidates are texts whose SimHash
    fingerprints link, by multi-index hashing; each such pair is checked. Fingerprints at 0.8 differ in up to 11 bits or
    more, which no ball of bits covers: so texts that meet in MinHash bands are candidates too (a pair at the threshold is
    found with probability 0.994). Rows are known by a hash of doc_id and text; of rows that repeat both, any one stays. A
    row without doc_id stays only if its group has no other. Texts of any length are compared whole; an empty table stays
    empty; columns of any name are kept.
    """
    rows = stored(_named(docs).groupBy("h", "fp", "doc_id", "row_key").agg(F.count("*").alias("n")))
    pairs = _print_pairs(rows.select("h", "fp").distinct())
    links = similar_links(_whole_texts(docs, False), _whole_texts(docs, True), similarity, pairs)
    labels = connected_components(links, "a", "b").select(F.col("node").alias("h"), "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key", "n")).alias("first")
    grouped = rows.groupBy("h").agg(first).join(labels, "h", "left")
    kept = grouped.groupBy(F.coalesce("component", "h").alias("component")).agg(F.min("first").alias("first"))
    kept = stored(kept.select("first.row_key", "first.n"))
    names = docs.columns
    wide = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    joined = wide.join(kept.hint("shuffle_hash"), "row_key")  # the texts stream past a small row each: a merge would sort them
    out = joined.where("n = 1")
    if not kept.where("n > 1").isEmpty():
        out = out.union(joined.where("n > 1").dropDuplicates(["row_key"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
