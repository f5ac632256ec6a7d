"""Benchmark decontamination: word windows of the training texts against the windows of the test items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import checkpoint

WINDOW = 10
#: Test windows, and bytes of their words, that are broadcast at most; beyond it, they meet the training windows in a shuffled join.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 48_000_000
#: Words of a text that are windowed at a time.
BLOCK = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII; a null text has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _hashes(split: Column) -> Column:
    """Each word's hash, so that a window hashes its words' hashes and no word is hashed once for each of its windows."""
    return F.transform(split, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """`(item_id, n, window_hash, window)`: every window of `size` words; a shorter item, unless empty, is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    windows = items.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("window"))
    return windows.select("item_id", "n", F.xxhash64(_hashes(F.col("window"))).alias("window_hash"), "window").distinct()


def _marked_windows(n: int) -> Column:
    """The windows of n words that start in the first BLOCK words of a block, as structs of start, n and hash."""
    last = F.least(F.size("hashes") - n, F.lit(BLOCK - 1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), F.xxhash64(F.slice("hashes", i + 1, n)).alias("hash")))


def hits(docs: DataFrame, benchmark: DataFrame, row: str, size: int = WINDOW) -> DataFrame:
    """`(row, n_words, at, n, item_ids)`: one line for each row of `docs` with at null, and one for each occurring window.

    `row` names a column of `docs` that tells its texts apart, the same at each reading. Texts are cut into blocks of
    words, each with the words that its last windows need, so that a very long text makes no very large array of windows.
    Only hashes are joined; the words of what meets are compared after it. A null text has a line with at null alone.
    """
    tests = checkpoint(item_windows(benchmark, size))
    lengths = sorted(r.n for r in tests.select("n").distinct().collect())  # at most `size` values
    # One line for each different window, with the items that hold it.
    known = tests.groupBy("n", "window_hash", "window").agg(F.collect_set("item_id").alias("item_ids"))
    known = known.select(F.col("n").alias("k_n"), F.col("window_hash").alias("k_hash"), F.col("window").alias("k_window"), "item_ids")
    most = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("window", " ")) + 8 * F.size("window")), F.lit(0)).alias("bytes")).first()

    split = docs.select(F.col(row).alias("row"), words(F.col("text")).alias("words")).withColumn("hashes", _hashes(F.col("words")))
    n_words = F.size("words")
    firsts = F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0)), F.lit(BLOCK))
    blocks = F.transform(firsts, lambda b: F.struct(b.alias("base"), F.slice("words", b + 1, BLOCK + size - 1).alias("part"), F.slice("hashes", b + 1, BLOCK + size - 1).alias("hashes")))
    blocked = split.select("row", n_words.alias("n_words"), F.inline(blocks))
    none = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("hash"))
    marks = [_marked_windows(n) for n in lengths]
    part = F.slice("part", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("n"))
    at = F.when(F.col("i") >= 0, F.col("base") + F.col("i"))
    if most.n <= BROADCAST_WINDOWS and most.bytes <= BROADCAST_BYTES:
        seen = blocked.select("row", "n_words", "base", "part", F.inline(F.concat(F.array(none), *marks)))
        met = seen.join(F.broadcast(known), F.col("hash") == F.col("k_hash"), "left")
        met = met.where((F.col("item_ids").isNotNull() & (part == F.col("k_window"))) | ((F.col("i") < 0) & (F.col("base") == 0)))
        return met.select("row", "n_words", at.alias("at"), "n", "item_ids")
    seen = blocked.select("row", "base", F.inline(F.concat(*marks)))
    met = seen.join(known, (F.col("hash") == F.col("k_hash")) & (F.col("n") == F.col("k_n"))).select("row", "base", "i", "n", "k_window", "item_ids").distinct()
    again = blocked.join(met, ["row", "base"]).where(part == F.col("k_window")).select("row", "n_words", at.alias("at"), "n", "item_ids")
    return split.select("row", n_words.alias("n_words"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("n"), F.lit(None).cast(known.schema["item_ids"].dataType).alias("item_ids")).union(again)


def contamination(docs: DataFrame, benchmark: DataFrame, row: str, carry: tuple[str, ...] = (), size: int = WINDOW) -> DataFrame:
    """For every row of `docs`: row, `carry`, n_words, n_hit, n_items, items_sha256, contaminated and `hit_spans`.

    A word inside any occurrence of a test window is hit; hit_spans are the maximal runs of hit words, as structs of
    first word and word after the last. n_items counts the items with occurring windows; items_sha256 is the digest of
    their ids, sorted as strings and joined by commas. A text without words, or null, has zeros; so has every row if
    there is no test item. Items without words make no window; items with a null id count under the empty string. Rows
    that share `row`, which have to share text and `carry` too, come back as often as they are there. Only DataFrame
    functions are used.
    """
    key = F.struct(F.col(row).alias("row"), *[F.col(c) for c in carry])
    met = hits(docs.select(key.alias("key"), "text"), benchmark, "key", size)
    spans = F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n")).alias("stop")))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids"))))
    per = met.groupBy("row").agg(F.max("n_words").cast("bigint").alias("n_words"), spans.alias("spans"), items.alias("items"), F.count_if(F.col("at").isNull()).alias("copies"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<first:int,stop:int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["stop"] >= s["first"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.array_append(out, s)),
    )
    per = per.withColumn("hit_spans", merged)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: F.coalesce(i.cast("string"), F.lit("")))), ",")
    out = per.select("row.*", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "hit_spans", (n_hit > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    return out.drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """`docs` without the rows that hold a test window; the others and their columns stay as they are.

    A text's hash names it, so repeated texts share the verdict. Null, empty and wordless texts stay; texts of any length
    are read whole; an empty table, or one of no test item, stays as it is; columns of any name are kept.
    """
    key = F.xxhash64("text", F.length("text"))
    met = hits(docs.select(key.alias("key"), "text"), benchmark, "key", size).where("at is not null").select("row").distinct()
    names = docs.columns
    wide = docs.select(key.alias("row"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    return wide.join(met, "row", "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that the benchmark's windows hit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text", F.length("text")))
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key", ("doc_id",))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
