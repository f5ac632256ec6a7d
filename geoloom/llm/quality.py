"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio with a fixed threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 10_000
#: Trusted documents that the target multinomial is counted over, at most; the raw one is counted over all documents.
TRUSTED_DOCUMENTS = 20_000
#: Mean log-likelihood ratio of an n-gram from which a document is kept.
THRESHOLD = -0.1
REPEAT_WINDOW = 8

def words(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(hashes: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words in windows found twice or more, from the windows' hashes in the order of the text.

    Equal hashes meet after a sort; the places of those that have an equal neighbour are sorted again and the words they
    cover are counted once. Texts whose hashes are all different, nearly all, skip that.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None)), F.slice(placed, 1, F.size(placed) - 1))
    after = F.concat(F.slice(placed, 2, F.size(placed)), F.array(F.lit(None)))
    marked = F.transform(
        F.arrays_zip(placed.alias("here"), before.alias("before"), after.alias("after")),
        lambda z: F.when((z["here"]["h"] == z["before"]["h"]) | (z["here"]["h"] == z["after"]["h"]), z["here"]["i"]),
    )
    places = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("stop"))
    covered = F.aggregate(places, zero, lambda s, p: F.struct((s["words"] + p + window - F.greatest(p, s["stop"])).alias("words"), (p + window).alias("stop")))["words"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("bigint")


def _pairs(hashes: Column, gap: int) -> Column:
    """A hash of each hash and the one `gap` places on."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, gap + 1, n), lambda a, b: F.xxhash64(a, b))


def with_grams(docs: DataFrame) -> DataFrame:
    """`docs` with __words, and hashes of each word (__ones), each pair of neighbours (__twos) and each word's last two characters (__ends)."""
    split = docs.withColumn("__words", words(F.coalesce("text", F.lit(""))))
    hashed = split.withColumns({"__ones": F.transform("__words", lambda w: F.xxhash64(w)), "__ends": F.transform("__words", lambda w: F.xxhash64(F.substring(w, -2, 2), F.lit("$")))})
    return hashed.withColumn("__twos", _pairs(F.col("__ones"), 1))


def base_counts(marked: DataFrame) -> DataFrame:
    """The rows of with_grams() with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has none of anything and fails. Windows of 8 words are compared by a 64-bit hash, made from
    those of their halves; a text whose windows of 4 words all differ repeats none of 8.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    fours = marked.withColumns({"__fours": _pairs(F.col("__twos"), 2), "__lines": lines})
    unlike = F.size(F.array_distinct("__fours")) == F.size("__fours")
    out = fours.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.when(unlike, F.lit(0)).otherwise(repeated_words(_pairs(F.col("__fours"), 4))).cast("bigint"),
        }
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__fours", "__lines")


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCUMENTS) -> DataFrame:
    """doc_ids of at most `most` documents of quality 1, by the order of a hash: a bounded table."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TRUSTED_DOCUMENTS) -> list[float]:
    """Each bucket's log-ratio of its share in the trusted target to its share in the raw corpus (all of `docs`).

    One is added to every count. Without a trusted document, all ratios are 0. The counts are summed in Spark; `buckets`
    rows come to the driver.
    """
    good = trusted_ids(labels, most).select(F.col("doc_id").alias("__trusted"))
    read = with_grams(docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("__trusted"), "left"))
    seen = read.select(F.col("__trusted").isNotNull().cast("int").alias("target"), F.explode(F.concat("__ones", "__twos", "__ends")).alias("gram"))
    counts = seen.groupBy(F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if sum(target) == buckets:
        return [0.0] * buckets
    base = math.log(sum(raw) / sum(target))
    return [math.log(t / r) + base for t, r in zip(target, raw, strict=True)]


def with_verdict(marked: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of with_grams() with score, the mean ratio of a text's n-grams (0 without any), and kept: score >= threshold."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    add = lambda s, g: s + F.get(table, F.pmod(g, F.lit(len(ratios))).cast("int"))
    total = sum(F.aggregate(c, F.lit(0.0), add) for c in ("__ones", "__twos", "__ends"))
    n = F.size("__ones") + F.size("__twos") + F.size("__ends")
    score = F.when(n > 0, total / n).otherwise(0.0)
    return marked.withColumn("score", score).withColumn("kept", F.col("score") >= threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `docs` with its base counts, its score and `kept`: base_failed false and score >= threshold.

    A null, empty or blank text has no n-gram and fails the base rules. Repeated rows get equal results each; an empty table
    gives none; whole texts are read, however long; a score equal to the threshold keeps its row. The columns that `docs`
    brings stay, unless they bear the name of a result in any letter case. Only DataFrame functions are used.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = docs.drop(*results)
    names = docs.columns
    plain = docs.toDF(*[c if c == "text" else f"own_{i}" for i, c in enumerate(names)])
    scored = with_verdict(base_counts(with_grams(plain)), log_ratios(docs, labels), threshold)
    return scored.withColumn("kept", ~F.col("base_failed") & F.col("kept")).select(*plain.columns, *results).toDF(*names, *results)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
