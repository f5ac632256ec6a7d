"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.session import stored

#: Rows of one (shard, bucket) group that are numbered by one task.
ROWS_PER_BUCKET = 50_000


def draws(key: Column, shards: int, weights: Mapping[int, float] | None = None) -> Column:
    """The array of all shards' draws for `key`, a string column (null counts as the empty key).

    A draw is 52 bits of MD5 over key and shard, so any engine can repeat the placement. With weights it becomes
    ln(u) / weight, whose greatest value wins each shard its share of the weights; without, u itself is in the same order.
    """
    weights = weights or {}
    if shards < 1 or any(w <= 0 for w in weights.values()):
        raise ValueError("at least one shard, and weights above zero")
    key = F.coalesce(key, F.lit(""))
    hexes = lambda s: F.substring(F.md5(F.concat(key, F.lit("#"), s.cast("string")).cast("binary")), 1, 13)
    numbers = F.array(*[F.lit(s) for s in range(shards)])
    if not weights:
        return F.transform(numbers, lambda s: F.struct(hexes(s).alias("draw"), (-s).alias("minus")))
    of = F.array(*[F.lit(float(weights.get(s, 1.0))) for s in range(shards)])
    u = lambda s: (F.conv(hexes(s), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.transform(numbers, lambda s: F.struct((F.log(u(s)) / F.get(of, s)).alias("draw"), (-s).alias("minus")))


def winner(drawn: Column) -> Column:
    """The shard of the greatest draw; the lower shard wins a tie."""
    return -F.array_max(drawn)["minus"]


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], buckets: int, bucket_key: Column) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in column `slot`.

    Rows that are equal in all columns are counted first, with a map-side combine, and numbered as one: a row that a third
    of the table repeats makes no bucket larger. A shard's different rows are dealt over `buckets` by a hash of
    bucket_key; each bucket is numbered by itself in the given order and starts where the buckets before it end. No task
    holds a whole shard, whatever its size. Nulls sort first; ties in the order take any slots next to each other; an
    empty table stays empty. Columns have to be comparable (no maps) and not to begin with `_slots_`.
    """
    names = rows.columns
    dealt = stored(rows.groupBy(*names).agg(F.count("*").alias("_slots_n")).withColumn("_slots_bucket", F.pmod(F.xxhash64(bucket_key), F.lit(buckets)).cast("int")))
    starts = dealt.groupBy(shard, "_slots_bucket").agg(F.sum("_slots_n").alias("_slots_all"))
    before = Window.partitionBy(shard).orderBy("_slots_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(shard, "_slots_bucket", F.coalesce(F.sum("_slots_all").over(before), F.lit(0)).alias("_slots_start"))
    within = Window.partitionBy(shard, "_slots_bucket").orderBy(*order, *[c for c in names if c not in order]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("_slots_rank", F.coalesce(F.sum("_slots_n").over(within), F.lit(0)))
    first = numbered.join(starts, [shard, "_slots_bucket"]).withColumn("_slots_first", F.col("_slots_start") + F.col("_slots_rank"))
    # Copies are given out in two steps, so that those of one row can be dealt over tasks.
    parts = F.sequence(F.lit(0).cast("bigint"), F.col("_slots_n") - 1, F.lit(ROWS_PER_BUCKET).cast("bigint"))
    parted = first.withColumn("_slots_part", F.explode(parts))
    if not dealt.where(F.col("_slots_n") > ROWS_PER_BUCKET).isEmpty():
        parted = parted.repartition(F.col("_slots_first"), F.col("_slots_part"))
    copies = F.sequence(F.col("_slots_part"), F.least(F.col("_slots_n"), F.col("_slots_part") + ROWS_PER_BUCKET) - 1)
    return parted.select(*names, "_slots_first", F.explode(copies).alias("_slots_copy")).select(*names, (F.col("_slots_first") + F.col("_slots_copy")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int, weights: Mapping[int, float] | None = None) -> DataFrame:
    """`docs` with `shard` (of the given number) and `grown_shard` (of one more), both from doc_id alone.

    A null doc_id is the empty key; repeated rows share a shard; the text plays no part. Weights of shards beyond the
    mapping are 1. A new shard takes only the rows whose draw it wins; no other row moves. An empty table stays empty. The
    columns that `docs` brings stay, unless they are called shard or grown_shard in any letter case.
    """
    docs = docs.drop("shard", "grown_shard")
    names = docs.columns
    plain = docs.toDF(*[c if c == "doc_id" else f"own_{i}" for i, c in enumerate(names)])
    drawn = plain.withColumn("draws", draws(F.col("doc_id").cast("string"), shards + 1, weights))
    placed = drawn.withColumns({"shard": winner(F.slice("draws", 1, shards)), "grown_shard": winner(F.col("draws"))}).drop("draws")
    return placed.toDF(*names, "shard", "grown_shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; every task writes the rows it holds, so no shard passes through one task.

    An empty table makes no folder for a shard; a column `shard` of nulls would get a folder of its own.
    """
    placed.write.partitionBy("shard").mode("overwrite").parquet(path)


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by rendezvous hashing of doc_id (the law `key`)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    measured = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"))
    placed = assign_shards(measured, 40)
    rows = docs.select("doc_id").count()
    buckets = max(1, -(-rows // (40 * ROWS_PER_BUCKET)))
    # Equal doc_ids may repeat, so the bucket is dealt by all that a row carries; rows equal in all are interchangeable.
    out = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], buckets, F.concat_ws("|", "doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT unnest(range(41)) AS s),
p AS (SELECT doc_id, max_by(s, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || s)[:13] || printf('%02d', 99 - s)) FILTER (s < 40) AS shard,
        max_by(s, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || s)[:13] || printf('%02d', 99 - s)) AS grown_shard
      FROM (SELECT DISTINCT doc_id FROM d), s GROUP BY doc_id),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
      FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
b AS (SELECT doc_id, t, (SELECT t FROM crc_table) AS k, regexp_extract_all(hex(encode(t)), '..') AS h FROM d),
c AS (SELECT doc_id, t, xor(list_reduce([4294967295::BIGINT] || list_transform(h, lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, k[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b)
SELECT c.doc_id, strlen(t) + 16 AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, text_crc32, strlen(t)) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM c JOIN p ON c.doc_id IS NOT DISTINCT FROM p.doc_id
"""
