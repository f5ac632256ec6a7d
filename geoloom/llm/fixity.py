"""Merkle fixity audit of record archives: roots are compared, and only mismatching branches are descended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.session import checkpoint, stored

#: Children of a tree node.
FANOUT = 16
#: Records that an archive is to hold on average.
ARCHIVE_RECORDS = 2048


def record_digest(*payload: str) -> Column:
    """SHA-256 of the payload columns, each preceded by its length in bytes; a null is told apart from an empty one."""
    parts = []
    for p in payload:
        parts += [F.coalesce(F.octet_length(p).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(p), F.lit(""))]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(records: DataFrame, key: list[str], payload: list[str], archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Leaves: archive, ordinal, start and length of every record in archives laid out one after another, with digest.

    Records are dealt to archives by their digest, so no key or source fills one, and lie in the order of digest and
    key. Records equal in key and payload are one leaf with their number, `copies`, so a record that a third of all rows
    repeat is summed before it is dealt. Columns: key, archive, ordinal, start, length, copies, digest.
    """
    size = sum((F.coalesce(F.octet_length(p), F.lit(0)) for p in payload), F.lit(0)).cast("bigint")
    digested = records.select(*key, record_digest(*payload).alias("digest"), size.alias("size"))
    leaves = checkpoint(digested.groupBy(*key, "digest", "size").agg(F.count("*").alias("copies")))
    archives = max(1, -(-leaves.count() // archive_records))
    dealt = leaves.withColumn("archive", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") % archives).cast("int"))
    order = Window.partitionBy("archive").orderBy("digest", *key)
    length = F.col("size") * F.col("copies")
    start = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select(*key, "archive", (F.row_number().over(order) - 1).alias("ordinal"), start.alias("start"), length.alias("length"), "copies", "digest")


def _leaf_hash() -> Column:
    return F.sha2(F.concat_ws("|", "digest", "start", "length", "copies").cast("binary"), 256)


def tree(leaves: DataFrame, depth: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels `(archive, node, hash)` from the leaves (0) to the roots (depth).

    A node hashes its children's hashes in the order of their offsets; it has `fanout` children at most. Each level above
    the leaves is stored once, so that a comparison reads it and builds nothing anew.
    """
    levels = [leaves.select("archive", F.col("ordinal").cast("bigint").alias("node"), _leaf_hash().alias("hash"))]
    for _ in range(depth):
        child = levels[-1].select("archive", F.floor(F.col("node") / fanout).alias("node"), F.struct("node", "hash").alias("child"))
        hashed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat(c["node"].cast("string"), F.lit("="), c["hash"])), ",").cast("binary"), 256)
        levels.append(stored(child.groupBy("archive", "node").agg(hashed.alias("hash"))))
    return levels


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Where the replica's leaves differ: `(archive, ordinal, primary_hash, replica_hash)`, a missing leaf's hash null.

    Both are leaf tables of manifest(), the replica's with what it holds at the same places. Roots are compared first;
    each further level compares only the children of nodes that differ. Equal replicas give no row.
    """
    most = primary.select("ordinal").union(replica.select("ordinal")).agg(F.max("ordinal")).first()[0] or 0
    depth = 0
    while fanout**depth <= most:
        depth += 1
    ours, theirs = tree(primary, depth, fanout), tree(replica, depth, fanout)
    suspect = None
    for level in range(depth, -1, -1):
        a, b = ours[level].withColumnRenamed("hash", "a"), theirs[level].withColumnRenamed("hash", "b")
        if suspect is not None:
            inside = lambda t: t.withColumn("parent", F.floor(F.col("node") / fanout)).join(suspect, ["archive", "parent"], "left_semi").drop("parent")  # noqa: B023, E731
            a, b = inside(a), inside(b)
        differ = checkpoint(a.join(b, ["archive", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))))
        suspect = differ.select("archive", F.col("node").alias("parent"))
    return differ.select("archive", F.col("node").cast("int").alias("ordinal"), F.col("a").alias("primary_hash"), F.col("b").alias("replica_hash"))


def locate(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The primary's leaves that the replica has not or holds otherwise: its columns, replica_digest and `issue`.

    issue is changed or missing; a leaf that only the replica has is `surplus`, with the primary's columns null. Null
    keys and empty payloads are leaves like any other; empty tables give no row.
    """
    found = audit(primary, replica, fanout)
    held = replica.select("archive", "ordinal", F.col("digest").alias("replica_digest"))
    out = found.join(primary, ["archive", "ordinal"], "left").join(held, ["archive", "ordinal"], "left")
    issue = F.when(F.col("primary_hash").isNull(), "surplus").when(F.col("replica_hash").isNull(), "missing").otherwise("changed")
    return out.withColumn("issue", issue).drop("primary_hash", "replica_hash")


def page_replica(pages: DataFrame) -> DataFrame:
    """A damaged copy of `pages`, as `(page_id, url, replica_html, lost)`, made by rule so that the audit has work.

    By the remainder of page_id by 97: 5 has a byte in the middle replaced, 6 ends after half, 7 is lost.
    """
    rest, html = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(97)), F.coalesce("html", F.lit(""))
    half = F.floor(F.length(html) / 2).cast("int")
    damaged = F.when(rest == 5, F.concat(F.left(html, half), F.lit("~"), F.substring(html, half + 2, F.length(html)))).when(rest == 6, F.left(html, half)).otherwise(F.col("html"))
    return pages.select("page_id", "url", "html", damaged.alias("replica_html"), (rest == 7).alias("lost"))


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archived records, audited against a damaged replica: every damaged record and where it lies."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    leaves = checkpoint(manifest(pages, ["page_id", "url"], ["url", "html"]))
    damaged = page_replica(pages).where("not lost").select("page_id", "url", record_digest("url", "html").alias("of"), record_digest("url", "replica_html").alias("now")).distinct()
    same = leaves["page_id"].eqNullSafe(damaged["page_id"]) & leaves["url"].eqNullSafe(damaged["url"]) & (leaves["digest"] == damaged["of"])
    held = leaves.join(damaged, same).select("archive", "ordinal", "start", "length", "copies", F.col("now").alias("digest"))
    return locate(leaves, checkpoint(held)).select("page_id", "url", "archive", "ordinal", "start", "length", "copies", "digest", "replica_digest", "issue")


OP9_SQL = """
WITH p AS (SELECT page_id, url, html, coalesce(html, '') AS h, coalesce(page_id, 0) % 97 AS m FROM pages),
q AS (SELECT *, CASE WHEN m = 5 THEN left(h, length(h) // 2) || '~' || substr(h, length(h) // 2 + 2) WHEN m = 6 THEN left(h, length(h) // 2) ELSE html END AS r FROM p),
s AS (SELECT page_id, url, m,
  sha256(coalesce(CAST(strlen(url) AS VARCHAR), '-') || ':' || coalesce(url, '') || coalesce(CAST(strlen(html) AS VARCHAR), '-') || ':' || coalesce(html, '')) AS digest,
  sha256(coalesce(CAST(strlen(url) AS VARCHAR), '-') || ':' || coalesce(url, '') || coalesce(CAST(strlen(r) AS VARCHAR), '-') || ':' || coalesce(r, '')) AS now,
  coalesce(strlen(url), 0) + coalesce(strlen(html), 0) AS size FROM q),
g AS (SELECT page_id, url, m, digest, now, size, count(*) AS copies FROM s GROUP BY ALL),
a AS (SELECT *, CAST(('0x' || digest[:8])::BIGINT % greatest(1, CAST(ceil((SELECT count(*) FROM g) / 2048.0) AS BIGINT)) AS INTEGER) AS archive FROM g),
l AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS ordinal, CAST(coalesce(sum(size * copies) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM a WINDOW w AS (PARTITION BY archive ORDER BY digest, page_id NULLS FIRST, url NULLS FIRST))
SELECT page_id, url, archive, ordinal, start, size * copies AS length, copies, digest, CASE WHEN m <> 7 THEN now END AS replica_digest, CASE WHEN m = 7 THEN 'missing' ELSE 'changed' END AS issue
FROM l WHERE m = 7 OR digest <> now
"""
