"""Groups of spelling variants: words one edit apart, found among the rotations of terminator-marked words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.words import BLOCK, sliced
from geoloom.session import ship_package, stored

#: Marks the end of a word in its rotations; no word holds it.
TERMINATOR = "$"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A variant's form is at least so many times as frequent as the variant.
RATIO = 2
#: Of so many different words in a document, one loses a character (0: none), as the query's contract asks.
DAMAGE = 97
#: Different words that a worker counts before it hands its counts on.
HELD_WORDS = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _blocks(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK characters that end where no run goes on."""
    begin = 0
    while len(text) - begin > 2 * BLOCK:
        end = begin + BLOCK
        if (run := _RUN.match(text, end - 1)) is not None:
            end = run.end()
        yield text[begin:end]
        begin = end
    yield text[begin:]


def word_counts(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """`(word, n)`: the runs of letters of all whole texts, A-Z in lower case, with how often they occur.

    Where `damage` divides the CRC-32 of "<doc_id>:<run>", the run loses the character at that CRC modulo its length.
    Counted in the workers, so what is shuffled is one row for each different word of a worker's share. A null text has no
    words; a null doc_id is the empty string; repeated rows count each time; an empty table gives no word. Other columns,
    whatever their names, are not read.
    """
    ship_package(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= least_length]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in _blocks(text.as_py() or ""):
                    runs = Counter(_RUN.findall(part.translate(_LOWER) if not part.isascii() else part.lower()))
                    for word, n in runs.items():
                        if damage and (h := zlib.crc32(word.encode(), seed)) % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield handed_on()
                    held.clear()
        yield handed_on()

    partial = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """Every rotation of each word with its terminator, as the two prefixes that a word of one edit shares with it.

    Rotated to begin behind a gap, a whole word is the prefix of all words with one character more in that gap
    (`whole`). Rotated to begin behind a character and cut before it, a word shares the prefix with those that have another
    character there, and with the whole word that lacks it. In a run of equal characters only the first is `first`: to take
    away any of them gives the same word.
    """
    w, n = F.col("word"), F.length("word")
    behind = lambda i: F.concat(F.substring(w, i + 1, n), F.lit(TERMINATOR))
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.concat(behind(i), F.substring(w, F.lit(1), i)).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first")))
    fresh = lambda i: (i == 1) | (F.substring(w, i, F.lit(1)) != F.substring(w, i - 1, F.lit(1)))
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(behind(i), F.substring(w, F.lit(1), i - 1)).alias("prefix"), F.lit(False).alias("whole"), fresh(i).alias("first")))
    return words.select("word", "n", F.inline(F.concat(gaps, cut)))


def near_words(words: DataFrame) -> DataFrame:
    """`(word, n_near, near_n, near)`: for each of the different `words` (word, n) that has words one edit away, how many, and the most frequent one.

    Rotations are sorted by prefix; a group has one row for each character that can stand in its gap and one for the whole
    word, so its size is bounded by the alphabet, whatever the number of words. Two words meet in exactly one group. Of
    equally frequent ones, the first in code-point order. An empty table gives no row.
    """
    group = Window.partitionBy("prefix")
    ranked = group.orderBy("whole", F.desc("n"), "word")
    every = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct(F.negate("n").alias("minus"), F.col("word").alias("near"))
    met = rotations(words).select(
        "*",
        F.row_number().over(ranked).alias("place"),
        F.count_if(~F.col("whole")).over(every).alias("others"),
        F.count_if(F.col("first")).over(every).alias("longer"),
        F.first(F.when(~F.col("whole"), me), ignorenulls=True).over(every).alias("best"),
        F.nth_value(F.when(~F.col("whole"), me), 2).over(every).alias("second"),
        F.first(F.when(F.col("first"), me), ignorenulls=True).over(every).alias("best_longer"),
        F.max(F.when(F.col("whole"), me)).over(every).alias("shorter"),
    )
    taken = F.when(F.col("first"), F.col("shorter"))
    replaced = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("best"))
    seen = met.select(
        "word",
        F.when(F.col("whole"), F.col("longer")).otherwise(F.col("others") - 1 + F.when(taken.isNotNull(), 1).otherwise(0)).alias("found"),
        F.when(F.col("whole"), F.col("best_longer")).otherwise(F.least(replaced, taken)).alias("top"),
    )
    near = seen.where("found > 0").groupBy("word").agg(F.sum("found").alias("n_near"), F.min("top").alias("top"))
    return near.select("word", "n_near", F.negate("top.minus").alias("near_n"), "top.near")


def roots(forms: DataFrame) -> DataFrame:
    """`(word, root)` for each row of `forms` (word, form): the end of its chain of forms.

    Every round doubles the step of each word, so chains of any length end after the binary logarithm of it in rounds;
    each form is more frequent than its word, so there are no rings. An empty table gives no row.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stored(steps.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return steps


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """`words` (word, n; each word once) with their form and root: `(word, form, root, n, n_near, form_n)`.

    The form of a word is its most frequent near word, if that is at least `ratio` (above 1) times as frequent; the root is where the
    forms lead, the word itself if it has none.
    """
    near = near_words(words)
    joined = words.join(near, "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    found = stored(joined.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of `documents` of five letters and three occurrences at least, with their forms and roots."""
    return variant_groups(stored(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


OP12_SQL = """
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
      FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
own AS (SELECT d, w, count(*) AS n FROM runs GROUP BY 1, 2),
h AS (SELECT w, n, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(d || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS h FROM own, crc_table),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h)
      WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
gaps AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || '_' || word[i + 1:] AS same, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM gaps a JOIN gaps b ON a.same = b.same AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.less = b.word),
top AS (SELECT word, count(*) AS n_near, max(n) AS near_n, min(near) FILTER (n = most) AS near FROM (SELECT *, max(n) OVER (PARTITION BY word) AS most FROM pairs) GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN near_n >= 2 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN top USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON k.next = f.word)
SELECT f.word, form, k.at AS root, n, n_near, form_n FROM forms f JOIN walk k ON k.word = f.word AND k.next IS NULL
"""
