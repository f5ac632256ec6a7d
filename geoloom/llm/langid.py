"""Language identification: TF-IDF n-gram vectors against several clustered centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.session import checkpoint, ship_package

#: Hashed places of the character n-grams (n = 1, 2, 3).
FEATURES = 4096
#: Labelled documents that centroids are clustered from, at most, in equal shares by language.
FIT_DOCUMENTS = 4000
CENTROIDS = 3
#: Cosine to the nearest centroid below which a text is rejected: this quantile of the language's own texts that took no
#: part in clustering, by length class, times the margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.01, 0.9
#: One in so many of a language's texts is kept out of clustering, if that makes KEPT_OUT or more.
OUT_OF, KEPT_OUT = 5, 20
#: With fewer, the floor is this share of the median over all of them.
REJECT_SHARE = 0.1
#: Length classes: n-grams counted in a text, up to; and the characters to which texts kept out are cut for each class.
LENGTHS = (120, 450, 1500)
CUTS = (20, 50, 160, 520)
#: Documents that are vectorised together.
ROWS = 64
UNDETERMINED = "und"

_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def counts(text: str | None, features: int = FEATURES) -> np.ndarray | None:
    """How often each hashed n-gram occurs in the lower-cased text, runs of other than letters as one blank.

    None for a null text or one without a letter.
    """
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    one = np.concatenate(([32], code[keep], [32])).astype(np.uint32)
    two = one[:-1] * np.uint32(0x9E3779B1) + one[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + one[2:]
    places = np.concatenate([(h * np.uint32(0xC2B2AE35) ^ (h * np.uint32(0xC2B2AE35)) >> np.uint32(15)) % np.uint32(features) for h in (one, two, three)])
    return np.bincount(places, minlength=features)


def length_class(counted: np.ndarray) -> int:
    return int(np.searchsorted(LENGTHS, counted.sum()))


def _weighted(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    table = np.log1p(np.array(rows, np.float32)) * idf
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the centroids of each (rows of one table), the language of each row, rejection cosines by language and length class, and IDF."""

    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """For each text: language (und: null or without a letter), cosine to its nearest centroid, rejected."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        for begin in range(0, len(texts), ROWS):
            found = [(k, c) for k in range(begin, min(begin + ROWS, len(texts))) if (c := counts(texts[k], len(self.idf))) is not None]
            if not found:
                continue
            cosine = _weighted([c for _, c in found], self.idf) @ self.centroids.T
            nearest = cosine.argmax(axis=1)
            for (k, c), n, row in zip(found, nearest, cosine, strict=True):
                score = float(min(1.0, max(0.0, row[n])))
                out[k] = (self.languages[self.of[n]], score, score < float(self.floors[self.of[n], length_class(c)]))
        return out


def _cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; starts are the rows least like those before them."""
    centres = [rows.mean(axis=0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(rows)):
        centres.append(rows[(rows @ np.array(centres).T).max(axis=1).argmin()])
    table = np.array(centres)
    for _ in range(rounds):
        nearest = (rows @ table.T).argmax(axis=1)
        for c in range(len(table)):
            if (nearest == c).any():
                mean = rows[nearest == c].mean(axis=0)
                table[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return table


def document_frequencies(docs: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, int]:
    """In how many texts of `docs` each place occurs, and the number of texts with a letter: `features` + 1 rows."""
    ship_package(docs.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (c := counts(text.as_py(), features)) is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, features)), pa.array(np.concatenate(([n], total)))], ["place", "n"])

    rows = docs.select("text").mapInArrow(summed, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(features + 1, np.int64)
    for r in rows:
        out[r.place + 1] = r.n
    return out[1:], int(out[0])


def fit_languages(docs: DataFrame, features: int = FEATURES, most: int = FIT_DOCUMENTS, centroids: int = CENTROIDS) -> LanguageModel:
    """The model of the labelled rows of `docs` (text and lang not null).

    IDF counts cover all of them; centroids are clustered on the driver from at most `most` different texts, a share for
    each language, taken in the order of a hash of the text: each language has min(share, its different texts).
    """
    ship_package(docs.sparkSession)
    known = docs.where(r"text is not null and lang is not null").select("text", "lang")
    lettered = known.where(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("t"), "text")
    different = checkpoint(lettered.groupBy("lang", "t").count().select("lang", "t"))
    sizes = {r["lang"]: r["count"] for r in different.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, features), np.float32), np.zeros(0, int), np.zeros((0, len(CUTS))), np.ones(features, np.float32))
    df, n = document_frequencies(known, features)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    share = max(1, most // len(sizes))
    draw = F.shiftrightunsigned("t", 11).cast("double") / float(1 << 53)
    chance = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * share + 50) / size))) for lang, size in sorted(sizes.items())], F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("t", 11), "t"))
    picked = different.where(draw <= chance).withColumn("place", place).where(F.col("place") <= share)
    some = lettered.join(F.broadcast(picked), ["lang", "t"]).groupBy("lang", "t", "place").agg(F.first("text").alias("text"))
    out = {lang: min(share, size) >= OUT_OF * KEPT_OUT for lang, size in sizes.items()}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, cuts, tables = [], [], [], []
            for text, lang, place in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                kept_out = out[lang] and place % OUT_OF == 0
                for cut in CUTS if kept_out else (0,):
                    if (c := counts(text[:cut] if 0 < cut < CUTS[-1] else text, features)) is not None:
                        langs.append(lang)
                        places.append(place)
                        cuts.append(cut)
                        tables.append(np.minimum(c, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.int32()), pa.array(cuts, pa.int32()), pa.array(tables, pa.binary())], ["lang", "place", "cut", "counts"])

    taken: dict[str, list[np.ndarray]] = {}
    apart: dict[str, list[np.ndarray]] = {}
    for r in some.select("text", "lang", "place").mapInArrow(vectors, "lang string, place int, cut int, counts binary").orderBy("lang", "place", "cut").collect():
        (apart if r["cut"] else taken).setdefault(r["lang"], []).append(np.frombuffer(bytes(r["counts"]), "<u2"))
    languages = sorted(taken)
    tables, of, floors = [], [], []
    for k, lang in enumerate(languages):
        rows = _weighted(taken[lang], idf)
        tables.append(_cluster(rows, centroids))
        of += [k] * len(tables[-1])
        floor = np.full(len(CUTS), REJECT_SHARE * float(np.median((rows @ tables[-1].T).max(axis=1))))
        if held := apart.get(lang):
            cosine = (_weighted(held, idf) @ tables[-1].T).max(axis=1)
            classes = np.array([length_class(c) for c in held])
            for c in range(len(CUTS)):
                if (classes == c).sum() >= KEPT_OUT:
                    floor[c] = max(floor[c], REJECT_MARGIN * float(np.quantile(cosine[classes == c], REJECT_QUANTILE)))
                elif c:
                    floor[c] = floor[c - 1]
        floors.append(floor)
    return LanguageModel(languages, np.concatenate(tables).astype(np.float32) if tables else np.zeros((0, features), np.float32), np.array(of, int), np.array(floors).reshape(-1, len(CUTS)), idf)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(start, rows)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected, from the text alone.

    A null text, or one without a letter, is `und`, score 0 and rejected; else lang_pred is a learned language, and
    rejected says whether the nearest centroid is further than the language's floor. A model of no language rejects all.
    Whole texts are read, however long; ties go to the first centroid; other columns stay, unless they bear these names.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    at = names.index("text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            langs, scores, rejected = zip(*model.predict(batch.column(at).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "lang_pred", "score", "rejected"])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double, rejected boolean").fields])
    return docs.mapInArrow(marked, schema)


def remainder(column: str, divisor: int) -> Column:
    """CRC-32 of a column as text, modulo divisor; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def keep_identified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of `docs` that a model of `labelled` does not reject; columns stay as they are, whatever their names.

    Texts that are null or have no letter go; repeated rows stay or go together; whole texts are read, however long; ties go
    to the first centroid; an empty table stays empty.
    """
    names = docs.columns
    plain = docs.toDF(*[c if c == "text" else f"own_{i}" for i, c in enumerate(names)])
    return identify(plain, fit_languages(labelled)).where("not rejected").drop("lang_pred", "score", "rejected").toDF(*names)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; those of remainder 2 take no part in learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit_languages(held.where("not held_out"))
    return identify(held.select("doc_id", "held_out", "text"), model).drop("text")
