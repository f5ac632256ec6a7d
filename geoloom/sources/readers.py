"""Readers of answers and files in the shapes that services and surveys give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "type string, id long, lat double, lon double, tags map<string,string>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,ref:long,role:string,geometry:array<struct<lat:double,lon:double>>>>"
RELATION_KEYS = ["building", "natural", "landuse", "water", "leisure"]


def read_overpass_json(answers: DataFrame, column: str = "json") -> DataFrame:
    """Elements with inline geometry: kind (node, way, area, relation), id, tags, lat, lon, geometry, members.

    A closed way with an area tag is an area; relations count if they are multipolygons or boundaries or bear a feature key.
    """
    e = answers.select(F.explode(F.from_json(column, f"elements array<struct<{_inner(ELEMENT)}>>")["elements"]).alias("e")).select("e.*")
    closed = (F.size("geometry") > 2) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    has = lambda k: F.coalesce(F.map_contains_key("tags", k), F.lit(False))
    feature = F.lit(False)
    for k in RELATION_KEYS:
        feature = feature | has(k)
    accepted = F.coalesce(F.col("tags")["type"].isin("multipolygon", "boundary"), F.lit(False)) | feature
    kind = F.when((F.col("type") == "way") & closed & feature, "area").when((F.col("type") == "relation") & ~accepted, None).otherwise(F.col("type"))
    return e.withColumn("kind", kind).where("kind is not null").select("kind", "id", "tags", "lat", "lon", "geometry", "members")


def _inner(ddl: str) -> str:
    """Field list of a struct from top-level DDL: names are followed by a colon."""
    out, depth, name = [], 0, True
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if depth == 0 and ch == " " and name and out and out[-1] not in ", ":
            out.append(":")
            name = False
            continue
        if depth == 0 and ch == ",":
            name = True
        out.append("" if ch == " " else ch)
    return "".join(out)


def read_places_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point features with a name: name, confidence, primary category, alternates, lat, lon."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<names:struct<primary:string>,confidence:double,categories:struct<primary:string,alternate:array<string>>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    named = f.where((F.col("f.geometry.type") == "Point") & (F.trim("f.properties.names.primary") != ""))
    return named.select(F.col("f.properties.names.primary").alias("name"), F.col("f.properties.confidence").alias("confidence"), F.col("f.properties.categories.primary").alias("category"), F.col("f.properties.categories.alternate").alias("alternates"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))


def read_survey_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with a header; the named columns as doubles, null where they aren't numbers."""
    t = spark.read.option("header", True).csv(path)
    return t.withColumns({c: F.col(c).try_cast("double") for c in numbers})
