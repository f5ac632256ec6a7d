"""Structured Streaming jobs over observation streams; each takes an unbounded or a bounded DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.weather import latest_by_cell
from geoloom.session import checkpoint
from geoloom.sources.sinks import merge_as_set, overwrite_cells

EVENT_SCHEMA = "event_id long, station string, user_id long, lat_e7 long, lon_e7 long, ts timestamp, wx string, temp_c double"


def read_observations(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Station reports as a stream of Parquet files."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh(events: DataFrame, minutes: int) -> DataFrame:
    """Late data beyond the freshness of its kind is dropped."""
    return events.withWatermark("ts", f"{minutes} minutes")


def refreshed_cells(events: DataFrame, value: str = "temp_c", width: str = "5 minutes", step_e7: int = 100_000) -> DataFrame:
    """The newest value of each cell in tumbling windows."""
    return latest_by_cell(events, value, width, step_e7)


def trailing_rate(events: DataFrame, size: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Events in sliding windows."""
    return events.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def held_weather(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a station: weather is held for `gap` after the last report."""
    s = events.groupBy("station", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("station", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame) -> DataFrame:
    """An observation that is seen again is ignored, within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def enriched(events: DataFrame, places: DataFrame, step_e7: int = 500_000) -> DataFrame:
    """Events with the place group of their cell, from a static table."""
    groups = places.select(F.floor(F.col("lat_e7") / step_e7).alias("cy"), F.floor(F.col("lon_e7") / step_e7).alias("cx"), "place_id").groupBy("cy", "cx").agg(F.min("place_id").alias("place_group"))
    keyed = events.withColumns({"cy": F.floor(F.col("lat_e7") / step_e7), "cx": F.floor(F.col("lon_e7") / step_e7)})
    return keyed.join(groups, ["cy", "cx"], "left").drop("cy", "cx")


def fused_streams(radar: DataFrame, stations: DataFrame, minutes: int = 75) -> DataFrame:
    """Radar readings with the reports of their cell in the `minutes` before them; both sides carry watermarks."""
    cell = lambda df, p: df.select(F.floor(F.col("lat_e7") / 1_000_000).alias(f"{p}y"), F.floor(F.col("lon_e7") / 1_000_000).alias(f"{p}x"), F.col("ts").alias(f"{p}_ts"), F.col("event_id").alias(f"{p}_id"))
    r, s = cell(radar, "r").withWatermark("r_ts", "30 minutes"), cell(stations, "s").withWatermark("s_ts", "75 minutes")
    near = F.expr(f"ry = sy AND rx = sx AND s_ts >= r_ts - INTERVAL {minutes} MINUTES AND s_ts <= r_ts")
    return r.join(s, near, "leftOuter")


def latest_with_expiry(events: DataFrame, minutes: int = 20) -> DataFrame:
    """The latest reading of each station as reports come, with state that expires in event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (0, None)
        for frame in frames:
            for r in frame.itertuples():
                at = int(r.ts.timestamp() * 1_000_000)
                if at >= held[0] and r.temp_c == r.temp_c:
                    held = (at, float(r.temp_c))
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        if held[1] is not None:
            yield pd.DataFrame({"station": [key[0]], "at": [held[0]], "temp_c": [held[1]]})

    return events.groupBy("station").applyInPandasWithState(step, "station string, at long, temp_c double", "at long, temp_c double", "update", "EventTimeTimeout")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def upsert_cells(path: str, cells_a_part: int = 100):
    """A foreachBatch sink: the newest version of a cell wins; only the parts that hold the batch's cells are rewritten.

    A part is a square of `cells_a_part` cells a side, so that files stay few. A batch that runs again changes nothing.
    """
    part = {f"part_{a}": F.floor(F.col(f"cell_{a}") / cells_a_part) for a in ("lat", "lon")}

    def newest_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cell_lat", "cell_lon").agg(F.max_by(F.struct("version", "value"), "version").alias("v")).select("cell_lat", "cell_lon", "v.*").withColumns(part)

    def write(batch: DataFrame, _: int) -> None:
        spark, newest = batch.sparkSession, newest_of(batch)
        if _exists(spark, path):
            held = spark.read.parquet(path).join(newest.select(*part).distinct(), [*part], "left_semi").select(*newest.columns)
            newest = checkpoint(newest_of(held.unionByName(newest)))  # the store is read before it is written
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)

    return write


def add_places(path: str, step_e7: int = 1_000_000):
    """A foreachBatch sink: new places join those that their cell holds, identical rows once; other cells stay as they are.

    A batch that runs again changes nothing. With the `availableNow` trigger, it imports what has come since the last run.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumns({"cell_lat": F.floor(F.col("lat_e7") / step_e7), "cell_lon": F.floor(F.col("lon_e7") / step_e7)}).dropDuplicates()
        if _exists(spark, path):
            held = spark.read.parquet(path).join(new.select("cell_lat", "cell_lon").distinct(), ["cell_lat", "cell_lon"], "left_semi").select(*new.columns)
            new = checkpoint(merge_as_set(held, new))  # the store is read before it is written
        overwrite_cells(new, path)

    return write


def dwellers(positions: DataFrame, covered: DataFrame, dwell_s: int = 60, again_s: int = 600, step_e7: int = 1_000_000) -> DataFrame:
    """One offer for each entity that has been outside all covered cells for `dwell_s` seconds, no other for `again_s` seconds.

    A position inside ends the stay; the last offer is remembered across stays. A position older than the newest one seen is
    ignored, as is one without a time; of positions at one time, an inside one comes last. State holds three numbers for each
    entity and goes `again_s` seconds of event time after its newest position. `positions` carries a watermark.
    """
    cells = covered.select("cell_lat", "cell_lon").distinct().withColumn("held", F.lit(True))
    keyed = positions.where("ts is not null").withColumns({"cell_lat": F.floor(F.col("lat_e7") / step_e7), "cell_lon": F.floor(F.col("lon_e7") / step_e7)})
    marked = keyed.join(cells, ["cell_lat", "cell_lon"], "left").select("station", "ts", F.col("held").isNotNull().alias("inside"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, since, offered = state.get if state.exists else (-1, -1, -1)
        offers = []
        for frame in frames:
            for r in frame.sort_values(["ts", "inside"]).itertuples():
                at = int(r.ts.timestamp() * 1_000_000)
                if at < newest:
                    continue
                newest = at
                if r.inside:
                    since = -1
                    continue
                since = at if since < 0 else since
                if at - since >= dwell_s * 1_000_000 and (offered < 0 or at - offered >= again_s * 1_000_000):
                    offered = at
                    offers.append((key[0], since, at))
        state.update((newest, since, offered))
        state.setTimeoutTimestamp(max(newest // 1000 + again_s * 1000, state.getCurrentWatermarkMs() + 1))
        if offers:
            yield pd.DataFrame(offers, columns=["station", "since", "offered"])

    return marked.groupBy("station").applyInPandasWithState(step, "station string, since long, offered long", "newest long, since long, offered long", "append", "EventTimeTimeout")


def readiness(positions: DataFrame, ready: DataFrame, reach: int = 2, step_e7: int = 1_000_000) -> DataFrame:
    """Ready against needed cells round each entity's latest position; `complete` says whether all of them are ready."""
    latest = positions.groupBy("station").agg(F.max_by(F.struct("lat_e7", "lon_e7"), F.struct("ts", "event_id")).alias("p"))
    cells = latest.select("station", F.floor(F.col("p.lat_e7") / step_e7).alias("y"), F.floor(F.col("p.lon_e7") / step_e7).alias("x"))
    around = F.sequence(F.lit(-reach), F.lit(reach))
    needed = cells.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select("station", (F.col("y") + F.col("dy")).alias("cell_lat"), (F.col("x") + F.col("dx")).alias("cell_lon"))
    met = needed.join(ready.select("cell_lat", "cell_lon").distinct().withColumn("is_ready", F.lit(1)), ["cell_lat", "cell_lon"], "left")
    counted = met.groupBy("station").agg(F.count("*").alias("needed"), F.coalesce(F.sum("is_ready"), F.lit(0)).alias("ready"))
    return counted.withColumn("complete", F.col("ready") == F.col("needed"))
