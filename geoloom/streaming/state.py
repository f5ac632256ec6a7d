"""Streams that keep state by key with timers, and sinks that follow a state from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geoloom.operators.weather import READING_MINUTES, reading_or_mean
from geoloom.session import checkpoint, ship_package
from geoloom.streaming.observations import _exists, readiness, upsert_cells

#: Neighbours within a cell of this side (5 km) share one reading.
AREA_E7 = 500_000
_HELD = "at long, event_id long, lat_e7 long, lon_e7 long, temp double"
_CHANGE = f"cell_lat long, cell_lon long, {_HELD}, live boolean"
#: The state store that state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LatestReading(StatefulProcessor):
    """Holds one area's newest reading; its timer stands `minutes` of event time after that reading."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def _hold(self, reading: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update(reading)
        self.handle.registerTimer(reading[0] // 1000 + self.minutes * 60_000)

    def _newest(self, rows: pd.DataFrame, best: tuple | None) -> tuple | None:
        for r in rows.itertuples():
            found = (int(r.at), int(r.event_id), int(r.lat_e7), int(r.lon_e7), float(r.temp))
            if best is None or found[:2] > tuple(best[:2]):
                best = found
        return best

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        best = held
        for frame in rows:
            best = self._newest(frame, best)
        if best is not None and best != held:
            self._hold(best)
            yield self._change(key, best, True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = tuple(self.held.get())
            self.held.clear()
            yield self._change(key, held, False)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        best = self._newest(initialState, None)
        if best is not None:
            self._hold(best)

    def _change(self, key: Any, held: tuple, live: bool) -> pd.DataFrame:
        names = ("cell_lat", "cell_lon", "at", "event_id", "lat_e7", "lon_e7", "temp", "live")
        return pd.DataFrame({n: [v] for n, v in zip(names, (int(key[0]), int(key[1]), *held, live), strict=True)})

    def close(self) -> None:
        pass


def _areas(events: DataFrame, area_e7: int) -> DataFrame:
    """Readings with a time, a place and a temperature, under their area."""
    cell = {f"cell_{a}": F.floor(F.col(f"{a}_e7") / area_e7) for a in ("lat", "lon")}
    full = events.where("ts is not null and lat_e7 is not null and lon_e7 is not null and event_id is not null and temp_c is not null and not isnan(temp_c)")
    return full.withColumns(cell).select("cell_lat", "cell_lon", "ts", F.unix_micros("ts").alias("at"), "event_id", "lat_e7", "lon_e7", F.col("temp_c").alias("temp"))


def reading_changes(events: DataFrame, minutes: int = READING_MINUTES, area_e7: int = AREA_E7, initial: DataFrame | None = None) -> DataFrame:
    """Each area's newest reading as it changes: a row with `live` true when it comes, one with false when it has expired.

    Of readings at one time the greatest event_id counts. A reading expires `minutes` after its time, once the watermark of
    `events` gets there; rows later than the watermark are dropped. `initial`: a table of readings with the columns of
    `events` that areas start from. Rows without a time, place, id or temperature are ignored. State is five numbers an
    area, none for areas whose reading has expired. Needs the RocksDB state store (`ROCKS`).
    """
    ship_package(events.sparkSession)
    keyed = _areas(events, area_e7).groupBy("cell_lat", "cell_lon")
    start = None if initial is None else _areas(initial, area_e7).drop("ts").groupBy("cell_lat", "cell_lon")
    return keyed.transformWithStateInPandas(_LatestReading(minutes), _CHANGE, "Update", "EventTime", initialState=start)


def keep_readings(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of reading_changes(): one row for each area, its last change. A batch that runs again changes nothing."""
    upsert = upsert_cells(path)

    def write(batch: DataFrame, number: int) -> None:
        version = F.struct("at", "event_id", (~F.col("live")).alias("gone"))
        upsert(batch.select("cell_lat", "cell_lon", version.alias("version"), F.struct("lat_e7", "lon_e7", "temp", "live").alias("value")), number)

    return write


def kept_readings(store: DataFrame) -> DataFrame:
    """`(reading_id, lat_e7, lon_e7, temp)`: the readings in the store that have not expired."""
    return store.where("value.live").select(F.col("version.event_id").alias("reading_id"), "value.lat_e7", "value.lon_e7", "value.temp")


def current_readings(events: DataFrame, now: Column, minutes: int = READING_MINUTES, area_e7: int = AREA_E7) -> DataFrame:
    """The same from a table: each area's newest reading that is less than `minutes` old at `now`."""
    newest = _areas(events, area_e7).groupBy("cell_lat", "cell_lon").agg(F.max_by(F.struct("at", "event_id", "lat_e7", "lon_e7", "temp"), F.struct("at", "event_id")).alias("v")).select("v.*")
    return newest.where(F.col("at") + minutes * 60_000_000 > F.unix_micros(now)).select(F.col("event_id").alias("reading_id"), "lat_e7", "lon_e7", "temp")


def temperature_at(places: DataFrame, readings: DataFrame, key: str, metres: float = 30_000.0) -> DataFrame:
    """`(key, temp, measured)`: the nearest kept reading within `metres` of each place, else the mean of all; null if there is none."""
    return reading_or_mean(places.select(key, "lat_e7", "lon_e7"), readings, key, metres)


def _rate(done: Column, total: Column, recent: Column, trail_s: int) -> list[Column]:
    rate = recent / F.lit(float(trail_s))
    return [rate.alias("rate"), F.when(total.isNotNull(), F.greatest((total - done) / rate, F.lit(0.0))).alias("left_s")]


def seconds_done(events: DataFrame, key: str) -> DataFrame:
    """`(key, second, n)`: events in each second that has any; in a stream a second comes out once the watermark has passed it."""
    counted = events.where("ts is not null").groupBy(key, F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.unix_seconds("w.start").alias("second"), "n")


class _Progress(StatefulProcessor):
    """Holds a key's count so far and those of its last `trail_s` seconds."""

    def __init__(self, key: str, trail_s: int):
        self.key, self.trail_s = key, trail_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "done long, seconds array<long>, counts array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done, seconds, counts = self.held.get() if self.held.exists() else (0, [], [])
        trail, out = dict(zip(seconds, counts, strict=True)), []
        for second, n in sorted((int(r.second), int(r.n)) for frame in rows for r in frame.itertuples()):
            done += n
            trail = {s: c for s, c in trail.items() if s > second - self.trail_s} | {second: n}
            out.append((key[0], second, done, sum(trail.values())))
        self.held.update((done, list(trail), list(trail.values())))
        yield pd.DataFrame(out, columns=[self.key, "second", "done", "recent"])

    def close(self) -> None:
        pass


def progress(events: DataFrame, totals: DataFrame, key: str, trail_s: int = 10) -> DataFrame:
    """`(key, second, done, rate, left_s)` at each second with events: those done so far, a second's rate over the last
    `trail_s` seconds, and the seconds left to `totals` (key, total) at that rate.

    Works on tables, by windows, and on streams with a watermark, by state of at most `trail_s` pairs for each key. Keys
    without a total have null left_s; one that is past its total has 0. Events without a time don't count.
    """
    counted = seconds_done(events, key)
    if not events.isStreaming:
        upto = Window.partitionBy(key).orderBy("second")
        done, recent = F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(upto.rangeBetween(1 - trail_s, 0))
        found = counted.select(key, "second", done.alias("done"), recent.alias("recent"))
    else:
        ship_package(events.sparkSession)
        kind = counted.schema[key].dataType.simpleString()
        found = counted.groupBy(key).transformWithStateInPandas(_Progress(key, trail_s), f"`{key}` {kind}, second long, done long, recent long", "Append", "None")
    return found.join(totals.select(key, "total"), key, "left").select(key, "second", "done", *_rate(F.col("done"), F.col("total"), F.col("recent"), trail_s))


def follow_readiness(path: str, ready: Callable[[SparkSession], DataFrame], reach: int = 2, step_e7: int = 1_000_000, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of positions: `path/readiness` says for every entity how many of the cells round it are ready.

    `ready` reads the table of ready cells, anew at each batch, so cells that have become ready (or no longer are) count
    for entities that haven't moved too. The newest position of each entity is kept under `path/positions`, in `parts`
    folders of which a batch rewrites its own; older positions that come late change nothing, nor does a batch that runs again.
    """
    positions, out = f"{path}/positions", f"{path}/readiness"
    part = F.pmod(F.xxhash64("station"), F.lit(parts)).alias("part")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fields = ("station", "ts", "event_id", "lat_e7", "lon_e7")
        newest_of = lambda rows: rows.groupBy("station").agg(F.max_by(F.struct(*fields[1:]), F.struct("ts", "event_id")).alias("p")).select("station", "p.*", part)
        new = newest_of(batch.where("station is not null and ts is not null and lat_e7 is not null and lon_e7 is not null").select(*fields))
        if _exists(spark, positions):
            held = spark.read.parquet(positions)
            new = newest_of(held.join(new.select("part").distinct(), "part", "left_semi").select(*fields).unionByName(new.select(*fields)))
        checkpoint(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(positions)
        readiness(spark.read.parquet(positions), ready(spark), reach, step_e7).write.mode("overwrite").parquet(out)

    return write
