"""Streams with state against the same rows as a table: late rows, expiry, restarts, changing tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoloom.streaming import observations, state

SCHEMA = "event_id long, station string, user_id long, lat_e7 long, lon_e7 long, ts timestamp, wx string, temp_c double"


def _at(minute, second=0):
    return dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute, seconds=second)


def _rows(spark, *rows):
    """Rows of (event_id, station, lat, lon, time, temperature)."""
    return spark.createDataFrame([(k, s, None, y, x, t, None, c) for k, s, y, x, t, c in rows], SCHEMA)


def _add(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def _run(stream, sink, log, mode="update"):
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert q.exception() is None


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


A, B, C, D = (600_000_000, 50_000_000), (601_000_000, 50_000_000), (640_000_000, 50_000_000), (600_000_100, 50_000_100)


def test_readings_expire_and_places_fall_back_to_the_mean(spark, tmp_path, rocks):
    folder, store, log = (str(tmp_path / n) for n in ("in", "store", "log"))
    first = [(1, "a", *A, _at(0), 5.0), (2, "b", *B, _at(4), 8.0), (3, "a", *A, _at(3), 6.0), (4, "c", *C, _at(5), None), (5, "a", *D, _at(3), 7.0), (6, "c", *C, None, 1.0)]
    start = [(90, "c", *C, _at(2), -4.0), (91, "c", *C, _at(1), 99.0)]

    def run():
        stream = observations.fresh(observations.read_observations(spark, folder), 10)
        _run(state.reading_changes(stream, initial=_rows(spark, *start)), state.keep_readings(store), log)
        return {(r.reading_id, r.temp) for r in state.kept_readings(spark.read.parquet(store)).collect()}

    places = spark.createDataFrame([(1, *A), (2, 600_900_000, 50_000_000), (3, 0, 0)], "place_id long, lat_e7 long, lon_e7 long")
    temperatures = lambda r: {(t.place_id, t.temp, t.measured) for t in state.temperature_at(places, r, "place_id", 30_000).collect()}
    _add(_rows(spark, *first), folder)
    assert run() == {(5, 7.0), (2, 8.0)}  # D lies in A's area and has the greater id; what an area starts from comes out with its change
    assert temperatures(state.kept_readings(spark.read.parquet(store))) == {(1, 7.0, True), (2, 8.0, True), (3, 7.5, False)}
    # After a restart: a newer reading of B carries the watermark to 10:25, past A's expiry at 10:23; C's start expires at 10:22.
    _add(_rows(spark, (7, "b", *B, _at(35), 9.0)), folder)
    assert run() == {(7, 9.0)}
    assert temperatures(state.kept_readings(spark.read.parquet(store))) == {(1, 9.0, True), (2, 9.0, True), (3, 9.0, False)}
    # A row later than the watermark is dropped; one within it isn't.
    _add(_rows(spark, (8, "a", *A, _at(10), 50.0), (9, "c", *C, _at(30), 2.0)), folder)
    assert run() == {(7, 9.0), (9, 2.0)}
    assert run() == {(7, 9.0), (9, 2.0)}
    table = _rows(spark, *first, *start, (7, "b", *B, _at(35), 9.0), (9, "c", *C, _at(30), 2.0))
    batch = state.current_readings(table, F.lit(_at(25)))
    assert {(r.reading_id, r.temp) for r in batch.collect()} == {(7, 9.0), (9, 2.0)}


def test_a_batch_of_readings_that_runs_again_changes_nothing(spark, tmp_path):
    change = lambda *r: spark.createDataFrame(r, state._CHANGE)
    write = state.keep_readings(str(tmp_path / "store"))
    live, gone = (1, 1, 10, 5, 0, 0, 1.5, True), (1, 1, 10, 5, 0, 0, 1.5, False)
    kept = lambda: [r.temp for r in state.kept_readings(spark.read.parquet(str(tmp_path / "store"))).collect()]
    write(change(live), 0)
    assert kept() == [1.5]
    for k in (1, 1):
        write(change(gone), k)
        assert kept() == []
    write(change(live), 0)
    assert kept() == []
    write(change((1, 1, 11, 2, 0, 0, 2.5, True)), 2)
    assert kept() == [2.5]


def test_no_reading_leaves_no_temperature(spark):
    places = spark.createDataFrame([(1, 0, 0)], "place_id long, lat_e7 long, lon_e7 long")
    none = state.current_readings(_rows(spark, (1, "a", 0, 0, _at(0), 3.0)), F.lit(_at(20)))
    assert [tuple(r) for r in state.temperature_at(places, none, "place_id").collect()] == [(1, None, False)]


def test_progress_as_a_stream_equals_the_table(spark, tmp_path, rocks):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    seconds = {"a": (0, 0, 1, 3, 3, 3, 14, 15, 40), "b": (2, 12, 13), "c": (5,)}
    rows = [(100 * i + k, s, 0, 0, _at(0, t), 0.0) for i, (s, ts) in enumerate(seconds.items()) for k, t in enumerate(ts)]
    totals = spark.createDataFrame([("a", 20), ("b", 2)], "station string, total long")
    parts = [[r for r in rows if low <= (r[4] - _at(0)).seconds < high] for low, high in ((0, 4), (4, 15), (15, 60))]
    # The last row only drives the watermark past the others.
    for part in [*parts, [(999, "z", 0, 0, _at(5), 0.0)]]:
        _add(_rows(spark, *part), folder)

        def keep(batch, k):
            batch.write.mode("append").parquet(out)

        stream = observations.fresh(observations.read_observations(spark, folder), 0)
        _run(state.progress(stream, totals, "station"), keep, log, "append")
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in state.progress(_rows(spark, *rows), totals, "station").collect())
    assert got == want
    start = int(spark.sql("SELECT unix_seconds(timestamp'2024-01-01 10:00:00')").first()[0])
    by = {(s, t - start): (done, rate, left) for s, t, done, rate, left in want}
    assert by["a", 3] == (6, 0.6, pytest.approx(14 / 0.6)) and by["a", 14] == (7, 0.1, pytest.approx(130.0))
    assert by["b", 12][0] == 2 and by["b", 13][2] == 0.0 and by["c", 5] == (1, 0.1, None)


def test_enriched_stream_equals_the_table(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = [(1, "a", *A, _at(0), 1.0), (2, "b", *C, _at(1), 1.0), (3, "c", -1, -1, _at(2), 1.0), (4, "d", 600_499_999, 50_499_999, _at(3), 1.0), (4, "d", *A, _at(3), 1.0), (5, "e", None, 5, _at(3), 1.0)]
    places = spark.createDataFrame([(9, *A), (7, 600_400_000, 50_400_000), (3, -400_000, -2)], "place_id long, lat_e7 long, lon_e7 long")
    for half in (rows[:3], rows[3:]):
        _add(_rows(spark, *half), folder)
        _run(observations.enriched(observations.read_observations(spark, folder), places), lambda b, k: b.write.mode("append").parquet(out), log, "append")
    pairs = lambda df: sorted(((r.event_id, r.place_group) for r in df.collect()), key=str)
    assert pairs(spark.read.parquet(out)) == pairs(observations.enriched(_rows(spark, *rows), places)) == [(1, 7), (2, None), (3, 3), (4, 7), (4, 7), (5, None)]


def test_readiness_follows_positions_and_cells(spark, tmp_path):
    folder, out, log, cells = (str(tmp_path / n) for n in ("in", "out", "log", "cells"))
    known = lambda *c: spark.createDataFrame(c, "cell_lat long, cell_lon long")
    ready = lambda s: s.read.parquet(cells)

    def run():
        stream = observations.read_observations(spark, folder)
        _run(stream, state.follow_readiness(out, ready, reach=1), log)
        return {tuple(r) for r in spark.read.parquet(f"{out}/readiness").select("station", "needed", "ready", "complete").collect()}

    _add(known((600, 50), (599, 49), (600, 50)), cells)
    _add(_rows(spark, (1, "a", *A, _at(0), 0.0), (2, "b", *C, _at(0), 0.0), (3, None, *A, _at(1), 0.0), (4, "d", None, 1, _at(1), 0.0)), folder)
    assert run() == {("a", 9, 2, False), ("b", 9, 0, False)}
    # All round `a` is ready now; `b` comes there; an older position of `a` is late.
    _add(known(*[(600 + i, 50 + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]), cells)
    _add(_rows(spark, (5, "b", *B, _at(2), 0.0), (6, "a", *C, _at(-9), 0.0)), folder)
    want = {("a", 9, 9, True), ("b", 9, 6, False)}
    assert run() == want
    table = observations.readiness(spark.read.parquet(folder).where("station is not null and lat_e7 is not null"), ready(spark), 1)
    assert {tuple(r) for r in table.select("station", "needed", "ready", "complete").collect()} == want
    state.follow_readiness(out, ready, reach=1)(_rows(spark, (5, "b", *B, _at(2), 0.0)), 1)
    assert {tuple(r) for r in spark.read.parquet(f"{out}/readiness").select("station", "needed", "ready", "complete").collect()} == want
