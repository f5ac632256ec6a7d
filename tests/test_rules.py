"""Hand-worked cases, properties, and streams against the same rows as a table."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry, text
from geoloom.operators import areas, lines, regions, weather
from geoloom.operators.components import connected_components
from geoloom.streaming import observations


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("given,want", [("12 m", 12.0), ("40'", 12.192), ("3,5", 3.5), ("approx. 40 ft", 12.192), ("2 km", 2000.0), ("none", None)])
def test_lengths(spark, given, want):
    got = _one(spark, text.parse_length(F.lit(given)))
    assert got == pytest.approx(want) if want is not None else got is None


def test_axial_difference(spark):
    assert _one(spark, geometry.axial_difference(F.lit(10.0), F.lit(190.0))) == pytest.approx(0)
    assert _one(spark, geometry.axial_difference(F.lit(10.0), F.lit(100.0))) == pytest.approx(90)


def test_metar(spark):
    for wx, wet, thunder in (("VCSH", False, False), ("VCTS", False, True), ("-RA", True, False), ("+TSRA", True, True), (None, False, False)):
        a, b = text.wet_and_thunder(F.lit(wx).cast("string"))
        assert (_one(spark, a), _one(spark, b)) == (wet, thunder)


def test_components_of_chain_star_and_repeats(spark):
    chain = [(i, i + 1) for i in range(30)]
    star = [(100, 100 + i) for i in range(1, 20)]
    edges = spark.createDataFrame(chain + star + star + [(500, 500), (None, 1)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}
    assert connected_components(edges.limit(0)).count() == 0


def test_runs_union_is_idempotent_and_difference_restores(spark):
    runs = spark.createDataFrame([(0, 1, 4), (0, 5, 6), (0, 9, 12), (1, 2, 2), (1, 2, 8)], "row int, start int, end int")
    once = areas.union_runs(runs)
    assert {tuple(r) for r in once.collect()} == {(0, 1, 6), (0, 9, 12), (1, 2, 8)}
    assert {tuple(r) for r in areas.union_runs(once).collect()} == {tuple(r) for r in once.collect()}


def test_ramp_is_no_steeper_than_its_grade(spark):
    p = spark.createDataFrame([(0, i, float((i * 7) % 11)) for i in range(40)], "line int, i int, value double")
    rows = lines.ramp_up(p, "value", 0.5).orderBy("i").collect()
    assert all(r.ramp >= r.value for r in rows)
    assert all(abs(a.ramp - b.ramp) <= 0.5 + 1e-9 for a, b in zip(rows, rows[1:], strict=False))


def _events(spark, folder):
    rows = [(i, f"S{i % 3}", i % 3, 600000000 + i % 3 * 1000000, 50000000, f"2024-01-01 00:{i:02d}:00", "", float(i)) for i in range(0, 50, 5)]
    df = spark.createDataFrame(rows, "event_id long, station string, user_id long, lat_e7 long, lon_e7 long, ts string, wx string, temp_c double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(1).write.parquet(folder)
    return df


def _drain(stream, name, mode, spark):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_stream_equals_table(spark, tmp_path):
    table = _events(spark, str(tmp_path / "in"))
    stream = observations.fresh(observations.read_observations(spark, str(tmp_path / "in")), 75)
    want = {tuple(r) for r in observations.refreshed_cells(table).collect()}
    assert _drain(observations.refreshed_cells(stream), "cells", "complete", spark) == want
    sessions = {tuple(r) for r in observations.held_weather(table).collect()}
    assert _drain(observations.held_weather(stream), "held", "complete", spark) == sessions


def test_state_expires_and_repeats_are_ignored(spark, tmp_path):
    _events(spark, str(tmp_path / "in"))
    stream = observations.fresh(observations.read_observations(spark, str(tmp_path / "in")), 75)
    last = _drain(observations.latest_with_expiry(stream), "latest", "update", spark)
    assert {s: t for s, _, t in last} == {"S0": 45.0, "S1": 40.0, "S2": 35.0}
    assert len(_drain(observations.once(stream), "once", "append", spark)) == 10


def test_upsert_keeps_the_newest_version(spark, tmp_path):
    write = observations.upsert_cells(str(tmp_path / "map"))
    cells = lambda rows: spark.createDataFrame(rows, "cell_lat long, cell_lon long, version long, value double")
    write(cells([(1, 1, 1, 0.5), (2, 2, 3, 0.7)]), 0)
    write(cells([(1, 1, 2, 0.9), (2, 2, 1, 0.1), (3, 3, 1, 0.2)]), 1)
    got = {(r.cell_lat, r.version, r.value) for r in spark.read.parquet(str(tmp_path / "map")).collect()}
    assert got == {(1, 2, 0.9), (2, 3, 0.7), (3, 1, 0.2)}


def _positions(spark, rows, folder):
    """Positions of (station, minute, second, inside); cell (600, 50) is the covered one. One file for each of two halves."""
    rows = [(k, s, k, 600_000_000 if inside else 610_000_000, 50_000_000, f"2024-01-01 00:{m:02d}:{sec:02d}", "", 0.0) for k, (s, m, sec, inside) in enumerate(rows)]
    df = spark.createDataFrame(rows, "event_id long, station string, user_id long, lat_e7 long, lon_e7 long, ts string, wx string, temp_c double").withColumn("ts", F.col("ts").cast("timestamp"))
    half = len(rows) // 2
    df.where(F.col("event_id") < half).repartition(1).write.parquet(f"{folder}/1")
    df.where(F.col("event_id") >= half).repartition(1).write.parquet(f"{folder}/2")
    return df


def test_dwellers_are_offered_once_in_ten_minutes(spark, tmp_path):
    rows = [("A", 0, 0, False), ("A", 0, 30, False), ("A", 1, 0, False), ("A", 3, 0, False)]  # out for a minute: an offer at 1:00
    rows += [("B", 0, 0, False), ("B", 0, 50, False), ("B", 0, 55, True), ("B", 1, 30, False)]  # a visit inside ends the stay
    rows += [("A", 5, 0, True), ("A", 6, 0, False), ("A", 8, 0, False), ("A", 12, 0, False), ("A", 15, 0, False)]  # again only ten minutes after 1:00
    rows += [("B", 2, 29, False), ("B", 2, 30, False), ("C", 4, 0, False), ("C", 4, 59, False), ("C", 20, 0, True)]  # C is never out for a minute
    _positions(spark, rows, str(tmp_path / "in"))
    covered = spark.createDataFrame([(600, 50)], "cell_lat long, cell_lon long")
    stream = observations.fresh(observations.read_observations(spark, str(tmp_path / "in/*")), 30)
    got = _drain(observations.dwellers(stream, covered), "offers", "append", spark)
    start = int(spark.sql("SELECT unix_micros(timestamp'2024-01-01 00:00:00')").first()[0])
    assert {(s, (a - start) // 1_000_000, (b - start) // 1_000_000) for s, a, b in got} == {("A", 0, 60), ("A", 360, 720), ("B", 90, 150)}


def test_fused_streams_meet_within_their_tolerance(spark, tmp_path):
    rows = [("S", m, 0, inside) for m, inside in ((0, True), (5, False), (10, True), (20, True), (40, False), (50, True))]
    table = _positions(spark, rows, str(tmp_path / "in"))
    parts = {}
    for name, rest in (("radar", 1), ("stations", 0)):
        table.where(F.col("event_id") % 2 == rest).repartition(1).write.parquet(str(tmp_path / name))
        parts[name] = observations.read_observations(spark, str(tmp_path / name))
    pairs = _drain(observations.fused_streams(parts["radar"], parts["stations"], 15).where("s_id is not null").select("r_id", "s_id"), "fused", "append", spark)
    cell = {k: inside for k, (_, _, _, inside) in enumerate(rows)}
    minute = {k: m for k, (_, m, _, _) in enumerate(rows)}
    assert pairs == {(r, s) for r in (1, 3, 5) for s in (0, 2, 4) if cell[r] == cell[s] and 0 <= minute[r] - minute[s] <= 15}
    assert pairs


def test_places_are_added_to_what_their_cell_holds(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "place_id long, lat_e7 long, lon_e7 long, name string")
    old, near, far = (1, 600_000_000, 50_000_000, "a"), (2, 600_000_001, 50_000_000, "b"), (3, 700_000_000, -1, None)
    rows(old, old).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(rows(old).schema).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(observations.add_places(str(tmp_path / "map"))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "map")).select("place_id", "lat_e7", "lon_e7", "name").collect())

    assert run() == [old]
    rows(old, near, far).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [old, near, far]
    assert run() == [old, near, far]
    observations.add_places(str(tmp_path / "map"))(rows(near), 7)  # a batch that runs again
    assert spark.read.parquet(str(tmp_path / "map")).count() == 3


def test_cell_store_round_trip(spark, tmp_path):
    from geoloom.operators import osm

    boxes = spark.createDataFrame([(1, 600000000, 50000000, 601500000, 50500000), (2, 605000000, 52000000, 605100000, 52100000)], "way_id long, south_e7 long, west_e7 long, north_e7 long, east_e7 long")
    osm.write_cells(osm.file_under_cells(boxes), str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    assert store.count() == 3
    assert [r.way_id for r in osm.read_cells(store, "way_id", 600000000, 50000000, 602000000, 51000000).collect()] == [1]


def test_ways_side_by_side_on_a_short_stretch(spark):
    """A stretch of 40 m in a kilometre is found, a crossing and another layer aren't."""
    lon = lambda metres: 50_000_000 + int(metres / (111_320 * 0.5) * 1e7)
    lat = lambda metres: 600_000_000 + int(metres / 111_320 * 1e7)
    lines = {1: [(0, 0), (1000, 0)], 2: [(300, 400), (310, 8), (350, 8), (360, 400)], 3: [(700, -200), (700, 200)], 4: [(100, 5), (200, 5)]}
    points = spark.createDataFrame([(way, k, lat(z), lon(x)) for way, line in lines.items() for k, (x, z) in enumerate(line)], "way_id long, seq long, lat_e7 long, lon_e7 long")
    layers = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "way_id long, layer int")
    assert {tuple(r) for r in regions.side_by_side(points, layers).collect()} == {(1, 2), (2, 1)}


def test_nearest_grid_cell_and_nearest_selected_cell(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, -250_000, 999), (3, None, 5), (4, 5_000_000, 0)], "k long, lat_e7 long, lon_e7 long")
    cells = spark.createDataFrame([(7, -60_000, -90_000, 1.5), (8, 60_000, 90_000, 2.5), (9, -300_000, 0, None)], "cell_id long, lat_e7 long, lon_e7 long, value double")
    assert {tuple(r) for r in weather.nearest_grid_cell(points, cells, "k").collect()} == {(1, 7, 1.5), (2, 9, None)}
    asked = spark.createDataFrame([(1, 0, 0), (2, -3000, 40), (3, 2, 5), (4, None, 1)], "k long, x long, z long")
    runs = spark.createDataFrame([(0, 10, 20), (0, -10, -10), (5, 0, 3), (5, 2, 4)], "row long, start long, end long")
    found = {tuple(r) for r in areas.nearest_cell(asked, runs, "k", block=4).collect()}
    assert found == {(1, 5, 0), (2, 0, -10), (3, 5, 2)}
    assert areas.nearest_cell(asked, runs.limit(0), "k").count() == 0
