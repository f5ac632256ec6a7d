"""Joins by distance at every latitude and across the 180th meridian, against all pairs; and what they are built on."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.operators import arrow, conflate, regions, weather
from geoloom.operators.spatial import metres_e7, near_pairs, with_boxes_near


def _metres(a, b):
    dx = (b[1] - a[1] + 1_800_000_000) % 3_600_000_000 - 1_800_000_000
    return math.hypot(dx / 1e7 * 111320.0 * math.cos(math.radians(a[0] / 1e7)), (b[0] - a[0]) / 1e7 * 111320.0)


@pytest.mark.parametrize("lat,lon", [(70.0, 25.0), (-45.0, -70.0), (0.0, 0.0), (85.0, 10.0), (60.0, 180.0), (-12.0, -180.0), (89.999, 3.0)])
@pytest.mark.parametrize("reach", [20.0, 30_000.0])
def test_all_pairs_within_reach_meet_once(spark, lat, lon, reach):
    draw = random.Random(int(lat * 10 + reach))
    spread = 3 * reach / 111320.0
    wide = min(170.0, spread / max(math.cos(math.radians(lat)), 1e-4))
    at = lambda: (round(1e7 * max(-90.0, min(90.0, lat + draw.uniform(-spread, spread)))), (round(1e7 * (lon + draw.uniform(-wide, wide))) + 1_800_000_000) % 3_600_000_000 - 1_800_000_000)
    left, right = [at() for _ in range(120)], [at() for _ in range(120)]
    frame = lambda rows, p: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{p} long, {p}_lat long, {p}_lon long")
    pairs = near_pairs(frame(left, "a"), frame(right, "b"), reach, ("a_lat", "a_lon"), ("b_lat", "b_lon"))
    close = pairs.where(metres_e7(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= reach)
    got = [(r.a, r.b) for r in close.select("a", "b").collect()]
    want = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if _metres(p, q) <= reach}
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("lat", [70.0, -45.0, 75.0])
def test_station_and_height_at_the_edge_of_reach(spark, lat):
    east = lambda metres: round(metres / 111320.0 / math.cos(math.radians(lat)) * 1e7)
    y = round(lat * 1e7)
    asked = spark.createDataFrame([(1, y, 0, "2024-01-01 10:30:00")], "k long, lat_e7 long, lon_e7 long, at string").withColumn("at", F.col("at").cast("timestamp"))
    reports = spark.createDataFrame([(7, y, east(28_000), "2024-01-01 10:20:00", "", 1.0), (8, y, east(31_000), "2024-01-01 10:25:00", "", 2.0)], "event_id long, lat_e7 long, lon_e7 long, ts string, wx string, temp_c double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.report for r in weather.nearest_station(asked, reports, "k").collect()] == [7]
    buildings = spark.createDataFrame([(1, y, 0)], "id long, lat_e7 long, lon_e7 long")
    points = spark.createDataFrame([(5, 0, y, east(19.5), 9.0), (6, 0, y, east(21.0), 8.0)], "point_id long, osm_id long, lat_e7 long, lon_e7 long, height double")
    assert [(r.id, r.height, r.how) for r in conflate.heights_by_id_or_place(buildings, points).collect()] == [(1, 9.0, "near")]


def test_boxes_of_any_size_are_found(spark):
    points = spark.createDataFrame([(1, 700_000_000, 250_000_000), (2, 700_000_000, 261_000_000)], "p long, y long, x long")
    boxes = spark.createDataFrame([(9, 690_000_000, 240_000_000, 710_000_000, 249_999_000), (8, 0, 0, 1000, 1000)], "b long, s long, w long, n long, e long")
    got = with_boxes_near(points, boxes, 10.0, ("y", "x", "y", "x"), ("s", "w", "n", "e")).select("p", "b").distinct().collect()
    assert {(1, 9)} <= {tuple(r) for r in got} and 8 not in {r.b for r in got}


def _split(points, tolerance):
    """The rule by recursion: the furthest point off the chord stays and parts the line."""
    a, b = np.array(points[0]), np.array(points[-1])
    best, at = -1.0, 0
    for k, p in enumerate(points[1:-1], 1):
        v, w = b - a, np.array(p) - a
        t = 0.0 if not v.any() else min(1.0, max(0.0, float(v @ w) / float(v @ v)))
        off = float(np.linalg.norm(w - t * v))
        if off > best:
            best, at = off, k
    if best <= tolerance:
        return [0, len(points) - 1]
    return _split(points[: at + 1], tolerance)[:-1] + [at + k for k in _split(points[at:], tolerance)]


def test_simplified_lines_against_recursion(spark):
    draw = random.Random(9)
    lines = [[[float(k), draw.uniform(-5, 5)] for k in range(draw.randrange(2, 40))] for _ in range(30)] + [[[0.0, 0.0], [1.0, 9.0], [0.0, 0.0]], [[1.0, 1.0]], [[0.0, 0.0, 1.0], [1.0, 0.0, 9.0], [2.0, 0.0, 1.0]]]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line long, pts array<array<double>>")
    got = {r.line: r.kept for r in arrow.simplify(table, "line", "pts", 2.5).collect()}
    assert all(got[i] == (_split(x, 2.5) if len(x) > 1 else [0]) for i, x in enumerate(lines))


def test_rings_are_joined_end_to_end(spark):
    rows = [(1, "outer", 10, "a", "b"), (1, "outer", 11, "c", "b"), (1, "outer", 12, "c", "a"), (1, "outer", 13, "x", "y"), (1, "outer", 14, "a", "z")]
    got = arrow.assemble_rings(spark.createDataFrame(rows, "rel long, role string, way_id long, first string, last string"), ["rel", "role"]).orderBy("ring", "seq").collect()
    assert [(r.ring, r.way_id, r.reversed, r.closed) for r in got] == [(0, 10, False, True), (0, 11, True, True), (0, 12, False, True), (1, 13, False, False), (2, 14, False, False)]


def test_groups_of_many_batches_are_whole_and_share_them(spark):
    rows = [(k, c, v) for k, c, n in ((1, "a", 2), (1, None, 7), (None, None, 1), (None, "b", 4), (2, "b", 1)) for v in range(n)]
    frames = [pd.DataFrame(rows[a : a + 3], columns=["k", "c", "v"], dtype=object) for a in range(0, len(rows), 3)]
    got = [[g.v.tolist() for g in np.split(pdf, begins[1:])] for pdf, begins in arrow.whole_groups(iter([frames[0], frames[0][:0], *frames[1:]]), ["k", "c"])]
    assert sum(got, []) == [list(range(n)) for n in (2, 7, 1, 4, 1)]
    ways = spark.createDataFrame([(k % 50, None if k % 3 else "outer", k, str(k // 50 % 4), str((k // 50 + 1) % 4)) for k in range(600)], "rel long, role string, way_id long, first string, last string")
    rings = arrow.assemble_rings(ways, ["rel", "role"])
    plan = rings._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "FlatMapGroups" not in arrow.relax_surface(spark.createDataFrame([], "b int, x int, z int, fixed double"), "b")._jdf.queryExecution().toString()
    assert rings.count() == 600 and rings.select("rel", "role").distinct().count() == ways.select("rel", "role").distinct().count()


def test_bodies_of_one_batch_are_relaxed_apart(spark):
    body = lambda b, low, fixed: [(b, x, z, fixed.get((x, z))) for x in range(low, low + 4) for z in range(-3, 3)]
    bodies = {1: body(1, 0, {(0, -3): 1.0, (3, 2): 5.0}), 2: body(2, -70, {(-69, 0): 2.0}), 3: body(3, 1, {}), 4: [(4, 9, 9, None), (4, 5, 5, 3.0)]}
    of = lambda rows: {(r.b, r.x, r.z): r.level for r in arrow.relax_surface(spark.createDataFrame(rows, "b int, x int, z int, fixed double").repartition(1), "b").collect()}
    got = of(sum(bodies.values(), []))
    assert got == {k: v for rows in bodies.values() for k, v in of(rows).items()} and {v for (b, _, _), v in got.items() if b == 3} == {0.0}
    assert got[1, 0, -3] == 1.0 and got[1, 3, 2] == 5.0 and 1.0 < got[1, 1, 0] < 5.0 and got[4, 9, 9] == 3.0


def test_newest_part_wins_but_chains_keep_their_ends(spark):
    bands = lambda ids: spark.createDataFrame([(1, i, *b) for i, b in zip(ids, ((0.0, 4.0), (3.0, 7.0), (6.0, 9.0)), strict=True)], "cell long, id long, bottom double, top double")
    stay = lambda ids: {r.id for r in regions.stacked_parts(bands(ids), "cell").collect()}
    assert stay((1, 3, 2)) == {3} and stay((2, 1, 3)) == {2, 3} and stay((3, 2, 1)) == {3, 1}
