"""Measured lines, crossings, surveys, roofs, coasts and zooms on hand-worked cases and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import coast, crossings, linear, pyramids, roofs, surveys
from geoloom.operators.spatial import with_boxes_near

M = 1e7 / 111320.0  # 1e-7 degrees of latitude in a metre


def _points(spark, lines, lat=0.0, lon=0.0):
    """Lines of (x, y) metres east and north of a place, as points of 1e-7 degrees."""
    scale = math.cos(math.radians(lat))
    rows = [(i, k, round(lat * 1e7 + y * M), round(lon * 1e7 + x * M / scale)) for i, line in lines.items() for k, (x, y) in enumerate(line)]
    return spark.createDataFrame(rows, "way_id long, seq long, lat_e7 long, lon_e7 long")


@pytest.mark.parametrize("lat,lon", [(0.0, 0.0), (70.0, 25.0), (-45.0, 179.99999), (60.0, -180.0)])
def test_points_along_and_their_feet(spark, lat, lon):
    draw = random.Random(1)
    lines = {i: [(draw.uniform(-300, 300), draw.uniform(-300, 300)) for _ in range(draw.randrange(2, 9))] for i in range(12)}
    lines[50] = [(5.0, 5.0), (5.0, 5.0)]
    lines[51] = [(0.0, 0.0), (2000.0, 0.0)]
    measured = linear.measured(_points(spark, lines, lat, lon), "way_id", "seq")
    wanted = measured.where("last").select("way_id", "total", F.explode(F.array(*[F.lit(s) for s in (-0.2, 0.0, 0.13, 0.5, 0.77, 1.0, 1.2)])).alias("s")).withColumn("at", F.col("s") * F.col("total"))
    got = linear.points_at(measured, wanted, "way_id")
    assert got.count() == 7 * 13
    here = got.where("s between 0 and 1").withColumn("point", F.struct("way_id", "at"))
    feet = linear.projected(here, measured, "point", "way_id", 3.0, ("lat", "lon"))
    met = here.select("point", "at", "way_id").join(feet, ["point", "way_id"]).collect()
    assert len(met) == 5 * 13 and all(r.offset < 0.01 for r in met)
    # Lines may cross themselves, so a foot may lie earlier, but never further off.
    assert sum(abs(r.along - r.at) < 0.01 for r in met) >= 0.9 * len(met) and all(r.along <= r.at + 0.01 for r in met)
    every = linear.every(measured, 10.0, "way_id", "total").groupBy("way_id").agg(F.count("*").alias("n"), F.max("total").alias("t"), F.max("at").alias("last")).collect()
    assert {r.way_id for r in every} == set(lines) - {50} and all(r.n == math.floor(r.t / 10) + 1 and r.last <= r.t for r in every)


def test_segments_near_points_against_all_pairs(spark):
    draw = random.Random(3)
    lines = {i: [(draw.uniform(0, 900), draw.uniform(0, 900)) for _ in range(4)] for i in range(20)}
    spots = {k: [(draw.uniform(0, 900), draw.uniform(0, 900))] for k in range(80)}
    measured = linear.measured(_points(spark, lines), "way_id", "seq")
    points = _points(spark, spots).select(F.col("way_id").alias("p"), F.col("lat_e7").cast("double").alias("y"), F.col("lon_e7").cast("double").alias("x"))
    for piece in (20.0, 400.0):
        rows = linear.near_segments(points, measured, 30.0, ("y", "x"), piece).select("p", "way_id", "seq", "d").collect()
        got = {(r.p, r.way_id, r.seq): r.d for r in rows}
        assert len(got) == len(rows)
        want = {}
        for p, ((x, y),) in spots.items():
            for i, line in lines.items():
                for k, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:], strict=False)):
                    t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                    want[p, i, k] = math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y)
        near = {k: d for k, d in want.items() if d <= 30}
        assert got.keys() >= {k for k, d in near.items() if d < 29.9} and all(abs(d - want[k]) < 0.05 for k, d in got.items())


def test_boxes_meet_across_the_meridian(spark):
    y = 700_000_000
    left = spark.createDataFrame([(1, y, 1_799_999_900), (2, y, -1_799_999_000), (3, y, 0)], "p long, y long, x long")
    boxes = spark.createDataFrame([(7, y - 10, -1_799_999_950, y + 10, -1_799_999_900), (8, y - 10, 1_799_990_000, y + 10, -1_799_999_100), (9, y - 10, 1_799_999_000, y + 10, 1_800_000_700)], "b long, s long, w long, n long, e long")
    got = {(r.p, r.b) for r in with_boxes_near(left, boxes, 5.0, ("y", "x", "y", "x"), ("s", "w", "n", "e")).select("p", "b").distinct().collect()}
    assert {(1, 7), (1, 8), (1, 9), (2, 8), (2, 9)} <= got and 3 not in {p for p, _ in got}


def test_boxes_that_only_share_a_cell_are_left_out(spark):
    draw = random.Random(5)
    turn = 3_600_000_000
    box = lambda k, low: (k, y := 700_000_000 + draw.randrange(9000), x := low + draw.randrange(9000), y + draw.randrange(1500), x + draw.randrange(1500))
    left, right = [[box(k, low) for k, low in enumerate([1_799_995_000, -1_800_004_000] * 25)] for _ in range(2)]
    a, b = spark.createDataFrame(left, "p long, s long, w long, n long, e long"), spark.createDataFrame(right, "b long, bs long, bw long, bn long, be long")
    rows = with_boxes_near(a, b, 3.0, ("s", "w", "n", "e"), ("bs", "bw", "bn", "be"), 2000, once=True).select("p", "b").collect()
    pad, wide = 3.0 / 111320.0 * 1e7, lambda r: 3.0 / 111320.0 * 1e7 / math.cos(math.radians((r[3] + 3.0 / 111320.0 * 1e7) / 1e7))
    want = {(p[0], r[0]) for p in left for r in right if p[1] <= r[3] + pad and p[3] >= r[1] - pad and any(p[2] + k * turn <= r[4] + wide(r) and p[4] + k * turn >= r[2] - wide(r) for k in (-1, 0, 1))}
    assert {tuple(r) for r in rows} == want and want


def _ways(spark, rows):
    return spark.createDataFrame(rows, "way_id long, layer int, half_width double, carries boolean, room double")


def test_a_bridge_over_a_road_and_its_approach(spark):
    # 1: a bridge of 100 m; 2 crosses it at 40 m; 3 begins at its end; 4 runs 3 m beside it; 5 crosses on its own layer; 6 has no ground.
    lines = {1: [(0, 0), (100, 0)], 2: [(40, -20), (40, 20)], 3: [(100, 0), (60, 1)], 4: [(10, 3), (30, 3)], 5: [(70, -9), (70, 9)], 6: [(80, -9), (80, 9)]}
    z = F.when(F.col("way_id") == 6, None).otherwise(F.lit(10.0))
    points = _points(spark, lines).withColumn("z", z)
    ways = _ways(spark, [(1, 1, 2.5, True, 0.0), (2, 0, 2.0, True, 5.0), (3, 0, 2.0, True, 5.0), (4, 0, 1.0, True, 3.0), (5, 1, 2.0, True, 5.0), (6, 0, 2.0, True, 5.0)])
    got = crossings.crossings(points, ways)
    rows = {(r.way_id, r.other_id, r.metre): r.required for r in got.collect()}
    assert {k[:2] for k in rows} == {(1, 2), (1, 4), (5, 3)}
    assert {m for _, o, m in rows if o == 2} <= {39, 40} and {m for _, o, m in rows if o == 3} <= {9, 10} and {m for _, o, m in rows if o == 4} >= set(range(11, 30))
    assert all(v == pytest.approx(13.0 if o == 4 else 15.0) for (_, o, _), v in rows.items())
    under = {(r.way_id, r.other_id) for r in crossings.crossings(points, ways, above=False).collect()}
    assert under == {(2, 1), (6, 1), (3, 5)}
    deck = {r.i: r.height for r in crossings.profiles(points, ways, got, 0.1).where("way_id = 1").collect()}
    assert set(deck) == set(range(101)) and max(deck.values()) == pytest.approx(15.0) and deck[0] == pytest.approx(12.0, abs=0.11) and deck[100] == pytest.approx(10.0)
    assert crossings.crossings(points, ways.where("way_id = 2")).count() == 0 and crossings.crossings(points.limit(0), ways).count() == 0


def test_a_forked_bore(spark):
    # A way of 90 m; bores a, b go on in each other along it, c forks off, d is the other tube 5 m beside, e continues too high.
    way = _points(spark, {1: [(0, 0), (90, 0)], 2: [(0, 500), (90, 500)]})
    bores = {10: [(0, 1), (30, 1)], 11: [(31, 1), (60, 1)], 12: [(30, 1), (40, 60)], 13: [(0, 6), (90, 6)], 14: [(61, 1), (90, 1)], 15: [(0, 501), (15, 501)]}
    heights = {10: 5.0, 11: 6.0, 12: 5.0, 13: 40.0, 14: 9.0, 15: 1.0}
    z = F.coalesce(*[F.when(F.col("way_id") == k, v) for k, v in heights.items()])
    table = _points(spark, bores).withColumn("z", z).withColumnRenamed("way_id", "bore_id")
    got = surveys.bore_heights(way, table).collect()
    of = {r.metre: (r.bore_id, r.z) for r in got if r.way_id == 1}
    assert {b for b, _ in of.values()} == {10, 11} and all(z == pytest.approx(heights[b]) for b, z in of.values())
    assert {m for m in of if m <= 59} == set(range(60)) and max(of) <= 68
    assert not [r for r in got if r.way_id == 2]  # a fifth of it is surveyed
    pairs = {(r.a, r.b) for r in surveys.touching(table).collect()}
    assert {(10, 11), (10, 12), (11, 10)} <= pairs and (11, 14) not in pairs
    assert surveys.bore_heights(way, table.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["flat", "gabled", "hipped", "across", "irregular"])
def test_roofs(spark, shape):
    rows = []
    for r in range(-15, 16):
        for c in range(-15, 16):
            u, v = abs(r + 0.5) / 10, abs(c + 0.5) / 6  # the long side runs along rows
            top = {"flat": 0.0, "gabled": 5 * max(0, 1 - v), "hipped": 5 * max(0, min(1 - v, 1.3 - 1.3 * u)), "across": 5 * max(0, 1 - u), "irregular": 4.0 * (c > 0)}[shape]
            rows.append((r, c, None if (r * 7 + c) % 17 == 0 else 103.0 + top + (r * 3 + c) % 4 * 0.05))
    surface = spark.createDataFrame(rows, "r long, c long, value double")
    buildings = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 10.0, 6.0, 100.0), (2, 0.0, 0.0, 1.0, 0.0, 2.0, 1.0, 100.0), (3, 900.0, 0.0, 1.0, 0.0, 10.0, 6.0, 100.0)], "id long, cy double, cx double, ay double, ax double, half_a double, half_b double, base double")
    got = {r.id: r for r in roofs.roofs(buildings, surface).collect()}
    assert set(got) == {1} and got[1].shape == {"across": "gabled"}.get(shape, shape) and got[1].eave >= 3 and got[1].ridge >= got[1].eave
    heights = {r.id: r.height for r in roofs.surface_heights(buildings, surface).collect()}
    assert set(heights) == {1, 2} and heights[1] >= 3


def _flood(cells, edge):
    free, piece = {k for k in cells if k not in edge}, {}
    for start in sorted(free):
        stack = [start] if start not in piece else []
        while stack:
            r, c = stack.pop()
            if (r, c) in piece or (r, c) not in free:
                continue
            piece[r, c] = start
            stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return piece


def test_pieces_of_a_raster_against_a_flood(spark):
    draw = random.Random(8)
    cells = {(r, c) for r in range(40) for c in range(150) if draw.random() < 0.6}
    of_cell, of_run = coast.pieces(spark.createDataFrame(sorted(cells), "r long, c long"))
    got = {(r.r, r.c): (r.piece.r, r.piece.c0) for r in of_cell.join(of_run, ["r", "c0"]).collect()}
    assert got == _flood(cells, set())


def test_line_cells_join_side_to_side(spark):
    draw = random.Random(4)
    lines = [(draw.uniform(0, 20), draw.uniform(0, 20), draw.uniform(0, 20), draw.uniform(0, 20)) for _ in range(20)] + [(0.0, 0.0, 6.0, 6.0), (6.0, 0.0, 0.0, 6.0), (3.5, 1.5, 3.5, 9.5), (2.2, 3.3, 2.2, 3.3)]
    for line in lines:
        got = {(r.r, r.c) for r in coast.line_cells(spark.createDataFrame([line], "ay double, ax double, by double, bx double")).collect()}
        assert len(set(_flood(got, set()).values())) == 1 and (math.floor(line[0]), math.floor(line[1])) in got or line[:2] in {(6.0, 0.0)}


def test_an_island_is_land_and_the_sea_goes_round_it(spark):
    cells = spark.createDataFrame([(r, c, -1.0 if c < 3 else 5.0) for r in range(20) for c in range(20)], "r long, c long, elevation double")
    ring = [(4.5, 14.5), (4.5, 4.5), (14.5, 4.5), (14.5, 14.5), (4.5, 14.5)]
    island = spark.createDataFrame([(*a, *b) for a, b in zip(ring, ring[1:], strict=False)], "ay double, ax double, by double, bx double")
    sea = {(r.r, r.c): r.sea for r in coast.sea_cells(cells, island).collect()}
    assert len(sea) == 400 and sea == {(r, c): not (5 <= r <= 13 and 5 <= c <= 13) for r in range(20) for c in range(20)}
    none = {(r.r, r.c): r.sea for r in coast.sea_cells(cells, island.limit(0)).collect()}
    assert none == {(r, c): c < 3 for r in range(20) for c in range(20)}


def test_tiles_without_ancestors_and_seams(spark):
    coarse = [(1, r, c, float(10 * r + c)) for r in range(4) for c in range(8)]
    pixels = spark.createDataFrame([*coarse, *[(2, r, c, 7.0) for r in range(4) for c in range(4)]], "z int, r long, c long, value double")
    wanted = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (5, 0)], "tr long, tc long")
    got = {(r.r, r.c): (r.value, r.z) for r in pyramids.finest(pixels, wanted, 2, 1, 4, -1e6, 1e6, 16).collect()}
    assert len(got) == 3 * 16 and got[0, 0] == (7.0, 2)
    # Linear in the parent, so it is linear across the seam between two parents; clamped to the parent where there is no row above.
    assert got[1, 7] == (pytest.approx(2.5 + 3.25), 1) and got[1, 8] == (pytest.approx(2.5 + 3.75), 1) and got[0, 7] == (pytest.approx(3.1875), 1)


def test_blend_at_the_edge_of_a_survey(spark):
    pixels = spark.createDataFrame([(0, c, v) for c, v in enumerate([5.0, 5.0, 5.0, 0.3, 5.0, 0.6, 5.0, 5.0, 5.0])], "r long, c long, value double")
    model = spark.createDataFrame([(0, c, -3.0) for c in range(9) if c != 6], "r long, c long, model double")
    got = {r.c: r.value for r in pyramids.feathered(pixels, spark.createDataFrame([(0, 0)], "tr long, tc long"), model, 2, 100.0, 1000, rings=4).collect()}
    assert got[0] == got[1] == 5.0 and got[3] == 0.3 and got[6] == 5.0 and got[5] == 0.51
    t = 0.25 * 100 / 400
    assert got[2] == pytest.approx(5 - t * t * (3 - 2 * t) * 8) and got[2] > got[4] > got[7]
    alone = pyramids.feathered(pixels, spark.createDataFrame([], "tr long, tc long"), model, 2, 100.0, 1000).where("c = 0").first().value
    assert alone == 0.51


def test_boxes_are_read_without_most_row_groups(spark, tmp_path):
    from geoloom.sources.boxes import read_boxes, write_boxes

    n = 300
    t = spark.range(n * n).select("id", *[((F.floor(F.col("id") * 7919 % (n * n) / k) % n - n // 2) * 5_000_000).cast("bigint").alias(c) for c, k in (("s", 1), ("w", n))])
    t = t.withColumns({"n": F.col("s") + 1_000_000, "e": F.col("w") + 1_000_000, "note": F.sha2(F.col("id").cast("string"), 256)})
    write_boxes(t, str(tmp_path / "boxes"), ("s", "w", "n", "e"), group_bytes=64 << 10)
    got = read_boxes(spark, str(tmp_path / "boxes"), 0, 0, 40_000_000, 40_000_000)
    rows = {r.id for r in got.collect()}
    assert rows == {r.id for r in t.where("s <= 40000000 and n >= 0 and w <= 40000000 and e >= 0").collect()} and rows
    plan = got._jdf.queryExecution().executedPlan()
    assert "bbox.south" in plan.toString().split("PushedFilters")[1]
    scans = plan.collectLeaves()
    read = scans.apply(0).metrics().apply("numOutputRows").value()
    assert len(rows) <= read < n * n / 4


def test_table_functions_in_sql(spark):
    from geoloom.functions import tables

    tables.register(spark)
    draw = random.Random(2)
    lines = {i: [(draw.uniform(-200, 200), draw.uniform(-200, 200)) for _ in range(5)] for i in range(6)}
    points = _points(spark, lines, 60.0, 180.0)
    points.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat_e7", "lon_e7"))).alias("p")).createOrReplaceTempView("drawn_lines")
    got = spark.sql("SELECT way_id, s.* FROM drawn_lines, LATERAL samples_of(p.lat_e7, p.lon_e7, 25D) s").collect()
    want = linear.every(linear.measured(points, "way_id", "seq"), 25.0, "way_id").collect()
    key = lambda r: (r.way_id, r.k)
    assert [(*key(a), pytest.approx(a.lat, abs=1), pytest.approx(a.lon, abs=1)) for a in sorted(want, key=key)] == [(*key(b), b.lat, b.lon) for b in sorted(got, key=key)]
    ring = spark.sql("SELECT c.* FROM (SELECT array(0D, 0D, 4D, 4D) AS z, array(0D, 6D, 6D, 3D) AS x), LATERAL cells_of(z, x) c").collect()
    assert {tuple(r) for r in ring} == {(z, x) for z in range(4) for x in range(6) if x + 0.5 >= 3 * (z + 0.5) / 4}
    assert spark.sql("SELECT * FROM cells_of(null, null)").count() == 0


def test_lines_on_a_map_are_filled_from_their_edges(spark):
    from geoloom.operators import legends

    red, blue, grey, near = 0xC80000, 0x0000C8, 0x646464, 0xB41414
    rows = [(1, 0, c, x, 255) for c, x in enumerate([red, grey, grey, grey, blue, near, 0x00FF00, None])]
    pixels = spark.createDataFrame([(t, r, c, x if x is not None else red, a if x is not None else 0) for t, r, c, x, a in rows] + [(2, 0, 0, near, 255)], "tile long, r long, c long, rgb int, alpha int")
    legend = spark.createDataFrame([(red, 1), (blue, 2)], "rgb int, class int")
    got = {(r.tile, r.c): r["class"] for r in legends.classify(pixels, legend).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 2, (1, 4): 2, (1, 5): 1, (1, 6): 1, (1, 7): 0, (2, 0): 0}
    assert legends.classify(pixels.limit(0), legend).count() == 0
    assert {r.rgb for r in legends.unnamed_colours(pixels, legend, 1).collect()} == {near, 0x00FF00}


def test_pieces_with_a_hole_are_dissolved(spark):
    from geoloom.operators import dissolve

    # A ring of unit squares round a hole, cut at every line; one square is cut once more, so corners lie on edges.
    edges = []
    for y in range(3):
        for x in range(3):
            if (y, x) == (1, 1):
                continue
            for w, e in ([(10 * x, 10 * x + 5), (10 * x + 5, 10 * x + 10)] if (y, x) == (0, 1) else [(10 * x, 10 * x + 10)]):
                s, n = 10 * y, 10 * y + 10
                edges += [(1, s, w, s, e), (1, s, e, n, e), (1, n, e, n, w), (1, n, w, s, w)]
    edges += [(2, 3, 3, 3, 7), (2, 3, 7, 8, 7), (2, 8, 7, 3, 3), (3, 1, 1, 1, 1)]
    table = spark.createDataFrame(edges, "id long, ay long, ax long, by long, bx long")
    rings = dissolve.ring_areas(dissolve.dissolve(table, "id", 5), "id").collect()
    assert sorted((r.id, r.area) for r in rings) == [(1, -200), (1, 1800), (2, 20)]
    assert dissolve.dissolve(table.limit(0), "id", 5).count() == 0


def test_water_surfaces(spark):
    from geoloom.operators import waters

    areas = spark.createDataFrame(
        [(1, "lake", False, 2e6, 0.5, 0.5), (2, "lake", None, 5e4, 0.5, 90.5), (3, "basin", True, 9e9, 7.0, 7.0), (4, "pond", False, 1.0, 500.0, 0.0), (5, "lake", False, 2e5, 0.5, 90.5)],
        "area_id long, kind string, tidal boolean, area_m2 double, mid_r double, mid_c double",
    )
    # Of 50 vertices every second counts, 24 of them: those after 46 don't, nor the odd ones with their height of 1000.
    shore = spark.createDataFrame([(1, k, 3.5, k + 0.5) for k in range(50)] + [(5, k, 3.9, 60.5 + k) for k in range(4)], "area_id long, seq long, r double, c double")
    heights = [(3, k, 1000.0 if k % 2 or k >= 48 else float(20 + k)) for k in range(50)] + [(0, 90, 30.6), (0, 0, -5.0)]
    heights += [(3, 60, 7.0), (3, 61, 9.5), (3, 62, None)]
    got = {r.area_id: tuple(r)[1:] for r in waters.water_surfaces(areas, shore, spark.createDataFrame(heights, "r long, c long, value double"), 2.0).collect()}
    assert got == {1: ("lake", 44.0, 12, False, 24), 2: ("lake", 31.0, 4, False, 0), 3: ("basin", 2.0, 2, True, 0), 4: ("sea", 2.0, 6, True, 0), 5: ("lake", 10.0, 7, False, 2)}


def test_samples_are_not_broadcast_and_values_are_worked_out_once(spark):
    """The many samples of few buildings meet the surface by a merge, and no test of the values is pushed down into the surface."""
    from geoloom.plans import catalogue

    for name in ("ag08_surface_heights", "ag08_roof_shapes"):
        query = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert "BroadcastHashJoin" not in query.executedPlan().toString() and "SortMergeJoin" in query.executedPlan().toString()
        assert not any("Join" in line and "CASE" in line for line in query.optimizedPlan().toString().splitlines())
