"""Results that only larger tables show, and plans that hold at their size."""

import functools
import math
import operator
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import areas, coast, components, grids, spatial
from geoloom.plans.statistics import rounded, steady_mean
from geoloom.sources import fixtures


def test_a_corner_that_rounding_parts_has_its_cell(spark):
    line = (2042.3, -0.5, 2053.7, 16.5)  # through the corner (2048, 8), which the two cuts miss by an ulp
    got = {(r.r, r.c) for r in coast.line_cells(spark.createDataFrame([line], "ay double, ax double, by double, bx double")).collect()}
    assert (2047, 8) in got and {(2047, 7), (2048, 8)} <= got and (2048, 7) not in got


def test_a_small_negative_value_keeps_its_sign(spark):
    got = [r.v for r in spark.createDataFrame([(-0.04,), (0.04,), (0.0,), (-0.06,), (None,)], "x double").select(rounded(F.col("x"), 1).alias("v")).collect()]
    assert got == [0.0, 0.0, 0.0, -0.1, None] and [math.copysign(1, v) for v in got[:3]] == [-1, 1, 1]


def test_a_mean_does_not_depend_on_the_order_of_its_rows(spark):
    draw = random.Random(1)
    values = [draw.randrange(1, 100) / draw.choice([1, 2, 3, 7]) * 1.1 for _ in range(60)]
    shuffled = [draw.sample(values, len(values)) for _ in range(40)]
    assert len({functools.reduce(operator.add, v) for v in shuffled}) > 1  # one after the other, as engines add
    rows = [(k, x) for k, v in enumerate(shuffled) for x in v] + [(100, 1.0), (100, math.inf), (101, None), (102, None), (102, 0.5)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k int, x double").coalesce(1).groupBy("k").agg(steady_mean(F.col("x")).alias("m")).collect()}
    assert len({got[k] for k in range(40)}) == 1 and abs(got[0] - sum(values) / 60) < 1e-11 and [got[k] for k in (100, 101, 102)] == [math.inf, None, 0.5]


def test_the_nearest_by_rounds_are_those_of_all_pairs(spark):
    draw = random.Random(7)
    crowd = [(k, 600_000_000 + draw.randrange(3000), 50_000_000 + draw.randrange(3000)) for k in range(60)]
    sparse = [(60 + k, 600_000_000 + draw.randrange(900_000), 50_000_000 + draw.randrange(900_000)) for k in range(60)]
    right = spark.createDataFrame(crowd + sparse, "id long, y long, x long")
    left = spark.createDataFrame([(k, y + 40, x - 30) for k, y, x in crowd[:20] + sparse] + [(999, None, 5)], "k long, lat long, lon long")
    got = {(r.k, r.id) for r in spatial.nearest_within(left, right, "k", 3000.0, ("lat", "lon"), ("y", "x"), ["id"], k=3).collect()}
    d = spatial.metres_e7(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    best = Window.partitionBy("k").orderBy(F.round("d", 3), "id")
    every = left.crossJoin(right).withColumn("d", d).where("round(d, 3) <= 3000").withColumn("n", F.row_number().over(best)).where("n <= 3")
    assert got == {(r.k, r.id) for r in every.collect()} and len(got) > 100


def test_near_pixels_are_those_of_all_offsets(spark):
    pixels = spark.createDataFrame([(r, c) for r in range(-20, 20) for c in range(-20, 20) if (r * 7 + c) % 3], "pr long, pc long")
    points = spark.createDataFrame([(1, -8, 7), (2, 0, 0), (3, 19, -20), (4, 40, 0)], "k long, r long, c long")
    got = {(r.k, r.dr, r.dc) for r in grids.near_pixels(points, pixels, 5).collect()}
    want = {(r.k, r.dr, r.dc) for r in grids.offsets(points, grids.square(5)).join(pixels, ["pr", "pc"]).collect()}
    assert got == want and got


def test_rows_spread_over_cells_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, 5, 5)], "p long, lat_e7 long, lon_e7 long")
    edges = spatial.square_edges(spark.createDataFrame([(1, 0, 0, 9, 9)], "id long, lat_e7 long, lon_e7 long, half_lat long, half_lon long"), "id")
    inside = spatial.points_in_polygons(points, edges, "p", "id", ("lat_e7", "lon_e7"))
    assert "BroadcastHashJoin" not in inside._jdf.queryExecution().executedPlan().toString() and inside.count() == 1


def test_a_raster_gives_each_cell_once_without_a_distinct(spark):
    ring = [(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (5.5, 0.0), (3.5, 0.0), (3.5, 4.0), (3.5, 0.0), (0.0, 4.0)]  # spans that touch in a cell's middle
    edges = spark.createDataFrame([(1, ax, az, bx, bz) for (ax, az), (bx, bz) in zip(ring, ring[1:] + ring[:1], strict=True)], "id long, x1 double, z1 double, x2 double, z2 double")
    cells = areas.rasterise_polygons(edges, "id")
    got = [(r.x, r.z) for r in cells.collect()]
    assert len(got) == len(set(got)) > 4 and "HashAggregate" not in cells._jdf.queryExecution().executedPlan().toString()


def test_tables_that_multiply_rows_spread_what_they_read(spark):
    surface = fixtures.table(spark, "/root/testdata/sf0.001", "surface")
    assert surface.rdd.getNumPartitions() >= 4


def test_smallest_region_by_rounds(spark, monkeypatch):
    """Rounds of few regions give what all regions at once give; a box meets no region that is larger than the one it found before."""
    from geoloom.operators import regions
    from geoloom.operators.spatial import square_edges

    areas = spark.range(300).selectExpr("id AS region", "id * 37 % 11 * 3000L AS lat_e7", "id * 53 % 13 * 3000L AS lon_e7", "5000L + id % 29 * 1500 AS half_lat", "5000L + id % 29 * 1500 AS half_lon")
    probes = spark.range(40 * 70).selectExpr("id % 40 AS box", "cast(id / 40 AS bigint) AS probe", "id % 40 % 7 * 4000L + cast(id / 40 AS bigint) * 20 AS y", "id % 40 % 5 * 6000L AS x")
    sized = areas.selectExpr("region", "cast(half_lat AS double) * half_lon AS area")
    find = lambda: {(r.box, r.region) for r in regions.smallest_holding_all(probes, square_edges(areas, "region"), sized, "box", "region").collect()}
    a, p = areas.collect(), probes.collect()
    ends = {k: (min(r.y for r in p if r.box == k), max(r.y for r in p if r.box == k), k % 5 * 6000) for k in range(40)}
    held = {k: [(r.half_lat**2, r.region) for r in a if r.lat_e7 - r.half_lat <= y0 and y1 < r.lat_e7 + r.half_lat and r.lon_e7 - r.half_lon <= x < r.lon_e7 + r.half_lon] for k, (y0, y1, x) in ends.items()}
    want = {(k, min(v)[1]) for k, v in held.items() if v}
    assert find() == want
    monkeypatch.setattr(regions, "FIRST_REGIONS", 5)
    assert want and find() == want


def test_nearest_segment_meets_few(spark):
    """The nearest of many parallel lines comes out as from all of them, however crowded, also from afar."""
    from geoloom.operators import linear

    points = spark.range(200).selectExpr("id AS line", "id * 3000L AS lat_e7").selectExpr("line", "inline(array(named_struct('seq', 1L, 'lat_e7', lat_e7, 'lon_e7', 0L), named_struct('seq', 2L, 'lat_e7', lat_e7, 'lon_e7', 2000L)))")
    asked = spark.range(20).selectExpr("id AS k", "cast(id * 37000 - 60000 AS double) AS y", "1000D AS x")
    got = {r.k: (r.line, round(r.d, 3)) for r in linear.nearest_segment(asked, ["k"], linear.measured(points, "line", "seq"), 600.0, ("y", "x"), ["line"]).collect()}
    want = {}
    for k in range(20):
        d, line = min((round(abs(k * 37000 - 60000 - n * 3000) / 1e7 * 111320.0, 6), n) for n in range(200))
        if d <= 600:
            want[k] = (line, round(d, 3))
    assert got == want and 0 < len(want) < 20


def test_names_are_looked_up_among_one_place_each(spark):
    """A name's best place is found before features meet it, so features and places of one name make no pairs."""
    from geoloom.plans import catalogue

    plan = catalogue.queries()["jn50_name_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [name#" in line for line in plan.splitlines())


def test_lines_that_share_cells_are_tied_by_their_steps(spark):
    # 5 and 3 share cell 2 in their middles, 9 ties in by a cell of 3 alone; 4 is alone; 7 and 8 stand in one cell; nulls are left out.
    lines = {5: [1, 2, 3], 3: [10, 2, 11], 9: [12, 11], 4: [20, 21, 20], 7: [30], 8: [30, None], None: [20]}
    points = spark.createDataFrame([(k, n, c) for k, cells in lines.items() for n, c in enumerate(cells)], "way long, seq long, cell long")
    got = {(r.node, r.component) for r in components.shared_cells(points, "way", "seq", "cell").collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7), (8, 7)}


def _tasks(df) -> int:
    """The greatest number of tasks that a plan deals rows over."""
    import re

    return max(int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString()))


def test_tasks_of_cells_grow_with_the_shapes(spark, tmp_path, monkeypatch):
    """Shapes and the cells made of them are dealt over more tasks where there are more shapes, with the same results."""
    from geoloom.plans import areas as plans
    from geoloom.plans import catalogue

    names = ("st01_area_selection", "st02_set_operations", "st03_grow", "st03_shrink", "st04_outline", "st07_coverage_level", "ag23_layered_overlay", "ag33_two_decks")
    made = {name: catalogue.queries()[name](spark, "/root/testdata/sf0.001") for name in names}
    want = {name: sorted(map(tuple, df.collect())) for name, df in made.items()}
    monkeypatch.setattr(fixtures, "SPREAD_ROWS", 20)
    monkeypatch.setattr(plans, "SPREAD_ROWS", 20)
    for name in names:
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        assert _tasks(made[name]) == 4 and _tasks(df) == 10, name
        assert "hashpartitioning(x" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == want[name]


def test_cells_meet_over_the_edges_of_blocks(spark):
    """Brushes, outlines and set sizes of cells about the corner of four blocks, also of negative ones, are those of plain sets."""
    draw = random.Random(3)
    held = {(b * areas.BLOCK + draw.randrange(-5, 5), d * areas.BLOCK + draw.randrange(-5, 5)) for b in (-1, 0, 1) for d in (0, 2) for _ in range(70)}
    cells = spark.createDataFrame(sorted(held), "x int, z int")
    moved = {(x + 3, z + 2) for x, z in held}
    brush = areas.disc(2)
    assert sorted(map(tuple, areas.grow(cells, 2, 7).collect())) == sorted({(x + a, z + b) for x, z in held for a, b in brush})
    assert sorted(map(tuple, areas.shrink(cells, 2, 7).collect())) == sorted((x, z) for x, z in held if all((x + a, z + b) in held for a, b in brush))
    seen = [e for x, z in held for e in ((x, z, x + 1, z), (x, z + 1, x + 1, z + 1), (x, z, x, z + 1), (x + 1, z, x + 1, z + 1))]
    assert sorted(map(tuple, areas.outline(cells, 7).collect())) == sorted(e for e in set(seen) if seen.count(e) == 1)
    sizes = areas.set_sizes(cells, spark.createDataFrame(sorted(moved), "x int, z int"), 7)
    assert {r.op: r.n for r in sizes.collect()} == {"union": len(held | moved), "difference": len(held - moved), "common": len(held & moved)}


def test_the_nearest_run_is_that_of_all_runs(spark, monkeypatch):
    """Points meet arrays of few runs, in parts where a block holds many, over more tasks where there are more points."""
    draw = random.Random(5)
    runs = {(draw.randrange(60), 2 * draw.randrange(60)) for _ in range(900)} | {(300, 900), (-400, 7)}
    asked = [(k, draw.randrange(-40, 160), draw.randrange(-40, 120)) for k in range(150)] + [(999, 500, 500)]
    want = {(k, *min(((a - x) ** 2 + (row - z) ** 2, row, a) for row, a in runs)[1:]) for k, x, z in asked}
    points = spark.createDataFrame(asked, "k long, x long, z long")
    given = spark.createDataFrame([(row, a, a) for row, a in runs], "row int, start int, end int")
    monkeypatch.setattr(areas, "RUNS", 8)
    monkeypatch.setattr(areas, "NEAREST_ROWS", 100)
    assert {tuple(r) for r in areas.nearest_cell(points, given, "k").collect()} == want


def test_distances_to_the_outside_are_those_of_plain_sets(spark):
    """Bodies with holes and gaps, rows over several batches; a cell makes no rows for its neighbours."""
    draw = random.Random(9)
    bodies = {1: {(x, z) for x in range(-12, 14) for z in range(-9, 11) if draw.random() > 0.02}, 2: {(x, 0) for x in range(9)}, 3: {(x, z) for x in range(20) for z in range(20) if x != 11}}
    cells = spark.createDataFrame([(k, x, z) for k, body in bodies.items() for x, z in body], "k long, x int, z int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = areas.distance_to_outside(cells, "k")
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.x, r.z): r.d for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(k, x, z): min(math.hypot(a, b) for a in range(-12, 13) for b in range(-12, 13) if (x + a, z + b) not in body) for k, body in bodies.items() for x, z in body}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)
