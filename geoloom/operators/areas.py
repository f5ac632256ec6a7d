"""Cell sets, runs and rasterisation: `(x, z)` cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from geoloom.session import ship_package, stored, tasks_for

#: Side of the square blocks of cells by which cells are dealt.
BLOCK = 64
#: Runs of one array where the nearest is looked for, and rows (points and runs) that one task takes, about.
RUNS, NEAREST_ROWS = 1024, 50_000


def union_runs(runs: DataFrame) -> DataFrame:
    """Runs `(row, start, end)` with inclusive ends; those that touch or overlap become one."""
    w = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
    marked = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("row", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def cells_of_runs(runs: DataFrame) -> DataFrame:
    return runs.select("row", F.explode(F.sequence("start", "end")).alias("col"))


def runs_of_cells(cells: DataFrame) -> DataFrame:
    island = cells.distinct().withColumn("_i", F.col("col") - F.row_number().over(Window.partitionBy("row").orderBy("col")))
    return island.groupBy("row", "_i").agg(F.min("col").alias("start"), F.max("col").alias("end")).drop("_i")


def subtract_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """What a covers and b doesn't."""
    return runs_of_cells(cells_of_runs(a).join(cells_of_runs(b), ["row", "col"], "left_anti"))


def rasterise_polygons(edges: DataFrame, key: str) -> DataFrame:
    """`(key, x, z)`: cells whose centre is inside by the even-odd rule, from ring edges (key, x1, z1, x2, z2).

    Each edge gives its crossings with the rows of cell centres; crossings are paired in order along the row. A pair begins
    behind the cells of those before it, so each cell comes out once and none is made distinct.
    """
    low, high = F.least("z1", "z2"), F.greatest("z1", "z2")
    rows = F.sequence(F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int"))
    crossed = edges.where("z1 <> z2").where(F.ceil(high - 0.5) - 1 >= F.ceil(low - 0.5)).withColumn("z", F.explode(rows))
    crossed = crossed.withColumn("x", F.col("x1") + (F.col("z") + 0.5 - F.col("z1")) * (F.col("x2") - F.col("x1")) / (F.col("z2") - F.col("z1")))
    w = Window.partitionBy(key, "z").orderBy("x")
    paired = crossed.withColumns({"_n": F.row_number().over(w), "xb": F.lead("x").over(w)}).where("_n % 2 = 1 and xb is not null")
    a, b = F.ceil(F.col("x") - 0.5).cast("int"), F.floor(F.col("xb") - 0.5).cast("int")
    runs = paired.select(key, "z", F.col("x").alias("_x"), a.alias("_a"), b.alias("_b")).where("_b >= _a")
    reached = F.max("_b").over(Window.partitionBy(key, "z").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_a", F.greatest(F.col("_a"), reached + 1)).where("_b >= _a")
    return runs.select(key, F.explode(F.sequence("_a", "_b")).alias("x"), "z")


def rasterise_lines(segments: DataFrame, key: str, half_width: float) -> DataFrame:
    """`(key, x, z, d)`: cells whose centre lies within half_width of a segment (key, x1, z1, x2, z2), with the least distance."""
    box = segments.withColumn("x", F.explode(F.sequence(F.floor(F.least("x1", "x2") - half_width).cast("int"), F.floor(F.greatest("x1", "x2") + half_width).cast("int"))))
    box = box.withColumn("z", F.explode(F.sequence(F.floor(F.least("z1", "z2") - half_width).cast("int"), F.floor(F.greatest("z1", "z2") + half_width).cast("int"))))
    from geoloom.functions.geometry import segment_distance

    d = segment_distance(F.col("x") + 0.5, F.col("z") + 0.5, F.col("x1"), F.col("z1"), F.col("x2"), F.col("z2"))
    return box.withColumn("d", d).where(F.col("d") <= half_width).groupBy(key, "x", "z").agg(F.min("d").alias("d"))


def by_blocks(cells: DataFrame, tasks: int | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """`cells` (x, z, ...) with their block `(_bx, _bz)`, dealt by it: over `tasks` tasks, else as a shuffle has.

    A cell is filed under each block that holds a cell from `before` less to `after` more along x and z, so what cells
    add to others near them meets within a block, and only the cells at its rim are shuffled more than once.
    """
    block = lambda c, d=0: F.floor((F.col(c) + d) / BLOCK)
    blocks = lambda c: F.explode(F.sequence(block(c, -before), block(c, after))) if before or after else block(c)
    filed = cells.withColumn("_bx", blocks("x")).withColumn("_bz", blocks("z"))
    return filed.repartition(*([tasks] if tasks else []), "_bx", "_bz")


def in_block(x: str, z: str) -> Column:
    """Whether the cell lies in the block that the row is filed under."""
    return (F.floor(F.col(x) / BLOCK) == F.col("_bx")) & (F.floor(F.col(z) / BLOCK) == F.col("_bz"))


def select_area(cells: DataFrame, shapes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cells `(x, z)` whose last shape adds: cells are (shape_order, x, z), shapes (shape_order, subtract)."""
    known = cells.join(shapes.hint("merge"), "shape_order")
    last = by_blocks(known, tasks).groupBy("_bx", "_bz", "x", "z").agg(F.max_by("subtract", "shape_order").alias("gone"))
    return last.where("not gone").select("x", "z")


def set_sizes(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """`(op, n)`: how many different cells are in a or b (union), in a and not in b (difference), in both (common)."""
    both = a.select("x", "z", F.lit(True).alias("a"), F.lit(False).alias("b")).union(b.select("x", "z", F.lit(False), F.lit(True)))
    held = by_blocks(both, tasks).groupBy("_bx", "_bz", "x", "z").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sizes = held.agg(F.count("*").alias("union"), F.count_if(F.col("a") & ~F.col("b")).alias("difference"), F.count_if(F.col("a") & F.col("b")).alias("common"))
    return sizes.select(F.inline(F.array(*[F.struct(F.lit(op).alias("op"), F.col(op).alias("n")) for op in ("union", "difference", "common")])))


def disc(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= k * k]


def _reached(cells: DataFrame, k: int, tasks: int | None) -> DataFrame:
    """`(_bx, _bz, x, z)`: each cell of the round brush of k cells about each cell, in the task of its own block."""
    brush = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc(k)])
    spots = F.inline(F.transform(brush, lambda o: F.struct((F.col("x") + o["a"]).alias("x"), (F.col("z") + o["b"]).alias("z"))))
    return by_blocks(cells, tasks, k, k).select("_bx", "_bz", spots).where(in_block("x", "z"))


def grow(cells: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """Every cell within a round brush of k cells."""
    return _reached(cells, k, tasks).distinct().select("x", "z")


def shrink(cells: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """Cells all of whose brush lies inside."""
    return _reached(cells, k, tasks).groupBy("_bx", "_bz", "x", "z").agg(F.count("*").alias("n")).where(F.col("n") == len(disc(k))).select("x", "z")


def outline(cells: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cell edges seen once: `(x1, z1, x2, z2)`."""
    e = lambda a, b, c, d: F.struct((F.col("x") + a).alias("x1"), (F.col("z") + b).alias("z1"), (F.col("x") + c).alias("x2"), (F.col("z") + d).alias("z2"))
    edges = by_blocks(cells, tasks, after=1).select("_bx", "_bz", F.inline(F.array(e(0, 0, 1, 0), e(0, 1, 1, 1), e(0, 0, 0, 1), e(1, 0, 1, 1)))).where(in_block("x1", "z1"))
    return edges.groupBy("_bx", "_bz", "x1", "z1", "x2", "z2").agg(F.count("*").alias("n")).where("n = 1").select("x1", "z1", "x2", "z2")


def overlay(cells: DataFrame, order: list, tasks: int | None = None) -> DataFrame:
    """The class that is drawn last in each cell: `order` are columns, the greatest wins."""
    return by_blocks(cells, tasks).groupBy("_bx", "_bz", "x", "z").agg(F.max_by("class", F.struct(*order)).alias("class")).select("x", "z", "class")


def _least(start: np.ndarray, stop: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The least squared distance of each cell of many runs (first and last row of each cell's run) to the outside, `g` being that along the column."""
    at = np.arange(len(g))
    best = np.minimum(g, np.minimum(at - start, stop - at) + 1) ** 2
    near, dx = at, 1
    while len(near := near[best[near] > dx * dx]):
        for step in (-dx, dx):
            inside = near[(near + step >= start[near]) & (near + step <= stop[near])]
            best[inside] = np.minimum(best[inside], dx * dx + g[inside + step] ** 2)
        dx += 1
    return best


def _row_distances(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Cells in order of key, z, x, whole runs of a row at a time."""
    kept: pa.Table | None = None

    def told(table: pa.Table, begins: np.ndarray) -> list[pa.RecordBatch]:
        n = np.diff(np.append(begins, table.num_rows))
        start, stop = np.repeat(begins, n), np.repeat(begins + n - 1, n)
        d = np.sqrt(_least(start, stop, table.column("g").to_numpy().astype(np.int64)))
        return table.drop_columns(["g"]).append_column("d", pa.array(d)).combine_chunks().to_batches()

    def begins_of(table: pa.Table) -> np.ndarray:
        x, z, own = table.column("x").to_numpy().astype(np.int64), table.column("z").to_numpy(), table.column(key)
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1] + 1) | (z[1:] != z[:-1]) | pc.fill_null(pc.not_equal(own[1:], own[:-1]), True).to_numpy()
        return np.flatnonzero(new)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        if not table.num_rows:
            continue
        begins = begins_of(table)
        last = int(begins[-1])  # this run may go on in the next batch
        if last:
            yield from told(table[:last].combine_chunks(), begins[:-1])
        kept = table[last:]
    if kept is not None and kept.num_rows:
        yield from told(kept.combine_chunks(), np.zeros(1, np.int64))


def distance_to_outside(cells: DataFrame, key: str) -> DataFrame:
    """Distance of each cell to the nearest cell outside its body: nearest along the column, then over the row.

    `cells` are (key, x, z), each once. Runs along z give the distance g to the run's ends; along the row, the least of
    dx^2 + g^2 is taken over the cells of the same run, and the cells at its ends count with g = 0: what lies beyond them is
    further off. Rows are read in order, so a cell is shuffled by column and by row and never for its neighbours.
    """
    wz = Window.partitionBy(key, "x").orderBy("z")
    run = cells.withColumn("_i", F.col("z") - F.row_number().over(wz))
    wr = Window.partitionBy(key, "x", "_i")
    g = F.least(F.col("z") - F.min("z").over(wr) + 1, F.max("z").over(wr) - F.col("z") + 1)
    held = run.select(key, "x", "z", g.cast("bigint").alias("g")).repartition(key, "z").sortWithinPartitions(key, "z", "x")
    ship_package(cells.sparkSession)
    schema = StructType([*(cells.schema[c] for c in (key, "x", "z")), StructField("d", DoubleType())])
    return held.mapInArrow(lambda batches: _row_distances(batches, key), schema)


def two_decks(cells: DataFrame, tasks: int | None = None) -> DataFrame:
    """The top way of each cell by layer, priority and id, and the one under it."""
    w = Window.partitionBy("_bx", "_bz", "x", "z").orderBy(F.col("layer").desc(), F.col("priority").desc(), "id")
    ranked = by_blocks(cells, tasks).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    return ranked.groupBy("_bx", "_bz", "x", "z").agg(F.max(F.when(F.col("_n") == 1, F.col("id"))).alias("top"), F.max(F.when(F.col("_n") == 2, F.col("id"))).alias("under")).drop("_bx", "_bz")


def nearest_cell(points: DataFrame, runs: DataFrame, key: str, block: int = 16) -> DataFrame:
    """`(key, row, col)`: the cell of the runs `(row, start, end)` that is nearest to each point `(key, x, z)`.

    Points look for runs in their own square block of cells and the eight round it; what lies within a block's side is
    the nearest of all. Points that find nothing so near look again in blocks of twice the side. The runs of a block stand
    in arrays of at most about RUNS, so a point gives at most a row for each array and not for each run. Ties go to the smaller
    row, then column. Points of null positions, and all points where there are no runs, get no cell.
    """
    runs = stored(union_runs(runs.where("row is not null and start <= end")))
    left = points.select(key, "x", "z").where("x is not null and z is not null")
    if runs.isEmpty():
        return left.select(key, F.lit(0).alias("row"), F.lit(0).alias("col")).limit(0)
    side = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    tasks = tasks_for(runs.select(F.lit(1)).union(left.select(F.lit(1))), NEAREST_ROWS)
    parts = []
    while True:
        filed = runs.withColumns({"_bx": F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))), "_bz": F.floor(F.col("row") / block), "_part": F.floor(F.col("row") / max(1, 2 * RUNS // block))})
        filed = filed.repartition(tasks, "_bx", "_bz").groupBy("_bx", "_bz", "_part").agg(F.collect_list(F.struct("row", "start", "end")).alias("_runs"))
        spread = left.withColumn("_bx", F.explode(F.transform(side, lambda d: F.floor(F.col("x") / block) + d))).withColumn("_bz", F.explode(F.transform(side, lambda d: F.floor(F.col("z") / block) + d)))

        def reached(run: Column) -> Column:
            col = F.least(F.greatest(F.col("x"), run["start"]), run["end"])
            d2 = (col - F.col("x")) * (col - F.col("x")) + (run["row"] - F.col("z")) * (run["row"] - F.col("z"))
            return F.struct(d2.alias("d2"), run["row"].alias("row"), col.alias("col"))

        met = spread.repartition(tasks, "_bx", "_bz").join(filed.hint("merge"), ["_bx", "_bz"]).select(key, F.array_min(F.transform("_runs", reached)).alias("best"))
        near = met.where(F.col("best.d2") <= block * block).repartition(tasks, key)
        parts.append(stored(near.groupBy(key).agg(F.min("best").alias("best")).select(key, "best.row", "best.col")))
        left = stored(left.join(parts[-1].hint("merge"), key, "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.union, parts)
        block *= 2
