"""Classes of map pixels by the colours of a legend: exact ones, soft edges, and lines and labels filled from beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import stored

#: Pixels of a colour from which it is worth asking for; channels of a grey differ by less; soft edges lie nearer than REACH.
LEAST, GREY, REACH, ROUNDS = 30, 6, 60, 8


def channels(rgb: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of 0xRRGGBB."""
    return tuple(F.shiftright(rgb, s).bitwiseAND(255) for s in (16, 8, 0))


def is_grey(rgb: Column, spread: int = GREY) -> Column:
    r, g, b = channels(rgb)
    return (F.abs(r - g) < spread) & (F.abs(g - b) < spread) & (F.abs(r - b) < spread)


def unnamed_colours(pixels: DataFrame, legend: DataFrame, least: int = LEAST) -> DataFrame:
    """`(rgb, tile, r, c, n)`: colours of `least` pixels in some tile that the legend lacks, and the place to ask for each."""
    seen = pixels.where("alpha >= 128").where(~is_grey(F.col("rgb"))).groupBy("tile", "rgb").agg(F.count("*").alias("n"), F.min(F.struct("r", "c")).alias("p")).where(F.col("n") >= least)
    asked = seen.join(legend.select("rgb").distinct(), "rgb", "left_anti")
    return asked.groupBy("rgb").agg(F.max_by(F.struct("tile", "p", "n"), F.struct("n", F.negate("tile"))).alias("a")).select("rgb", "a.tile", "a.p.r", "a.p.c", "a.n")


def classify(pixels: DataFrame, legend: DataFrame, reach: int = REACH, rounds: int = ROUNDS) -> DataFrame:
    """`(tile, r, c, class)` of all `pixels` (tile, r, c, rgb, alpha; each once), from `legend` (rgb, class above 0; each colour once).

    A colour of the legend has its class. Another one takes that of the nearest colour of the legend that its tile shows,
    if nearer than `reach` (the smaller colour of equally near ones). Greys, which are lines and labels, and colours that
    are near none take the most common class of the eight pixels around in the tile (the smaller of equally common ones),
    round by round from the edges inwards, at most `rounds` times and until nothing changes. What is transparent, and what
    is still unknown, has class 0. Only colours, not pixels, are compared with the palette, and only unknown pixels look round.
    """
    solid = pixels.where("alpha >= 128")
    colours = stored(solid.select("tile", "rgb").distinct().where(~is_grey(F.col("rgb"))).join(legend.select("rgb", "class"), "rgb", "left"))
    palette = colours.where("class is not null").select("tile", F.col("rgb").alias("k_rgb"), F.col("class").alias("k_class"))
    d2 = sum((a - b) * (a - b) for a, b in zip(channels(F.col("rgb")), channels(F.col("k_rgb")), strict=True))
    near = colours.where("class is null").select("tile", "rgb").join(palette, "tile").withColumn("d2", d2).where(F.col("d2") < reach * reach)
    near = near.groupBy("tile", "rgb").agg(F.min_by("k_class", F.struct("d2", "k_rgb")).alias("class"))
    known = colours.where("class is not null").select("tile", "rgb", "class").union(near)
    shown = solid.select("tile", "r", "c", "rgb").join(known, ["tile", "rgb"], "left")
    state = stored(shown.select("tile", "r", "c", "class"))
    around = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    filled, unknown = state.where("class is not null"), state.where("class is null").select("tile", "r", "c")
    for _ in range(rounds):
        asked = unknown.select("tile", "r", "c", F.inline(around)).select("tile", "r", "c", (F.col("r") + F.col("dr")).alias("nr"), (F.col("c") + F.col("dc")).alias("nc"))
        votes = asked.join(filled.select("tile", F.col("r").alias("nr"), F.col("c").alias("nc"), "class"), ["tile", "nr", "nc"]).groupBy("tile", "r", "c", "class").agg(F.count("*").alias("n"))
        won = stored(votes.groupBy("tile", "r", "c").agg(F.max_by("class", F.struct("n", F.negate("class"))).alias("class")))
        if won.isEmpty():
            break
        filled, unknown = filled.union(won), stored(unknown.join(won, ["tile", "r", "c"], "left_anti"))
    rest = unknown.select("tile", "r", "c", F.lit(0).cast(dict(legend.dtypes)["class"]).alias("class"))
    clear = pixels.where("alpha < 128 or alpha is null").select("tile", "r", "c", F.lit(0).cast(dict(legend.dtypes)["class"]).alias("class"))
    return filled.union(rest).union(clear)
