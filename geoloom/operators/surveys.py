"""Surveyed tunnel bores on mapped tunnels: votes along each way, growth over bores that touch end to end, a gate on cover."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import bearing
from geoloom.operators import linear, tiles
from geoloom.operators.components import connected_components
from geoloom.operators.spatial import metres_e7, with_boxes_near
from geoloom.session import stored

REACH_M, DEGREES = 8.0, 35.0
#: Bores go on in each other where ends are this close, in plan and in height.
JOINT_M, JOINT_HEIGHT_M = 2.0, 2.0
#: Side of the cells that ends meet in (1e-7 degrees), many times the distance of a joint: an end stands in few of them.
JOINT_E7 = 2_000
#: A way is taken as surveyed with this share of its metres, and this many.
SHARE, LEAST = 0.3, 3


def touching(bores: DataFrame) -> DataFrame:
    """`(a, b)`, both ways round: bores (bore_id, seq, lat_e7, lon_e7, z) that share an end."""
    place = F.struct("lat_e7", "lon_e7", "z")
    ends = bores.groupBy("bore_id").agg(F.array(F.min_by(place, "seq"), F.max_by(place, "seq")).alias("e")).select("bore_id", F.inline("e"))
    side = lambda p: ends.select(*[F.col(c).alias(f"{p}_{c}") for c in ends.columns])
    at = lambda p: (f"{p}_lat_e7", f"{p}_lon_e7") * 2
    met = with_boxes_near(side("a"), side("b"), JOINT_M, at("a"), at("b"), JOINT_E7)
    far = metres_e7(F.col("a_lat_e7"), F.col("a_lon_e7"), F.col("b_lat_e7"), F.col("b_lon_e7"))
    met = met.where((F.col("a_bore_id") != F.col("b_bore_id")) & (far <= JOINT_M) & (F.abs(F.col("a_z") - F.col("b_z")) <= JOINT_HEIGHT_M))
    return met.select(F.col("a_bore_id").alias("a"), F.col("b_bore_id").alias("b")).distinct()


def _allowed(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of a way's segment and a bore that its list holds."""
    lists, bores = left.column("l_allowed").combine_chunks(), right.column("r_bore_id").to_numpy()
    names, code = np.unique(bores, return_inverse=True)
    held = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    at = np.searchsorted(names, held).clip(max=len(names) - 1)
    here = names[at] == held
    return np.isin(a * len(names) + code[b], row[here] * len(names) + at[here])


def _votes(met: tiles.Met, reach: float) -> pa.Table:
    """How many metres of a way's segment have a bore as the nearest."""
    bore = met.right.column("r_bore_id").to_numpy()[met.b]
    order = np.lexsort((bore, np.round(met.d, 6), met.k, met.a))
    order = order[met.d[order] < reach]
    best = order[tiles.firsts(met.a[order], met.k[order])]
    a, bore = met.a[best], bore[best]
    order = np.lexsort((bore, a))
    begins = tiles.firsts(a[order], bore[order])
    n = np.diff(np.append(begins, len(order)))
    return pa.table({"way_id": met.left.column("l_way_id").to_numpy()[a[order][begins]], "bore_id": bore[order][begins], "votes": n})


def _heights(met: tiles.Met, reach: float) -> pa.Table:
    """The height at each metre by the nearest bore, of each bore by its nearest segment; unknown heights are none."""
    get = lambda name: met.right.column(name).to_numpy()[met.b]
    bore, off = get("r_bore_id"), np.round(met.d, 6)
    order = np.lexsort((get("r_seq"), off, bore, met.k, met.a))
    order = order[met.d[order] < reach]
    order = order[tiles.firsts(met.a[order], met.k[order], bore[order])]
    z = get("r_z") + met.t * (get("r_z2") - get("r_z"))
    order = order[~np.isnan(z[order])]
    order = order[np.lexsort((bore[order], off[order], met.k[order], met.a[order]))]
    best = order[tiles.firsts(met.a[order], met.k[order])]
    of = lambda name: met.left.column(name).to_numpy()[met.a[best]]
    return pa.table({"way_id": of("l_way_id"), "metre": met.k[best], "n": of("l_n"), "bore_id": bore[best], "z": z[best]})


def bore_heights(points: DataFrame, bores: DataFrame, reach: float = REACH_M, degrees: float = DEGREES, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """`(way_id, metre, bore_id, z)`: the surveyed height at each metre of the tunnels of `points` (way_id, seq, lat_e7, lon_e7).

    Each metre votes for the nearest bore within `reach` metres and `degrees` of its direction; the bore of most votes (the
    smaller id of equal ones) is the way's, with those that were voted for and are joined to it end to end, directly or
    over others. The metres are then measured by these alone; the other tube of a pair never touches them, so it lends no
    height. A way with fewer than `least` measured metres, or less than `share` of all, has no rows. Bores of one place and
    points without a height measure nothing.
    """
    ordered = Window.partitionBy("bore_id").orderBy("seq")
    graded = bores.select("bore_id", "seq", "lat_e7", "lon_e7", F.col("z").cast("double").alias("z"), F.lead(F.col("z").cast("double")).over(ordered).alias("z2"))
    ways, tubes = linear.measured(points.select("way_id", "seq", "lat_e7", "lon_e7"), "way_id", "seq"), linear.measured(graded, "bore_id", "seq")
    axis = F.pmod(bearing(F.col("dx"), F.col("dy")), F.lit(180.0))
    meet = partial(tiles.meet, reach=reach, step=1.0, bearing_of=axis, degrees=degrees, right_keep={c: F.col(c) for c in ("bore_id", "seq", "z", "z2")})

    votes = meet(ways, tubes, made=partial(_votes, reach=reach), schema="way_id long, bore_id long, votes long", left_keep={"way_id": F.col("way_id")})
    voted = stored(votes.groupBy("way_id", "bore_id").agg(F.sum("votes").alias("votes")))
    winner = voted.groupBy("way_id").agg(F.min_by("bore_id", F.struct(F.negate("votes"), F.col("bore_id"))).alias("bore_id"))
    joined = voted.select("way_id", F.col("bore_id").alias("a")).join(touching(bores), "a").join(voted.select("way_id", F.col("bore_id").alias("b")), ["way_id", "b"])
    grown = connected_components(joined.select(F.struct("way_id", F.col("a").alias("bore_id")).alias("src"), F.struct("way_id", F.col("b").alias("bore_id")).alias("dst")))
    grown = grown.select(F.col("node.way_id").alias("way_id"), F.col("node.bore_id").alias("bore_id"), "component")
    of_winner = grown.join(winner, ["way_id", "bore_id"]).select("way_id", "component")
    allowed = grown.join(of_winner, ["way_id", "component"], "left_semi").select("way_id", "bore_id").union(winner.select("way_id", "bore_id")).distinct()

    # Only the allowed bores measure: they go with the ways, and other pairs are left out before they are sampled.
    lists = allowed.groupBy("way_id").agg(F.collect_list("bore_id").alias("allowed"))
    told = ways.join(lists.hint("merge"), "way_id")
    taken = meet(told, tubes, made=partial(_heights, reach=reach), schema="way_id long, metre long, n long, bore_id long, z double", pair=_allowed, left_keep={"way_id": F.col("way_id"), "n": F.ceil("total") + 1, "allowed": F.col("allowed")})
    whole = Window.partitionBy("way_id")
    counted = taken.withColumn("_c", F.count("*").over(whole))
    return counted.where((F.col("_c") >= least) & (F.col("_c") >= share * F.col("n"))).select("way_id", "metre", "bore_id", "z")
