"""Fusion of radar, stations and forecasts; the same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.text import sky_of_symbol, wet_and_thunder
from geoloom.operators.spatial import nearest_within
from geoloom.session import stored

STATION_MINUTES, RADAR_MINUTES, READING_MINUTES = 75, 30, 20


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def nearest_station(asked: DataFrame, stations: DataFrame, key: str, km: float = 30.0, minutes: int = STATION_MINUTES) -> DataFrame:
    """For each question (key, lat_e7, lon_e7, at): the nearest station report within `km` and the last `minutes`.

    Of one place's reports, the newest; ties by event id. The join is on equality in cell and hour.
    """
    slots = F.sequence(F.floor((seconds(F.col("at")) - minutes * 60) / 3600), F.floor(seconds(F.col("at")) / 3600))
    asked = asked.withColumn("_h", F.explode(slots))
    reports = stations.select("event_id", F.col("lat_e7").alias("s_lat"), F.col("lon_e7").alias("s_lon"), F.col("ts").alias("s_ts"), "wx", "temp_c", F.floor(seconds(F.col("ts")) / 3600).alias("_sh"))
    age = seconds(F.col("at")) - seconds(F.col("s_ts"))
    own = asked.select(F.col(key).alias("_k"), F.col("lat_e7").alias("_y"), F.col("lon_e7").alias("_x"), "at", "_h")
    near = nearest_within(own, reports, "_k", km * 1000, ("_y", "_x"), ("s_lat", "s_lon"), [age, "event_id"], also=(("_h", "_sh"),), good=(age >= 0) & (age <= minutes * 60) & (F.col("d") <= km * 1000))
    return near.select(F.col("_k").alias(key), F.col("event_id").alias("report"), "wx", "temp_c", "s_ts")


def fuse(rows: DataFrame) -> DataFrame:
    """Sky, temperature and provenance from columns rate, lightning, wx, has_station, s_temp, symbol, f_temp (null: none).

    Wet: radar of 0.1 mm/h or more, else the station, else the forecast. Thunder: lightning, else the station if there is
    one, else the forecast. Temperature: the station, else the forecast.
    """
    wet_wx, thunder_wx = wet_and_thunder(F.col("wx"))
    sky = sky_of_symbol(F.col("symbol"))
    wet = F.coalesce(F.when(F.col("rate").isNotNull(), F.col("rate") >= 0.1), F.when(F.col("has_station"), wet_wx), sky != "CLEAR", F.lit(False))
    thunder = F.when(F.coalesce("lightning", F.lit(False)), True).when(F.col("has_station"), thunder_wx).otherwise(F.coalesce(sky == "THUNDER", F.lit(False)))
    source = F.concat_ws("+", F.when(F.col("rate").isNotNull(), "radar"), F.when(F.col("has_station"), "station"), F.when(F.col("symbol").isNotNull(), "forecast"))
    return rows.withColumns({"sky": F.when(thunder, "THUNDER").when(wet, "RAIN").otherwise("CLEAR"), "temp": F.coalesce("s_temp", "f_temp"), "source": source})


def latest_by_cell(events: DataFrame, value: str, width: str, step_e7: int) -> DataFrame:
    """The newest value of each cell and tumbling window of event time `ts` (a timestamp)."""
    return (
        events.groupBy(F.floor(F.col("lat_e7") / step_e7).alias("cell_lat"), F.floor(F.col("lon_e7") / step_e7).alias("cell_lon"), F.window("ts", width).alias("w"))
        .agg(F.max_by(value, F.struct("ts", "event_id")).alias(value), F.count("*").alias("n"))
        .select("cell_lat", "cell_lon", F.col("w.start").alias("start"), value, "n")
    )


def reading_or_mean(asked: DataFrame, readings: DataFrame, key: str, metres: float) -> DataFrame:
    """The nearest reading within reach (the smaller reading_id of equally near ones), else the mean of all.

    Readings of one position are brought down to the one that counts before they are joined, so a position may hold any share of them.
    """
    r = readings.groupBy(F.col("lat_e7").alias("r_lat"), F.col("lon_e7").alias("r_lon")).agg(F.min("reading_id").alias("reading_id"), F.min_by("temp", "reading_id").alias("temp"))
    places = asked.select(F.col(key).alias("_k"), F.col("lat_e7").alias("_y"), F.col("lon_e7").alias("_x"))
    best = nearest_within(places, r, "_k", metres, ("_y", "_x"), ("r_lat", "r_lon"), ["reading_id"], good=F.col("d") <= metres).select(F.col("_k").alias(key), F.col("temp").alias("near"))
    mean = readings.agg(F.avg("temp").alias("mean"))
    return asked.select(key).join(best, key, "left").join(F.broadcast(mean)).select(key, F.coalesce("near", "mean").alias("temp"), F.col("near").isNotNull().alias("measured"))


def season_of_months(temps: Column, rains: Column) -> Column:
    """Season of each month from twelve normals: cold, thawing, dry, the mild winter months, summer, spring or autumn."""
    coldest = F.array_min(temps)
    ranks = F.transform(temps, lambda t: F.size(F.filter(temps, lambda u: u < t)))
    wettest = F.array_max(rains)

    def one(i: Column) -> Column:
        t, r = F.get(temps, i), F.get(rains, i)
        before, after = F.get(temps, F.pmod(i + 11, F.lit(12))), F.get(temps, F.pmod(i + 1, F.lit(12)))
        return (
            F.when(t < 0, "winter").when(t < 3, "thaw").when((t >= 10) & (r < 2 * t) & (wettest >= 60), "dry")
            .when((F.get(ranks, i) < 3) & (t < 12), "winter").when((t >= 16) | (coldest >= 16), "summer").when(after >= before, "spring").otherwise("autumn")
        )

    return F.transform(F.sequence(F.lit(0), F.lit(11)), one)


def synthetic_year(mean: Column, coldest_quarter: Column, south: Column) -> Column:
    """Twelve monthly temperatures from the mean and the coldest quarter; the swing is (mean - coldest) / 0.911."""
    swing = (mean - coldest_quarter) / 0.911
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: mean - swing * F.cos((m - F.when(south, F.lit(6)).otherwise(F.lit(0))) * 3.141592653589793 / 6))


def nearest_grid_cell(points: DataFrame, cells: DataFrame, key: str, bucket_e7: int = 100_000) -> DataFrame:
    """`(key, cell_id, value)`: the cell `(cell_id, lat_e7, lon_e7, value)` nearest to each point among the 3 x 3 buckets round it.

    Points without a cell so near get no row; ties go to the smaller cell_id. A point looks in buckets of a 32nd of the
    side first, and only where nothing lies within that side again, in four times as wide ones; so it meets few cells in a crowd.
    """
    left = stored(points.select(key, F.col("lat_e7").alias("_y"), F.col("lon_e7").alias("_x")))
    cells = stored(cells.select("cell_id", "lat_e7", "lon_e7", "value"))
    shrunk = F.cos(F.radians(F.col("_y") / 1e7))
    dy, dx = F.col("lat_e7") - F.col("_y"), (F.col("lon_e7") - F.col("_x")) * shrunk
    found = None
    for parts in (32, 8, 2, 1):
        side = bucket_e7 / parts
        own = left.withColumns({"_by": F.floor(F.col("_y") / side), "_bx": F.floor(F.col("_x") / side)})
        for axis in ("_by", "_bx"):
            own = own.withColumn(axis, F.explode(F.sequence(F.col(axis) - 1, F.col(axis) + 1)))
        filed = cells.withColumns({"_by": F.floor(F.col("lat_e7") / side), "_bx": F.floor(F.col("lon_e7") / side)})
        met = filed.join(own.hint("merge"), ["_by", "_bx"]).groupBy(key, "_y").agg(F.min(F.struct(F.round(dy * dy + dx * dx, 2).alias("d2"), "cell_id", "value")).alias("best"))
        if parts > 1:  # what lies nearer than a bucket's narrow side is the nearest of all
            met = stored(met.where(F.sqrt("best.d2") < side * shrunk - 1))
            left = stored(left.join(met.select(key).hint("merge"), key, "left_anti").select(*left.columns))
        found = met if found is None else found.union(met)
    return found.select(key, "best.cell_id", "best.value")
