"""Daily rainfall per box, and the reshaping around it; the flooded area beside it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rounding import half_even
from ..params import FLOODED, UNKNOWN, Grid, Params


def box_rain(rain: DataFrame, boxes: DataFrame) -> DataFrame:
    """Half-hourly rates of named boxes ``(ts, box, cell, mm_per_h)`` from gridded ones ``(ts, lon, lat, mm_per_h)``.

    A grid cell belongs to every box (box, west, south, east, north) that holds its centre, west and south borders included.
    Boxes are the few areas of a run: they travel as one array that each row filters."""
    areas = boxes.agg(F.collect_list(F.struct("box", "west", "south", "east", "north"))).scalar()
    inside = F.filter("_boxes", lambda b: (F.col("lon") >= b["west"]) & (F.col("lon") < b["east"]) & (F.col("lat") >= b["south"]) & (F.col("lat") < b["north"]))
    hit = rain.withColumn("_boxes", areas).withColumn("box", F.explode(F.transform(inside, lambda b: b["box"])))
    return hit.select("ts", "box", F.concat_ws("/", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("cell"), "mm_per_h")


def daily_rain(rain: DataFrame, step_hours: float = 0.5, p: Params = Params()) -> DataFrame:
    """Box-average mm per local day from half-hourly rates ``(ts, box, cell, mm_per_h)``.

    Totals are taken per cell first, so a box with gaps in some cells is averaged over cells, not rows. They are
    kept as whole nanometres, which makes the result independent of the order of summation."""
    start = f"{(24 - p.utc_offset_hours) % 24} hours"
    cell = (rain.groupBy(F.window("ts", "1 day", "1 day", start).alias("w"), "box", "cell")
            .agg(F.rint(F.sum("mm_per_h") * F.lit(step_hours * 1e6)).cast("bigint").alias("nm")))
    day = F.to_date(F.col("w.start") + F.expr(f"interval {p.utc_offset_hours} hours"))
    return cell.groupBy(day.alias("date"), "box").agg(half_even(F.sum("nm") / (F.count(F.lit(1)) * F.lit(1e6)), 1).alias("mm"))


def rain_wide(daily: DataFrame, boxes: list[str]) -> DataFrame:
    return (daily.groupBy("date").pivot("box", boxes).agg(F.first("mm"))
            .select("date", *[F.col(b).alias(f"{b}_mm") for b in boxes]))


def rain_long(wide: DataFrame, start, end) -> DataFrame:
    """Rows of the date window, one per box."""
    values = [c for c in wide.columns if c != "date"]
    return wide.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).unpivot("date", values, "box", "mm")


def flooded_area_series(merged: DataFrame, observed: DataFrame, grid: Grid, start=None, end=None) -> DataFrame:
    """(date, flooded_km2, unknown_pct) of the observation dates between ``start`` and ``end``, both included and both optional.

    ``observed`` has every registered date, so one of which no cell is known shows no flood and all unknown. The window is on the
    partition column and prunes both scans; cells are counted map-side."""
    day = F.col("date")
    inside = F.lit(True)
    for bound, test in ((start, lambda b: day >= b), (end, lambda b: day <= b)):
        if bound is not None:
            inside = inside & test(F.lit(bound).cast("date"))
    known = merged.filter(inside).groupBy("date").agg(F.count_if(F.col("value") == FLOODED).alias("_f"), F.count_if(F.col("value") != UNKNOWN).alias("_n"))
    all_dates = observed.filter(inside).select("date").distinct().join(known, "date", "left").na.fill(0, ["_f", "_n"])
    unknown = F.lit(100.0) * (F.lit(grid.size) - F.col("_n")) / F.lit(grid.size)
    return all_dates.select("date", F.round(F.col("_f") * F.lit(grid.res * grid.res / 1e6), 6).alias("flooded_km2"), half_even(unknown, 2).alias("unknown_pct"))
