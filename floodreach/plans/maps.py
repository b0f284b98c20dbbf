"""From observations to flood cells: radar scenes, optical composites, and fields between two observations filled from elevation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import ndwi, optical_class, radar_class
from ..functions.rounding import half_even
from ..operators import focal, otsu, raster, water_level
from ..params import UNKNOWN, Grid, Params
from ..session import materialize


def optical_maps(pixels: DataFrame, baseline_end: str, source: str = "modis", p: Params = Params()) -> DataFrame:
    """date, source, row, col, value from pixels (date, t, row, col, green, nir, qa): water now that was none before ``baseline_end``.

    Both sides are medians of clear observations; a cell without either is UNKNOWN."""
    late = F.col("t") >= F.lit(baseline_end).cast("timestamp")
    now = raster.clear_composite(pixels.filter(late), ["date"]).select("date", "row", "col", ndwi(F.col("green"), F.col("nir")).alias("now"))
    old = raster.clear_composite(pixels.filter(~late), []).select("row", "col", ndwi(F.col("green"), F.col("nir")).alias("old"))
    return now.join(old, ["row", "col"], "left").select("date", F.lit(source).alias("source"), "row", "col", optical_class(F.col("now"), F.col("old"), p).alias("value"))


def gap_fill(cells: DataFrame, dem: DataFrame, min_edge: int = 20, p: Params = Params()) -> DataFrame:
    """date, source, row, col, value for the days between observed ones: water levels read off the flood's edge, interpolated by
    day, and laid over the elevation."""
    return water_level.bathtub(dem, water_level.daily_levels(water_level.edge_levels(cells, dem, min_edge=min_edge, p=p)))


def radar_maps(pixels: DataFrame, dry_pixels: DataFrame, dem: DataFrame, grid: Grid, dry_start: str, dry_end: str, radius_m: float = 30.0, source: str = "sentinel1",
               p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Radar scenes to flood maps: cells (date, source, row, col, value) and one note a date, as ``register_flood_maps`` takes them.

    ``pixels`` (date, t, scene_id, relative_orbit, row, col, vv_db) are those of the flood; of a day's scenes the latest that knows a cell counts. The
    dry reference is the median of ``dry_pixels`` (t, relative_orbit, row, col, vv_db) in ``[dry_start, dry_end)`` on the orbit of the day's first scene, of all
    orbits where that one has none. Both are freed of speckle by a circular median. Water is darker than the day's Otsu threshold (or its
    fallback) and than the reference, on ground that is not steep; a cell without backscatter, reference or slope is UNKNOWN. A date of no known pixel has its note and no cells.

    Scale: the mosaic is a hash aggregate per cell and meets its halo in one shuffle by tile. Reference and slope do not depend on the date: they are
    brought together once per cell, with one entry an orbit, so dates join one static table by cell whatever their number. Thresholds and orbits are one row a date."""
    first = F.struct("t", "scene_id")
    orbits = materialize(pixels.groupBy("date").agg(F.min_by("relative_orbit", first).alias("relative_orbit")), "orbits")
    known = pixels.filter(F.col("vv_db").isNotNull()).groupBy("date", "row", "col").agg(F.max(F.struct("t", "scene_id", "vv_db"))["vv_db"].alias("vv_db"))
    flood = materialize(focal.focal_median(known, grid, radius_m, "vv_db", ("date",), p), "flood")
    dry = raster.dry_reference(dry_pixels.filter(F.col("vv_db").isNotNull()), orbits.select("relative_orbit").distinct(), dry_start, dry_end)
    dry = focal.focal_median(dry, grid, radius_m, "dry_db", ("relative_orbit",), p)
    none = lambda kind: F.lit(None).cast(kind)
    static = dry.select("row", "col", F.struct("relative_orbit", "dry_db").alias("dry"), none("double").alias("slope_deg")).unionByName(
        focal.slope(dem, grid, (), p).select("row", "col", none("struct<relative_orbit:int,dry_db:double>").alias("dry"), "slope_deg"))
    static = static.groupBy("row", "col").agg(F.map_from_entries(F.collect_list("dry")).alias("dry"), F.max("slope_deg").alias("slope_deg"))
    days = orbits.join(otsu.radar_threshold(flood, p), "date", "left").withColumn("threshold_db", F.coalesce("threshold_db", F.lit(p.fallback_db)))
    days = materialize(days, "days")
    at = flood.join(days, "date").join(static, ["row", "col"], "left")
    value = radar_class(F.col("vv_db"), F.try_element_at("dry", F.col("relative_orbit")), F.col("slope_deg"), F.col("threshold_db"), p)
    cells = at.select("date", F.lit(source).alias("source"), "row", "col", value.cast("int").alias("value")).filter(F.col("value") != UNKNOWN)
    note = F.format_string("otsu=%.2fdB orbit=%d", half_even(F.col("threshold_db"), 2), F.col("relative_orbit"))
    return cells, days.select("date", F.lit(source).alias("source"), note.alias("note"))
