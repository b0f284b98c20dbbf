"""Operators on cell tables ``(date, source, row, col, value)``; only known cells are stored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import clear_sky, product_class
from ..functions.rounding import half_even
from ..params import DRY, FLOODED, UNKNOWN, Grid, Params


def source_rank(source, p: Params = Params()) -> Column:
    rank = F.lit(None).cast("int")
    for i, name in enumerate(p.source_priority):
        rank = F.when(source == name, i).otherwise(rank)
    return rank


def merge_by_date(cells: DataFrame, sources: list[str] | None = None, p: Params = Params()) -> DataFrame:
    """One value per (date, row, col): the best-ranked source that knows the cell.

    Rank and class are packed in one integer, so the merge is a plain hash ``min`` that combines copies
    before the shuffle and whose keys are cells, never sources or dates. A source without a rank is an error."""
    known = cells.filter(F.col("value") != UNKNOWN)
    if sources:
        known = known.filter(F.col("source").isin(list(sources)))
    rank = F.coalesce(source_rank(F.col("source"), p), F.raise_error(F.concat(F.lit("no priority for source "), F.coalesce("source", F.lit("null")))).cast("int"))
    packed = known.groupBy("date", "row", "col").agg(F.min(rank * 256 + F.col("value")).alias("code"))
    return packed.select("date", "row", "col", (F.col("code") % 256).cast("int").alias("value"),
                         F.floor(F.col("code") / 256).cast("int").alias("source_rank"))


def coverage(merged: DataFrame, grid: Grid, dates: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """Per date: sources that filled at least one cell, and class shares of the whole grid.

    ``dates`` lists registered dates, so that a date without a single known cell still gets its row."""
    part = merged.select("date", (F.col("value") == FLOODED).cast("bigint").alias("f"),
                         (F.col("value") == DRY).cast("bigint").alias("d"),
                         F.expr("shiftleft(1, source_rank)").alias("bit"))
    if dates is not None:
        zero = F.lit(0)
        part = part.unionByName(dates.select("date").distinct().select(
            "date", zero.cast("bigint").alias("f"), zero.cast("bigint").alias("d"), zero.alias("bit")))
    g = part.groupBy("date").agg(F.sum("f").alias("f"), F.sum("d").alias("d"), F.bit_or("bit").alias("bits"))
    names = F.concat_ws("+", *[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, s)
                               for i, s in enumerate(p.source_priority)])

    def pct(n):
        return half_even(F.lit(100.0) * n / F.lit(float(grid.size)), 2)

    return g.select("date", names.alias("sources"), pct(F.col("f")).alias("flooded_pct"), pct(F.col("d")).alias("dry_pct"),
                    pct(F.lit(grid.size) - F.col("f") - F.col("d")).alias("unknown_pct"))


def go_no_go(summary: DataFrame, min_dates: int = 4, max_unknown: float = 50.0) -> DataFrame:
    """Do the usable dates cover the rise, the peak and the fall of the flood?"""
    good = summary.filter(F.col("unknown_pct") < max_unknown)
    agg = good.agg(F.count(F.lit(1)).alias("usable_dates"),
                   F.max_by("date", F.struct("flooded_pct", -F.datediff("date", F.lit("1970-01-01").cast("date")))).alias("peak"),
                   F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    rise, fall = F.coalesce(F.col("_lo") < F.col("peak"), F.lit(False)), F.coalesce(F.col("_hi") > F.col("peak"), F.lit(False))
    return agg.select("usable_dates", "peak", rise.alias("before_peak"), fall.alias("after_peak"),
                      ((F.col("usable_dates") >= min_dates) & rise & fall).alias("go"))


def observed_dates(registered: DataFrame) -> DataFrame:
    """Dates of all registered maps, also of those without a single known cell."""
    return registered.select("date").distinct().orderBy("date")


def agreement(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two sources on each date that both registered, over the cells both know; without any, 0 cells and nulls.

    Both classes of a cell meet in one aggregation rather than in a self join."""
    def of(name):
        return F.max(F.when((F.col("source") == name) & (F.col("value") != UNKNOWN), F.col("value")))

    def has(name):
        return F.bool_or(F.col("source") == name)

    both = (cells.filter(F.col("source").isin(a, b)).groupBy("date", "row", "col")
            .agg(of(a).alias("a"), of(b).alias("b"), has(a).alias("has_a"), has(b).alias("has_b")))
    fa, fb, met = F.col("a") == FLOODED, F.col("b") == FLOODED, F.col("a").isNotNull() & F.col("b").isNotNull()
    n = both.groupBy("date").agg(F.count_if(met).alias("overlap_px"), F.count_if(met & (fa == fb)).alias("same"),
                                 F.count_if(met & fa & fb).alias("inter"), F.count_if(met & (fa | fb)).alias("uni"),
                                 F.bool_or("has_a").alias("has_a"), F.bool_or("has_b").alias("has_b"))
    return n.filter("has_a and has_b").select("date", "overlap_px",
                    half_even(F.try_divide(F.lit(100.0) * F.col("same"), F.col("overlap_px")), 1).alias("same_class_pct"),
                    half_even(F.try_divide(F.col("inter").cast("double"), F.col("uni")), 3).alias("flood_iou"))


def mosaic_granules(granules: DataFrame, code: str = "code", order: str = "file_order") -> DataFrame:
    """Recode product codes and let the later granule win wherever it knows the cell."""
    cls = granules.withColumn("_v", product_class(F.col(code))).filter(F.col("_v") != UNKNOWN)
    packed = cls.groupBy("date", "row", "col").agg(F.max(F.col(order).cast("bigint") * 256 + F.col("_v")).alias("_m"))
    return packed.select("date", "row", "col", (F.col("_m") % 256).cast("int").alias("value"))


def scenes_per_date(scenes: DataFrame) -> DataFrame:
    """Relative orbit and pass of the first scene of each day, and the number of scenes."""
    first = F.struct("t", "scene_id")
    return (scenes.groupBy(F.to_date("t").alias("date"))
            .agg(F.min_by("relative_orbit", first).alias("relative_orbit"), F.min_by("pass", first).alias("passes"),
                 F.count(F.lit(1)).alias("scenes")))


def dry_reference(pixels: DataFrame, orbits: DataFrame, start: str, end: str) -> DataFrame:
    """Median dry-season backscatter per (relative_orbit, row, col) over ``[start, end)``.

    An orbit with no dry-season scene at all falls back to the median over every orbit. Each pixel feeds its
    own orbit's group, plus the shared fallback group only when some orbit needs it."""
    dry = pixels.filter((F.col("t") >= F.lit(start).cast("timestamp")) & (F.col("t") < F.lit(end).cast("timestamp")))
    wanted = orbits.agg(F.collect_set("relative_orbit").alias("v")).scalar()
    have = dry.agg(F.collect_set("relative_orbit").alias("v")).scalar()
    missing = F.array_except(wanted, have)
    own = F.when(F.array_contains(wanted, F.col("relative_orbit")), F.array("relative_orbit")).otherwise(F.array().cast("array<int>"))
    tagged = dry.withColumn("_orbits", F.concat(own, F.when(F.size(missing) > 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))))
    med = (tagged.select(F.explode("_orbits").alias("_o"), "row", "col", "vv_db")
           .groupBy("_o", "row", "col").agg(F.median("vv_db").alias("dry_db")))
    return med.select(F.explode(F.when(F.col("_o") >= 0, F.array("_o")).otherwise(missing)).alias("relative_orbit"),
                      "row", "col", "dry_db")


def clear_composite(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per-cell median of both reflectance bands over clear observations."""
    return (pixels.filter(clear_sky(F.col("qa"))).groupBy(*keys, "row", "col")
            .agg(F.median("green").alias("green"), F.median("nir").alias("nir")))


def daily_area(cells: DataFrame, area_cells: DataFrame, grid: Grid, dates: DataFrame | None = None) -> DataFrame:
    """Flooded km2 and unknown share inside an area given as cells ``(row, col)``, for every date of ``dates`` (else of ``cells``)."""
    area = area_cells.select("row", "col").distinct()
    total = area.agg(F.count(F.lit(1)).alias("n")).scalar()
    inside = cells.filter(F.col("value") != UNKNOWN).join(area, ["row", "col"], "left_semi")
    days = (cells if dates is None else dates).select("date").distinct()
    part = inside.select("date", (F.col("value") == FLOODED).cast("int").alias("f"), F.lit(1).alias("k"))
    g = part.unionByName(days.select("date", F.lit(0).alias("f"), F.lit(0).alias("k"))).groupBy("date").agg(F.sum("f").alias("f"), F.sum("k").alias("k"))
    return g.select("date", half_even(F.col("f") * F.lit(grid.res ** 2 / 1e6), 1).alias("flooded_km2"),
                    half_even(F.lit(100.0) * (total - F.col("k")) / total, 1).alias("unknown_pct"))


def shape_mismatch(manifest: DataFrame) -> DataFrame:
    """Registered sizes ``(width, height)`` with their number of maps where they differ; empty if all maps share one size.

    Sizes are those recorded for the maps: stored cells cannot tell, for unknown borders are not stored."""
    shapes = manifest.groupBy("width", "height").agg(F.count(F.lit(1)).alias("maps"))
    n = shapes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return shapes.filter(n > 1)
