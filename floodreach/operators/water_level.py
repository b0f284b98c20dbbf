"""Water levels from flood edges, filled in between observations, and the bathtub estimate."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.classify import bathtub_class
from ..params import Params
from .common import exact_median
from .focal import flood_edge
from .raster import merge_by_date


def edge_levels(cells: DataFrame, dem: DataFrame, min_edge: int = 100, p: Params = Params()) -> DataFrame:
    """Median ground height along the flood edge of each observed date with enough edge cells."""
    edge = flood_edge(merge_by_date(cells, ["sentinel1", "unosat"], p), p=p)
    heights = edge.join(dem.select("row", "col", "elevation"), ["row", "col"], "left")
    n = heights.groupBy("date").agg(F.count(F.lit(1)).alias("edge_px"))
    med = exact_median(heights.filter(F.col("elevation").isNotNull()), ["date"], "elevation", 1.0)
    return (n.filter(F.col("edge_px") >= min_edge).join(med, "date")
            .select("date", F.col("median").alias("water_level_m"), "edge_px"))


def daily_levels(levels: DataFrame) -> DataFrame:
    """Every day between the first and last level, linear in time. ``observed`` marks measured days.

    The table has one row per observed date, so the single ordered window is bounded by construction."""
    w = W.partitionBy(F.lit(0)).orderBy("date")
    nxt = (levels.withColumn("_d", F.lead("date").over(w)).withColumn("_l", F.lead("water_level_m").over(w))
           .withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))))
    guarded = nxt.withColumn("_n", F.when(F.col("_n") < 2, F.raise_error(F.lit("need at least two observed dates to interpolate")))
                             .otherwise(F.col("_n"))).filter(F.col("_n") >= 2)
    days = F.sequence(F.col("date"), F.coalesce(F.date_sub("_d", 1), F.col("date")))
    out = guarded.withColumn("day", F.explode(days))
    frac = F.datediff("day", "date") / F.datediff("_d", "date")
    level = F.col("water_level_m") + F.coalesce((F.col("_l") - F.col("water_level_m")) * frac, F.lit(0.0))
    return out.select(F.col("day").alias("date"), level.alias("level_m"), (F.col("day") == F.col("date")).alias("observed"))


def bathtub(dem: DataFrame, levels: DataFrame) -> DataFrame:
    """Estimated cells of every unobserved day. One pass over the DEM; the short list of levels rides along."""
    fill = levels.filter(~F.col("observed"))
    days = fill.agg(F.collect_list(F.struct("date", "level_m")).alias("v")).scalar()
    out = dem.withColumn("_l", F.explode(days))
    return out.select(F.col("_l.date").alias("date"), F.lit("dem_estimate").alias("source"), "row", "col",
                      bathtub_class(F.col("elevation"), F.col("_l.level_m")).alias("value"))
