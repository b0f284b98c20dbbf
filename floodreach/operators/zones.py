"""Nearest-village zones and what they sum up."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import cell_x, cell_y, clean_population
from ..params import Grid, Params
from ..session import materialize
from .nearest import nearest


def zone_cells(cells: DataFrame, villages: DataFrame, grid: Grid, p: Params = Params(), bucket: float = 2000.0) -> DataFrame:
    """Owner of each cell ``(row, col)``: the village nearest to its centre, which is the Voronoi owner there."""
    # row and col pack into one long id that the nearest-site join carries instead of a composite key
    pts = cells.select((F.col("row").cast("bigint") * grid.width + F.col("col")).alias("cell_id"),
                       cell_x(F.col("col"), grid).alias("x"), cell_y(F.col("row"), grid).alias("y"))
    own = nearest(pts, villages, "cell_id", "village_id", "village_id", "d", p=p, bucket=bucket)
    return own.select(F.floor(F.col("cell_id") / grid.width).cast("int").alias("row"), F.pmod("cell_id", F.lit(grid.width)).cast("int").alias("col"), "village_id")


def zonal_population(raster: DataFrame, area_cells: DataFrame, villages: DataFrame, grid: Grid, p: Params = Params()) -> DataFrame:
    """Population of each village: raster sum over its zone inside the area, rounded; 0 without any cell.

    Raster and area meet in one aggregate, so cells that the area names often are combined before they travel."""
    people = raster.select("row", "col", clean_population(F.col("pop")).alias("pop"), F.lit(False).alias("inside")).filter(F.col("pop") > 0)
    area = area_cells.select("row", "col", F.lit(None).cast("double").alias("pop"), F.lit(True).alias("inside"))
    pop = materialize(people.unionByName(area).groupBy("row", "col").agg(F.sum("pop").alias("pop"), F.max("inside").alias("inside"))
                      .filter(F.col("inside") & F.col("pop").isNotNull()).drop("inside"), "population")
    own = zone_cells(pop.select("row", "col"), villages, grid, p)
    sums = own.join(pop, ["row", "col"]).groupBy("village_id").agg(F.sum("pop").alias("s"))
    return villages.select("village_id").join(sums, "village_id", "left").select("village_id", F.rint(F.coalesce("s", F.lit(0.0))).cast("bigint").alias("population"))
