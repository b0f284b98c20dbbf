"""Neighbourhood operators.

Cells are shuffled once by tile, together with a thin halo copied from the adjacent tiles. Offsets are then
exploded inside the tile and grouped on keys that extend the partitioning, so the fan-out of a neighbourhood
stays within a task and never crosses the network."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..params import DRY, FLOODED, UNKNOWN, Grid, Params

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def circle(radius_px: float) -> list[tuple[int, int]]:
    r = int(radius_px)
    return [(dr, dc) for dr in range(-r, r + 1) for dc in range(-r, r + 1) if dr * dr + dc * dc <= radius_px ** 2]


def with_halo(cells: DataFrame, radius: int, tile: int, keys: list[str]) -> DataFrame:
    """Assign each cell to its tile and to every tile within ``radius`` cells of it."""
    if radius > tile:
        raise ValueError("tile must be at least as large as the neighbourhood radius")

    def tiles(axis):
        return F.array_distinct(F.array(*[F.floor((F.col(axis) + d) / F.lit(tile)).cast("int") for d in (0, -radius, radius)]))

    return (cells.withColumn("_tr", F.explode(tiles("row"))).withColumn("_tc", F.explode(tiles("col")))
            .repartition(*keys, "_tr", "_tc"))


def _spread(cells: DataFrame, offsets, tile: int, keys: list[str], keep) -> DataFrame:
    """Every cell reported to the cells it is a neighbour of, inside one tile: dr, dc point back at the sender."""
    radius = max(max(abs(a), abs(b)) for a, b in offsets)
    arr = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    out = (with_halo(cells, radius, tile, keys).withColumn("_o", F.explode(arr))
           .select(*keys, "_tr", "_tc", (F.col("row") - F.col("_o.dr")).alias("row"), (F.col("col") - F.col("_o.dc")).alias("col"),
                   F.col("_o.dr").alias("dr"), F.col("_o.dc").alias("dc"), *keep))
    return out.filter((F.floor(F.col("row") / F.lit(tile)) == F.col("_tr")) & (F.floor(F.col("col") / F.lit(tile)) == F.col("_tc")))


def focal_median(cells: DataFrame, grid: Grid, radius_m: float = 30.0, value: str = "value", keys=("date",),
                 p: Params = Params()) -> DataFrame:
    """Circular median over known neighbours; cells that are themselves unknown stay unknown."""
    keys = list(keys)
    offsets = circle(radius_m / grid.res)
    g = _spread(cells, offsets, p.tile_px, keys, [value]).groupBy(*keys, "_tr", "_tc", "row", "col")
    own = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), 1))
    return (g.agg(F.median(value).alias(value), own.alias("_own")).filter(F.col("_own") == 1)
            .select(*keys, "row", "col", value))


def flood_edge(cells: DataFrame, keys=("date",), p: Params = Params()) -> DataFrame:
    """Flooded cells with at least one dry 4-neighbour."""
    keys = list(keys)
    known = cells.filter(F.col("value").isin(DRY, FLOODED))
    near = _spread(known, [(0, 0)] + FOUR, p.tile_px, keys, ["value"])
    self_cell = (F.col("dr") == 0) & (F.col("dc") == 0)
    near = near.filter((self_cell & (F.col("value") == FLOODED)) | (~self_cell & (F.col("value") == DRY)))
    g = near.groupBy(*keys, "_tr", "_tc", "row", "col").agg(F.max(self_cell.cast("int")).alias("wet"), F.min(self_cell.cast("int")).alias("alone"))
    return g.filter((F.col("wet") == 1) & (F.col("alone") == 0)).select(*keys, "row", "col")


def slope(dem: DataFrame, grid: Grid, keys=(), p: Params = Params()) -> DataFrame:
    """Slope in degrees from the four direct neighbours; cells missing one of them are left out."""
    keys = list(keys)
    near = _spread(dem, FOUR, p.tile_px, keys, ["elevation"])

    def at(a, b):
        return F.max(F.when((F.col("dr") == a) & (F.col("dc") == b), F.col("elevation")))

    g = near.groupBy(*keys, "_tr", "_tc", "row", "col").agg(
        ((at(0, 1) - at(0, -1)) / F.lit(2 * grid.res)).alias("gx"), ((at(-1, 0) - at(1, 0)) / F.lit(2 * grid.res)).alias("gy"))
    deg = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    g = g.withColumn("slope_deg", deg).filter(F.col("slope_deg").isNotNull())
    return g.join(dem.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi").select(*keys, "row", "col", "slope_deg")


def chunk_bounds(spark, grid: Grid, tile_width: int = 800, tile_height: int = 800) -> DataFrame:
    """Contiguous, non-overlapping tiles covering the grid: x0, y0, x1, y1, width, height."""
    if tile_width < 1 or tile_height < 1:
        raise ValueError("tile dimensions must be positive")
    nx, ny = -(-grid.width // tile_width), -(-grid.height // tile_height)
    t = spark.range(nx * ny).select(((F.col("id") % nx) * tile_width).cast("int").alias("x0"),
                                    (F.floor(F.col("id") / nx) * tile_height).cast("int").alias("y0"))
    t = (t.withColumn("x1", F.least(F.col("x0") + tile_width, F.lit(grid.width)))
         .withColumn("y1", F.least(F.col("y0") + tile_height, F.lit(grid.height))))
    return t.withColumn("width", F.col("x1") - F.col("x0")).withColumn("height", F.col("y1") - F.col("y0"))


def overview(merged: DataFrame, grid: Grid, max_px: int = 2000) -> DataFrame:
    """Majority class per coarse cell so that the longer side is at most ``max_px`` and the shorter at least 1; UNKNOWN votes too.

    Unknown votes follow from the geometry, so the unstored cells never have to be produced. Ties go to the
    smaller class code."""
    scale = max(1.0, max(grid.width, grid.height) / max_px)
    w, h = max(1, int(grid.width / scale)), max(1, int(grid.height / scale))

    def span(i, n_out, n_in):
        return F.ceil((i + 1) * F.lit(n_in) / F.lit(n_out)) - F.ceil(i * F.lit(n_in) / F.lit(n_out))

    g = (merged.groupBy("date", F.floor(F.col("row") * F.lit(h) / F.lit(grid.height)).cast("int").alias("orow"),
                        F.floor(F.col("col") * F.lit(w) / F.lit(grid.width)).cast("int").alias("ocol"))
         .agg(F.count_if(F.col("value") == DRY).alias("d"), F.count_if(F.col("value") == FLOODED).alias("f")))
    u = span(F.col("orow"), h, grid.height) * span(F.col("ocol"), w, grid.width) - F.col("d") - F.col("f")
    best = F.greatest(F.col("d"), F.col("f"), u)
    return g.select("date", "orow", "ocol", F.when(F.col("d") == best, DRY).when(F.col("f") == best, FLOODED)
                    .otherwise(UNKNOWN).alias("value"))
