"""Cell and road classes as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..params import DRY, FLOODED, UNKNOWN, Grid, Params


def cell_col(x, grid: Grid) -> Column:
    return F.floor((x - F.lit(grid.xmin)) / F.lit(grid.res)).cast("int")


def cell_row(y, grid: Grid) -> Column:
    return F.floor((F.lit(grid.ymax) - y) / F.lit(grid.res)).cast("int")


def inside_grid(row, col, grid: Grid) -> Column:
    return (row >= 0) & (row < grid.height) & (col >= 0) & (col < grid.width)


def cell_x(col, grid: Grid) -> Column:
    return F.lit(grid.xmin) + (col + F.lit(0.5)) * F.lit(grid.res)


def cell_y(row, grid: Grid) -> Column:
    return F.lit(grid.ymax) - (row + F.lit(0.5)) * F.lit(grid.res)


def product_class(code) -> Column:
    """Water-product codes: 0 and 1 are dry, 2 and 3 flooded, anything else unknown."""
    return F.when(code.isin(0, 1), DRY).when(code.isin(2, 3), FLOODED).otherwise(UNKNOWN)


def road_state(frac_flooded, frac_unknown, threshold, majority) -> Column:
    """Cut is decided before unknown: what is visible may already be over the threshold."""
    return (F.when(frac_flooded > threshold, "cut").when(frac_unknown > majority, "unknown").otherwise("open"))


def radar_class(vv, dry, slope, threshold, p: Params = Params()) -> Column:
    masked = vv.isNull() | dry.isNull() | slope.isNull()
    water = (vv < threshold) & (vv - dry < F.lit(p.diff_db)) & (slope <= F.lit(p.slope_max_deg))
    return F.when(masked, UNKNOWN).when(water, FLOODED).otherwise(DRY)


def clear_sky(qa) -> Column:
    """Bits 0-1 (cloud state) and bit 2 (cloud shadow) must all be zero."""
    return (qa.bitwiseAND(F.lit(3)) == 0) & (qa.bitwiseAND(F.lit(4)) == 0)


def ndwi(green, nir) -> Column:
    return F.try_divide(green - nir, green + nir)


def optical_class(now, baseline, p: Params = Params()) -> Column:
    """Newly wet relative to the baseline; a null index on either side is unknown."""
    fresh = (now > F.lit(p.ndwi_min)) & (baseline <= F.lit(p.ndwi_min))
    return F.when(now.isNull() | baseline.isNull(), UNKNOWN).when(fresh, FLOODED).otherwise(DRY)


def bathtub_class(dem, level) -> Column:
    return F.when(dem.isNull() | F.isnan(dem) | level.isNull(), UNKNOWN).when(dem <= level, FLOODED).otherwise(DRY)


def area_class(analysed, water) -> Column:
    """Water polygons win over the analysed area; outside both nothing is known."""
    return F.when(water, FLOODED).when(analysed, DRY).otherwise(UNKNOWN)


def clean_population(pop) -> Column:
    bad = pop.isNull() | F.isnan(pop) | (pop < 0) | (pop == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(pop)


def scene_ok(mode, polarisations, band_time, start, end) -> Column:
    """Interferometric-wide scenes that carry VV within the half-open time range."""
    return ((mode == "IW") & F.array_contains(polarisations, "VV")
            & (band_time >= F.lit(start).cast("timestamp")) & (band_time < F.lit(end).cast("timestamp")))
