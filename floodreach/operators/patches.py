"""Training patches: three previous flood maps, rain, elevation, and the next map as target."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..params import UNKNOWN, Grid
from .common import distinct_values

_SPAN = 128  # cells


def history(merged: DataFrame, steps: int = 3, dates: DataFrame | None = None) -> DataFrame:
    """Per target date and cell: the ``steps`` previous observations and the target itself.

    A cell's whole record is one short array indexed by observation, so unknown dates need no stored rows:
    date, row, col, h0..h2 (oldest first), target. ``dates`` lists the registered dates, which may know no cell at all.
    Cells never known on any date are left to patch filling."""
    dates = distinct_values(merged if dates is None else dates, "date")
    rec = merged.groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("date", "value"))).alias("_m")).withColumn("_d", dates)
    rec = rec.withColumn("_v", F.transform("_d", lambda d: F.coalesce(F.try_element_at(F.col("_m"), d), F.lit(UNKNOWN))))
    idx = F.when(F.size("_d") > steps, F.sequence(F.lit(steps), F.size("_d") - 1)).otherwise(F.array().cast("array<int>"))
    out = rec.select("row", "col", "_d", "_v", F.explode(idx).alias("i"))
    past = [F.get("_v", F.col("i") - steps + j).alias(f"h{j}") for j in range(steps)]
    return out.select(F.get("_d", F.col("i")).alias("date"), "row", "col", *past, F.get("_v", F.col("i")).alias("target"))


def require_dem(flood_dates: DataFrame, dem_dates: DataFrame) -> DataFrame:
    """Flood dates, failing with the list of those that lack an elevation raster."""
    d = flood_dates.select("date").distinct()
    miss = d.join(dem_dates.select("date").distinct(), "date", "left_anti").agg(F.array_join(F.sort_array(F.collect_list(F.col("date").cast("string"))), ", ").alias("m")).scalar()
    return d.withColumn("_m", miss).select(F.when(F.col("_m") != "", F.raise_error(F.concat(F.lit("Real DEM raster(s) are required; missing dates: "), "_m"))).otherwise(F.col("date")).alias("date"))


def with_context(hist: DataFrame, rain: DataFrame, dem: DataFrame) -> DataFrame:
    """Attach the day's rain (date, mm) and the elevation (row, col, elevation); null where there is none."""
    return hist.join(rain.select("date", F.col("mm").alias("rain")), "date", "left").join(dem.select("row", "col", "elevation"), ["row", "col"], "left")


def patch_starts(length: int, size: int) -> list[int]:
    """Half-overlapping starts; the ones that would stick out are moved back, and duplicates dropped."""
    if length < size:
        raise ValueError("grid is smaller than a patch")
    return sorted({min(s, length - size) for s in range(0, length, size // 2)})


def patches(samples: DataFrame, grid: Grid, size: int, channels: list[str], target: str = "target", fill: float = 0.0) -> DataFrame:
    """Complete square patches, one row-major array per channel.

    A cell names the few patches that contain it; a group holds the patches that start in one square of ``_SPAN`` cells (or of one patch, if
    that is larger), four rows a cell of it at most, whatever the data. Cells that are not stored are filled: history and target with UNKNOWN, other channels with ``fill``."""
    patch_starts(min(grid.width, grid.height), size)
    half, last = size // 2, {"row": grid.height - size, "col": grid.width - size}

    def holders(axis):
        first = F.floor(F.col(axis) / half) - 2
        starts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.least((first + i) * half, F.lit(last[axis])).cast("int"))
        return F.array_distinct(F.filter(starts, lambda s: (s >= 0) & (F.col(axis) >= s) & (F.col(axis) < s + size)))

    c = (samples.withColumn("prow", F.explode(holders("row"))).withColumn("pcol", F.explode(holders("col")))
         .select("date", "prow", "pcol", ((F.col("row") - F.col("prow")) * size + F.col("col") - F.col("pcol")).alias("pos"),
                 *[F.col(n).cast("float").alias(n) for n in channels], F.col(target).cast("int").alias(target)))

    # a group is a square of patches, as one call for each patch costs more than its cells
    span = max(size, _SPAN)
    c = c.withColumn("_brow", F.floor(F.col("prow") / span)).withColumn("_bcol", F.floor(F.col("pcol") / span))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        which, at = np.unique(pdf["prow"].to_numpy(np.int64) << 32 | pdf["pcol"].to_numpy(np.int64), return_inverse=True)
        prow, pcol = which >> 32, which & 0xFFFFFFFF
        out, pos = {"sample_id": [f"{key[0]:%Y%m%d}_{r}_{k}" for r, k in zip(prow, pcol)], "date": key[0], "prow": prow, "pcol": pcol}, pdf["pos"].to_numpy()
        for n in [*channels, target]:
            default = UNKNOWN if n == target or n.startswith("h") else fill
            plane = np.full((len(which), size * size), default, "int32" if n == target else "float32")
            plane[at, pos] = pdf[n].fillna(default).to_numpy()
            out[n] = list(plane)
        return pd.DataFrame(out)

    schema = ("sample_id string, date date, prow int, pcol int, " + ", ".join(f"{n} array<float>" for n in channels) + f", {target} array<int>")
    return c.groupBy("date", "_brow", "_bcol").applyInPandas(build, schema)
