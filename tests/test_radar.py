"""Radar scenes to registered maps."""
from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from floodreach import Grid, Params
from floodreach.plans import maps
from floodreach.sources import tables

GRID = Grid(0.0, 400.0, 20, 20, 20.0)
DAYS = [dt.date(2022, 6, d) for d in (1, 2, 3)]


def _pixels(rows):
    return rows, "date date, t timestamp, scene_id int, relative_orbit int, row int, col int, vv_db double"


def test_radar_maps_equal_a_plain_restatement_and_can_be_registered(spark, tmp_path):
    rng = np.random.default_rng(6)
    at = lambda day, hour: dt.datetime(day.year, day.month, day.day, hour)
    flood, dry = [], []
    for r in range(20):
        for c in range(20):
            wet = (r - 8) ** 2 + (c - 9) ** 2 < 30
            flood.append((DAYS[0], at(DAYS[0], 6), 2, 5, r, c, float(-12 - 10 * wet + rng.normal())))
            if r < 10:  # a later scene of the day, on another orbit, unknown in places
                flood.append((DAYS[0], at(DAYS[0], 18), 1, 7, r, c, None if c % 5 == 0 else float(-11 - 10 * wet + rng.normal())))
            flood.append((DAYS[1], at(DAYS[1], 6), 3, 9, r, c, float(-13 - 8 * wet + rng.normal()) if c < 15 else None))
            flood.append((DAYS[2], at(DAYS[2], 6), 4, 5, r, c, None))
            for n, orbit in enumerate((5, 5, 7)):  # orbit 9 has no dry season
                if (r + c + n) % 11:
                    dry.append((None, dt.datetime(2022, 1, 1 + n), n, orbit, r, c, float(-10 + orbit / 10 + rng.normal())))
            dry.append((None, dt.datetime(2022, 6, 1), 9, 5, r, c, -60.0))  # after the dry season
    elevation = {(r, c): float(3.0 * max(0, c - 12)) for r in range(20) for c in range(20) if (r, c) != (3, 3)}
    dem = spark.createDataFrame([(r, c, z) for (r, c), z in elevation.items()], "row int, col int, elevation double")
    cells, notes = maps.radar_maps(spark.createDataFrame(*_pixels(flood)), spark.createDataFrame(*_pixels(dry)), dem, GRID, "2022-01-01", "2022-04-01", p=Params(tile_px=8))

    def smooth(table):
        return {(r, c): float(np.median([table[r + a, c + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (r + a, c + b) in table])) for r, c in table}
    slope = {}
    for r, c in elevation:
        near = [elevation.get(x) for x in ((r, c + 1), (r, c - 1), (r - 1, c), (r + 1, c))]
        if None not in near:
            slope[r, c] = np.degrees(np.arctan(np.hypot((near[0] - near[1]) / 40, (near[2] - near[3]) / 40)))
    want = {}
    for day, orbit in zip(DAYS, (5, 9, 5)):
        latest = {}
        for _, _, _, _, r, c, v in sorted((x for x in flood if x[0] == day and x[6] is not None), key=lambda x: (x[1], x[2])):
            latest[r, c] = v
        group = {}
        for _, t, _, o, r, c, v in dry:
            if t < dt.datetime(2022, 4, 1) and (o == orbit or orbit == 9):
                group.setdefault((r, c), []).append(v)
        vv, ref = smooth(latest), smooth({k: float(np.median(v)) for k, v in group.items()})
        for k in vv:
            if k in ref and k in slope:  # fewer than 1,000 pixels: the fallback threshold
                want[day, *k] = int(vv[k] < -18 and vv[k] - ref[k] < -3 and slope[k] <= 5)
    assert {(r["date"], r["row"], r["col"]): r["value"] for r in cells.collect()} == want
    assert {1, 0} == set(want.values())
    assert {r["date"]: r["note"] for r in notes.collect()} == {d: f"otsu=-18.00dB orbit={o}" for d, o in zip(DAYS, (5, 9, 5))}

    tables.register_flood_maps(cells, notes, str(tmp_path))
    back, dates = tables.read_cells(spark, str(tmp_path))
    assert back.count() == len(want) and [r[0] for r in dates.orderBy("date").collect()] == DAYS  # the day without a known cell too


def test_radar_dates_share_one_static_table(spark):
    """However many dates, the date-independent side is read and shuffled once, and flood cells meet it in one join by cell."""
    empty = spark.createDataFrame([], "date date, t timestamp, scene_id int, relative_orbit int, row int, col int, vv_db double")
    cells, notes = maps.radar_maps(empty, empty, spark.createDataFrame([], "row int, col int, elevation double"), GRID, "2022-01-01", "2022-04-01")
    assert cells.count() == 0 and notes.count() == 0
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("relative_orbit#") > 0 and plan.count("Join LeftOuter") == 1
    assert cells.filter(F.col("value") == 255).count() == 0
