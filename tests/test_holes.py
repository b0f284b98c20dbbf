"""Polygons with holes and several parts."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from floodreach.functions import geometry
from floodreach.operators import polygons

SQUARE = lambda x, y, r, turn=1: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)][::turn]
SHAPES = {
    1: [SQUARE(0, 0, 100), SQUARE(0, 0, 60), SQUARE(0, 0, 20)],  # an island in a hole
    2: [SQUARE(0, 0, 50), SQUARE(400, 30, 80, -1), SQUARE(400, 30, 10)],  # two parts, one with a hole
    3: [[(0, 0), (300, 0), (300, 200), (200, 200), (200, 20), (100, 20), (100, 200), (0, 200)]],  # a U, concave
    4: [SQUARE(4000, 4000, 900), SQUARE(4300, 4300, 500, -1)],  # large, off the middle
    5: [[(7, 9)]],
}
AREAS = {1: 40000 - 14400 + 1600, 2: 10000 + 25600 - 400, 3: 60000 - 18000, 4: 1800 ** 2 - 1000 ** 2, 5: 0}


def _polygons(spark):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, rings in SHAPES.items()], "polygon_id int, rings array<array<struct<x:double,y:double>>>")


def _inside(rings, x, y):
    hits = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            hits += (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
    return hits % 2 == 1


def _border(rings, x, y):
    best = math.inf
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def test_areas_subtract_holes_whatever_the_order_of_vertices(spark):
    area, x, y = geometry.polygon_measures(F.col("rings"))
    got = {r["polygon_id"]: r for r in _polygons(spark).select("polygon_id", area.alias("a"), x.alias("x"), y.alias("y")).collect()}
    assert {k: round(r["a"], 6) for k, r in got.items()} == AREAS
    assert abs(got[1]["x"]) < 1e-9 and got[5]["x"] is None
    assert abs(got[4]["x"] - (1800 ** 2 * 4000 - 1000 ** 2 * 4300) / AREAS[4]) < 1e-6
    assert abs(got[2]["x"] - 25200 * 400 / 35200) < 1e-6 and abs(got[2]["y"] - 25200 * 30 / 35200) < 1e-6


def test_interior_points_lie_inside(spark):
    shapes = _polygons(spark)
    x, y = geometry.polygon_interior_point(F.col("rings"))
    points = shapes.select(F.col("polygon_id").alias("of"), x.alias("x"), y.alias("y"))
    inside = {(r["of"], r["polygon_id"]) for r in polygons.points_in_polygons(points, shapes, "of").collect()}
    assert {(k, k) for k in SHAPES if k != 5} <= inside
    assert points.filter("of = 5").select("x", "y").first() == (7.0, 9.0)


def test_distance_counts_from_borders_of_holes_and_parts(spark):
    rng = np.random.default_rng(2)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate([*rng.uniform(-250, 650, (400, 2)), *rng.uniform(2800, 5200, (400, 2)), (0, 40), (0, 39), (4300, 4300), (7, 9), (7, 49)])]
    points = spark.createDataFrame(spots, "pid int, x double, y double")
    for reach in (0.0, 25.0, 40.0):
        got = {(r["pid"], r["polygon_id"]) for r in polygons.points_within(points, _polygons(spark), "pid", reach).collect()}
        assert got == {(i, k) for i, x, y in spots for k, rings in SHAPES.items() if _inside(rings, x, y) or _border(rings, x, y) <= reach}
