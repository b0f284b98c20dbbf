"""One test per step that the findings of round 4 made change."""
import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodreach.operators import polygons

from .test_findings_r03 import _most_shuffled
from .test_holes import _border, _inside

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string"
# (row, counts): copies of one order and line in one cell; the last part and supplier counts, whether it knows the cell or not
COPIES = [((10, 5, 1, 1, "A"), False), ((10, 69, 1, 1, "N"), True), ((20, 7, 1, 1, "A"), False), ((20, 7, 65, 1, "N"), True),
          ((30, 8, 1, 1, "N"), False), ((30, 72, 1, 1, "A"), True), ((10, 5, 19, 3, "N"), True), ((20, 7, 19, 3, "N"), True), ((30, 8, 19, 3, "N"), True)]


def _result(spark, folder, name, lines):
    """Rows of the query in Spark and of its SQL, over the given lines and 40 parts."""
    import __spark_entry__ as entry
    os.makedirs(folder)
    part = pd.DataFrame({"p_partkey": range(40), "p_size": [k % 9 for k in range(40)]}).astype({"p_size": "int32"})
    spark.createDataFrame(part).coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()), sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert got == [pytest.approx(w) for w in want]
    return got


def _losers_change_nothing(spark, tmp_path, name):
    got = _result(spark, tmp_path / "all", name, [r for r, _ in COPIES])
    assert got == _result(spark, tmp_path / "winners", name, [r for r, counts in COPIES if counts])
    return got


def test_agreement_settles_copies_by_the_full_row(spark, tmp_path):
    """two of three cells are known to both sources, by the copy of the last part or supplier; the larger class would leave none."""
    assert _losers_change_nothing(spark, tmp_path, "agreement")[0][1] == 2


def test_pixel_accuracy_settles_copies_by_the_full_row(spark, tmp_path):
    """only the copies that count are told right or wrong."""
    _losers_change_nothing(spark, tmp_path, "pixel_accuracy")


RINGS = "rings array<array<struct<x:double,y:double>>>"


def _shapes(spark, shapes, key="polygon_id bigint"):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, rings in shapes], f"{key}, {RINGS}")


def _pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_buffered_area_sends_a_few_tiles_a_polygon(spark):
    """600 diamonds with holes; edges laid out in tiles of their own size were more than 300 rows a polygon, and pairs travelled too."""
    rng = random.Random(5)
    at = lambda x, y, s: [(x - s, y), (x, y - s), (x + s, y), (x, y + s)]
    shapes = [(k, [at(x, y, rng.uniform(300, 1200)), at(x, y, 130)]) for k in range(600) for x, y in [(rng.randrange(0, 20000, 10), rng.randrange(0, 20000, 10))]]
    pts = [(i, float(rng.randrange(0, 20000, 10)), float(rng.randrange(0, 20000, 10))) for i in range(600)]
    points = spark.createDataFrame(pts, "pid bigint, x double, y double")
    got, most = _most_shuffled(spark, lambda: _pairs(polygons.points_within(points, _shapes(spark, shapes), "pid", 101.3)))
    assert got == sorted(((i, k) for i, x, y in pts for k, rings in shapes if _inside(rings, x, y) or _border(rings, x, y) <= 101.3), key=repr)
    assert most <= 25 * len(shapes)


def test_tiles_with_many_edges_are_quartered(spark):
    """rings of hundreds of edges and a small square in their midst, points also on tile sides and at vertices; no tile that can be cut has many edges."""
    rng = random.Random(6)
    star = [(round(math.cos(a) * r, 1), round(math.sin(a) * r, 1)) for i in range(700) for a, r in [(i * math.tau / 700, rng.uniform(900, 1500))]]
    comb = [(x * 10.0, 50.0 if x % 2 else 780.0) for x in range(120)] + [(1190.0, 0.0), (0.0, 0.0)]
    shapes = [(1, [star, [(-50, -50), (50, -50), (50, 50), (-50, 50)]]), (2, [comb]), (3, [[(-100, -100), (100, -100), (100, 100), (-100, 100)]])]
    pts = [(i, rng.choice([rng.uniform(-1700, 1700), rng.randrange(-1700, 1700, 50) * 1.0]), rng.choice([rng.uniform(-1700, 1700), rng.randrange(-1700, 1700, 50) * 1.0])) for i in range(900)]
    pts += [(1000 + i, *v) for i, v in enumerate(star[::9] + comb[::9])]
    points = spark.createDataFrame(pts, "pid bigint, x double, y double")
    for reach in (0.0, 3.0, 60.0):
        got = _pairs(polygons.points_within(points, _shapes(spark, shapes), "pid", reach))
        assert got == sorted(((i, k) for i, x, y in pts for k, rings in shapes if _inside(rings, x, y) or _border(rings, x, y) <= reach), key=repr)
    levels, pieces = polygons._pieces(_shapes(spark, shapes), "polygon_id", 3.0, 704)
    crowds = pieces.groupBy("polygon_id").agg(F.max(F.size("edges"))).collect()
    assert max(n for _, n in crowds) <= polygons._CROWD and {r.level for r in pieces.select("level").distinct().collect()} <= {r.level for r in levels.collect()}


def test_repeated_and_null_keys_within_as_before(spark):
    """points of one id in several rows, polygons of one key in several rows and null keys are told by the former rule, each pair once."""
    rng = random.Random(7)
    square = lambda x, y, s: [(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s)]
    shapes = [(k, [square(rng.uniform(0, 2000), rng.uniform(0, 2000), rng.uniform(100, 500))]) for k in [*range(20), 3, 3, 4, 5, None]]
    shapes += [shapes[7]]
    pts = [(rng.choice([i, i, 5, 6, None]), rng.uniform(0, 2000), rng.uniform(0, 2000)) for i in range(100, 220)]
    points, areas = spark.createDataFrame(pts + pts[:30], "pid bigint, x double, y double"), _shapes(spark, shapes)
    want = _pairs(polygons._within_of_shared_keys(points, areas, "pid", 40.0, "polygon_id"))
    assert _pairs(polygons.points_within(points, areas, "pid", 40.0)) == want and len(want) > 150
    some = points.dropDuplicates(["pid"]).filter("pid is not null")
    assert _pairs(polygons.points_within(some, areas, "pid", 40.0)) == _pairs(polygons._within_of_shared_keys(some, areas, "pid", 40.0, "polygon_id"))
