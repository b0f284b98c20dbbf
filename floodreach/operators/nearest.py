"""Nearest-site joins: snapping to junctions, naming clusters, nearest-village zones, map clicks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geometry import distance
from ..params import Params
from ..session import materialize

_BITS = 52  # of a cell's place per axis: 13 levels of 16 x 16
_CELLS = 1 << _BITS


def _sites(targets: DataFrame, target_id: str) -> DataFrame:
    """One site per distinct position, smallest id first; copies of a position never multiply candidates."""
    return targets.groupBy("x", "y").agg(F.min(target_id).alias("t_id"))


def _near_buckets(sites: DataFrame, bucket: float, cap: int) -> DataFrame:
    """Bucket -> all sites of its 3x3 neighbourhood, for buckets where those are at most ``cap``."""
    off = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = (sites.withColumn("_kx", F.explode(F.transform(off, lambda o: F.floor(F.col("x") / F.lit(bucket)) + o)))
              .withColumn("_ky", F.explode(F.transform(off, lambda o: F.floor(F.col("y") / F.lit(bucket)) + o))))
    light = spread.groupBy("_kx", "_ky").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= cap)
    return (spread.join(light, ["_kx", "_ky"], "left_semi").groupBy("_kx", "_ky")
            .agg(F.collect_list(F.struct("x", "y", "t_id")).alias("_sites")))


def _tree(sites: DataFrame, cap: int) -> tuple[list[DataFrame], DataFrame]:
    """A tree of cells over the sites, each cut into 16 x 16 until none holds more than ``cap``: per level its cells (parent px, py,
    own cx, cy, bounding box of the sites inside, ``leaf``), and the sites of all leaves (level, cx, cy, x, y, t_id).

    Cells are cut where the sites are, whatever the extent; positions are distinct, so cutting ends."""
    box = sites.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)) * (1 + 1e-12)).alias("side"))
    at = lambda c, low: F.least(F.floor((F.col(c) - F.col(f"_b.{low}")) / F.col("_b.side") * float(_CELLS)), F.lit(_CELLS - 1))
    open_ = materialize(sites.withColumn("_b", box.select(F.struct("*").alias("b")).scalar()).withColumn("ix", at("x", "x0")).withColumn("iy", at("y", "y0")).drop("_b"), "sites")
    levels, leaves, depth = [], [], 0
    while True:
        depth += 1
        cell = [F.shiftright(c, _BITS - 4 * depth).alias(n) for c, n in (("ix", "cx"), ("iy", "cy"))]
        own = open_.withColumns({"cx": cell[0], "cy": cell[1]})
        kids = own.groupBy("cx", "cy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
        last = 4 * depth == _BITS
        kids = materialize(kids.select(F.shiftright("cx", 4).alias("px"), F.shiftright("cy", 4).alias("py"), "cx", "cy", "x0", "x1", "y0", "y1",
                                       ((F.col("n") <= cap) | F.lit(last)).alias("leaf")), "cells")
        levels.append(kids)
        done = own.join(kids.filter("leaf").select("cx", "cy"), ["cx", "cy"], "left_semi")
        leaves.append(done.select(F.lit(depth).alias("level"), "cx", "cy", "x", "y", "t_id"))
        if kids.filter(~F.col("leaf")).isEmpty():
            return levels, reduce(DataFrame.unionByName, leaves)
        open_ = materialize(own.join(kids.filter(~F.col("leaf")).select("cx", "cy"), ["cx", "cy"], "left_semi").drop("cx", "cy"), "sites")


def _bounds(x, y, c) -> tuple[Column, Column]:
    """Squared distance from a point to the nearest and to the farthest corner of a box."""
    zero = F.lit(0.0)
    nx, ny = F.greatest(c["x0"] - x, x - c["x1"], zero), F.greatest(c["y0"] - y, y - c["y1"], zero)
    fx, fy = F.greatest(c["x1"] - x, x - c["x0"]), F.greatest(c["y1"] - y, y - c["y0"])
    return nx * nx + ny * ny, fx * fx + fy * fy


def _closest(sites: str) -> Column:
    """Distance and id of the closest of an array of sites to the row's point, smaller id on ties."""
    return F.array_min(F.transform(sites, lambda s: F.struct(distance(F.col("x"), F.col("y"), s["x"], s["y"]).alias("d"), s["t_id"].alias("t_id"))))


def _descend(points: DataFrame, sites: DataFrame, point_id: str, cap: int) -> DataFrame:
    """Exact nearest site by walking down the tree.

    A point keeps only the cells whose closest corner is not beyond the farthest corner of its best cell so far, and leaves
    hold at most ``cap`` sites, so each step pairs it with a bounded number of cells. The first level, at most 256 cells, is
    one array that every point filters; deeper levels are joined on the parent cell."""
    levels, leaves = _tree(sites, cap)
    top = levels[0].agg(F.collect_list(F.struct("cx", "cy", "x0", "x1", "y0", "y1", "leaf"))).scalar()
    points = points.withColumn("_top", top).withColumn("_best", F.array_min(F.transform("_top", lambda c: _bounds(F.col("x"), F.col("y"), c)[1])))
    points = materialize(points.drop("_top"), "points")
    slack, at, ends = 1 + 1e-9, None, []
    for depth, kids in enumerate(levels, 1):
        if at is None:
            f = points.withColumn("_top", top).select(point_id, "x", "y", "_best", F.inline(F.filter("_top", lambda c: _bounds(F.col("x"), F.col("y"), c)[0] <= F.col("_best") * slack)))
            f = f.withColumn("_near", _bounds(F.col("x"), F.col("y"), {n: F.col(n) for n in ("x0", "x1", "y0", "y1")})[0])
        else:
            # first the best cell of each point, summed before it travels; then only cells that are not beyond it are spelt out
            near, far = _bounds(F.col("x"), F.col("y"), {n: F.col(n) for n in ("x0", "x1", "y0", "y1")})
            below = kids.select("px", "py", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "x0", "x1", "y0", "y1", F.col("leaf").alias("_leaf"))
            meet = lambda at, below=below: at.join(below, [at["cx"] == below["px"], at["cy"] == below["py"]])
            best = meet(at).groupBy(point_id).agg(F.min(far).alias("_far"))
            at = at.join(best, point_id).withColumn("_best", F.least("_best", "_far")).drop("_far")
            f = meet(at).withColumn("_near", near).filter(F.col("_near") <= F.col("_best") * slack)
            f = f.select(point_id, "x", "y", "_best", "_near", F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), F.col("_leaf").alias("leaf"))
        f = f.select(point_id, "x", "y", "_best", "_near", "cx", "cy", "leaf")
        if depth < len(levels):
            f = materialize(f, "front")
            at = f.filter(~F.col("leaf")).select(point_id, "x", "y", "_best", "cx", "cy")
        ends.append(f.filter("leaf").select(point_id, "x", "y", "_best", "_near", F.lit(depth).alias("level"), "cx", "cy"))
    met = reduce(DataFrame.unionByName, ends)
    if len(ends) > 1:
        met = met.withColumn("_best", F.min("_best").over(W.partitionBy(point_id))).filter(F.col("_near") <= F.col("_best") * slack)
    # a leaf's sites are compared inside its row, so a point travels once per leaf and not once per site
    leaves = leaves.groupBy("level", "cx", "cy").agg(F.collect_list(F.struct("x", "y", "t_id")).alias("sites"))
    met = met.join(leaves, ["level", "cx", "cy"]).select(point_id, _closest("sites").alias("_h"))
    return met.groupBy(point_id).agg(F.min("_h").alias("_hit"))


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, out_id: str = "target_id",
            out_dist: str = "distance_m", max_distance: float | None = None, p: Params = Params(), bucket: float | None = None) -> DataFrame:
    """Every point with its nearest target and the distance; ties go to the smaller target id.

    Points meet the candidates of their bucket as one array in one equi-join, and that answer is final when it
    lies within a bucket width. The rest (remote points, crowded buckets) walk down a tree of cells, which is exact for
    any layout. With ``max_distance`` farther matches become null."""
    b = bucket or p.knn_bucket_m
    sites = materialize(_sites(targets.select("x", "y", target_id), target_id), "sites")
    q = points.select(point_id, "x", "y")
    fast = (q.withColumn("_kx", F.floor(F.col("x") / F.lit(b))).withColumn("_ky", F.floor(F.col("y") / F.lit(b)))
            .join(_near_buckets(sites, b, p.knn_bucket_cap), ["_kx", "_ky"], "left")
            .withColumn("_hit", _closest("_sites")))
    done = F.coalesce(F.col("_hit.d") <= F.lit(b), F.lit(False))
    hits = (fast.filter(done).select(point_id, "_hit")
            .unionByName(_descend(fast.filter(~done).select(point_id, "x", "y"), sites, point_id, p.knn_bucket_cap)))
    ok = F.lit(True) if max_distance is None else F.col("_hit.d") <= F.lit(float(max_distance))
    return hits.select(point_id, F.when(ok, F.col("_hit.t_id")).alias(out_id), F.when(ok, F.col("_hit.d")).alias(out_dist))


def snap_villages(villages: DataFrame, nodes: DataFrame, p: Params = Params()) -> DataFrame:
    s = nearest(villages, nodes, "village_id", "node_id", "node_id", "snap_dist_m", p=p)
    return villages.join(s, "village_id").withColumn("boat_dependent", F.col("snap_dist_m") > F.lit(p.boat_dependent_m))


def snap_shelters(shelters: DataFrame, nodes: DataFrame, p: Params = Params()) -> DataFrame:
    s = nearest(shelters, nodes, "shelter_id", "node_id", "node_id", "snap_dist_m", p=p)
    return shelters.join(s, "shelter_id").withColumn("road_reachable", F.col("snap_dist_m") <= F.lit(p.shelter_snap_max_m))


def village_at_click(clicks: DataFrame, villages: DataFrame, max_m: float = 400.0, p: Params = Params()) -> DataFrame:
    """Nearest village (lon, lat) to each click (click_id, lon, lat) within ``max_m`` equirectangular metres.

    Metres per degree of longitude depend on the click, so candidates come from cells of ``max_m``, cut by count: a cell's villages
    in excess of ``knn_bucket_cap`` are spread over sub-keys that every click of the cell meets by an equality join."""
    # Metres per degree.
    per_lon, per_lat = 111_320.0, 110_540.0
    kx = F.lit(per_lon) * F.cos(F.radians("lat"))
    step = max_m / per_lat
    spread = lambda c, reach: F.sequence(F.floor((c - reach) / F.lit(step)), F.floor((c + reach) / F.lit(step)))
    v = villages.groupBy("lon", "lat").agg(F.min("village_id").alias("village_id"))
    v = v.select("village_id", F.col("lon").alias("vlon"), F.col("lat").alias("vlat"), F.floor(F.col("lon") / F.lit(step)).alias("_bx"), F.floor(F.col("lat") / F.lit(step)).alias("_by"))
    size = v.groupBy("_bx", "_by").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.knn_bucket_cap)).cast("int").alias("_parts"))
    v = v.join(size, ["_bx", "_by"]).withColumn("_part", F.pmod(F.hash("village_id"), F.col("_parts"))).drop("_parts")
    q = (clicks.select("click_id", "lon", "lat").withColumn("_by", F.explode(spread(F.col("lat"), F.lit(max_m / per_lat))))
         .withColumn("_bx", F.explode(spread(F.col("lon"), F.lit(max_m) / kx))))
    q = q.join(size, ["_bx", "_by"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dx, dy = (F.col("vlon") - F.col("lon")) * kx, (F.col("vlat") - F.col("lat")) * F.lit(per_lat)
    hit = (q.join(v, ["_bx", "_by", "_part"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") <= F.lit(max_m))
           .groupBy("click_id").agg(F.min(F.struct("d", "village_id")).alias("h"))
           .select("click_id", F.col("h.village_id").alias("village_id"), F.col("h.d").alias("distance_m")))
    return clicks.select("click_id").join(hit, "click_id", "left")
