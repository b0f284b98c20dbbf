"""Density clustering of building centroids and the settlements it yields."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..params import Params
from ..session import materialize
from .common import global_rank
from .nearest import nearest
from .network import components

_SPLIT, _STEPS = 4, 3
_TILE = 4  # side of the tiles in which points meet their neighbours, in eps


def confident_centroids(buildings: DataFrame, minimum: float = 0.75) -> DataFrame:
    return buildings.filter(F.col("confidence") >= minimum)


def _offsets():
    """Cells of side eps/sqrt(2) that can hold a point within eps: 5x5 without the corners."""
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4])


def _gap2(a: str, b: str, far: bool = False):
    """Squared nearest (or farthest) distance between two boxes given as structs x0, x1, y0, y1."""
    def axis(lo, hi):
        if far:
            return F.greatest(F.abs(F.col(f"{a}.{hi}") - F.col(f"{b}.{lo}")), F.abs(F.col(f"{b}.{hi}") - F.col(f"{a}.{lo}")))
        return F.greatest(F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"), F.lit(0.0))
    dx, dy = axis("x0", "x1"), axis("y0", "y1")
    return dx * dx + dy * dy


def _linked_cells(core: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs of neighbouring cells that hold core points within eps of each other.

    Box pairs are settled by their bounds alone where possible; only undecided pairs are split further, so two
    crowded cells are never compared point by point."""
    pos = F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).alias("box")

    def level(j):
        s = side / _SPLIT ** j
        return (core.groupBy("cx", "cy", F.floor(F.col("x") / F.lit(s)).alias("sx"), F.floor(F.col("y") / F.lit(s)).alias("sy")).agg(pos)
                .withColumn("px", F.floor(F.col("sx") / _SPLIT)).withColumn("py", F.floor(F.col("sy") / _SPLIT)))

    top = level(0).select("cx", "cy", "box")
    near = top.select(F.struct("cx", "cy").alias("a"), F.col("box").alias("abox"), F.explode(_offsets()).alias("o"))
    near = near.select("a", "abox", F.struct((F.col("a.cx") + F.col("o.dx")).alias("cx"), (F.col("a.cy") + F.col("o.dy")).alias("cy")).alias("b")).filter(F.col("a") < F.col("b"))
    pairs = (near.join(top.select(F.struct("cx", "cy").alias("b"), F.col("box").alias("bbox")), "b")
             .withColumn("as", F.struct(F.col("a.cx").alias("sx"), F.col("a.cy").alias("sy")))
             .withColumn("bs", F.struct(F.col("b.cx").alias("sx"), F.col("b.cy").alias("sy"))))
    eps2, links = eps * eps, None
    for j in range(_STEPS + 1):
        pairs = materialize(pairs.filter(_gap2("abox", "bbox") <= eps2).withColumn("sure", _gap2("abox", "bbox", True) <= eps2), "pairs")
        sure = pairs.filter("sure").select("a", "b").distinct()
        links = sure if links is None else links.unionByName(sure)
        pairs = pairs.filter(~F.col("sure")).join(sure, ["a", "b"], "left_anti").drop("sure")
        if j == _STEPS:
            break
        kids = level(j + 1).select(F.struct("cx", "cy").alias("c"), F.struct(F.col("px").alias("sx"), F.col("py").alias("sy")).alias("ps"), F.struct("sx", "sy").alias("s"), "box")
        left = kids.select(F.col("c").alias("a"), F.col("ps").alias("as"), F.col("s").alias("as2"), F.col("box").alias("abox2"))
        right = kids.select(F.col("c").alias("b"), F.col("ps").alias("bs"), F.col("s").alias("bs2"), F.col("box").alias("bbox2"))
        pairs = (pairs.join(left, ["a", "as"]).join(right, ["b", "bs"])
                 .select("a", "b", F.col("as2").alias("as"), F.col("bs2").alias("bs"), F.col("abox2").alias("abox"), F.col("bbox2").alias("bbox")))
    s = side / _SPLIT ** _STEPS
    fine = core.select(F.struct("cx", "cy").alias("c"), F.struct(F.floor(F.col("x") / F.lit(s)).alias("sx"), F.floor(F.col("y") / F.lit(s)).alias("sy")).alias("s"), "x", "y").distinct()
    ends = (pairs.select("a", "b", "as", "bs").join(fine.select(F.col("c").alias("a"), F.col("s").alias("as"), F.col("x").alias("ax"), F.col("y").alias("ay")), ["a", "as"])
            .join(fine.select(F.col("c").alias("b"), F.col("s").alias("bs"), F.col("x").alias("bx"), F.col("y").alias("by")), ["b", "bs"]))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return links.unionByName(ends.filter(dx * dx + dy * dy <= eps2).select("a", "b")).distinct()


def _tile(c, size: float):
    return F.floor(c / F.lit(size))


def _around(points: DataFrame, eps: float) -> DataFrame:
    """Each point in every tile that its neighbourhood reaches, 2.25 on average: point_id, qx, qy, tx, ty."""
    size, reach = _TILE * eps, F.lit(eps * (1 + 1e-6))
    run = lambda c: F.explode(F.sequence(_tile(F.col(c) - reach, size), _tile(F.col(c) + reach, size)))
    return (points.select("point_id", "x", "y").withColumn("tx", run("x")).withColumn("ty", run("y"))
            .select("point_id", F.col("x").alias("qx"), F.col("y").alias("qy"), "tx", "ty"))


def density_clusters(points: DataFrame, eps: float = 60.0, min_points: int = 10) -> DataFrame:
    """Density clusters of ``(point_id, x, y)``: point_id, x, y, cluster (null for scattered points).

    Grid formulation (Gunawan 2013): in cells of diagonal eps all points are neighbours, so a cell with
    ``min_points`` is core without comparing anything, and only thin cells (fewer points than that) count
    neighbours. These meet the points of their tiles; a tile holds a bounded number of them, so work is linear in the
    points however crowded a cell is. A border point joins the cluster of
    its nearest core point, smaller id on ties."""
    side, eps2 = eps / math.sqrt(2), eps * eps
    pts = points.select("point_id", "x", "y").withColumn("cx", F.floor(F.col("x") / F.lit(side))).withColumn("cy", F.floor(F.col("y") / F.lit(side)))
    size = pts.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    pts = materialize(pts.join(size, ["cx", "cy"]), "points")
    thin = pts.filter(F.col("n") < min_points)
    tile = [_tile(F.col(c), _TILE * eps).alias(f"t{c}") for c in ("x", "y")]
    close = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    counted = (_around(thin, eps).join(pts.select(*tile, "x", "y"), ["tx", "ty"]).filter(close <= eps2)
               .groupBy("point_id").agg(F.count(F.lit(1)).alias("near")).filter(F.col("near") >= min_points))
    core = pts.filter(F.col("n") >= min_points).select("point_id", "x", "y", "cx", "cy").unionByName(
        thin.join(counted, "point_id", "left_semi").select("point_id", "x", "y", "cx", "cy"))
    core = materialize(core, "core")
    links = _linked_cells(core, eps, side)
    code = lambda c: F.shiftleft(c["cx"], 32) + c["cy"] + F.lit(1 << 31)
    cc = components(links.select(code(F.col("a")).alias("u"), code(F.col("b")).alias("v")))
    named = (core.withColumn("node", F.shiftleft("cx", 32) + F.col("cy") + F.lit(1 << 31)).join(cc, "node", "left")
             .withColumn("comp", F.coalesce("component", "node")))
    cluster = named.groupBy("comp").agg(F.min("point_id").alias("cluster"))
    core_out = materialize(named.join(cluster, "comp").select("point_id", "x", "y", "cx", "cy", "cluster"), "labelled")
    rest = materialize(thin.join(core.select("point_id"), "point_id", "left_anti").select("point_id", "x", "y"), "scattered")
    border = (_around(rest, eps).join(core_out.select(*tile, "x", "y", F.col("point_id").alias("core_id"), "cluster"), ["tx", "ty"])
              .withColumn("d", close).filter(F.col("d") <= eps2).groupBy("point_id").agg(F.min(F.struct("d", "core_id", "cluster")).alias("b")))
    return core_out.select("point_id", "x", "y", "cluster").unionByName(
        rest.join(border, "point_id", "left").select("point_id", "x", "y", F.col("b.cluster").alias("cluster")))


def settlements(clustered: DataFrame, villages: DataFrame, p: Params = Params()) -> DataFrame:
    """One settlement per cluster, numbered in cluster order and named after the nearest village within 1 km."""
    c = (clustered.filter(F.col("cluster").isNotNull()).groupBy("cluster")
         .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n_buildings")))
    c = materialize(global_rank(c, [F.col("cluster").asc()], "n"), "clusters")
    near = nearest(c, villages, "cluster", "village_id", "near_id", "d", max_distance=1000.0, p=p)
    names = villages.select(F.col("village_id").alias("near_id"), "name", "name_bn")
    j = c.join(near, "cluster").join(names, "near_id", "left")
    return j.select(F.format_string("ob%05d", "n").alias("village_id"), F.coalesce("name", F.format_string("Settlement %d", "n")).alias("name"), "name_bn",
                    F.lit("building_cluster").alias("place"), F.lit("Google Open Buildings v3").alias("source"), "n_buildings", "x", "y")
