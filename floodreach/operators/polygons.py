"""Polygons against grids and points.

A polygon row is filled between successive crossings. Points meet polygons through tiles sized to each polygon, and then only
the edges of their own band or tile, so no cell or point ever meets all vertices of a polygon, nor polygons far away."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.classify import cell_col, cell_row, cell_x, cell_y, inside_grid
from ..functions.geometry import segment_distance, to_lonlat
from ..params import Grid
from .common import distinct_values


def ring_edges(polygons: DataFrame, key: str = "polygon_id", rings: str = "rings", level: bool = False) -> DataFrame:
    """One row per ring edge, level ones only where asked for; holes need no flag because filling is even-odd."""
    ring = F.col("ring")
    edges = (polygons.select(key, F.explode(rings).alias("ring"))
             .select(key, F.explode(F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))).alias("e"))
             .select(key, F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1")))
    return edges if level else edges.filter(F.col("y0") != F.col("y1"))


def row_spans(polygons: DataFrame, grid: Grid, key: str = "polygon_id") -> DataFrame:
    """Runs of cells whose centres lie inside: key, row, col_from, col_to (inclusive)."""
    top, bottom = F.greatest("y0", "y1"), F.least("y0", "y1")
    lo = F.greatest(F.lit(0), (F.floor((F.lit(grid.ymax) - top) / F.lit(grid.res)) - 1).cast("int"))
    hi = F.least(F.lit(grid.height - 1), (F.floor((F.lit(grid.ymax) - bottom) / F.lit(grid.res)) + 1).cast("int"))
    e = (ring_edges(polygons, key).withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") <= F.col("_hi"))
         .withColumn("row", F.explode(F.sequence("_lo", "_hi"))).withColumn("yc", cell_y(F.col("row"), grid))
         .filter((F.col("y0") > F.col("yc")) != (F.col("y1") > F.col("yc")))
         .withColumn("xc", F.col("x0") + (F.col("yc") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))))
    w = W.partitionBy(key, "row").orderBy("xc")
    pairs = (e.withColumn("_n", F.row_number().over(w)).withColumn("xn", F.lead("xc").over(w))
             .filter((F.col("_n") % 2 == 1) & F.col("xn").isNotNull()))
    # a centre at x is inside when xc <= x < xn
    first = F.ceil((F.col("xc") - F.lit(grid.xmin)) / F.lit(grid.res) - F.lit(0.5)).cast("int")
    last = (F.ceil((F.col("xn") - F.lit(grid.xmin)) / F.lit(grid.res) - F.lit(0.5)) - 1).cast("int")
    return (pairs.select(key, "row", F.greatest(first, F.lit(0)).alias("col_from"), F.least(last, F.lit(grid.width - 1)).alias("col_to"))
            .filter(F.col("col_from") <= F.col("col_to")))


def burn(polygons: DataFrame, grid: Grid, key: str = "polygon_id") -> DataFrame:
    """Cells whose centres lie inside each polygon: key, row, col."""
    return row_spans(polygons, grid, key).select(key, "row", F.explode(F.sequence("col_from", "col_to")).alias("col"))


_RUN = 32  # columns whose cells travel as the bits of one integer


def burn_any(polygons: DataFrame, grid: Grid, key: str = "polygon_id") -> DataFrame:
    """Cells whose centres lie inside some polygon, each once: row, col.

    A span travels as bits per run of columns, which are combined before cells are spelt out, so cells under many polygons cost no rows."""
    at = lambda c: F.floor(c / _RUN)
    low = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1
    base = F.col("_run") * _RUN
    spans = row_spans(polygons, grid, key).withColumn("_run", F.explode(F.sequence(at(F.col("col_from")), at(F.col("col_to")))))
    bits = low(F.least(F.col("col_to") - base, F.lit(_RUN - 1)) + 1) - low(F.greatest(F.col("col_from") - base, F.lit(0)))
    runs = spans.groupBy("row", "_run").agg(F.bit_or(bits).alias("_bits"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(_RUN - 1)), lambda i: F.call_function("shiftright", F.col("_bits"), i) % 2 == 1)
    return runs.withColumn("_at", F.explode(inside)).select("row", (base + F.col("_at")).cast("int").alias("col"))


_TILE, _ACROSS = 50.0, 8  # metres of the finest tile; tiles along a polygon's longer side, at most twice as many


def _boxes(polygons: DataFrame, key: str, reach: float = 0.0, *keep: Column) -> DataFrame:
    """Each polygon's box, widened by ``reach``, and the level of its tiles: key, what is to be kept, x0, x1, y0, y1, level. Tiles double in size per level, and
    a polygon takes the level at which about ``_ACROSS`` of them cover its longer side, so it has a bounded number of tiles whatever its extent."""
    points = F.flatten("rings")
    end = lambda f, axis, by: f(F.transform(points, lambda q: q[axis])) + F.lit(by)
    box = polygons.select(key, *keep, end(F.array_min, "x", -reach).alias("x0"), end(F.array_max, "x", reach).alias("x1"), end(F.array_min, "y", -reach).alias("y0"), end(F.array_max, "y", reach).alias("y1"))
    return box.withColumn("level", _level())


def _level() -> Column:
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(_TILE * _ACROSS))
    return F.ceil(F.log2(side / F.lit(_TILE * _ACROSS))).cast("int")


def _tile() -> Column:
    return F.lit(_TILE) * F.pow(F.lit(2.0), F.col("level"))


def _run(lo, hi, tile) -> Column:
    return F.explode(F.sequence(F.floor(lo / tile), F.floor(hi / tile)))


def _cover(boxes: DataFrame, key: str) -> DataFrame:
    """Tiles of each box: key, level, tx, ty."""
    x = boxes.withColumn("tile", _tile()).withColumn("tx", _run(F.col("x0"), F.col("x1"), F.col("tile")))
    return x.withColumn("ty", _run(F.col("y0"), F.col("y1"), F.col("tile"))).select(key, "level", "tx", "ty")


def _edge_boxes(edges: DataFrame, reach: float) -> DataFrame:
    """Boxes of single edges as in ``_boxes``, the edge itself (``_edge``: key, x0, y0, x1, y1) as the key."""
    e = lambda c: F.col(f"_edge.{c}")
    low, high = (lambda a: F.least(e(f"{a}0"), e(f"{a}1")) - F.lit(reach)), (lambda a: F.greatest(e(f"{a}0"), e(f"{a}1")) + F.lit(reach))
    return edges.select("_edge", low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1")).withColumn("level", _level())


def _edge_cover(boxes: DataFrame, reach: float) -> DataFrame:
    """Tiles that come within ``reach`` of an edge, column by column: what of the edge lies in the widened column tells the rows."""
    e = lambda c: F.col(f"_edge.{c}")
    wide = F.lit(reach + 1e-6)
    dx, dy = e("x1") - e("x0"), e("y1") - e("y0")
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - e("x0")) / dx))
    x = boxes.withColumn("tile", _tile()).withColumn("tx", _run(F.col("x0"), F.col("x1"), F.col("tile")))
    ends = [F.when(dx == 0, F.lit(flat)).otherwise(at(side)) for flat, side in
            ((0.0, F.col("tx") * F.col("tile") - wide), (1.0, (F.col("tx") + 1) * F.col("tile") + wide))]
    y = [e("y0") + t * dy for t in ends]
    return x.withColumn("ty", _run(F.least(*y) - wide, F.greatest(*y) + wide, F.col("tile"))).select("_edge", "level", "tx", "ty")


def _near_pairs(points: DataFrame, boxes: DataFrame, cover: DataFrame, point_id: str, key: str) -> DataFrame:
    """Pairs (point, polygon) with the point in a tile of the polygon: point_id, x, y, key, level. The levels in use are few."""
    p = points.select(point_id, "x", "y", F.explode(distinct_values(boxes, "level")).alias("level"))
    return p.withColumn("tx", F.floor(F.col("x") / _tile())).withColumn("ty", F.floor(F.col("y") / _tile())).join(cover, ["level", "tx", "ty"]).drop("tx", "ty")


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, key: str = "polygon_id") -> DataFrame:
    """Pairs (point, polygon) with the point inside.

    A point meets the polygons of its tile, and of each only the edges of its own thin band. Crossings to the right are
    counted per pair, map-side first."""
    boxes = _boxes(polygons, key)
    pairs = _near_pairs(points, boxes, _cover(boxes, key), point_id, key)
    band = lambda y: F.floor(y / (F.lit(_TILE / 4) * F.pow(F.lit(2.0), F.col("level"))))
    level = boxes.select(key, "level").distinct()
    e = ring_edges(polygons, key).join(level, key).withColumn("_b", F.explode(F.sequence(band(F.least("y0", "y1")), band(F.greatest("y0", "y1"))))).drop("level")
    right = (((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y")))
             & (F.col("x") < F.col("x0") + (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))))
    return (pairs.withColumn("_b", band(F.col("y"))).join(e, [key, "_b"]).filter(right).groupBy(point_id, key).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") % 2 == 1).select(point_id, key))


_SLACK = 1e-6  # metres by which tiles are widened, above any rounding
_CROWD, _QUARTERED = 32, 6  # edges above which a tile is cut in four, and how many times at most
_FEW = 6  # edges and turns of a tile that compiled code tells; further ones are interpreted


def _to_right(edge, x, y) -> Column:
    """Does the level line from (x, y) to the right cross the edge?"""
    return F.when((edge["y0"] > y) != (edge["y1"] > y), x < edge["x0"] + (y - edge["y0"]) / (edge["y1"] - edge["y0"]) * (edge["x1"] - edge["x0"])).otherwise(False)


def _frame(level, tx, ty, reach: float) -> Column:
    """A tile's name, its sides with ``_SLACK`` and (``near_``) with ``reach`` around it, its centre and half its size."""
    size = F.lit(_TILE) * F.pow(F.lit(2.0), level)
    sides = {"left": tx * size, "right": (tx + 1) * size, "low": ty * size, "high": (ty + 1) * size}
    out = {k: -1 if k in ("left", "low") else 1 for k in sides}
    return F.struct(level.alias("level"), tx.alias("tx"), ty.alias("ty"), ((tx + 0.5) * size).alias("x"), ((ty + 0.5) * size).alias("y"), (size / 2).alias("half"),
                    *[(v + out[k] * _SLACK).alias(k) for k, v in sides.items()], *[(v + out[k] * (reach + _SLACK)).alias(f"near_{k}") for k, v in sides.items()])


def _piece(edges, odd, turns, tile, reach: float) -> Column:
    """What a tile (see ``_frame``) needs to know of a polygon, null where no point of the tile lies inside or within ``reach``: level, tx, ty, odd, turns, edges.

    ``edges`` are those within reach of the tile. What passes to the right of it is told by the heights where it begins and ends: ``turns`` are those beside
    the tile, ``odd`` is whether an odd number lies below. Edges that follow each other share a height, which counts twice and so not at all.
    Without an edge within reach all of the tile is inside or all outside."""
    def kind(e):
        up_to = lambda c, side: (e[f"{c}0"] <= tile[side]) | (e[f"{c}1"] <= tile[side])
        down_to = lambda c, side: (e[f"{c}0"] >= tile[side]) | (e[f"{c}1"] >= tile[side])
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        cross = dx * (tile["y"] - e["y0"]) - dy * (tile["x"] - e["x0"])
        near = (up_to("x", "near_right") & down_to("x", "near_left") & up_to("y", "near_high") & down_to("y", "near_low")
                & (F.abs(cross) <= (F.abs(dx) + F.abs(dy)) * tile["half"] + F.lit(reach + _SLACK) * F.sqrt(dx * dx + dy * dy)))
        beside = down_to("x", "left") & up_to("y", "high") & down_to("y", "low")
        return F.when(near, 2).when(beside & (((e["x0"] >= tile["right"]) & (e["x1"] >= tile["right"])) | (cross * dy > 0)), 1).otherwise(0)

    def made(kinds):
        def own(e, i, side, other, step):  # not shared with the edge before or after
            return (F.get(kinds, i) == 1) & ~F.coalesce((F.get(kinds, i + step) == 1) & (F.get(edges, i + step)[other] == e[side]), F.lit(False))
        begin = F.transform(F.filter(edges, lambda e, i: own(e, i, "y0", "y1", -1)), lambda e: e["y0"])
        end = F.transform(F.filter(edges, lambda e, i: own(e, i, "y1", "y0", 1)), lambda e: e["y1"])
        return F.get(F.transform(F.array(F.concat(turns, begin, end)), lambda ys: told(kinds, ys)), F.lit(0))

    def told(kinds, ys):
        below = lambda y: (odd + F.size(F.filter(ys, lambda v: v <= y))) % 2
        out = lambda o, v, e: F.struct(*[tile[c].alias(c) for c in ("level", "tx", "ty")], o.alias("odd"), v.alias("turns"), e.alias("edges"))
        return (F.when(F.array_contains(kinds, 2), out(below(tile["low"]), F.filter(ys, lambda v: (v > tile["low"]) & (v <= tile["high"])), F.filter(edges, lambda e, i: F.get(kinds, i) == 2)))
                .when(below(tile["y"]) == 1, out(F.lit(1), F.slice(ys, 1, 0), F.slice(edges, 1, 0))))

    return F.get(F.transform(F.array(F.transform(edges, kind)), made), F.lit(0))


def _pieces(polygons: DataFrame, key: str, reach: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The levels of the tiles, and the polygons cut into them, no two of a polygon's tiles overlapping: key, level, tx, ty, odd, turns, edges.

    A few tiles cover a polygon's longer side; those with many edges are cut in four, so a point meets few edges whatever the polygon's number of them.
    ``most`` is the number of edges of the largest polygon."""
    corner = lambda r, i: F.get(r, i % F.size(r))
    ends = lambda r: lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), corner(r, i + 1)["x"].alias("x1"), corner(r, i + 1)["y"].alias("y1"))
    edges = F.flatten(F.transform("rings", lambda r: F.transform(r, ends(r))))
    level = F.col("level") + 1  # twice the tiles of a cover: a polygon is sent to fewer
    levels = _boxes(polygons, key, reach, F.size(F.flatten("rings")).alias("_n")).select(F.explode(
        F.when(F.col("_n") > _CROWD, F.sequence(level - _QUARTERED, level)).otherwise(F.array(level))).alias("level")).distinct()
    boxes = _boxes(polygons, key, reach, edges.alias("_edges")).withColumn("level", level).withColumn("tile", _tile())
    tiles = boxes.withColumn("tx", _run(F.col("x0"), F.col("x1"), F.col("tile"))).withColumn("ty", _run(F.col("y0"), F.col("y1"), F.col("tile")))
    some = lambda made: F.explode(F.filter(made, lambda f: f.isNotNull())).alias("_f")
    tiles = tiles.select(key, "_edges", _frame(F.col("level"), F.col("tx"), F.col("ty"), reach).alias("_tile"))
    f = tiles.select(key, some(F.array(_piece(F.col("_edges"), F.lit(0), F.array().cast("array<double>"), F.col("_tile"), reach))))
    of = lambda c: F.col(f"_f.{c}")
    crowded = (F.size(of("edges")) > _CROWD) & (F.lit(_TILE) * F.pow(F.lit(2.0), of("level")) > F.lit(2 * reach))
    quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _frame(of("level") - 1, of("tx") * 2 + i % 2, of("ty") * 2 + F.floor(i / 2), reach))
    for _ in range(_QUARTERED if most > _CROWD else 0):
        f = f.select(key, some(F.when(crowded, F.transform(quarters, lambda q: _piece(of("edges"), of("odd"), of("turns"), q, reach))).otherwise(F.array("_f"))))
    return levels, f.select(key, "_f.*")


def _shared(keys: DataFrame, key: str) -> DataFrame:
    """Keys of several rows, and null. ``keys`` has the number ``_n`` of rows of each key."""
    return keys.filter((F.col("_n") > 1) | F.col(key).isNull()).select(key)


def _told(x, y, reach: float) -> tuple[Column, Column]:
    """Of a point and a polygon's piece of its tile: inside, within ``reach`` of an edge."""
    n, m = F.size("edges"), F.size("turns")
    rest = lambda c, n: F.slice(c, _FEW + 1, F.greatest(n - _FEW, F.lit(0)))
    apart = lambda e: segment_distance(x, y, *[e[c] for c in ("x0", "y0", "x1", "y1")]) <= F.lit(float(reach))
    crossed = F.col("odd") + F.when(n > _FEW, F.size(F.filter(rest("edges", n), lambda e: _to_right(e, x, y)))).otherwise(0)
    crossed = crossed + F.when(m > _FEW, F.size(F.filter(rest("turns", m), lambda v: v <= y))).otherwise(0)
    near = (n > _FEW) & F.exists(rest("edges", n), apart)
    for i in map(F.lit, range(_FEW)):
        e, v = F.get("edges", i), F.get("turns", i)
        crossed = crossed + F.when(n > i, _to_right(e, x, y).cast("int")).otherwise(0) + F.when(m > i, (v <= y).cast("int")).otherwise(0)
        near = ((n > i) & apart(e)) | near
    return crossed % 2 == 1, near


def _split(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not among ``keys``, and those whose key is."""
    k = keys.withColumnRenamed(key, "_k")
    return tuple(df.join(k, F.col(key).eqNullSafe(F.col("_k")), how) for how in ("left_anti", "left_semi"))


def points_within(points: DataFrame, polygons: DataFrame, point_id: str, distance_m: float, key: str = "polygon_id") -> DataFrame:
    """Pairs (point, polygon) with the point inside the polygon or at most ``distance_m`` away from it, holes and all parts counted.

    Polygons travel once, cut into tiles with the few edges that matter there, and a point meets its tile's pieces, which tell it all: pairs are
    told where they meet, and neither they nor whole rings travel. Only points and polygons whose key is not their own are told apart by further shuffles."""
    own_points, own_polygons, out = points.select(point_id, "x", "y"), polygons.select(key, F.filter("rings", lambda r: r.isNotNull()).alias("rings")), []
    ids = own_points.groupBy(point_id).agg(F.count(F.lit(1)).alias("_n"))
    keys = own_polygons.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size(F.flatten("rings"))).alias("_edges"))
    some_shared = lambda c: F.coalesce(F.bool_or((F.col("_n") > 1) | F.col(c).isNull()), F.lit(False))
    shared_key, most = keys.agg(some_shared(key), F.coalesce(F.max("_edges"), F.lit(0))).first()
    if shared_key:
        own_polygons, shared = _split(own_polygons, _shared(keys, key), key)
        out.append(_within_of_shared_keys(own_points, shared, point_id, distance_m, key))
    levels, pieces = _pieces(own_polygons, key, distance_m, most)
    inside, near = _told(F.col("x"), F.col("y"), distance_m)

    def met(some):
        return _near_pairs(some, levels, pieces, point_id, key).filter(inside | near)

    if ids.agg(some_shared(point_id)).first()[0]:  # even-odd over all places of such a point
        own_points, shared = _split(own_points, _shared(ids, point_id), point_id)
        odd = met(shared).select(point_id, key, inside.alias("_in"), near.alias("_near")).groupBy(point_id, key).agg(F.count_if("_in").alias("_n"), F.bool_or("_near").alias("_near"))
        out.append(odd.filter((F.col("_n") % 2 == 1) | F.col("_near")).select(point_id, key))
    df = met(own_points).select(point_id, key)
    for more in out:
        df = df.unionByName(more)
    return df


def _within_of_shared_keys(points: DataFrame, polygons: DataFrame, point_id: str, distance_m: float, key: str) -> DataFrame:
    """As ``points_within``, each pair once, for polygons of one key in several rows.

    A point far enough from a border is either inside or not, which the even-odd test tells; for the others edges are laid out in tiles of
    their own size, only in those that the distance reaches, and a point meets only the edges of its tile, never a whole ring."""
    edges = ring_edges(polygons, key, level=True).select(F.struct(key, "x0", "y0", "x1", "y1").alias("_edge"))
    boxes = _edge_boxes(edges, distance_m)
    near = _near_pairs(points, boxes, _edge_cover(boxes, distance_m), point_id, "_edge")
    apart = segment_distance(F.col("x"), F.col("y"), *[F.col("_edge")[c] for c in ("x0", "y0", "x1", "y1")])
    border = near.filter(apart <= F.lit(float(distance_m))).select(point_id, F.col("_edge")[key].alias(key))
    return border.unionByName(points_in_polygons(points, polygons, point_id, key)).distinct()


def classify_area(water: DataFrame, analysed: DataFrame, grid: Grid) -> DataFrame:
    """Cells of a polygon product: flooded inside water, dry in the rest of the analysed area."""
    w = burn(water, grid).select("row", "col", F.lit(1).alias("value"))
    a = burn(analysed, grid).select("row", "col", F.lit(0).alias("value"))
    return w.unionByName(a).groupBy("row", "col").agg(F.max("value").alias("value"))


def resample_nearest(source_cells: DataFrame, source_grid: Grid, grid: Grid, keys=("date",)) -> DataFrame:
    """Nearest-neighbour resampling onto ``grid`` (same projection). Uncovered cells are simply absent.

    A source cell knows the run of destination rows and columns whose centres fall inside it, so it is
    expanded in place: no join and no shuffle."""
    def runs(idx, near_edge, count):
        # destination index i has its centre at (i + .5) * res from the destination origin
        lo = F.ceil((near_edge + idx * F.lit(source_grid.res)) / F.lit(grid.res) - F.lit(0.5)).cast("int")
        hi = (F.ceil((near_edge + (idx + 1) * F.lit(source_grid.res)) / F.lit(grid.res) - F.lit(0.5)) - 1).cast("int")
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(count - 1))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    rows = runs(F.col("row"), F.lit(grid.ymax - source_grid.ymax), grid.height)
    cols = runs(F.col("col"), F.lit(source_grid.xmin - grid.xmin), grid.width)
    return (source_cells.filter(F.col("value") != 255).withColumn("_r", F.explode(rows)).withColumn("_c", F.explode(cols))
            .select(*keys, F.col("_r").alias("row"), F.col("_c").alias("col"), "value"))


def resample_from_lonlat(source_cells: DataFrame, source_grid: Grid, grid: Grid, keys=("date",)) -> DataFrame:
    """Nearest-neighbour resampling of a longitude/latitude raster onto the projected ``grid``.

    Destination centres are generated in parallel, taken to the source projection and looked up by cell."""
    i = F.col("id")
    d = source_cells.sparkSession.range(grid.size).select(F.floor(i / grid.width).cast("int").alias("row"), F.pmod(i, F.lit(grid.width)).cast("int").alias("col"))
    lon, lat = to_lonlat(cell_x(F.col("col"), grid), cell_y(F.col("row"), grid))
    d = d.select("row", "col", cell_row(lat, source_grid).alias("_r"), cell_col(lon, source_grid).alias("_c"))
    s = source_cells.filter(F.col("value") != 255).select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return d.filter(inside_grid(F.col("_r"), F.col("_c"), source_grid)).join(s, ["_r", "_c"]).select(*keys, "row", "col", "value")


def road_density(edges: DataFrame, nodes: DataFrame, polygons: DataFrame, area: DataFrame) -> DataFrame:
    """Road km per km2 of each area, densest first; a road counts where both its ends lie inside."""
    inside = points_in_polygons(nodes, polygons, "node_id")
    u = inside.withColumnRenamed("node_id", "u")
    v = inside.withColumnRenamed("node_id", "v")
    km = (edges.select("u", "v", "length_m").join(u, "u").join(v, ["v", "polygon_id"])
          .groupBy("polygon_id").agg((F.sum("length_m") / 1000).alias("km")))
    out = area.join(km, "polygon_id", "left").withColumn("km", F.coalesce("km", F.lit(0.0)))
    return out.select("polygon_id", F.rint("area_km2").alias("area_km2"), F.rint("km").alias("road_km"),
                      (F.rint(F.col("km") / F.col("area_km2") * 100) / 100).alias("road_km_per_km2")
                      ).orderBy(F.desc("road_km_per_km2"), "polygon_id")
