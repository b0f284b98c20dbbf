"""Geometry as column expressions over ``x``/``y`` doubles and ``array<struct<x,y>>`` lines and rings."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# WGS84 ellipsoid and UTM zone 46 north.
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _E0, _LON0 = 0.9996, 500000.0, 93.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64 + _N ** 6 / 256)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
# Krueger series to sixth order in the third flattening (Karney 2011); the fourth is off by some 5e-8 m, which may turn a rounding to mm.
_ALPHA = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180 - 127 * _N ** 5 / 288 + 7891 * _N ** 6 / 37800,
          13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440 + 281 * _N ** 5 / 630 - 1983433 * _N ** 6 / 1935360,
          61 * _N ** 3 / 240 - 103 * _N ** 4 / 140 + 15061 * _N ** 5 / 26880 + 167603 * _N ** 6 / 181440,
          49561 * _N ** 4 / 161280 - 179 * _N ** 5 / 168 + 6601661 * _N ** 6 / 7257600,
          34729 * _N ** 5 / 80640 - 3418889 * _N ** 6 / 1995840,
          212378941 * _N ** 6 / 319334400)
_BETA = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360 - 81 * _N ** 5 / 512 + 96199 * _N ** 6 / 604800,
         _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440 + 46 * _N ** 5 / 105 - 1118711 * _N ** 6 / 3870720,
         17 * _N ** 3 / 480 - 37 * _N ** 4 / 840 - 209 * _N ** 5 / 4480 + 5569 * _N ** 6 / 90720,
         4397 * _N ** 4 / 161280 - 11 * _N ** 5 / 504 - 830251 * _N ** 6 / 7257600,
         4583 * _N ** 5 / 161280 - 108847 * _N ** 6 / 3991680,
         20648693 * _N ** 6 / 638668800)
_DELTA = (2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45 + 26 * _N ** 5 / 45 - 2854 * _N ** 6 / 675,
          7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45 + 2704 * _N ** 5 / 315 + 2323 * _N ** 6 / 945,
          56 * _N ** 3 / 15 - 136 * _N ** 4 / 35 - 1262 * _N ** 5 / 105 + 73814 * _N ** 6 / 2835,
          4279 * _N ** 4 / 630 - 332 * _N ** 5 / 35 - 399572 * _N ** 6 / 14175,
          4174 * _N ** 5 / 315 - 144838 * _N ** 6 / 6237,
          601676 * _N ** 6 / 22275)


def _series(coef, first, second, start):
    total = start
    for j, c in enumerate(coef, 1):
        total = total + F.lit(c) * first(F.lit(2.0 * j)) * second(F.lit(2.0 * j))
    return total


def to_utm(lon, lat) -> tuple[Column, Column]:
    """Longitude/latitude in degrees to easting/northing in metres."""
    s, lam = F.sin(F.radians(lat)), F.radians(lon - F.lit(_LON0))
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north = _series(_ALPHA, lambda k: F.sin(k * xi), lambda k: F.cosh(k * eta), xi)
    east = _series(_ALPHA, lambda k: F.cos(k * xi), lambda k: F.sinh(k * eta), eta)
    return F.lit(_E0) + F.lit(_K0 * _RECT) * east, F.lit(_K0 * _RECT) * north


def to_lonlat(x, y) -> tuple[Column, Column]:
    """Easting/northing in metres to longitude/latitude in degrees."""
    xi, eta = y / F.lit(_K0 * _RECT), (x - F.lit(_E0)) / F.lit(_K0 * _RECT)
    neg = tuple(-b for b in _BETA)
    xi1 = _series(neg, lambda k: F.sin(k * xi), lambda k: F.cosh(k * eta), xi)
    eta1 = _series(neg, lambda k: F.cos(k * xi), lambda k: F.sinh(k * eta), eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    one = F.lit(1.0)
    lat = _series(_DELTA, lambda k: F.sin(k * chi), lambda k: one, chi)
    return F.lit(_LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def segment_lengths(line) -> Column:
    """Length of each segment of a line (empty for fewer than two vertices)."""
    heads = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
    tails = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))


def line_length(line) -> Column:
    return F.aggregate(segment_lengths(line), F.lit(0.0), lambda acc, d: acc + d)


def _ring_pairs(ring) -> Column:
    """Consecutive vertex pairs with the ring closed."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("p"), shifted.alias("q"))


def ring_area(ring) -> Column:
    """Unsigned shoelace area."""
    return F.abs(F.aggregate(_ring_pairs(ring), F.lit(0.0), lambda acc, s: acc + (
        s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]))) / F.lit(2.0)


def ring_centroid(ring) -> tuple[Column, Column]:
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def step(acc, s):
        w = s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]
        return F.struct((acc["w"] + w).alias("w"),
                        (acc["sx"] + (s["p"]["x"] + s["q"]["x"]) * w).alias("sx"),
                        (acc["sy"] + (s["p"]["y"] + s["q"]["y"]) * w).alias("sy"))

    acc = F.aggregate(_ring_pairs(ring), start, step)
    return acc["sx"] / (acc["w"] * 3), acc["sy"] / (acc["w"] * 3)


def _let(value, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _widest_span(edges, y, otherwise) -> Column:
    """(x, y): middle of the widest inside span of the line at height ``y``, the eastern one of equal spans; ``otherwise`` without a span."""
    crossing = F.filter(edges, lambda s: (s["p"]["y"] > y) != (s["q"]["y"] > y))
    xs = F.array_sort(F.transform(crossing, lambda s: s["p"]["x"] + (y - s["p"]["y"]) / (s["q"]["y"] - s["p"]["y"]) * (s["q"]["x"] - s["p"]["x"])))

    def widest(xs):
        spans = F.transform(F.filter(xs, lambda x, i: (i % 2 == 0) & (i + 1 < F.size(xs))), lambda x, k: F.struct(
            F.round(F.get(xs, k * 2 + 1) - x, 6).alias("w"), ((F.get(xs, k * 2 + 1) + x) / 2).alias("mid")))
        return F.when(F.size(xs) >= 2, F.struct(F.array_max(spans)["mid"].alias("x"), y.alias("y"))).otherwise(otherwise)

    return _let(xs, widest)


def ring_interior_point(ring) -> tuple[Column, Column]:
    """Middle of the widest inside span on the horizontal line halfway up the ring.

    A single point or a line passes through as its first vertex."""
    ys = F.transform(ring, lambda p: p["y"])
    first = F.get(ring, F.lit(0))
    first = F.struct(first["x"].alias("x"), first["y"].alias("y"))
    point = _let((F.array_min(ys) + F.array_max(ys)) / 2, lambda y: _widest_span(_ring_pairs(ring), y, first))
    point = F.when(F.size(ring) >= 3, point).otherwise(first)
    return point["x"], point["y"]


def ring_contains(ring, x, y) -> Column:
    """Even-odd test."""
    hits = F.filter(_ring_pairs(ring), lambda s: ((s["p"]["y"] > y) != (s["q"]["y"] > y)) & (
        x < s["p"]["x"] + (y - s["p"]["y"]) / (s["q"]["y"] - s["p"]["y"]) * (s["q"]["x"] - s["p"]["x"])))
    return F.size(hits) % 2 == 1


def ring_distance(ring, x, y) -> Column:
    """Distance from a point to the ring, 0 inside: ``<= d`` is membership of the area buffered by d."""
    def to_segment(s):
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        l2 = dx * dx + dy * dy
        t = F.when(l2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
            (x - s["p"]["x"]) * dx + (y - s["p"]["y"]) * dy) / l2)))
        return distance(x, y, s["p"]["x"] + t * dx, s["p"]["y"] + t * dy)

    return F.when(ring_contains(ring, x, y), F.lit(0.0)).otherwise(
        F.array_min(F.transform(_ring_pairs(ring), to_segment)))


def _depth(rings, i) -> Column:
    """How many of the other rings hold the ``i``-th one, told by its first vertex."""
    at = F.get(F.get(rings, i), F.lit(0))
    return F.size(F.filter(rings, lambda other, j: (j != i) & ring_contains(other, at["x"], at["y"])))


def polygon_measures(rings) -> tuple[Column, Column, Column]:
    """Area and centroid of all rings together: a ring inside an odd number of others is a hole, any other a part of its own.

    The way a ring runs does not matter; rings may touch but not cross. Without any area the centroid is null."""
    def part(ring, i):
        sign = F.when(_depth(rings, i) % 2 == 0, 1.0).otherwise(-1.0)
        x, y = ring_centroid(ring)
        a = sign * ring_area(ring)
        return F.struct(a.alias("a"), F.when(a == 0, 0.0).otherwise(a * x).alias("x"), F.when(a == 0, 0.0).otherwise(a * y).alias("y"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in "axy"])
    total = F.aggregate(F.transform(rings, part), zero, lambda acc, p: F.struct(*[(acc[c] + p[c]).alias(c) for c in "axy"]))
    return total["a"], F.try_divide(total["x"], total["a"]), F.try_divide(total["y"], total["a"])


def polygon_interior_point(rings) -> tuple[Column, Column]:
    """Middle of the widest inside span of a horizontal line through all rings, the eastern one of equal spans.

    The line lies midway between the two vertex heights around half height, so it meets no vertex. Rings without height pass
    through as their first vertex."""
    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
    first = F.get(F.get(rings, F.lit(0)), F.lit(0))
    first = F.struct(first["x"].alias("x"), first["y"].alias("y"))

    def between(hs):
        half = lambda: (F.get(hs, F.lit(0)) + F.element_at(hs, -1)) / 2
        return (F.array_max(F.filter(hs, lambda h: h <= half())) + F.array_min(F.filter(hs, lambda h: h > half()))) / 2

    y = _let(heights, lambda hs: F.when(F.size(hs) > 0, between(hs)))
    point = _let(y, lambda y: _widest_span(F.flatten(F.transform(rings, _ring_pairs)), y, first))
    return point["x"], point["y"]


def segment_distance(px, py, x0, y0, x1, y1) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    t = F.when(l2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / l2)))
    return distance(px, py, x0 + t * dx, y0 + t * dy)


def merge_lines(lines) -> Column:
    """Concatenate consecutive lines that already run head to tail, dropping repeated joints."""
    flat = F.flatten(lines)
    return F.filter(flat, lambda p, i: (i == 0) | (p != F.get(flat, i - 1)))
