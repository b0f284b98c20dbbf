"""Check-points along roads, what the merged flood maps say there, and the road state that follows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import cell_col, cell_row, inside_grid, road_state
from ..functions.geometry import line_length, segment_lengths
from ..functions.rounding import half_even
from ..params import FLOODED, Grid, Params
from .common import distinct_values


def point_count(length, spacing) -> Column:
    return F.greatest(F.lit(2), F.ceil(length / F.lit(float(spacing))).cast("int") + 1)


def check_points(edges: DataFrame, spacing: float = 20.0) -> DataFrame:
    """Evenly spaced points along each line, both ends included: edge_id, k, x, y.

    A line is first cut into its segments, each of which produces only its own points, so long lines spread
    over rows instead of dragging their geometry behind every point."""
    starts = F.aggregate("_len", F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))
    seg = (edges.select("edge_id", "geom", segment_lengths(F.col("geom")).alias("_len")).withColumn("_s", starts)
           .withColumn("_total", F.element_at("_s", -1)).withColumn("_n", point_count(F.col("_total"), spacing))
           .select("edge_id", "_total", "_n", F.explode(F.transform("_len", lambda d, i: F.struct(
               F.get("geom", i).alias("a"), F.get("geom", i + 1).alias("b"), F.get("_s", i).alias("s"), d.alias("d"),
               F.get("_s", i + 1).alias("e"), (i == F.size("_len") - 1).alias("last"), (i == 0).alias("first")))).alias("g")))
    gaps = F.col("_n") - 1

    def first_point(s):
        return F.when(F.col("_total") == 0, F.lit(0)).otherwise(F.ceil(s * gaps / F.col("_total")).cast("int"))

    lo = F.when(F.col("g.first"), F.lit(0)).otherwise(first_point(F.col("g.s")))
    hi = F.when(F.col("g.last"), gaps).otherwise(first_point(F.col("g.e")) - 1)
    pts = (seg.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") <= F.col("_hi"))
           .withColumn("k", F.explode(F.sequence("_lo", "_hi"))))
    at = F.col("_total") * F.col("k") / gaps
    t = F.when(F.col("g.d") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("g.s")) / F.col("g.d"))))
    return pts.select("edge_id", "k", (F.col("g.a.x") + (F.col("g.b.x") - F.col("g.a.x")) * t).alias("x"),
                      (F.col("g.a.y") + (F.col("g.b.y") - F.col("g.a.y")) * t).alias("y"))


def lookup(points: DataFrame, merged: DataFrame, grid: Grid, dates: DataFrame | None = None) -> DataFrame:
    """Class of the cell under each point on each of ``dates`` (else of ``merged``), unknown where no cell is stored."""
    p = (points.withColumn("row", cell_row(F.col("y"), grid)).withColumn("col", cell_col(F.col("x"), grid))
         .withColumn("date", F.explode(distinct_values(merged if dates is None else dates, "date"))))
    return (p.join(merged.select("date", "row", "col", "value"), ["date", "row", "col"], "left")
            .withColumn("value", F.coalesce(F.col("value"), F.lit(255))))


def edge_fractions(edges: DataFrame, merged: DataFrame, grid: Grid, spacing: float = 20.0, dates: DataFrame | None = None) -> DataFrame:
    """Share of flooded and unknown check-points per (date, edge_id), for every edge on every date.

    Points carry no date and collapse to counts per (edge, cell), so one join on the cell serves all dates.
    Unknown is what the join did not find: total minus known, with the total known from the geometry. Edges
    without any known point enter the same aggregation as zero rows instead of through another join.
    ``dates`` lists the registered dates: on one without any known cell all edges are unknown."""
    at = (check_points(edges, spacing).select("edge_id", cell_row(F.col("y"), grid).alias("row"), cell_col(F.col("x"), grid).alias("col"))
          .filter(inside_grid(F.col("row"), F.col("col"), grid))
          .groupBy("edge_id", "row", "col").agg(F.count(F.lit(1)).cast("int").alias("n")))
    zero = F.lit(0)
    hit = merged.join(at, ["row", "col"]).select("date", "edge_id", (F.col("n") * (F.col("value") == FLOODED).cast("int")).alias("f"),
                                                 F.col("n").alias("k"), zero.alias("total"))
    days = distinct_values(merged if dates is None else dates, "date")
    base = edges.select(F.explode(days).alias("date"), "edge_id", zero.alias("f"), zero.alias("k"),
                        point_count(line_length(F.col("geom")), spacing).alias("total"))
    # dealt out before the sums: almost every row is a group of its own, which no task should hold for a whole input partition
    g = hit.unionByName(base).repartition("edge_id").groupBy("date", "edge_id").agg(F.sum("f").alias("f"), F.sum("k").alias("k"), F.sum("total").alias("n"))
    return g.select("date", "edge_id", (F.col("f") / F.col("n")).alias("frac_flooded"), ((F.col("n") - F.col("k")) / F.col("n")).alias("frac_unknown"))


def road_status(fractions: DataFrame, p: Params = Params()) -> DataFrame:
    """Road state at every threshold, decided on unrounded fractions, which are then stored to 3 decimals."""
    states = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), road_state(
        F.col("frac_flooded"), F.col("frac_unknown"), F.lit(float(t)), F.lit(p.unknown_majority)).alias("status")) for t in p.thresholds])
    return fractions.select("date", "edge_id", half_even(F.col("frac_flooded"), 3).alias("frac_flooded"),
                            half_even(F.col("frac_unknown"), 3).alias("frac_unknown"), F.explode(states).alias("s")
                            ).select("s.threshold", "date", "edge_id", "frac_flooded", "frac_unknown", "s.status")


def status_column(threshold: float) -> str:
    return f"status_{round(threshold * 100)}"


def road_status_wide(status: DataFrame, p: Params = Params()) -> DataFrame:
    """Export shape: one status column per threshold."""
    cols = [F.max(F.when(F.col("threshold") == F.lit(float(t)), F.col("status"))).alias(status_column(t)) for t in p.thresholds]
    return status.groupBy("date", "edge_id").agg(F.first("frac_flooded").alias("frac_flooded"), F.first("frac_unknown").alias("frac_unknown"), *cols)


def cut_km(status: DataFrame, edges: DataFrame, p: Params = Params()) -> DataFrame:
    """Cut road km per date and threshold, and unknown km at the last threshold."""
    j = status.join(edges.select("edge_id", "length_m"), "edge_id")

    def km(state, t):
        hit = (F.col("threshold") == F.lit(float(t))) & (F.col("status") == state)
        return half_even(F.coalesce(F.sum(F.when(hit, F.col("length_m"))), F.lit(0.0)) / 1000, 1)

    cols = [km("cut", t).alias(f"cut_km_{round(t * 100)}") for t in p.thresholds]
    return j.groupBy("date").agg(*cols, km("unknown", p.thresholds[-1]).alias("unknown_km"))


def network_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return edges.agg(F.count(F.lit(1)).alias("segments"), F.rint(F.sum("length_m") / 1000).alias("km")).select(n.alias("junctions"), "segments", "km")
