"""Domain tables projected from the generic test tables, in Spark. ``checks.oracle`` states the same rules in SQL."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodreach import Grid
from floodreach.functions.geometry import to_lonlat

DAY0 = "2022-06-01"
X0, Y0 = 324000.0, 2700000.0  # where the lattice sits when lon/lat are needed


def base_class(d, r, c):
    wet = ((r % 64 - 50) * (r % 64 - 50) + (c - 22) * (c - 22) < 40 + 90 * (5 - F.abs(d - 5))) & ((r * 5 + c * 3 + d) % 11 != 0)
    return F.when((r * 31 + c * 17 + d * 13) % 23 == 0, 255).when(wet, 1).otherwise(0)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return self.table("part").count()

    @cached_property
    def grid(self) -> Grid:
        h = max(64, -(-(self.n // 50) * 200 // 160) + 1)
        return Grid(0.0, h * 160.0, 64, h, 160.0)

    @property
    def nodes(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(k.alias("node_id"), ((k % 50) * 200 + (s % 5) * 10).cast("double").alias("x"),
                                         (F.floor(k / 50) * 200 + (s % 7) * 10).cast("double").alias("y"))

    @property
    def edges(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size")
        east = F.when((k % 50 < 49) & ((k * 7 + s) % 10 < 8) & (k + 1 < self.n), k + 1)
        north = F.when(((k * 3 + s) % 10 < 8) & (k + 50 < self.n), k + 50)
        links = self.table("part").select(k.alias("u"), F.explode(F.array_compact(F.array(east, north))).alias("v"))
        a = self.nodes.select(F.col("node_id").alias("u"), F.struct("x", "y").alias("a"))
        b = self.nodes.select(F.col("node_id").alias("v"), F.struct("x", "y").alias("b"))
        e = links.join(a, "u").join(b, "v")
        dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
        mm = F.floor(F.sqrt(dx * dx + dy * dy) * 1000)
        return e.select(F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"), F.lit("0")).alias("edge_id"), "u", "v",
                        (mm / 1000.0).alias("length_m"), F.when(F.col("u") % 3 == 0, F.array("b", "a")).otherwise(F.array("a", "b")).alias("geom"))

    @property
    def lattice(self) -> DataFrame:
        """Every (d, r, c) with its base class: grows with the part table through the grid height."""
        h = self.grid.height
        i = F.col("id")
        t = self.spark.range(10 * h * 64).select(F.floor(i / (h * 64)).cast("int").alias("d"), F.pmod(F.floor(i / 64), F.lit(h)).cast("int").alias("r"), (i % 64).cast("int").alias("c"))
        return t.withColumn("b", base_class(F.col("d"), F.col("r"), F.col("c")))

    @property
    def observations(self) -> DataFrame:
        """Every row of lineitem as an observation of a (day, source, cell), copies included."""
        h = self.grid.height
        src = F.when(F.col("l_linenumber") % 3 == 0, "sentinel1").when(F.col("l_linenumber") % 3 == 1, "unosat").otherwise("modis")
        t = self.table("lineitem").select(
            (F.col("l_orderkey") % 10).cast("int").alias("d"), src.alias("source"), (F.col("l_partkey") % h).cast("int").alias("r"),
            ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 64).cast("int").alias("c"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        r, c, b = F.col("r"), F.col("c"), base_class(F.col("d"), F.col("r"), F.col("c"))
        flip = ((F.col("source") == "modis") & ((r + c) % 7 == 0)) | ((F.col("source") == "unosat") & ((r + 2 * c) % 9 == 0))
        t = t.withColumn("value", F.when((F.col("l_returnflag") == "A") | (b == 255), 255).when(flip, 1 - b).otherwise(b))
        return t.withColumn("cls", F.when(F.col("value") == 255, 2).otherwise(F.col("value")))

    def _one_a_cell(self, last) -> DataFrame:
        v = F.col("v")
        return self.observations.groupBy("d", "source", "r", "c").agg(last.alias("v")).select("d", "source", "r", "c", F.when(v == 2, 255).otherwise(v).cast("int").alias("value"))

    @property
    def hits(self) -> DataFrame:
        """One observation per (day, source, cell) from lineitem: of the last order and line, then of the larger class."""
        # order key, line and class packed in one integer, which keeps the aggregate a hash one; lines are 1 to 7, so any order key below 2^58 fits
        return self._one_a_cell(F.max((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + F.col("cls")) % 4)

    @property
    def hits_by_row(self) -> DataFrame:
        """As ``hits``, copies settled by the full row: of the last order, line, part and supplier, then of the larger class."""
        row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cls")  # too wide for one integer at every scale
        return self._one_a_cell(F.max(F.when(F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull(), row))["cls"])

    def _cells(self, hits: DataFrame) -> DataFrame:
        dem = self.lattice.filter((F.col("r") + F.col("c")) % 5 != 0).select("d", F.lit("dem_estimate").alias("source"), "r", "c", F.col("b").alias("value"))
        blind = self.table("part").select(F.lit(10).alias("d"), F.explode(F.array(F.lit("sentinel1"), F.lit("unosat"))).alias("source"),
                                          (F.col("p_partkey") % self.grid.height).cast("int").alias("r"), (F.col("p_size") % 64).cast("int").alias("c"), F.lit(255).alias("value")).distinct()
        t = hits.unionByName(dem).unionByName(blind)  # day 10 is registered, and nothing is known of it
        return t.select(F.date_add(F.lit(DAY0).cast("date"), F.col("d")).alias("date"), "source", F.col("r").alias("row"), F.col("c").alias("col"), F.col("value").cast("int").alias("value"))

    @property
    def cells(self) -> DataFrame:
        return self._cells(self.hits)

    @property
    def cells_by_row(self) -> DataFrame:
        return self._cells(self.hits_by_row)

    def _west(self, key, every):
        return F.when(every, -(100 + (key % 13) * 100).cast("double"))

    @property
    def villages(self) -> DataFrame:
        k = F.col("c_custkey")
        c = self.table("customer").select(k, "c_name", "c_acctbal", ((k * 37) % self.n).alias("node_id")).join(self.nodes, "node_id")
        pop = F.when(k % 17 != 0, F.floor(F.abs("c_acctbal")))
        return c.select(F.format_string("v%06d", k).alias("village_id"), F.col("c_name").alias("name"), pop.alias("population"),
                        F.coalesce(self._west(k, k % 10 == 0), F.col("x") + 30).alias("x"), (F.col("y") + 40).alias("y"))

    @property
    def shelters(self) -> DataFrame:
        k = F.col("s_suppkey")
        s = self.table("supplier").select(k, "s_name", ((k * 113 + self.n // 2) % self.n).alias("node_id")).join(self.nodes, "node_id")
        return s.select(F.format_string("s%05d", k).alias("shelter_id"), F.col("s_name").alias("name"), F.coalesce(self._west(k, k % 20 == 0), F.col("x") + 30).alias("x"), (F.col("y") + 40).alias("y"))

    @property
    def status(self) -> DataFrame:
        """Village status by event type, the latest event of the day."""
        kind = (F.when(F.col("event_type") == "error", "isolated").when(F.col("event_type").isin("click", "view", "signup"), "connected").otherwise("uncertain"))
        boat = F.when(F.col("user_id") % 13 == 0, "boat_dependent")
        e = self.table("events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
        e = e.select("user_id", "date", F.col("m.event_type").alias("event_type"))
        return e.select(F.format_string("v%06d", F.col("user_id")).alias("village_id"), "date", F.coalesce(boat, kind).alias("status"))

    @property
    def rain(self) -> DataFrame:
        e = self.table("events")
        return e.select("ts", F.when(F.col("user_id") % 2 == 0, "sunamganj").otherwise("meghalaya_upstream").alias("box"), (F.col("user_id") % 5).alias("cell"), F.col("value").alias("mm_per_h"))

    @property
    def backscatter(self) -> DataFrame:
        h = self.grid.height
        cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint") % 400
        t = self.table("lineitem").select((F.col("l_orderkey") % 10).cast("int").alias("d"), (F.col("l_partkey") % h).cast("int").alias("row"),
                                          ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 64).cast("int").alias("col"), (F.col("l_linenumber") % 4).cast("int").alias("relative_orbit"),
                                          F.col("l_shipdate").alias("t"), cents.alias("cents"), "l_returnflag")
        b = base_class(F.col("d"), F.col("row"), F.col("col"))
        vv = F.when(b == 1, -22.0).otherwise(-10.0) + F.col("cents") / 100.0
        return t.select(F.date_add(F.lit(DAY0).cast("date"), F.col("d")).alias("date"), "row", "col", "relative_orbit", "t",
                        F.when(F.col("cents") % 37 != 0, vv).alias("vv_db"), (F.lit(-9.0) + F.col("cents") / 200.0).alias("dry_db"),
                        ((F.col("row") * 3 + F.col("col")) % 8).cast("double").alias("slope_deg"), F.col("cents").alias("qa"))

    @property
    def dem(self) -> DataFrame:
        """Bowl-shaped elevation, roughened by the part table, with a few cells missing."""
        h = self.grid.height
        size = self.table("part").select(F.col("p_partkey").alias("k"), "p_size")
        t = self.spark.range(h * 64).select((F.col("id") % self.n).alias("k"), F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col")).join(size, "k")
        r, c = F.col("row"), F.col("col")
        z = (F.abs(r % 64 - 50) + F.abs(c - 22)) / 8.0 + (F.col("p_size") % 16) / 16.0
        return t.select("row", "col", z.alias("elevation")).filter((r * 7 + c) % 29 != 0)

    @property
    def reports(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("od"))
        c = self.table("customer").select("c_custkey", "c_name")
        j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        k, cut = F.col("c_custkey"), 10 + F.col("c_custkey") % 9
        name = F.when(k % 3 == 0, F.concat(F.substring(F.col("c_name"), F.lit(1), cut - 1), F.substring(F.col("c_name"), cut + 1, F.lit(30)))).otherwise(F.col("c_name"))
        return j.select("o_orderkey", name.alias("place_name"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.dayofmonth("od") - 1)), "yyyy-MM-dd").alias("date_reported"),
                        F.when(F.col("o_orderkey") % 4 == 0, "no").when(F.col("o_orderkey") % 4 == 1, "").otherwise("yes").alias("reported_isolated"),
                        F.when(F.col("o_orderkey") % 7 == 0, F.format_string("v%06d", k)).otherwise("").alias("village_id"))

    @property
    def polygons(self) -> DataFrame:
        return self.polygons_around(self.nodes)

    def polygons_around(self, p: DataFrame) -> DataFrame:
        """A diamond with a square hole around every junction."""
        x, y = F.col("x"), F.col("y")
        size = (303 + (F.col("node_id") % 7) * 150).cast("double")
        pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
        outer = F.array(pt(x - size, y), pt(x, y - size), pt(x + size, y), pt(x, y + size))
        hole = F.array(pt(x - 93, y - 93), pt(x + 93, y - 93), pt(x + 93, y + 93), pt(x - 93, y + 93))
        return p.select(F.col("node_id").alias("polygon_id"), F.array(outer, hole).alias("rings"), size.alias("size"))

    def with_lonlat(self, df: DataFrame) -> DataFrame:
        lon, lat = to_lonlat(F.col("x") + X0, F.col("y") + Y0)
        return df.withColumn("lon", lon).withColumn("lat", lat)
