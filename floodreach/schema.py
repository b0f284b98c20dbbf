"""Declared schemas of the domain tables."""
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


NODES = "node_id string, x double, y double"
EDGES = ("edge_id string, u string, v string, length_m double, highway string, name string, "
         "geom array<struct<x:double,y:double>>")
CELLS = "date date, source string, row int, col int, value int"
MANIFEST = "date date, source string, path string, note string"
COMMITS = f"{MANIFEST}, version bigint"
VILLAGES = "village_id string, name string, name_bn string, place string, source string, population bigint, x double, y double"
SHELTERS_CSV = "shelter_id string, name string, type string, lat double, lon double, source string, verified string, notes string"
ROAD_STATUS = "threshold double, date date, edge_id string, frac_flooded double, frac_unknown double, status string"
VILLAGE_STATUS = ("threshold double, date date, village_id string, status string, dist_to_shelter_m double, "
                  "nearest_shelter_id string")
REPORTS = ("place_name string, place_name_bn string, upazila string, date_reported string, reported_isolated string, "
           "source_name string, source_url string, village_id string, notes string")
RAINFALL_WIDE = "date date, sunamganj_mm double, meghalaya_upstream_mm double"
FLOOD_AREA = "date date, flooded_km2 double, unknown_pct double, metric string"

STATUSES = ("connected", "isolated", "uncertain", "boat_dependent")
