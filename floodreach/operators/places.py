"""From tagged map features to roads, villages and shelter candidates."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import ring_interior_point, to_lonlat
from ..functions.rounding import half_even

# Tags that make a feature a place or a shelter candidate. None stands for "any value".
PLACE_TAGS = {"place": ["village", "hamlet", "isolated_dwelling", "neighbourhood", "quarter", "suburb", "town"]}
SHELTER_TAGS = {
    "amenity": ["school", "college", "university", "hospital", "clinic", "doctors", "townhall", "shelter", "community_centre"],
    "healthcare": None,
    "building": ["school", "hospital"],
    "emergency": ["assembly_point"],
    "social_facility": ["shelter"],
    "office": ["government"],
}


def tagged(features: DataFrame, tags: dict[str, list[str] | None]) -> DataFrame:
    """Features whose ``tags`` map matches any of the wanted tags."""
    keep = F.lit(False)
    for key, values in tags.items():
        v = F.try_element_at("tags", F.lit(key))
        keep = keep | F.coalesce(v.isNotNull() if values is None else v.isin(values), F.lit(False))
    return features.filter(keep)


def first_of(values):
    """First entry of a multi-valued attribute."""
    return F.get(values, F.lit(0))


def to_roads(ways: DataFrame) -> DataFrame:
    """Edge table from raw ways ``(u, v, key, length, highway[], name[], geom)``."""
    return ways.select(F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"), F.col("key").cast("string")).alias("edge_id"),
                       F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), half_even(F.col("length"), 1).alias("length_m"),
                       first_of("highway").alias("highway"), first_of("name").alias("name"), "geom")


def _tag(name):
    return F.try_element_at("tags", F.lit(name))


def to_villages(features: DataFrame) -> DataFrame:
    """Village points from place features ``(id, tags, ring)``; areas give an interior point."""
    x, y = ring_interior_point(F.col("ring"))
    return tagged(features, PLACE_TAGS).select(
        F.concat(F.lit("osm"), F.col("id").cast("string")).alias("village_id"), F.coalesce(_tag("name"), _tag("name:en"), F.lit("(unnamed)")).alias("name"),
        _tag("name:bn").alias("name_bn"), _tag("place").alias("place"), F.lit("OpenStreetMap").alias("source"), x.alias("x"), y.alias("y"))


def shelter_kind():
    """First non-blank of the tag columns in order; a plain "yes" says only which column it was."""
    cols = list(SHELTER_TAGS)
    kinds = [F.nullif(F.when(_tag(c) == "yes", c).otherwise(_tag(c)), F.lit("")) for c in cols]
    return F.coalesce(*kinds, F.lit(""))


def to_shelters(features: DataFrame) -> DataFrame:
    x, y = ring_interior_point(F.col("ring"))
    s = tagged(features, SHELTER_TAGS).select("id", "tags", x.alias("x"), y.alias("y"))
    lon, lat = to_lonlat(F.col("x"), F.col("y"))
    return s.select(F.concat(F.lit("osm"), F.col("id").cast("string")).alias("shelter_id"), F.coalesce(_tag("name"), F.lit("(unnamed)")).alias("name"),
                    shelter_kind().alias("type"), half_even(lat, 6).alias("lat"), half_even(lon, 6).alias("lon"), F.lit("OpenStreetMap").alias("source"),
                    F.lit("").alias("verified"), F.lit("").alias("notes"))


def verified_only(shelters: DataFrame) -> DataFrame:
    """Hand-checked shelters; fails when the list has none."""
    if "verified" not in shelters.columns:
        return shelters
    # Accepted spellings of yes.
    s = shelters.filter(F.lower(F.col("verified").cast("string")).isin("yes", "y", "true", "1"))
    if s.isEmpty():
        raise ValueError("no shelter is marked verified")
    return s
