"""Questions asked of finished results: what holds on a chosen day."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import notice_text, supply_left


def observation_for_day(days: DataFrame, observations: DataFrame) -> DataFrame:
    """Latest observation on or before each day, else the earliest one: day, obs_date.

    Observation dates are one short sorted array, searched inside the row; no range join."""
    obs = observations.select("date").distinct().agg(F.sort_array(F.collect_set("date")).alias("v")).scalar()
    d = days.select("day").distinct().withColumn("_o", obs)
    past = F.array_max(F.filter("_o", lambda o: o <= F.col("day")))
    return d.select("day", F.coalesce(past, F.array_min("_o")).alias("obs_date"))


def status_as_of(days: DataFrame, status: DataFrame, villages: DataFrame) -> DataFrame:
    """Status of every village as seen on each day; a village without a row that date is uncertain."""
    obs = observation_for_day(days, status)
    axis = obs.agg(F.sort_array(F.collect_set(F.struct("day", "obs_date"))).alias("v")).scalar()
    v = villages.select("village_id", "population", F.explode(axis).alias("a")).select("village_id", "population", "a.day", F.col("a.obs_date").alias("date"))
    s = status.select("village_id", "date", "status")
    return (v.join(s, ["village_id", "date"], "left")
            .select("day", F.col("date").alias("obs_date"), "village_id", "population", F.coalesce("status", F.lit("uncertain")).alias("status_now")))


def isolated_now(as_of: DataFrame) -> DataFrame:
    iso = F.col("status_now") == "isolated"
    return as_of.groupBy("day", "obs_date").agg(F.count_if(iso).alias("villages"), F.coalesce(F.sum(F.when(iso, F.col("population"))), F.lit(0)).alias("people"))


def peak_day(status: DataFrame) -> DataFrame:
    """Date with most isolated villages, earliest on ties."""
    n = status.filter(F.col("status") == "isolated").groupBy("date").agg(F.count(F.lit(1)).alias("villages"))
    return n.agg(F.max_by("date", F.struct("villages", -F.unix_date("date"))).alias("date"), F.max("villages").alias("villages"))


def routes_available(routes: DataFrame, asked: DataFrame) -> DataFrame:
    """Routes that existed on or before the asked day; ``asked`` is (village_id, day).

    A route table without dates keeps all its routes."""
    j = asked.join(routes, "village_id")
    return j.filter(F.col("date") <= F.col("day")) if "date" in routes.columns else j


def largest_villages(villages: DataFrame, k: int = 10) -> DataFrame:
    """Top-k report by population."""
    return villages.orderBy(F.col("population").desc_nulls_last(), "village_id").limit(k).select("village_id", "name", "population")


def village_card(summary: DataFrame, routes: DataFrame, days: DataFrame, lang: str = "en") -> DataFrame:
    """Panel of each isolated village on each asked day (village_id, day): route, supply left, notice."""
    usable = (routes_available(routes, days).groupBy("village_id", "day")
              .agg(F.min_by(F.struct("length_m", "shelter_name"), F.struct("date", "shelter_id")).alias("r")))
    s = summary.filter(F.col("outcome") == "isolated").join(days, "village_id").join(usable, ["village_id", "day"], "left")
    left, urgent = supply_left(F.col("aid_deadline"), F.col("isolated_from_earliest"), F.col("day"))
    km = F.col("r.length_m") / 1000
    bn = F.col("name_bn") if "name_bn" in summary.columns else F.lit(None).cast("string")
    text = notice_text(F.col("name"), bn, F.col("last_connected"), F.col("isolated_from_earliest"), F.col("first_isolated"), km, F.col("r.shelter_name"), lang)
    return s.select("village_id", "day", "name", F.col("r.shelter_name").alias("shelter_name"), km.alias("route_km"),
                    left.alias("days_left"), urgent.alias("urgent"), text.alias("notice"))
