"""Per-village timelines, deadlines, ranking, sensitivity."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rounding import half_even
from ..functions.text import isolation_range_text
from ..params import Params
from .common import global_rank

_DATES = ("last_connected", "first_isolated", "isolated_from_earliest", "reconnected", "safe_exit_date")


def fold_timeline(status: DataFrame, keys: list[str] = ("village_id",)) -> DataFrame:
    """One row per key from its dated statuses.

    Everything comes from one aggregation: with the first isolated date known, "last connected before" and
    "first connected after" are lookups in the key's own sorted connected dates (one entry per observation)."""
    keys = list(keys)
    is_ = {s: F.col("status") == s for s in ("isolated", "connected", "uncertain", "boat_dependent")}
    g = status.groupBy(*keys).agg(
        F.max(is_["boat_dependent"]).alias("_boat"), F.max(is_["uncertain"]).alias("_unc"),
        F.count_if(is_["isolated"]).cast("int").alias("n_dates_isolated"),
        F.min(F.when(is_["isolated"], F.col("date"))).alias("_first"),
        F.collect_set(F.when(is_["connected"], F.col("date"))).alias("_conn"))
    outcome = (F.when(F.col("_boat"), "boat_dependent").when(F.col("_first").isNotNull(), "isolated")
               .when(F.col("_unc"), "uncertain").otherwise("never_isolated"))
    iso = F.col("outcome") == "isolated"
    before = F.array_max(F.filter("_conn", lambda d: d < F.col("_first")))
    after = F.array_min(F.filter("_conn", lambda d: d > F.col("_first")))
    g = g.withColumn("outcome", outcome).withColumn("last_connected", F.when(iso, before)).withColumn("first_isolated", F.when(iso, F.col("_first")))
    earliest = F.coalesce(F.date_add("last_connected", 1), F.col("first_isolated"))
    return (g.withColumn("isolated_from_earliest", earliest).withColumn("reconnected", F.when(iso, after))
            .withColumn("safe_exit_date", F.col("last_connected")).select(*keys, "outcome", *_DATES, "n_dates_isolated"))


def add_deadlines(summary: DataFrame, supply_days: int = 7) -> DataFrame:
    return summary.withColumn("aid_deadline", F.date_add("isolated_from_earliest", supply_days))


def add_urgency(summary: DataFrame) -> DataFrame:
    """Rank isolated villages: earliest deadline, then largest population, then id."""
    iso = F.col("outcome") == "isolated"
    order = [F.col("aid_deadline").asc_nulls_last(), F.col("population").desc_nulls_last(), F.col("village_id").asc()]
    ranked = global_rank(summary.filter(iso), order, "urgency_rank")
    rest = summary.filter(~iso).withColumn("urgency_rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def summarise(status: DataFrame, villages: DataFrame, supply_days: int = 7) -> DataFrame:
    """Timeline of each village seen in ``status`` with deadline, rank and range text."""
    names = [c for c in ("name", "name_bn", "population") if c in villages.columns]
    s = villages.select("village_id", *names).join(fold_timeline(status), "village_id", "right")
    s = add_urgency(add_deadlines(s, supply_days))
    return s.withColumn("isolation_range", isolation_range_text(F.col("outcome"), F.col("last_connected"), F.col("isolated_from_earliest"), F.col("first_isolated")))


def by_urgency(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("urgency_rank").asc_nulls_last(), F.col("name").asc_nulls_last(), "village_id")


def most_urgent(summary: DataFrame, k: int = 15) -> DataFrame:
    """Top-k report of isolated villages (take-ordered, no global sort)."""
    return summary.filter(F.col("outcome") == "isolated").orderBy("urgency_rank").limit(k)


def with_exit_routes(summary: DataFrame, routes: DataFrame) -> DataFrame:
    r = routes.select("village_id", F.col("shelter_id").alias("exit_shelter_id"), F.col("shelter_name").alias("exit_shelter"), F.col("length_m").alias("exit_route_m"))
    return summary.join(r, "village_id", "left")


def sensitivity(status: DataFrame, villages: DataFrame, p: Params = Params()) -> DataFrame:
    """How isolation results move with the cut threshold, against the main one.

    All thresholds are folded together, then one aggregation per village lines each up with the main result."""
    t = fold_timeline(status, ["threshold", "village_id"]).join(villages.select("village_id", "population"), "village_id", "left")
    main = F.col("threshold") == F.lit(float(p.main_threshold))
    v = t.groupBy("village_id").agg(F.first("population").alias("population"),
                                    F.collect_list(F.struct("threshold", "outcome", "first_isolated")).alias("all"),
                                    F.max(F.when(main, F.col("outcome"))).alias("m_out"), F.max(F.when(main, F.col("first_isolated"))).alias("m_first"))
    r = v.select("population", "m_out", "m_first", F.explode("all").alias("s")).select("population", "m_out", "m_first", "s.*")
    iso = F.col("outcome") == "isolated"
    shift = F.when(iso & (F.col("m_out") == "isolated"), F.datediff("first_isolated", "m_first"))
    return r.groupBy("threshold").agg(
        F.count_if(iso).alias("villages_isolated"), F.coalesce(F.sum(F.when(iso, F.col("population"))), F.lit(0)).alias("people_isolated"),
        half_even(F.avg(shift), 2).alias("mean_shift_days_vs_main"),
        F.count_if(~F.col("outcome").eqNullSafe(F.col("m_out"))).alias("villages_changed_outcome"))
