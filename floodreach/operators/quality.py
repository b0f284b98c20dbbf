"""Contract checks of a published dataset: every rule is a predicate counted inside one pass over its table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schema import STATUSES


def _rules(df: DataFrame, table: str, rules: list[tuple]) -> DataFrame:
    """rules: (name, severity, aggregate that counts offences, message)."""
    g = df.agg(*[F.coalesce(agg.cast("bigint"), F.lit(0)).alias(f"r{i}") for i, (_, _, agg, _) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("rule"), F.lit(sev).alias("severity"), F.col(f"r{i}").alias("n_bad"), F.lit(msg).alias("message"))
                     for i, (n, sev, _, msg) in enumerate(rules)])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _unique(df, table, keys):
    return _rules(duplicates(df, keys), table, [("unique_key", "error", F.count(F.lit(1)), f"duplicate {', '.join(keys)} values")])


def _no_rows():
    return (F.count(F.lit(1)) == 0).cast("int")


def _missing(df: DataFrame, table: str, columns: list[str]) -> DataFrame | None:
    miss = sorted(set(columns) - set(df.columns))
    return _rules(df.limit(0), table, [("columns", "error", F.lit(len(miss)) + F.count(F.lit(1)), "absent: " + ", ".join(miss))]) if miss else None


def check_villages(v: DataFrame) -> list[DataFrame]:
    bad = _missing(v, "villages", ["village_id", "name", "population", "x", "y"])
    if bad is not None:
        return [bad]
    return [_rules(v, "villages", [("not_empty", "error", _no_rows(), "no village at all"),
                                   ("geometry", "error", F.count_if(F.col("x").isNull() | F.col("y").isNull()), "village without coordinates")]), _unique(v, "villages", ["village_id"])]


def check_status(s: DataFrame) -> list[DataFrame]:
    bad = _missing(s, "village_status", ["village_id", "date", "status", "dist_to_shelter_m", "nearest_shelter_id"])
    if bad is not None:
        return [bad]
    d = F.col("dist_to_shelter_m")
    odd = d.isNotNull() & F.expr("try_cast(dist_to_shelter_m as double)").isNull()
    return [_rules(s, "village_status", [
        ("not_empty", "error", _no_rows(), "no status row at all"), ("dates", "error", F.count_if(F.expr("try_cast(date as date)").isNull()), "value is not a date"),
        ("status_domain", "error", F.count_if(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES)), "status outside the four words"),
        ("numeric_distance", "error", F.count_if(odd), "distance is not a number")]), _unique(s, "village_status", ["village_id", "date"])]


def check_lines(df: DataFrame, table: str, id_column: str | None = None) -> list[DataFrame]:
    """Features need a geometry; a table whose coordinates all fit in degrees is probably not projected."""
    bad = _missing(df, table, ["geom"] + ([id_column] if id_column else []))
    if bad is not None:
        return [bad]
    widest = F.max(F.array_max(F.transform("geom", lambda q: F.greatest(F.abs(q["x"]), F.abs(q["y"])))))
    return [_rules(df, table, [("geometry", "error", F.count_if(F.col("geom").isNull() | (F.size("geom") == 0)), "feature without geometry"),
                               ("projected", "warning", (widest <= 360).cast("int"), "coordinates look like degrees, not metres")])]


def check_classes(cells: DataFrame) -> list[DataFrame]:
    return [_rules(cells, "flood", [("not_empty", "error", _no_rows(), "no cell at all"), ("class_domain", "error", F.count_if(~F.col("value").isin(0, 1, 255) | F.col("value").isNull()), "class is none of 0, 1, 255")])]


def check_meta(meta: DataFrame) -> list[DataFrame]:
    """One document: dates array, flood_bounds / sources / unknown_pct maps keyed by date text, label, window."""
    dates = F.col("dates")
    parsed = F.transform(dates, lambda d: F.try_to_date(d))
    keyed = lambda m: F.size(F.filter(dates, lambda d: ~F.array_contains(F.map_keys(m), d)))
    off = F.size(F.filter(F.map_values("unknown_pct"), lambda v: (v < 0) | (v > 100)))
    one = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(1)))
    return [_rules(meta, "meta", [
        ("dates", "error", one((F.size(dates) == 0) | F.exists(parsed, lambda d: d.isNull())), "no dates, or some that do not parse"),
        ("chronological", "error", one(parsed != F.array_sort(parsed)), "a date comes before its predecessor"),
        ("label", "error", one(F.coalesce("data_label", F.lit("")) == ""), "no label"),
        ("window", "error", one(F.col("app_start").isNull() | F.col("app_end").isNull()), "display window is open"),
        ("bounds", "error", F.sum(keyed(F.col("flood_bounds"))), "date without bounds"), ("sources", "error", F.sum(keyed(F.col("sources"))), "date without sources"),
        ("unknown_pct", "error", F.sum(off), "share outside 0 to 100")])]


def quality_report(tables: dict[str, DataFrame], optional: tuple[str, ...] = ("rainfall_daily", "modis_flood_area", "sensitivity_summary", "validation")) -> DataFrame:
    """All rules as rows (table_name, rule, severity, n_bad, message). A dataset is valid when no error row has n_bad > 0."""
    checks = {"meta": check_meta, "villages": check_villages, "village_status": check_status, "flood": check_classes,
              "shelters": lambda d: check_lines(d.withColumn("geom", F.array(F.struct("x", "y"))) if "geom" not in d.columns and "x" in d.columns else d, "shelters"),
              "exit_routes": lambda d: check_lines(d, "exit_routes"), "cut_roads": lambda d: check_lines(d, "cut_roads", id_column="edge_id")}
    spark = next(iter(tables.values())).sparkSession
    parts = [c for name, run in checks.items() if name in tables for c in run(tables[name])]
    absent = [(n, "present", "error", 1, "table is absent") for n in checks if n not in tables]
    absent += [(n, "present", "warning", 1, "optional table is absent") for n in optional if n not in tables]
    if absent:
        parts.append(spark.createDataFrame(absent, "table_name string, rule string, severity string, n_bad bigint, message string"))
    return reduce(DataFrame.unionByName, parts)


def is_valid(report: DataFrame) -> bool:
    return report.filter((F.col("severity") == "error") & (F.col("n_bad") > 0)).isEmpty()
