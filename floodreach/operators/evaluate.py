"""News reports against model results, and classifier metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.rounding import half_even
from .common import exact_quantiles
from .fuzzy import best_match


def match_reports(reports: DataFrame, summary: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """Reports with the village they mean: a hand-set id wins, else the best fuzzy name match.

    Where several villages share a lower-cased name, the largest id stands for it."""
    names = summary.groupBy(F.lower("name").alias("cand")).agg(F.max("village_id").alias("auto_id"))
    r = reports.withColumn("_q", F.lower("place_name"))
    manual = F.coalesce("village_id", F.lit("")) != ""
    m = best_match(r.filter(~manual).select(F.col("_q").alias("query")), names, cutoff)
    hit = m.join(names, m["match"] == names["cand"]).select(F.col("query").alias("_q"), "auto_id", "score")
    how = (F.when(manual, "manual").when(F.col("auto_id").isNotNull(), F.format_string("auto (%.2f)", "score")).otherwise("no match"))
    return (r.join(hit, "_q", "left").withColumn("match", how)
            .withColumn("village_id", F.when(manual, F.col("village_id")).otherwise(F.col("auto_id"))).drop("_q", "auto_id", "score"))


def score_reports(matched: DataFrame, summary: DataFrame) -> DataFrame:
    """Model outcome and date error of each report (positive: the model was late)."""
    s = summary.select("village_id", F.col("name").alias("model_name"), F.col("outcome").alias("model_outcome"), "isolated_from_earliest", "first_isolated")
    j = matched.join(s, "village_id", "left").withColumn("_d", F.try_to_date(F.col("date_reported").cast("string")))
    lo, hi, d = F.col("isolated_from_earliest"), F.col("first_isolated"), F.col("_d")
    scored = (F.col("model_outcome") == "isolated") & d.isNotNull()
    inside = d.between(lo, hi)
    away = F.when(inside, 0).otherwise(F.least(F.abs(F.datediff(lo, d)), F.abs(F.datediff(hi, d))))
    return (j.withColumn("model_isolated", F.col("model_outcome") == "isolated").withColumn("error_days", F.when(scored, F.datediff(hi, d)))
            .withColumn("report_in_range", F.when(scored, inside)).withColumn("days_outside_range", F.when(scored, away))
            .drop("_d", "isolated_from_earliest", "first_isolated"))


def contingency(scored: DataFrame) -> DataFrame:
    """Model isolated against reported isolated over matched reports; a blank answer counts as yes."""
    said = F.lower(F.coalesce("reported_isolated", F.lit(""))).isin("yes", "y", "true", "1", "")
    return (scored.filter(F.col("model_outcome").isNotNull()).groupBy("model_isolated")
            .agg(F.count_if(~said).alias("report_no"), F.count_if(said).alias("report_yes")))


def error_stats(scored: DataFrame) -> DataFrame:
    e = scored.filter(F.col("model_outcome").isNotNull())
    return e.agg(F.count("error_days").alias("n"), half_even(F.avg("error_days"), 1).alias("mean_days"),
                 half_even(F.avg(F.abs("error_days")), 1).alias("mean_abs_days"), F.median("error_days").alias("median_days"),
                 half_even(F.avg(F.col("report_in_range").cast("double")) * 100, 0).alias("in_range_pct"))


def confusion(predictions: DataFrame, ignore: int | None = None) -> DataFrame:
    """Binary confusion counts with accuracy, precision, recall and F1; ``ignore`` masks a label (255)."""
    p = predictions if ignore is None else predictions.filter(F.col("label") != ignore)
    pos, true = F.col("pred") == 1, F.col("label") == 1
    c = p.agg(F.count_if(~pos & (F.col("label") == 0) & (F.col("pred") == 0)).alias("tn"), F.count_if(pos & (F.col("label") == 0)).alias("fp"),
              F.count_if((F.col("pred") == 0) & true).alias("fn"), F.count_if(pos & true).alias("tp"),
              F.count_if(F.col("pred") == F.col("label")).alias("ok"), F.count(F.lit(1)).alias("total"))
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    c = c.withColumn("accuracy", F.try_divide(F.col("ok").cast("double"), F.col("total"))).withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.lit(2.0) * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8))
    return c.withColumn("f1", f1).drop("ok", "total")


def pixel_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of right pixels: over all of them, unknown ones counting as wrong, and over known ones only."""
    hit, known = F.col("pred") == F.col("label"), F.col("label") != 255
    return predictions.agg((F.count_if(hit) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("raw"),
                           (F.count_if(hit & known) / F.greatest(F.count_if(known), F.lit(1))).alias("masked"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    g = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return g if k is None else g.limit(k)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, rounded to one decimal."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").filter(F.col("v").isNotNull())
    g = long.groupBy("column").agg(F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    g = g.join(exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75]).drop("n"), "column")
    r = lambda c: half_even(c, 1)
    return g.select("column", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("min")).alias("min"),
                    r(F.col("q")[0]).alias("p25"), r(F.col("q")[1]).alias("p50"), r(F.col("q")[2]).alias("p75"), r(F.col("max")).alias("max"))


def split_by_hash(df: DataFrame, item: str, fraction: float = 0.2, seed: int = 42, by: str | None = None) -> DataFrame:
    """Train/validation split of distinct items, ceil(fraction * n) to validation, optionally within each label.

    Items are ordered by the MD5 of seed and item. Instead of ranking a whole label in one task, the cut is located on a
    histogram of hash prefixes and only the bucket that straddles it is ranked."""
    keys = [by] if by else []
    items = df.select(item, *keys).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))).withColumn("_b", F.substring("_h", 1, 4))
    hist = items.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    hist = (hist.withColumn("_cut", F.ceil(F.sum("_c").over(part) * F.lit(fraction)))
            .withColumn("_before", F.sum("_c").over(part.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")))
    j = items.join(hist, [*keys, "_b"])
    whole = F.when(F.col("_before") + F.col("_c") <= F.col("_cut"), "validation").when(F.col("_before") >= F.col("_cut"), "train")
    easy = j.withColumn("split", whole)
    tie = easy.filter(F.col("split").isNull()).withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", item)))
    tie = tie.withColumn("split", F.when(F.col("_before") + F.col("_r") <= F.col("_cut"), "validation").otherwise("train"))
    return easy.filter(F.col("split").isNotNull()).select(item, *keys, "split").unionByName(tie.select(item, *keys, "split"))


def split_dates(df: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """No date lands in both parts."""
    return split_by_hash(df, "date", fraction, seed)


def split_dates_in_time(df: DataFrame, fraction: float = 0.2) -> DataFrame:
    """The latest dates validate; the axis is one row per observation."""
    d = df.select("date").distinct()
    w = W.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(F.desc("date")))
    return d.select("date", F.when(r <= F.ceil(n * F.lit(fraction)), "validation").otherwise("train").alias("split"))
