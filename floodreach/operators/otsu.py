"""Backscatter histograms and the threshold that best separates them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..params import Params


def histogram(pixels: DataFrame, value: str = "vv_db", width: float = 0.25, max_buckets: int = 200) -> DataFrame:
    """Per date: bucket, count and mean. Buckets double in width until at most ``max_buckets`` remain.

    Pixels are counted once at the narrowest width; wider buckets are exact unions of those, so widening
    only touches the small histogram."""
    fine = (pixels.filter(F.col(value).isNotNull()).groupBy("date", F.floor(F.col(value) / F.lit(width)).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")))
    day = W.partitionBy("date")
    span = F.max("b").over(day) - F.min("b").over(day) + 1
    factor = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(span / F.lit(max_buckets - 1)))))
    wide = fine.withColumn("bucket", F.floor(F.col("b") / factor))
    return (wide.groupBy("date", "bucket").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean")))


def otsu(hist: DataFrame) -> DataFrame:
    """Per date: the bucket mean with the largest between-class variance, first one on ties."""
    run = W.partitionBy("date").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    day = W.partitionBy("date")
    mass = F.col("n") * F.col("mean")
    c = (hist.withColumn("w0", F.sum("n").over(run)).withColumn("m0", F.sum(mass).over(run))
         .withColumn("w", F.sum("n").over(day)).withColumn("m", F.sum(mass).over(day))
         .withColumn("w1", F.col("w") - F.col("w0")))
    mean0 = F.coalesce(F.try_divide(F.col("m0"), F.col("w0")), F.lit(0.0))
    mean1 = F.coalesce(F.try_divide(F.col("m") - F.col("m0"), F.col("w1")), F.lit(0.0))
    between = F.col("w0") * F.col("w1") * (mean0 - mean1) * (mean0 - mean1)
    return (c.withColumn("v", F.when(F.col("w1") == 0, F.lit(0.0)).otherwise(between))
            .groupBy("date").agg(F.max_by("mean", F.struct("v", -F.col("bucket"))).alias("otsu_db"),
                                 F.first("w").alias("pixels")))


def radar_threshold(pixels: DataFrame, p: Params = Params()) -> DataFrame:
    """Otsu with its guards: too few pixels (also none at all) or an implausible value give the fallback."""
    t = pixels.select("date").distinct().join(otsu(histogram(pixels)), "date", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0).cast("bigint")))
    ok = F.coalesce((F.col("pixels") > 1000) & F.col("otsu_db").between(*p.plausible_db), F.lit(False))
    return t.select("date", F.when(ok, F.col("otsu_db")).otherwise(F.lit(p.fallback_db)).alias("threshold_db"), "pixels")
