"""Small building blocks shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize


def distinct_values(df: DataFrame, *cols: str) -> Column:
    """Sorted distinct values as one scalar-subquery array, for exploding a dense output axis.

    Meant for axes whose length is the number of observations (dates, thresholds), never for entities."""
    item = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
    return df.select(*cols).distinct().agg(F.sort_array(F.collect_set(item)).alias("v")).scalar()


def global_rank(df: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """row_number over the whole table without moving it into one task.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the number of
    rows in the partitions before them. ``order`` must be a total order."""
    num = F.monotonically_increasing_id()
    ordered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("_part", F.shiftright(num, 33).cast("int"))
               .withColumn("_pos", num.bitwiseAND(F.lit((1 << 33) - 1))))
    ordered = materialize(ordered, "rank")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (ordered.join(shifts, "_part")
            .withColumn(rank, (F.col("_pos") + F.col("_shift") + 1).cast("bigint"))
            .drop("_part", "_pos", "_shift"))


def exact_median(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Exact median of huge groups: keys, ``median``, ``n``.

    Equal values are counted map-side, a coarse histogram locates the bucket(s) that hold the middle
    ranks, and only those buckets are put in order."""
    counts = (df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_b", F.floor(F.col("_v") / F.lit(width))))
    hist = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    run = W.partitionBy(*keys).orderBy("_b")
    hist = (hist.withColumn("_end", F.sum("_bc").over(run.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("n", F.sum("_bc").over(W.partitionBy(*keys)))
            .withColumn("_lo", F.floor((F.col("n") + 1) / 2)).withColumn("_hi", F.ceil((F.col("n") + 1) / 2))
            .filter((F.col("_end") >= F.col("_lo")) & (F.col("_end") - F.col("_bc") < F.col("_hi")))
            .withColumn("_before", F.col("_end") - F.col("_bc")))
    inner = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    mid = counts.join(hist, [*keys, "_b"]).withColumn("_to", F.col("_before") + F.sum("_c").over(inner))

    def at(rank):
        return F.min(F.when(F.col("_to") >= F.col(rank), F.col("_v")))

    return mid.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias("median"), F.first("n").alias("n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """Exact quantiles of huge groups, linear between ranks: keys (not null), ``n`` and ``q``, one number per fraction. Nulls do not count.

    Distinct values are counted map-side and laid out once in key and value order, in as many parts as their amount asks for,
    so however skewed they are. The parts' sums tell which parts hold the wanted ranks; only these are read again and ordered."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "quantiles")
    sizes = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_pc"))
    before = F.coalesce(F.sum("_pc").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).withColumn("n", F.sum("_pc").over(W.partitionBy(*keys)))
    at = [(F.col("n") - 1) * F.lit(float(f)) for f in fractions]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_pc")))
    need = sizes.withColumn("_ranks", here).filter(F.size("_ranks") > 0).select(*keys, "_part", "n", "_before", "_ranks")
    w = W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    found = counts.join(need, [*keys, "_part"]).withColumn("_to", F.col("_before") + F.sum("_c").over(w))
    found = found.select(*keys, "n", "_v", F.explode(F.filter("_ranks", lambda r: (r < F.col("_to")) & (r >= F.col("_to") - F.col("_c")))).alias("_r"))
    known = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))  # two ranks a fraction at most
    low, high = (lambda a: F.col("_m")[F.floor(a)]), (lambda a: F.col("_m")[F.ceil(a)])
    return known.select(*keys, "n", F.array(*[low(a) + (a - F.floor(a)) * (high(a) - low(a)) for a in at]).alias("q"))
