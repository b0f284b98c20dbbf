"""Best approximate name matches (Ratcliff-Obershelp similarity) without comparing all names."""
from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


def similarity(a: Column, b: Column) -> Column:
    """2M/T of matching blocks, as the standard library computes it; the argument order matters."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        m, last, out = SequenceMatcher(), None, []
        for p, q in zip(x, y):
            if q != last:
                m.set_seq2(q)
                last = q
            m.set_seq1(p)
            out.append(m.ratio())
        return pd.Series(out)

    return run(a, b)


def _letters(text) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _tokens(text) -> Column:
    """Letters with their occurrence number, so that set overlap equals multiset overlap."""
    chars = _letters(text)
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda o: o == c)).cast("string")))


def _drop_one(text) -> Column:
    """The text itself and every text with one character removed."""
    n = F.length(text)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), shorter))


def _prepared(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Letter tokens of each text, taken once per text and carried through the joins."""
    return df.select(column, F.length(column).alias(f"{tag}n"), _tokens(F.col(column)).alias(f"{tag}t"))


def _score(pairs: DataFrame, cutoff: float) -> DataFrame:
    """Best candidate per query among pairs that can reach the cutoff: query, s, cand.

    The letter overlap bounds the similarity from above, so only pairs that might pass are compared in full. Pairs that come without
    letters (they share all but one or two anyway) are bounded by their lengths alone.
    Those are spread by count, because their cost lies in the comparison and not in their bytes."""
    spark = pairs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if "qt" not in pairs.columns:
        pairs = pairs.withColumns({"qn": F.length("query"), "cn": F.length("cand")})
    total = F.col("qn") + F.col("cn")
    least = F.col("least") if "least" in pairs.columns else F.lit(cutoff)
    may = pairs.filter(F.lit(2.0) * F.least("qn", "cn") / total >= least)
    if "qt" in pairs.columns:
        may = may.filter(F.lit(2.0) * F.size(F.array_intersect("qt", "ct")) / total >= least)
    may = may.select("query", "cand")
    scored = may.repartition(width, "query", "cand").withColumn("s", similarity(F.col("cand"), F.col("query"))).filter(F.col("s") >= cutoff)
    return scored.groupBy("query").agg(F.max(F.struct("s", "cand")).alias("b")).select("query", "b.s", "b.cand")


def _letter_candidates(queries: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """Lossless candidates at any cutoff c: names that share one of the rare letters in both prefixes.

    Similarity >= c needs an overlap of at least c/(2-c) of each length; so among the letters in rare-first order one of
    the first n - need + 1 is shared. A query that knows a match already (``least``) only asks for better ones, with a
    shorter prefix. A pair is reported at the first letter its prefixes share, hence once."""
    freq = names.select(F.explode("ct").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df, col, tag):
        c = F.first("least") if tag == "q" else F.lit(cutoff)
        need = F.ceil(F.col("_c") / (F.lit(2.0) - F.col("_c")) * F.col(f"{tag}n") - F.lit(1e-9))
        t = df.withColumn("tok", F.explode(f"{tag}t")).join(freq, "tok", "left").withColumn("f", F.coalesce("f", F.lit(0)))
        g = t.groupBy(col).agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("_o"), F.first(f"{tag}n").alias(f"{tag}n"), F.first(f"{tag}t").alias(f"{tag}t"), c.alias("_c"))
        return g.withColumn(f"{tag}p", F.transform(F.slice("_o", F.lit(1), (F.col(f"{tag}n") - need + 1).cast("int")), lambda o: o["tok"])).drop("_o")

    q = prefix(queries, "query", "q").withColumnRenamed("_c", "least").withColumn("tok", F.explode("qp"))
    n = prefix(names, "cand", "c").drop("_c").withColumn("tok", F.explode("cp"))
    met = q.join(n, "tok").filter(F.get(F.array_intersect("qp", "cp"), F.lit(0)) == F.col("tok"))
    return met.select("query", "least", "qn", "qt", "cand", "cn", "ct")


def best_match(queries: DataFrame, names: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """Most similar name for each distinct query, ties to the larger name: query, match, score.

    ``queries`` has column query, ``names`` column cand. Three lossless tiers, each over what the last left
    open: equal names; names one deletion apart on either side, met through an equi-join on their deletion
    variants; and, for queries whose best score a farther name could still reach, the rare-letter candidates."""
    q = materialize(_prepared(queries.filter(F.col("query").isNotNull()).select("query").distinct(), "query", "q"), "queries")
    n = materialize(_prepared(names.filter(F.col("cand").isNotNull()).select("cand").distinct(), "cand", "c"), "names")
    same = q.join(n, q["query"] == n["cand"]).select("query", F.lit(1.0).alias("s"), "cand")
    q = q.join(n, q["query"] == n["cand"], "left_anti")
    near = (q.select("query", F.explode(_drop_one(F.col("query"))).alias("k")).join(n.select("cand", F.explode(_drop_one(F.col("cand"))).alias("k")), "k")
            .select("query", "cand").distinct())
    tier = materialize(_score(near, cutoff), "near")
    # a pair not met above differs by two or more letters beyond its common subsequence
    longest = F.floor(F.length("query") * F.lit((2 - cutoff) / cutoff) + F.lit(1e-9))
    bound = F.lit(1.0) - F.lit(2.0) / (F.length("query") + longest)
    closed = tier.filter(F.col("s") > bound)
    left = q.join(closed, "query", "left_anti").join(tier.select("query", F.col("s").alias("least")), "query", "left")
    left = left.withColumn("least", F.coalesce(F.col("least"), F.lit(cutoff)))
    far = _score(_letter_candidates(left, n, cutoff), cutoff)
    out = same.unionByName(closed).unionByName(far)
    return out.select("query", F.col("cand").alias("match"), similarity(F.col("query"), F.col("cand")).alias("score"))


def match_boundaries(wanted: DataFrame, boundaries: DataFrame, cutoff: float = 0.6, district: str | None = None) -> DataFrame:
    """Boundary name for each wanted area (column ``area``); a name without any match is an error."""
    b = boundaries if district is None else boundaries.filter(F.lower("district") == district.lower())
    m = best_match(wanted.select(F.col("area").alias("query")), b.select(F.col("name").alias("cand")), cutoff)
    j = wanted.select("area").join(m, F.col("area") == F.col("query"), "left")
    name = F.when(F.col("match").isNull(), F.raise_error(F.concat(F.lit("no boundary named like "), "area"))).otherwise(F.col("match"))
    return j.select("area", name.alias("boundary"))
