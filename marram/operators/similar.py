"""Exact set-similarity join of short texts on character trigrams.

All-pairs prefix filter (Bayardo et al., WWW 2007): trigrams are ordered from
rare to frequent; two sets that reach the threshold share one of their first
|A| - ceil(t |A|) + 1. Only those are joined, sizes are compared, then the pair
is verified. For names and places; long texts are the near-duplicate operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions import text as X


def similar_pairs(values: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Pairs a < b of distinct values (column value, normal forms) with their similarity at or above the threshold."""
    v = values.where("value IS NOT NULL AND value <> ''").distinct().withColumn("t", X.trigrams(F.col("value")))
    grams = v.select("value", F.size("t").alias("n"), F.explode("t").alias("g"))
    freq = grams.groupBy("g").agg(F.count("*").alias("f"))
    ranked = grams.join(freq, "g").groupBy("value", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
    prefix = ranked.select("value", "n", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("p")).select("value", "n", F.col("p.g").alias("g"))
    a, b = prefix.select(F.col("value").alias("a"), F.col("n").alias("na"), "g"), prefix.select(F.col("value").alias("b"), F.col("n").alias("nb"), "g")
    pairs = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)).select("a", "b").distinct()
    return pairs.withColumn("similarity", F.round(X.similarity(F.col("a"), F.col("b")), 6)).where(F.col("similarity") >= threshold)
