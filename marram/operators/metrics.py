"""Counts over the whole situation in one row, and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(claims: DataFrame, reports: DataFrame, conflicts: DataFrame, groups: DataFrame | None = None, label: str = "", model: str = "") -> DataFrame:
    """The situation in one row; stated people are a lower bound, as nothing is added for claims that state none."""
    n = lambda cond: F.count(F.when(cond, 1))
    state = F.col("verification_state")
    c = claims.agg(
        F.count("*").alias("claims"), n(state == "unverified").alias("unverified"), n(state == "corroborated").alias("corroborated"), n(state == "disputed").alias("disputed"), n(state == "verified_by_operator").alias("verified"), n(state == "rejected").alias("rejected"),
        n(F.col("severity") == "critical").alias("critical"), F.coalesce(F.sum("people_affected"), F.lit(0)).alias("people_reported"), F.coalesce(F.sum("people_affected"), F.lit(0)).alias("people_lower_bound"), F.countDistinct(F.when((state != "rejected") & (F.trim("location_text") != ""), F.lower(F.trim("location_text")))).alias("places"),
        F.coalesce(F.max("independent_source_count"), F.lit(0)).alias("most_sources"),
    )
    r = reports.agg(F.count("*").alias("reports"), n(F.col("suspected_injection")).alias("flagged_reports"), n(F.col("processed")).alias("processed_reports"))
    k = conflicts.agg(n(F.col("status") == "unresolved").alias("unresolved_conflicts"), n(F.col("status") != "unresolved").alias("settled_conflicts"))
    g = (claims.limit(0) if groups is None else groups).agg(F.count("*").alias("duplicate_groups"), F.lit(label).alias("model_label"), F.lit(model).alias("model_used"))
    return c.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(k)).crossJoin(F.broadcast(g))  # one row each


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
