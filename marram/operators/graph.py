"""The situation graph: nodes and edges as two frames, edges keyed by source, target and relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.operators.evidence import neighbours

# The colour of each state of a claim, and of any other.
COLOURS = {"verified_by_operator": "#22c55e", "corroborated": "#22c55e", "disputed": "#f97316", "unverified": "#eab308", "rejected": "#6b7280"}
OTHER = "#eab308"


def nodes(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """id, kind, label of reports, claims, places and counts."""
    node = lambda df, kind, ident, label: df.select(F.concat(F.lit(f"{kind}:"), ident).alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    place = F.lower(F.trim("location_text"))
    out = node(reports, "report", F.col("report_id"), F.col("report_id"))
    out = out.unionByName(node(claims, "event", F.col("event_id"), F.replace("event_type", F.lit("_"), F.lit(" "))))
    out = out.unionByName(node(claims.where(place != ""), "place", place, place))
    return out.unionByName(node(claims.where("people_affected > 0"), "people", F.col("people_affected").cast("string"), F.col("people_affected").cast("string"))).distinct()


def edges(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """src, dst, rel: reported_by, occurred_at, affects, contradicts, corroborates."""
    edge = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"))
    event = F.concat(F.lit("event:"), "event_id")
    place = F.lower(F.trim("location_text"))
    known = claims.select("event_id").distinct()
    both = conflicts.join(known.withColumnRenamed("event_id", "event_a_id"), "event_a_id", "left_semi").join(known.withColumnRenamed("event_id", "event_b_id"), "event_b_id", "left_semi")
    out = edge(claims.where("report_id IS NOT NULL"), event, F.concat(F.lit("report:"), "report_id"), "reported_by")
    out = out.unionByName(edge(claims.where(place != ""), event, F.concat(F.lit("place:"), place), "occurred_at"))
    out = out.unionByName(edge(claims.where("people_affected > 0"), event, F.concat(F.lit("people:"), F.col("people_affected").cast("string")), "affects"))
    out = out.unionByName(edge(both, F.concat(F.lit("event:"), "event_a_id"), F.concat(F.lit("event:"), "event_b_id"), "contradicts"))
    return out.unionByName(edge(neighbours(claims), F.concat(F.lit("event:"), "src"), F.concat(F.lit("event:"), "dst"), "corroborates")).distinct()


def colour(state: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[state], F.lit(OTHER))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, n: nodes by kind, edges by relation, and both in all."""
    count = lambda df, what: df.groupBy(what.alias("what")).agg(F.count("*").alias("n"))
    by = count(nodes, F.concat(F.lit("node:"), "kind")).unionByName(count(edges, F.concat(F.lit("edge:"), "rel")))
    return by.unionByName(count(nodes, F.lit("nodes"))).unionByName(count(edges, F.lit("edges")))
