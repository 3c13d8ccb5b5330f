"""Evidence written back to claims: counts, confidence, states, resolved places. Nothing is mutated; every stage gives full claim rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions import text as X
from marram.functions import vocab as V
from marram.operators import evidence
from marram.plans.shared import salted_join

#: The confidence that a promotion needs, what a dispute caps it at, the confidence of a place that was resolved.
FLOOR, DISPUTED_CAP, RESOLVED = 0.45, 0.49, 0.8


def evaluated(claims: DataFrame, reports: DataFrame, compatibility: bool = True) -> DataFrame:
    """Every claim with independent_source_count, evidence_confidence and verification_state as its group's evidence has them.

    A group is the claims of one type and place that aren't rejected. Its flagged
    members count for nothing, but take no state from it either: they end with no
    source, no confidence, and neither corroborated nor disputed. Claims without
    place, and rejected ones, keep what they have. Claims whose report is unknown
    count as a source each report, without language or weight.
    """
    flagged = reports.where("suspected_injection").select("report_id").distinct().withColumn("_flagged", F.lit(True))
    c = claims.join(flagged, "report_id", "left").withColumn("_flagged", F.coalesce("_flagged", F.lit(False)))
    c = c.withColumn("_place", X.place_key(X.place_of(F.col("resolved_location"), F.col("location_text")), compatibility))
    # every claim of the group must see it: one row a group, spread over the tasks of its claims
    groups = evidence.corroboration_groups(c, reports).select("event_type", "_place", F.col("sources").alias("_sources"), F.col("confidence").alias("_confidence"), F.col("disputed").alias("_disputed"))
    grouped = (F.col("verification_state") != "rejected") & (F.col("_place") != "")
    own = salted_join(c.where(grouped), groups, ["event_type", "_place"], "event_id", "left")
    j = own.unionByName(c.where(~F.coalesce(grouped, F.lit(False))), allowMissingColumns=True)
    state, was = F.col("verification_state"), F.col("_sources").isNotNull()
    promoted = F.when(state != "unverified", state).when(F.col("_disputed"), "disputed").when((F.col("_sources") >= 2) & (F.col("_confidence") >= FLOOR), "corroborated").otherwise(state)
    confidence = F.when(F.col("_disputed"), F.least("_confidence", F.lit(DISPUTED_CAP))).otherwise(F.col("_confidence"))
    out = {
        "independent_source_count": F.when(F.col("_flagged"), 0).when(was, F.col("_sources").cast("int")).otherwise(F.col("independent_source_count")),
        "evidence_confidence": F.when(F.col("_flagged"), 0.0).when(was, confidence).otherwise(F.col("evidence_confidence")),
        "verification_state": F.when(F.col("_flagged"), F.when(state.isin("corroborated", "disputed"), "unverified").otherwise(state)).when(was, promoted).otherwise(state),
    }
    return j.withColumns(out).select(*claims.columns)


def canonical_names(claims: DataFrame, aliases: DataFrame, compatibility: bool = True) -> DataFrame:
    """mention, canonical, same, confidence, reason of every distinct typed place of place claims, without a model.

    Names are equal if their keys are, or if one alias group (name, group_id)
    holds both; the first mention names them all. Generic mentions stay alone.
    """
    c = claims.where(F.col("event_type").isin(V.PLACE_TYPES) & (F.coalesce("location_text", F.lit("")) != ""))
    m = c.groupBy(F.col("location_text").alias("mention")).agg(F.min(F.struct("created_at", "event_id")).alias("at")).withColumn("key", X.place_name(F.col("mention"), compatibility))
    groups = aliases.where("name IS NOT NULL").groupBy(X.place_name(F.col("name"), compatibility).alias("key")).agg(F.min("group_id").alias("group_id"))
    m = m.join(groups, "key", "left").withColumn("unit", F.coalesce(F.concat(F.lit("g:"), "group_id"), F.concat(F.lit("k:"), "key"))).withColumn("generic", X.is_generic(F.col("key")))
    first = m.where("NOT generic").groupBy("unit").agg(F.min(F.struct("at", "mention", "key")).alias("first"))
    j = m.join(first, "unit", "left")
    reason = (
        F.when(F.col("generic"), "generic_or_empty").when(F.col("mention") == F.col("first.mention"), "first_mention")
        .when(F.col("key") == F.col("first.key"), "exact_normalized_match").otherwise("known_alias")
    )
    j = j.withColumn("reason", reason)
    same = F.when(F.col("reason").isin("exact_normalized_match", "known_alias"), F.lit(True))
    sure = F.when(F.col("generic"), 0.0).when(F.col("reason") == "known_alias", 0.7).otherwise(1.0)
    return j.select("mention", F.coalesce("first.mention", "mention").alias("canonical"), same.alias("same"), sure.alias("confidence"), "reason")


def resolved(claims: DataFrame, aliases: DataFrame, compatibility: bool = True) -> DataFrame:
    """Every claim with resolved_location: the canonical name where it differs from what was typed, else null, so no old resolution stays. Claims of other types keep theirs."""
    names = canonical_names(claims, aliases, compatibility).select(F.col("mention").alias("location_text"), F.col("canonical").alias("_canonical"))
    j = salted_join(claims, names, ["location_text"], "event_id", "left")
    mine = F.col("event_type").isin(V.PLACE_TYPES) & (F.coalesce("location_text", F.lit("")) != "")
    new = F.when(F.col("_canonical") != F.col("location_text"), F.col("_canonical"))
    out = {"resolved_location": F.when(mine, new).otherwise(F.col("resolved_location")), "location_confidence": F.when(mine, F.when(new.isNotNull(), RESOLVED)).otherwise(F.col("location_confidence"))}
    return j.withColumns(out).select(*claims.columns)
