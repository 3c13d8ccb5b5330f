"""Claims weighed against each other: duplicates, corroboration, contradictions, evidence links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.functions import text as X
from marram.functions import vocab as V


def duplicate_groups(reports: DataFrame) -> DataFrame:
    """Reports with one text_hash: group id, size, first and last member; members come from group_members."""
    g = reports.where("text_hash IS NOT NULL").groupBy("text_hash").agg(F.count("*").alias("members"), F.min(F.struct("ingested_at", "report_id")).alias("f"), F.max(F.struct("ingested_at", "report_id")).alias("l")).where("members > 1")
    return g.select(F.concat(F.lit("DUP-"), F.upper(F.substring("text_hash", 1, 10))).alias("group_id"), "members", F.col("f.report_id").alias("first_report_id"), F.col("l.report_id").alias("last_report_id"), F.lit("exact_fingerprint").alias("method"), F.lit(1.0).alias("similarity"))


def group_members(reports: DataFrame) -> DataFrame:
    """report_id, group_id of every report in an exact duplicate group; sizes are combined before the join."""
    sizes = reports.where("text_hash IS NOT NULL").groupBy("text_hash").agg(F.count("*").alias("n")).where("n > 1").select("text_hash")
    return reports.join(sizes, "text_hash", "left_semi").select("report_id", F.concat(F.lit("DUP-"), F.upper(F.substring("text_hash", 1, 10))).alias("group_id"))


def confidence(groups: Column, languages: Column, weight: Column) -> Column:
    """Evidence confidence from independent sources, distinct languages and mean weight; its constants are fixed values."""
    base = F.least(F.lit(1.0), F.lit(1.6) * F.log(F.lit(1.0) + groups) / F.log(F.lit(5.0)))
    return F.when(groups <= 0, 0.0).otherwise(F.round(F.least(F.lit(0.97), base * (F.lit(1.0) + F.lit(0.08) * (languages - 1)) * weight), 3))


def source_key(reporter: Column, text_hash: Column) -> Column:
    return F.when(reporter.isNotNull() & (reporter != ""), F.concat(F.lit("reporter:"), reporter)).otherwise(F.concat(F.lit("anon:"), F.substring(text_hash, 1, 16)))


def report_weight(reporter: Column, flagged: Column) -> Column:
    """Weight of a report: less without a reporter, least where flagged; fixed values."""
    return F.when(reporter.isNull() | (reporter == ""), 0.7).otherwise(1.0) * F.when(flagged, 0.3).otherwise(1.0)


def corroboration_groups(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """claims with their _place, grouped by event type and place: claims, independent sources, languages, mean weight, confidence, dispute; flagged reports count for nothing.

    Counts are aggregated and can be joined back; no window over distinct values.
    """
    r = reports.groupBy("report_id").agg(F.min(F.struct("reporter_id", F.sha2("raw_text", 256).alias("h"), "source_language", "suspected_injection")).alias("r")).select("report_id", "r.*")
    c = claims.where("verification_state <> 'rejected' AND _place <> ''").select("report_id", "event_type", "_place", "verification_state")
    j = c.join(r, "report_id", "left")
    clean = ~F.coalesce("suspected_injection", F.lit(False))
    known = F.col("h").isNotNull()
    source = F.when(known, source_key(F.col("reporter_id"), F.col("h"))).otherwise(F.concat(F.lit("report:"), F.coalesce("report_id", F.lit(""))))
    g = j.groupBy("event_type", "_place").agg(
        F.count("*").alias("claims"), F.countDistinct(F.when(clean, source)).alias("sources"), F.countDistinct(F.when(clean, F.col("source_language"))).alias("languages"),
        F.coalesce(F.avg(F.when(clean & known, report_weight(F.col("reporter_id"), F.col("suspected_injection")))), F.lit(1.0)).alias("w"), F.bool_or(clean & (F.col("verification_state") == "disputed")).alias("disputed"),
    )
    return g.withColumn("confidence", confidence(F.col("sources"), F.greatest("languages", F.lit(1)), F.col("w")))


def corroboration(claims: DataFrame, reports: DataFrame, compatibility: bool = False) -> DataFrame:
    """corroboration_groups of claims by their resolved, else typed place, disputes capping the confidence."""
    c = claims.withColumn("_place", X.place_key(X.place_of(F.col("resolved_location"), F.col("location_text")), compatibility))
    capped = F.when(F.col("disputed"), F.least("confidence", F.lit(0.49))).otherwise(F.col("confidence"))
    return corroboration_groups(c, reports).select("event_type", F.col("_place").alias("place"), "claims", "sources", "languages", F.round("w", 6).alias("weight"), capped.alias("confidence"), "disputed")


def unpivoted(claims: DataFrame) -> DataFrame:
    """A row for each stated field of a claim: the evidence it rests on."""
    cols = ", ".join(f"'{f}', cast({f} as string)" for f in V.FIELDS)
    return claims.select("event_id", "report_id", F.expr(f"stack({len(V.FIELDS)}, {cols}) as (field_path, value)")).where("value IS NOT NULL")


def ungrounded(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Claims without a link to their own report."""
    have = links.where("event_id IS NOT NULL AND report_id IS NOT NULL").select("event_id", "report_id").distinct()
    return claims.join(have, ["event_id", "report_id"], "left_anti").select("event_id")


def fresh_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Conflicts (event_a_id, event_b_id, conflict_type) not stored in either orientation."""
    key = lambda df: df.withColumn("x", F.least("event_a_id", "event_b_id")).withColumn("y", F.greatest("event_a_id", "event_b_id"))
    return key(new).join(key(stored).select("x", "y", "conflict_type").distinct(), ["x", "y", "conflict_type"], "left_anti").select(*new.columns)


def conflict_sides(conflicts: DataFrame, claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Both sides of each conflict, described; sides are rows, so no join needs an OR."""
    sides = conflicts.select("conflict_id", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("event_a_id", "event_b_id"))).alias("side", "event_id"))
    place = X.place_of(F.col("resolved_location"), F.col("location_text"))
    j = sides.join(claims, "event_id", "left").join(reports.select("report_id", "source_language"), "report_id", "left")
    return j.select("conflict_id", "side", "event_id", "report_id", "source_language", X.side_text(F.col("event_type"), place, F.col("people_affected"), F.col("severity"), F.col("time_reference")).alias("description"))


def first_names(claims: DataFrame) -> DataFrame:
    """The first mention of each place key names it."""
    c = claims.withColumn("name_key", X.place_name(F.col("location_text"), False)).where(~X.is_generic(F.col("name_key")) & F.col("event_type").isin(V.PLACE_TYPES))
    return c.groupBy("name_key").agg(F.min_by("location_text", F.struct("created_at", "event_id")).alias("canonical"), F.count("*").alias("mentions"))


def same_group_names(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Keys of names that a gazetteer group holds, with the group: alias lookup by two equi-joins."""
    g = gazetteer.select("group_id", X.place_name(F.col("name"), False).alias("name_key")).distinct()
    return names.join(g, "name_key").select("name_key", "group_id")


def neighbours(claims: DataFrame) -> DataFrame:
    """Consecutive claims of one type and place from different reports.

    Windows run within a day; the days' ends are stitched over their first and
    last rows, so a hot place never lies in one task.
    """
    c = claims.withColumn("place", F.lower(F.trim("location_text"))).where("place <> ''").select("event_type", "place", F.to_date("created_at").alias("day"), F.struct("created_at", "event_id", "report_id").alias("row"))
    inside = c.select(F.col("row").alias("x"), F.lead("row").over(Window.partitionBy("event_type", "place", "day").orderBy("row.created_at", "row.event_id")).alias("y"))
    ends = c.groupBy("event_type", "place", "day").agg(F.min("row").alias("head"), F.max("row").alias("x"))
    across = ends.select("x", F.lead("head").over(Window.partitionBy("event_type", "place").orderBy("day")).alias("y"))
    return inside.union(across).where("y IS NOT NULL AND x.report_id <> y.report_id").select(F.col("x.event_id").alias("src"), F.col("y.event_id").alias("dst"))
