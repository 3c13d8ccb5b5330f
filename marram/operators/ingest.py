"""Reports on their way in: validation, hashes, signals, segments, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import text as X

SOURCE_TYPES = ["human_report", "batch", "demo", "audio_transcript"]


def reject_reason(text: Column, source_type: Column, hint: Column, reporter: Column) -> Column:
    """Null for rows that may enter."""
    return (
        F.when(X.blank(text), "blank text").when(F.length(text) > 8000, "text too long").when(~F.coalesce(source_type, F.lit("human_report")).isin(SOURCE_TYPES), "unknown source type")
        .when(F.length(hint) > 400, "hint too long").when(F.length(reporter) > 64, "reporter too long")
    )


def language_code(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.lower(F.trim(c)), 1, 8), F.lit("")), F.lit("und"))


def ingested(raw: DataFrame) -> DataFrame:
    """raw (report_id, raw_text, source_language, source_type, location_hint, reporter_id) with hash, signals, segment count, language, reject_reason."""
    signals = X.injection_signals(F.col("raw_text"))
    return raw.select(
        "report_id", F.sha2("raw_text", 256).alias("text_hash"), language_code(F.col("source_language")).alias("language"), F.array_join(signals, "|").alias("signals"), (F.size(signals) > 0).alias("suspected_injection"),
        F.size(X.segments(F.col("raw_text"))).alias("segment_count"), reject_reason(F.col("raw_text"), F.col("source_type"), F.col("location_hint"), F.col("reporter_id")).alias("reject_reason"),
    )


def segmented(reports: DataFrame) -> DataFrame:
    """One row a segment: report_id, segment_index, segment."""
    return reports.select("report_id", F.posexplode(X.segments(F.col("raw_text"))).alias("segment_index", "segment"))


def hash_check(reports: DataFrame) -> DataFrame:
    """Rows whose stored text_hash is missing or not that of the text."""
    h = F.sha2("raw_text", 256)
    return reports.where(F.col("text_hash").isNull() | (F.col("text_hash") != h)).select("report_id", F.when(F.col("text_hash").isNull(), "missing").otherwise("wrong").alias("problem"), h.alias("text_hash"))


def audit_rows(reports: DataFrame, action: str = "ingested") -> DataFrame:
    """Append-only audit rows of a stage, with ids that follow from their content."""
    key = F.concat_ws("|", F.lit(action), F.col("report_id"))
    return reports.select(F.concat(F.lit("ALOG-"), F.upper(F.substring(F.sha2(key, 256), 1, 10))).alias("audit_id"), F.lit("report").alias("entity_type"), F.col("report_id").alias("entity_id"), F.lit(action).alias("action"), F.col("ingested_at").alias("logged_at"))
