"""Typed readers of the stored tables and of the JSON corpora; writers of graph and scores. No schema is ever inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.plans.shared import checkpoint_folder

SCHEMAS = {
    "reports": "report_id string, ingested_at timestamp, reported_at timestamp, source_type string, source_language string, raw_text string, location_hint string, reporter_id string, metadata map<string,string>, text_hash string, processed boolean, processed_at timestamp, suspected_injection boolean, injection_signals array<string>, segment_count int",
    "claims": "event_id string, report_id string, segment_index int, event_type string, description string, location_text string, resolved_location string, location_confidence double, people_affected int, severity string, time_reference string, event_timestamp timestamp, uncertainties array<string>, model_confidence double, evidence_confidence double, verification_state string, independent_source_count int, duplicate_group_id string, model_used string, model_label string, prompt_version string, grammar_version string, extraction_latency_ms int, guards_applied array<string>, created_at timestamp",
    "evidence_links": "link_id string, event_id string, report_id string, field_path string, reason string, created_at timestamp",
    "conflicts": "conflict_id string, event_a_id string, event_b_id string, conflict_type string, severity string, explanation string, evidence array<string>, status string, resolved_by string, resolved_at timestamp, detected_at timestamp, detection_rule string",
    "audit_log": "audit_id string, entity_type string, entity_id string, action string, actor string, detail string, logged_at timestamp",
}
_CORPUS = "scenario string, t0 string, seed long, reports array<struct<report_id:string, raw_text:string, source_language:string, reported_at:string, source_type:string, reporter_id:string, metadata:map<string,string>>>"
_TRUTH = "scenario string, seed long, annotations array<struct<report_id:string, source_language:string, expected_events:array<struct<event_type:string, location_ref:string, location_tokens:array<string>, people_affected:int, severity:string>>, is_duplicate_of:string, conflicts_with:array<string>, should_abstain_fields:array<string>, design_note:string>>"


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table with its declared schema; filters and columns reach the files."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def append(df: DataFrame, folder: str, table: str) -> None:
    """Append-only write in the declared column order."""
    df.select(*[f.split(" ")[0] for f in _columns(SCHEMAS[table])]).write.mode("append").parquet(f"{folder}/{table}.parquet")


def _columns(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Reports of JSON corpus files, one row a report."""
    df = spark.read.schema(_CORPUS).json(path, multiLine=True)
    return df.select("scenario", F.explode("reports").alias("r")).select("scenario", "r.*").withColumn("reported_at", F.to_timestamp("reported_at"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected claims of JSON annotation files: one row an expected claim, reports without any keep one row with null n."""
    df = spark.read.schema(_TRUTH).json(path, multiLine=True).select(F.explode("annotations").alias("a"))
    return df.select("a.report_id", "a.source_language", "a.is_duplicate_of", "a.should_abstain_fields", F.posexplode_outer("a.expected_events").alias("n", "e")).select("report_id", "source_language", "is_duplicate_of", "should_abstain_fields", "n", "e.*")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as JSON lines in two folders."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def write_scores(row: DataFrame, folder: str) -> None:
    row.write.mode("overwrite").json(folder)


def through_json(df: DataFrame) -> DataFrame:
    """The rows after a round through JSON lines in the shared folder, read with their schema."""
    folder = f"{checkpoint_folder(df.sparkSession)}/json-{uuid.uuid4().hex}"
    df.write.json(folder)
    return df.sparkSession.read.schema(df.schema).json(folder)


def create(spark: SparkSession, folder: str, overwrite: bool = False) -> None:
    """Every declared table, empty, in a folder; existing ones are only replaced on demand."""
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{table}.parquet")


def timeline(spark: SparkSession, t0: str, offsets: DataFrame) -> DataFrame:
    """offsets (…, minutes) with reported_at, minutes after t0."""
    return offsets.withColumn("reported_at", F.to_timestamp(F.lit(t0)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes")))
