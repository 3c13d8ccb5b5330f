"""Streams over reports and claims (beyond the batch capabilities): late data, exact forwards, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import text as X
from marram.sources.tables import SCHEMAS


def incoming(spark: SparkSession, folder: str, table: str = "reports") -> DataFrame:
    """A stream of Parquet files with the declared schema."""
    return spark.readStream.schema(SCHEMAS[table]).parquet(folder)


def first_of_copies(reports: DataFrame, late: str = "7 days") -> DataFrame:
    """The first report of each text within the watermark."""
    return reports.withColumn("text_hash", F.sha2("raw_text", 256)).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["text_hash"])


def claims_by_place(claims: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Claims per place and event type in tumbling windows."""
    place = X.place_key(X.place_of(F.col("resolved_location"), F.col("location_text")), False)
    return claims.withWatermark("created_at", late).groupBy(F.window("created_at", window), place.alias("place"), "event_type").agg(F.count("*").alias("claims"), F.sum("people_affected").alias("people"))


def bursts(claims: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of claims on one place, ended by a gap."""
    place = X.place_key(X.place_of(F.col("resolved_location"), F.col("location_text")), False)
    return claims.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), place.alias("place")).agg(F.count("*").alias("claims"))


def recompute(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a batch function on everything available, once, with exactly-once progress."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
