"""References to records that do not exist, or not yet (problem 5).

References are first reduced to one row a key (the earliest reference, combined
before the shuffle), co-partitioned and sorted with the parents' keys and
merged; only keys that fail for at least one reference go back to the rows, each
spread over as many tasks as its references need, so neither a hot healthy key
nor a hot orphan key fills a task. Absent keys are held against the intervals in
which their parent was removed: a removal that stands makes them deleted.

Defined results: null references and null row ids are no references; a
reference without a creation time fails only if its key is absent; a parent
without a time is taken as always there; copies of a row count once; an empty
parent table makes every reference an orphan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.plans.shared import salted_join, spread_join


def _parents(df: DataFrame, key: str, at: str) -> DataFrame:
    epoch = F.lit("0001-01-01").cast("timestamp")
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.coalesce(at, epoch)).alias("first_at"))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs (row_id, key, created_at) whose key is absent or came later; first_at is null where absent."""
    refs = refs.where("row_id IS NOT NULL AND key IS NOT NULL")
    keys = refs.groupBy("key").agg(F.min("created_at").alias("least"), F.count("*").alias("n"))
    bad = keys.join(parents.hint("merge"), "key", "left").where("first_at IS NULL OR least < first_at").select("key", "first_at", "n")
    return spread_join(refs, bad, "key", "row_id").where("first_at IS NULL OR created_at < first_at").select(*refs.columns, "first_at").distinct()


def references(claims: DataFrame, links: DataFrame) -> dict[tuple[str, str, str], DataFrame]:
    """Row id, key and creation time of each referring column, by (source table, column, target)."""
    pick = lambda df, row, key: df.select(F.col(row).alias("row_id"), F.col(key).alias("key"), F.col("created_at").alias("created_at"))
    return {
        ("claims", "report_id", "reports"): pick(claims, "event_id", "report_id"),
        ("evidence_links", "report_id", "reports"): pick(links, "link_id", "report_id"),
        ("evidence_links", "event_id", "claims"): pick(links, "link_id", "event_id"),
    }


def _all(reports: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    targets = {"reports": _parents(reports, "report_id", "ingested_at"), "claims": _parents(claims, "event_id", "created_at")}
    out = None
    for (table, field, target), refs in references(claims, links).items():
        one = orphans(refs, targets[target]).select(F.lit(table).alias("source_table"), F.lit(field).alias("ref_field"), F.lit(target).alias("target"), "row_id", "key", "created_at", "first_at")
        out = one if out is None else out.unionByName(one)
    return out


def found(reports: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """p5_found: one row per orphan reference."""
    return _all(reports, claims, links).select("source_table", "ref_field", "row_id").distinct()


def removals(audit: DataFrame) -> DataFrame:
    """target, key, removed_at, restored_at: the intervals in which a parent wasn't valid; restored_at is null where its removal stands."""
    target = F.when(F.col("action").isin("report_deleted", "report_restored"), "reports").when(F.col("action").isin("event_deleted", "event_restored"), "claims")
    logged = audit.select(target.alias("target"), F.col("entity_id").alias("key"), "logged_at", F.col("action").endswith("deleted").alias("gone")).where("target IS NOT NULL AND key IS NOT NULL AND logged_at IS NOT NULL").distinct()
    own = Window.partitionBy("target", "key").orderBy("logged_at", "gone")  # a key's few log entries
    # only changes of state count: of removals in a row the first, of restorations in a row the first
    changed = logged.withColumn("before", F.lag("gone").over(own)).where(F.col("gone") != F.coalesce("before", F.lit(False)))
    return changed.withColumn("restored_at", F.lead("logged_at").over(own)).where("gone").select("target", "key", F.col("logged_at").alias("removed_at"), "restored_at")


def report(reports: DataFrame, claims: DataFrame, links: DataFrame, audit: DataFrame) -> DataFrame:
    """Orphans per table, field, month and kind: missing, deleted (a removal is logged and stands) or late.

    A parent's validity intervals follow from its removals and restorations;
    after_removal counts the references made while it was removed.
    """
    rows = _all(reports, claims, links)
    gone = removals(audit).join(rows.where("first_at IS NULL").select("target", "key").distinct(), ["target", "key"], "left_semi")
    per = gone.groupBy("target", "key").agg(F.max(F.col("restored_at").isNull()).alias("stands"), F.collect_list(F.struct("removed_at", "restored_at")).alias("intervals"))
    kinds = salted_join(rows, per, ["target", "key"], "row_id", "left").withColumn("kind", F.when(F.col("first_at").isNotNull(), "late").when(F.col("stands"), "deleted").otherwise("missing"))
    away = F.exists("intervals", lambda x: (F.col("created_at") >= x["removed_at"]) & (x["restored_at"].isNull() | (F.col("created_at") < x["restored_at"])))
    return kinds.groupBy("source_table", "ref_field", F.date_format("created_at", "yyyy-MM").alias("period"), "kind").agg(
        F.count("*").alias("refs"), F.countDistinct("key").alias("keys"), F.count(F.when(away, 1)).alias("after_removal")
    )
