"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import sentences

    return sentences.found(_t(spark, d, "reports"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import sentences

    return sentences.counts(_t(spark, d, "reports"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import places

    return places.found(_t(spark, d, "claims"), _t(spark, d, "entities"), _t(spark, d, "gazetteer"))


def p2_resolved(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import places

    return places.resolved(_t(spark, d, "claims"), _t(spark, d, "gazetteer"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import places

    return places.unmatched(_t(spark, d, "claims"), _t(spark, d, "entities"), _t(spark, d, "gazetteer"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import duplicates

    return duplicates.format_found(_t(spark, d, "reports"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import duplicates

    return duplicates.format_records(_t(spark, d, "reports"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import near

    return near.near_found(_t(spark, d, "reports"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import forms

    return forms.found(_t(spark, d, "reports"), _t(spark, d, "claims"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import forms

    return forms.all_forms(_t(spark, d, "reports"), _t(spark, d, "claims"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import languages

    return languages.found(_t(spark, d, "reports"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import languages

    return languages.documents(_t(spark, d, "reports"))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import languages

    return languages.settled(_t(spark, d, "reports"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import leaks

    return leaks.found(_t(spark, d, "documents"), _t(spark, d, "eval_items"), _t(spark, d, "reports"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import leaks

    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"), _t(spark, d, "reports"))


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import leaks

    return leaks.every(_t(spark, d, "documents"), _t(spark, d, "eval_items"), _t(spark, d, "reports"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import leaks

    return leaks.clean(_t(spark, d, "documents"), _t(spark, d, "eval_items"), _t(spark, d, "reports"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import mixing

    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import mixing

    return mixing.select(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import levels

    return levels.found(_t(spark, d, "documents"), _t(spark, d, "level_labels"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    from marram.llm import levels

    return levels.profile(_t(spark, d, "documents"), _t(spark, d, "level_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def _p6_sql(outs: str, where: str) -> str:
    """The embedded SQL of the consistent form over whole tables instead of Arrow batches."""
    from marram.llm import forms

    both = "(SELECT 'reports' AS source_table, report_id AS row_id, raw_text AS text FROM reports UNION SELECT 'claims', event_id, location_text FROM claims)"
    return f"SELECT DISTINCT {outs} FROM ({forms.form_sql('text', both, 'source_table, row_id', 'source_table, row_id, s0, s4')}) WHERE row_id IS NOT NULL AND s4 IS NOT NULL{where}"


def oracle_sql() -> dict[str, str]:
    """Statements for what SQL can say; the other operators are tested against brute force and held-out accuracy."""
    return {"p6_found": _p6_sql("source_table, row_id", " AND s4 <> s0"), "p6_forms": _p6_sql("source_table, row_id, s4 AS form", "")}
