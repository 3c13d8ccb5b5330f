"""The registered queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.functions import text as X
from marram.functions import vocab as V
from marram.operators import contradictions, evaluation, evidence, extraction, graph, ingest, metrics, orphans, scoring, similar
from marram.operators.rows import accept_new, once
from marram.plans import core_sql
from marram.plans.shared import cut, salted_join
from marram.sources import tables


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(_t(spark, d, "reports"), _t(spark, d, "claims"), _t(spark, d, "evidence_links"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_t(spark, d, "reports"), _t(spark, d, "claims"), _t(spark, d, "evidence_links"), _t(spark, d, "audit_log"))


_CLAIM = ["report_id", "segment_index", "event_type", "location_text", "resolved_location", "people_affected", "severity", "time_reference", "description", "verification_state", "independent_source_count", "evidence_confidence", "created_at"]
_REPORT = ["ingested_at", "source_type", "source_language", "raw_text", "location_hint", "reporter_id", "processed", "suspected_injection", "text_hash"]


def _claims(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(_t(spark, d, "claims"), "event_id", *(columns or _CLAIM))


def _reports(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(_t(spark, d, "reports"), "report_id", *(columns or _REPORT), wide="raw_text")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return once(_t(spark, d, "evidence_links"), "link_id", "event_id", "report_id", "field_path", "reason")


def conflicts_detected(spark, d):
    return contradictions.contradictions(_claims(spark, d), False)


def conflict_classes(spark, d):
    return contradictions.claim_classes(_claims(spark, d), False).select("branch", "place", "known", "event_type", "people_affected", "clock", F.col("first.event_id").alias("first_event_id"), "n")


def claims_disputed(spark, d):
    return contradictions.disputed(_claims(spark, d), False).select("event_id", "verification_state")


def conflict_sides(spark, d):
    return evidence.conflict_sides(_t(spark, d, "conflicts"), _claims(spark, d), _reports(spark, d, "source_language"))


def conflicts_fresh(spark, d):
    stored = _t(spark, d, "conflicts")
    new = stored.select(F.col("event_b_id").alias("event_a_id"), F.col("event_a_id").alias("event_b_id"), F.when(F.col("status") == "dismissed", "location").otherwise(F.col("conflict_type")).alias("conflict_type"))
    return evidence.fresh_conflicts(new, stored)


def conflicts_by_status(spark, d):
    return _t(spark, d, "conflicts").where("status = 'unresolved'").select("conflict_id", "conflict_type", "severity", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected")).orderBy(F.desc("detected"), "conflict_id")


def reports_listed(spark, d):
    r = _reports(spark, d, "ingested_at", "source_language", "processed", "suspected_injection").where("source_language = 'fr' AND processed AND NOT suspected_injection")
    return r.orderBy(F.desc("ingested_at"), "report_id").limit(200).select("report_id", "source_language", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested"))


def claims_listed(spark, d):
    c = _claims(spark, d, "event_type", "severity", "location_text", "created_at").where("severity = 'high'").where(F.col("location_text").ilike("%kelghadou%"))
    return c.orderBy(F.desc("created_at"), "event_id").limit(500).select("event_id", "event_type", "location_text")


def reports_pending(spark, d):
    return _reports(spark, d, "processed", "ingested_at").where("NOT processed").orderBy("ingested_at", "report_id").limit(500).select("report_id")


def report_by_id(spark, d):
    least = _reports(spark, d, "source_type").agg(F.min("report_id").alias("report_id"))
    return _reports(spark, d, "source_type", "source_language").join(F.broadcast(least), "report_id")  # one row


def audit_of_entity(spark, d):
    a = _t(spark, d, "audit_log")
    least = a.where("action = 'report_restored'").agg(F.min("entity_id").alias("entity_id"))
    return a.join(F.broadcast(least), "entity_id").select("audit_id", "entity_id", "action", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged")).orderBy("logged", "audit_id")  # one row


def audit_recent(spark, d):
    return _t(spark, d, "audit_log").orderBy(F.desc("logged_at"), "audit_id").limit(100).select("audit_id", "action")


def audit_appended(spark, d):
    return ingest.audit_rows(_reports(spark, d, "ingested_at")).select("audit_id", "entity_id", "action")


def ingest_checked(spark, d):
    return ingest.ingested(_reports(spark, d, "raw_text", "source_language", "source_type", "location_hint", "reporter_id"))


def ingest_new(spark, d):
    """The stored table as a delivery (copies included) to a store that holds its processed reports: the first of each new report_id is accepted."""
    r = _t(spark, d, "reports").where("report_id IS NOT NULL").select("report_id", "ingested_at", "processed")
    return accept_new(r, r.where("processed"), "report_id", "ingested_at").select("report_id")


def ingest_hash_check(spark, d):
    return ingest.hash_check(_reports(spark, d, "raw_text", "text_hash"))


def segments_of_reports(spark, d):
    return ingest.segmented(_reports(spark, d, "raw_text"))


def text_model_view(spark, d):
    return _reports(spark, d, "raw_text").select("report_id", X.model_view(F.col("raw_text")).alias("view"))


def text_severity(spark, d):
    return _reports(spark, d, "raw_text").select("report_id", X.licensed_severity(F.col("raw_text")).alias("severity"))


def text_normal(spark, d):
    return _reports(spark, d, "raw_text").select("report_id", X.normal(F.col("raw_text"), False).alias("form"))


def text_normal_compatible(spark, d):
    return _reports(spark, d, "raw_text").select("report_id", X.normal(F.col("raw_text")).alias("form"))


def text_fingerprints(spark, d):
    return _reports(spark, d, "raw_text").select("report_id", X.fingerprint(F.col("raw_text"), False).alias("fingerprint"))


def text_clocks(spark, d):
    c = X.clocks(F.col("raw_text"))
    return _reports(spark, d, "raw_text").select("report_id", F.array_join(c, "/").alias("clocks"), X.minutes(F.array_min(c)).alias("first_minute")).where("clocks <> ''")


def text_words(spark, d):
    w = X.words(F.col("raw_text"))
    return _reports(spark, d, "raw_text").select("report_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"))


def text_wire(spark, d):
    c = _claims(spark, d, "event_type", "location_text", "people_affected", "severity", "time_reference")
    q = lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(x), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("null"))
    wire = F.concat(F.lit("events:[{type:"), "event_type", F.lit(",location:"), q("location_text"), F.lit(",people:"), F.coalesce(F.col("people_affected").cast("string"), F.lit("null")), F.lit(",severity:"), "severity", F.lit(",time:"), q("time_reference"), F.lit(",desc:null}]"))
    return c.select("event_id", F.explode(X.wire_events(wire)).alias("e")).select("event_id", F.col("e.event_type"), F.col("e.location_text"), F.col("e.people_affected").cast("int").alias("people_affected"), F.col("e.severity"), F.col("e.time_reference"))


def guard_counts(spark, d):
    c = _claims(spark, d, "report_id", "people_affected").where("people_affected IS NOT NULL")
    return c.join(_reports(spark, d, "raw_text"), "report_id").select("event_id", X.grounded_count(F.col("people_affected").cast("string"), F.col("raw_text")).alias("people"))


def guard_severity(spark, d):
    j = _claims(spark, d, "report_id", "severity").join(_reports(spark, d, "raw_text", "suspected_injection"), "report_id")
    return j.select("event_id", X.capped_severity(F.col("severity"), X.licensed_severity(F.col("raw_text")), F.col("suspected_injection")).alias("severity"))


def guard_places(spark, d):
    c = _claims(spark, d, "location_text")
    clean = X.cleaned(F.col("location_text"), F.trim(F.regexp_replace(F.lower("location_text"), r"\s+", " ")))
    return c.select("event_id", F.when(~X.is_echo(clean), clean).alias("place"))


def guard_types(spark, d):
    return _claims(spark, d, "event_type").select("event_id", F.when(F.col("event_type").isin(V.EVENT_TYPES), F.col("event_type")).otherwise("other").alias("event_type"))


def guard_uncertainties(spark, d):
    note = lambda cond, what: F.when(cond, F.lit(what))
    notes = F.array_compact(F.array(note(F.col("people_affected").isNull(), "no people count stated in report"), note(F.col("severity") == "unknown", "severity not stated in report"), note(F.coalesce("location_text", F.lit("")) == "", "no location stated in report"), note(F.coalesce("time_reference", F.lit("")) == "", "no time reference stated in report")))
    return _claims(spark, d, "people_affected", "severity", "location_text", "time_reference").select("event_id", F.array_join(notes, "; ").alias("notes"))


def links_unpivoted(spark, d):
    return evidence.unpivoted(_claims(spark, d))


def links_ungrounded(spark, d):
    return evidence.ungrounded(_claims(spark, d, "report_id"), _links(spark, d))


def links_reports_per_claim(spark, d):
    return _links(spark, d).where("event_id IS NOT NULL").groupBy("event_id").agg(F.countDistinct("report_id").alias("reports"), F.count("*").alias("links"))


def claims_with_reports(spark, d):
    r = _reports(spark, d, "reporter_id", "source_language", "suspected_injection")
    return _claims(spark, d, "report_id", "event_type").join(r, "report_id", "left").select("event_id", "report_id", "event_type", "reporter_id", "source_language", "suspected_injection")


def duplicates_exact(spark, d):
    return evidence.duplicate_groups(_reports(spark, d, "ingested_at", "text_hash"))


def duplicates_members(spark, d):
    return evidence.group_members(_reports(spark, d, "text_hash"))


def duplicates_names(spark, d):
    return similar.similar_pairs(_t(spark, d, "gazetteer").select(X.normal(F.col("name"), False).alias("value")))


def corroboration(spark, d):
    return evidence.corroboration(_claims(spark, d), _reports(spark, d))


def claims_evaluated(spark, d):
    return evaluation.evaluated(_claims(spark, d), _reports(spark, d, "reporter_id", "raw_text", "source_language", "suspected_injection"), False).select("event_id", "independent_source_count", "evidence_confidence", "verification_state")


def claims_resolved(spark, d):
    c = _claims(spark, d, "event_type", "location_text", "resolved_location", "location_confidence", "created_at")
    return evaluation.resolved(c, _t(spark, d, "gazetteer"), False).select("event_id", "resolved_location", "location_confidence")


def places_canonical(spark, d):
    return evaluation.canonical_names(_claims(spark, d), _t(spark, d, "gazetteer"), False)


def confidence_grid(spark, d):
    g = spark.range(0, 80).select((F.col("id") % 10).cast("int").alias("sources"), (F.floor(F.col("id") / 10) % 4 + 1).cast("int").alias("languages"), F.when(F.col("id") < 40, 1.0).otherwise(0.7).alias("weight"))
    return g.withColumn("confidence", evidence.confidence(F.col("sources"), F.col("languages"), F.col("weight")))


def places_first_names(spark, d):
    return evidence.first_names(_claims(spark, d))


def places_aliases(spark, d):
    names = _claims(spark, d, "location_text").select(X.place_name(F.col("location_text"), False).alias("name_key")).distinct()
    return evidence.same_group_names(names, _t(spark, d, "gazetteer"))


def places_keys(spark, d):
    c = F.col("location_text")
    return _claims(spark, d, "location_text").where("location_text IS NOT NULL").select("event_id", X.place_key(c, False).alias("key"), X.place_name(c, False).alias("name"), F.lower(F.trim(c)).alias("raw"), X.is_generic(X.place_name(c, False)).alias("generic"), F.array_join(F.array_sort(X.content_tokens(X.place_name(c, False))), " ").alias("tokens"))


def places_resolution(spark, d):
    g = _t(spark, d, "gazetteer")
    return extraction.resolution(_claims(spark, d, "location_text").where("location_text IS NOT NULL").select(F.col("location_text").alias("mention")), g.where("preferred").select(F.col("name").alias("canonical")), g.select("name", "group_id"), compatibility=False)


def claims_collapsed(spark, d):
    return extraction.collapsed(_claims(spark, d), compatibility=False).select("event_id")


def _rules():
    """A stand-in for a model: a few words and the first number of a segment."""
    import re

    def rules(texts: list[str]) -> list[str]:
        return ["events:[{type:" + ("injury" if "hurt" in t or "bless" in t else "other") + ",location:null,people:" + next((w for w in re.split(r"\s+", t, flags=re.ASCII) if w.isascii() and w.isdigit() and len(w) < 9), "null") + ",severity:high,time:null,desc:null}]" for t in texts]

    return rules


def claims_extracted(spark, d):
    return extraction.extracted(_reports(spark, d, "raw_text", "suspected_injection"), _rules).select("report_id", "segment_index", "event_type", "people_affected", "severity", F.array_join("guards_applied", "|").alias("guards"))


def reports_processed(spark, d):
    """What processing leaves of every report: its segments, claims and links."""
    out = extraction.processed(_reports(spark, d, "raw_text", "suspected_injection", "ingested_at"), _rules)
    links = out["links"].groupBy("report_id").agg(F.count("*").alias("links"))
    return out["reports"].join(links, "report_id", "left").select("report_id", "segment_count", "claims", F.coalesce("links", F.lit(0)).alias("links"))


def duplicates_classified(spark, d):
    """How alike the reports behind the two sides of each conflict are."""
    c = _claims(spark, d, "report_id").select("event_id", "report_id")
    side = lambda s: c.select(F.col("event_id").alias(f"event_{s}_id"), F.col("report_id").alias(f"r{s}"))
    t = _reports(spark, d, "raw_text").select("report_id", X.normal(F.col("raw_text"), False).alias("form"), X.fingerprint(F.col("raw_text"), False).alias("print"))
    text = lambda s: t.select(F.col("report_id").alias(f"r{s}"), F.col("form").alias(f"f{s}"), F.col("print").alias(f"p{s}"))
    j = _t(spark, d, "conflicts").select("conflict_id", "event_a_id", "event_b_id").join(side("a"), "event_a_id").join(side("b"), "event_b_id").join(text("a"), "ra").join(text("b"), "rb")
    j = j.select("conflict_id", F.transform(F.array(F.struct(F.round(X.similarity(F.col("fa"), F.col("fb")), 6).alias("s"), (F.col("pa") == F.col("pb")).alias("same"))), lambda x: F.struct(x["s"].alias("similarity"), X.duplicate_class(x["same"], x["s"]).alias("class")))[0].alias("c"))
    return j.select("conflict_id", "c.similarity", "c.class")


def graph_nodes(spark, d):
    return graph.nodes(_claims(spark, d), _reports(spark, d, "source_type"))


def graph_edges(spark, d):
    return graph.edges(_claims(spark, d), _t(spark, d, "conflicts"))


def graph_stats(spark, d):
    return graph.stats(graph_nodes(spark, d), graph_edges(spark, d))


def metrics_summary(spark, d):
    return metrics.summary(_claims(spark, d), _reports(spark, d, "suspected_injection", "processed"), _t(spark, d, "conflicts"), duplicates_exact(spark, d), "rules", "offline")


def metrics_states(spark, d):
    return metrics.histogram(_claims(spark, d, "verification_state"), "verification_state")


def metrics_languages(spark, d):
    return metrics.histogram(_reports(spark, d, "source_language"), "source_language")


def score_locations(spark, d):
    """Old resolutions of places that were typed as the gazetteer writes them, against its preferred names."""
    g = _t(spark, d, "gazetteer").where("name IS NOT NULL")
    best = g.where("preferred").groupBy("group_id").agg(F.min("name").alias("want"))
    truth = g.groupBy(F.col("name").alias("location_text")).agg(F.min("group_id").alias("group_id")).join(best, "group_id").select("location_text", "want")
    c = salted_join(_claims(spark, d, "location_text", "resolved_location").where("resolved_location IS NOT NULL"), truth, ["location_text"], "event_id")
    return c.select("event_id", F.round(scoring.location_score(scoring.place_tokens(F.col("want"), False), F.col("location_text"), F.col("resolved_location"), False), 6).alias("score"))


def duplicates_fresh(spark, d):
    """Exact duplicate groups that no claim carries yet."""
    stored = _claims(spark, d, "duplicate_group_id").select(F.col("duplicate_group_id").alias("group_id")).where("group_id IS NOT NULL").distinct()
    return duplicates_exact(spark, d).join(stored, "group_id", "left_anti")


def duplicates_claims(spark, d):
    """The claims of every member of an exact duplicate group: rows, not arrays, as a group has no bound."""
    return duplicates_members(spark, d).join(_claims(spark, d, "report_id"), "report_id").select("group_id", "report_id", "event_id")


def claims_detail(spark, d):
    """Each claim with its report's language and number of links and contradictions; conflicts become sides, so no join needs an OR."""
    k = _t(spark, d, "conflicts")
    sides = k.select("conflict_id", "conflict_type", F.explode(F.array("event_a_id", "event_b_id")).alias("event_id")).groupBy("event_id").agg(F.countDistinct("conflict_id").alias("conflicts"), F.array_join(F.array_sort(F.collect_set("conflict_type")), "|").alias("conflict_types"))
    links = _links(spark, d).where("event_id IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("links"))
    c = _claims(spark, d, "report_id", "event_type").join(_reports(spark, d, "source_language"), "report_id", "left").join(links, "event_id", "left").join(sides, "event_id", "left")
    return c.select("event_id", "report_id", "event_type", F.coalesce("source_language", F.lit("und")).alias("source_language"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("conflict_types", F.lit("")).alias("conflict_types"))


def links_report_sets(spark, d):
    """The set of reports of every claim, as rows."""
    return _links(spark, d).where("event_id IS NOT NULL AND report_id IS NOT NULL").select("event_id", "report_id").distinct()


def links_moved(spark, d):
    """Links after repeats within a report fell away: those of a dropped claim lead to the one that stays."""
    return extraction.moved_links(_links(spark, d), extraction.repeats(_claims(spark, d), compatibility=False)).select("link_id", "event_id", "report_id")


def claims_keys(spark, d):
    """The comparison key of each claim: its resolved, else its typed place."""
    place = X.place_of(F.col("resolved_location"), F.col("location_text"))
    return _claims(spark, d, "resolved_location", "location_text").select("event_id", X.place_key(place, False).alias("key"))


def places_count(spark, d):
    return evaluation.canonical_names(_claims(spark, d), _t(spark, d, "gazetteer"), False).agg(F.countDistinct("canonical").alias("places"))


def metrics_latency(spark, d):
    """Milliseconds of extraction a report."""
    return _claims(spark, d, "report_id", "extraction_latency_ms").where("report_id IS NOT NULL").groupBy("report_id").agg(F.coalesce(F.sum("extraction_latency_ms"), F.lit(0)).alias("latency_ms"), F.count("*").alias("claims"))


def metrics_pairs(spark, d):
    """Pairs of claims that a comparison of all would take."""
    return _claims(spark, d, "report_id").agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs"))


def graph_colours(spark, d):
    return _claims(spark, d, "verification_state").select(F.concat(F.lit("event:"), "event_id").alias("id"), graph.colour(F.col("verification_state")).alias("colour"))


def graph_written(spark, d):
    """Nodes written as JSON and read again."""
    return tables.through_json(graph.nodes(_claims(spark, d), _reports(spark, d, "source_type")))


def guard_placeholders(spark, d):
    """Placeholder cleaning with its own fold, over what the claims say and over the placeholders in other spellings."""
    c = _claims(spark, d, "location_text").where("location_text IS NOT NULL")
    return c.select("event_id", X.cleaned(F.col("location_text")).alias("place"), X.cleaned(F.concat(F.lit(" "), F.upper("location_text"))).isNull().alias("dropped"))


def _scored(spark, d):
    """Stored claims as expected ones, and what guards and collapse make of them as predicted ones."""
    c = _claims(spark, d)
    order = F.row_number().over(Window.partitionBy("report_id").orderBy("segment_index", "created_at", "event_id")) - 1
    c = c.where("report_id IS NOT NULL").withColumn("n", order)
    expected = c.select("report_id", "n", "event_type", scoring.place_tokens(F.col("location_text"), False).alias("location_tokens"), "people_affected", "severity")
    text = _reports(spark, d, "raw_text", "suspected_injection").groupBy("report_id").agg(F.max("suspected_injection").alias("flagged"), F.max(X.licensed_severity(F.col("raw_text"))).alias("licensed"))
    kept = extraction.collapsed(c, compatibility=False).join(text, "report_id")
    predicted = kept.select(
        "report_id", "event_id", "n", "event_type", "location_text", "resolved_location", "people_affected", X.capped_severity(F.col("severity"), F.col("licensed"), F.col("flagged")).alias("severity"),
        "verification_state", "independent_source_count", "time_reference", "created_at",
    )
    expected, predicted = cut(expected), cut(predicted)  # read several times, and texts are read for the second
    return expected, predicted, cut(scoring.matched(expected, predicted, accents=False))


def score_matches(spark, d):
    return _scored(spark, d)[2].withColumn("score", F.round("score", 6))


def score_fields(spark, d):
    return scoring.precision_recall(scoring.field_counts(*_scored(spark, d), accents=False))


def score_shapes(spark, d):
    """Shapes of the stored contradictions, as designed and with those that detection finds again."""
    designed, detected = _shapes(spark, d, _claims(spark, d))
    key = ["kind", "first_type", "second_type", "place"]
    return designed.join(detected.withColumn("detected", F.lit(True)), key, "left").select(*key, "comparable", F.coalesce("detected", F.lit(False)).alias("detected"))


def _designed(spark, d, claims):
    c = _claims(spark, d, "report_id").select("event_id", "report_id")
    pairs = _t(spark, d, "conflicts").join(c.select(F.col("event_id").alias("event_a_id"), F.col("report_id").alias("report_a")), "event_a_id").join(c.select(F.col("event_id").alias("event_b_id"), F.col("report_id").alias("report_b")), "event_b_id").select("report_a", "report_b").distinct()
    return scoring.shapes(pairs, claims)


def _shapes(spark, d, claims):
    return _designed(spark, d, claims), scoring.detected_shapes(contradictions.contradictions(claims, False).select("event_a_id", "event_b_id"), claims)


def score_weighted(spark, d):
    """The weighted score of guarded and collapsed claims, the stored ones being expected."""
    expected, predicted, matches = _scored(spark, d)
    flagged = _reports(spark, d, "suspected_injection").where("suspected_injection").select("report_id").distinct()
    designed, detected = _designed(spark, d, predicted), scoring.comparable_shapes(predicted, False)
    row = scoring.components(expected, predicted, matches, _links(spark, d), flagged, designed, detected, accents=False)
    return scoring.weighted(row.select(*[F.round(k, 6).alias(k) for k in scoring.WEIGHTS]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in [
        conflicts_detected, conflict_classes, claims_disputed, conflict_sides, conflicts_fresh, conflicts_by_status, reports_listed, claims_listed, reports_pending, report_by_id, audit_of_entity, audit_recent, audit_appended,
        ingest_checked, ingest_new, ingest_hash_check, segments_of_reports, text_model_view, text_severity, text_normal, text_normal_compatible, text_fingerprints, text_clocks, text_words, text_wire,
        guard_counts, guard_severity, guard_places, guard_types, guard_uncertainties, links_unpivoted, links_ungrounded, links_reports_per_claim, claims_with_reports, duplicates_exact, duplicates_members, duplicates_names,
        corroboration, claims_evaluated, claims_resolved, places_canonical, confidence_grid, places_first_names, places_aliases, places_keys, places_resolution, claims_collapsed, claims_extracted, reports_processed, graph_nodes, graph_edges, graph_stats, metrics_summary, metrics_states, metrics_languages, score_locations, score_matches, score_fields, duplicates_classified, score_shapes, score_weighted,
        duplicates_fresh, duplicates_claims, claims_detail, links_report_sets, links_moved, claims_keys, places_count, metrics_latency, metrics_pairs, graph_colours, graph_written, guard_placeholders, p5_found, p5_report,
    ]
}

_ORPHANS = """
WITH r AS (SELECT report_id AS key, min(ingested_at) AS first_at FROM reports WHERE report_id IS NOT NULL GROUP BY 1),
c AS (SELECT event_id AS key, min(created_at) AS first_at FROM claims WHERE event_id IS NOT NULL GROUP BY 1),
refs AS (
  SELECT DISTINCT 'claims' AS source_table, 'report_id' AS ref_field, 'reports' AS target, event_id AS row_id, report_id AS key, created_at FROM claims
  UNION ALL SELECT DISTINCT 'evidence_links', 'report_id', 'reports', link_id, report_id, created_at FROM evidence_links
  UNION ALL SELECT DISTINCT 'evidence_links', 'event_id', 'claims', link_id, event_id, created_at FROM evidence_links),
bad AS (
  SELECT refs.*, CASE WHEN target = 'reports' THEN r.first_at ELSE c.first_at END AS seen FROM refs
  LEFT JOIN r ON refs.target = 'reports' AND r.key = refs.key LEFT JOIN c ON refs.target = 'claims' AND c.key = refs.key
  WHERE refs.key IS NOT NULL AND refs.row_id IS NOT NULL)
"""
SQL: dict[str, str] = {
    "p5_found": _ORPHANS + "SELECT DISTINCT source_table, ref_field, row_id FROM bad WHERE seen IS NULL OR created_at < seen",
    "p5_report": _ORPHANS
    + """, log AS (
  SELECT DISTINCT CASE WHEN action LIKE 'report%' THEN 'reports' ELSE 'claims' END AS target, entity_id AS key, logged_at, action LIKE '%deleted' AS gone
  FROM audit_log WHERE action IN ('report_deleted', 'event_deleted', 'report_restored', 'event_restored')),
turns AS (SELECT *, lag(gone) OVER (PARTITION BY target, key ORDER BY logged_at, gone) AS before FROM log),
spans AS (SELECT target, key, gone, logged_at AS removed_at, lead(logged_at) OVER (PARTITION BY target, key ORDER BY logged_at, gone) AS restored_at FROM turns WHERE gone <> coalesce(before, false)),
gone AS (SELECT target, key, bool_or(restored_at IS NULL) AS stands, list(struct_pack(a := removed_at, b := restored_at)) AS spans FROM spans WHERE gone GROUP BY 1, 2),
k AS (
  SELECT bad.*, spans, CASE WHEN seen IS NOT NULL THEN 'late' WHEN stands THEN 'deleted' ELSE 'missing' END AS kind
  FROM bad LEFT JOIN gone ON bad.seen IS NULL AND gone.target = bad.target AND gone.key = bad.key WHERE seen IS NULL OR created_at < seen)
SELECT source_table, ref_field, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period, kind, count(*) AS refs, count(DISTINCT key) AS keys,
  count(CASE WHEN len(list_filter(spans, lambda x: created_at >= x.a AND (x.b IS NULL OR created_at < x.b))) > 0 THEN 1 END) AS after_removal FROM k GROUP BY 1, 2, 3, 4""",
}


SQL |= core_sql.statements()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
