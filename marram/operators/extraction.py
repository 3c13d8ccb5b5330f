"""Claims out of reports: a pluggable extractor over segments, guards over what it says, places by a decision ladder.

An extractor is any function from a list of segments to a list of wire texts;
it is called once a batch inside a partition, so a model client lives as long
as its partition. Its failure fails the task: nothing is made up in its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions import text as X
from marram.functions import vocab as V
from marram.operators.evidence import unpivoted
from marram.operators.ingest import audit_rows, segmented

Extractor = Callable[[list[str]], list[str]]


def wires(segments: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """segments (report_id, segment_index, segment) with the extractor's wire text; each different segment is asked once over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(extract(b.column(0).to_pylist()), pa.string())], names=["segment", "wire"])

    said = segments.select("segment").distinct().mapInArrow(run, "segment string, wire string")
    return segments.select("report_id", "segment_index", "segment").join(said, "segment")


def guarded(rows: DataFrame, *more: str) -> DataFrame:
    """Raw claims (event fields, segment, suspected_injection) after all guards, with the guards that acted in guards_applied."""
    kind, place, time, desc = (X.cleaned(F.col(c)) for c in ("event_type", "location_text", "time_reference", "description"))
    people = X.grounded_count(F.col("people_affected"), F.col("segment"))
    licensed = X.licensed_severity(F.col("segment"))
    claimed = X.cleaned(F.col("severity"))
    n = F.col("people_affected").try_cast("bigint")
    tag = lambda cond, what: F.when(cond, what)
    said = F.col("people_affected").isNotNull() & (F.col("people_affected") != "null")
    # fixed values: the names of the guards that acted
    acted = F.array_compact(
        F.array(
            tag(kind.isNotNull() & ~kind.isin(V.EVENT_TYPES), F.concat(F.lit("event_type_out_of_taxonomy("), kind, F.lit(")->other"))), tag(X.is_echo(place), F.lit("location_delimiter_echo->null")),
            tag(said & n.isNull(), F.lit("people_unparseable->null")), tag(n <= 0, F.lit("people_nonpositive->null")), tag((n > 0) & people.isNull(), F.lit("people_not_in_source->null")),
            tag(time.contains("UNTRUSTED_REPORT"), F.lit("time_delimiter_echo->null")), tag(desc.contains("UNTRUSTED_REPORT"), F.lit("desc_delimiter_echo->null")),
            F.when(F.col("suspected_injection"), F.lit("injection_flagged->severity_forced_unknown")).when((licensed == "unknown") & (claimed != "unknown"), F.concat(F.lit("severity_unlicensed("), claimed, F.lit(")->unknown"))),
        )
    )
    return rows.select(
        "report_id", "segment_index", F.when(kind.isin(V.EVENT_TYPES), kind).otherwise("other").alias("event_type"), F.when(~X.is_echo(place), place).alias("location_text"), people.alias("people_affected"),
        X.capped_severity(claimed, licensed, F.col("suspected_injection")).alias("severity"), F.when(~time.contains("UNTRUSTED_REPORT"), time).alias("time_reference"), F.when(~desc.contains("UNTRUSTED_REPORT"), desc).alias("description"), acted.alias("guards_applied"), *more,
    )


def extracted(reports: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """Guarded claims of every report: model view, segments, extraction, parsing, guards. Ids follow from the place in the report."""
    view = reports.select("report_id", "suspected_injection", X.model_view(F.col("raw_text")).alias("raw_text"))
    said = wires(segmented(view), make).join(view.select("report_id", "suspected_injection"), "report_id")
    raw = said.select("report_id", "segment_index", "segment", "suspected_injection", F.posexplode(X.wire_events(F.col("wire"))).alias("k", "e")).select("*", "e.*")
    ident = F.concat(F.lit("EVT-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "report_id", "segment_index", "k"), 256), 1, 10)))
    return guarded(raw, "k").withColumn("event_id", ident).drop("k")


def processed(reports: DataFrame, make: Callable[[], Extractor]) -> dict[str, DataFrame]:
    """A batch of reports (report_id, raw_text, suspected_injection, ingested_at) end to end: claims, links, report states and audit rows, each to be appended or stored as it is.

    Every claim is grounded by a link for each field it states. A report counts
    its segments even where nothing is claimed.
    """
    claims = extracted(reports, make)
    links = unpivoted(claims).withColumn("link_id", F.concat(F.lit("LNK-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "event_id", "field_path"), 256), 1, 10)))).select("link_id", "event_id", "report_id", "field_path")
    counted = claims.groupBy("report_id").agg(F.count("*").alias("claims"))
    states = reports.select("report_id", F.size(X.segments(X.model_view(F.col("raw_text")))).alias("segment_count"), F.lit(True).alias("processed"))
    states = states.join(counted, "report_id", "left").select("report_id", "segment_count", "processed", F.coalesce("claims", F.lit(0)).alias("claims"))
    return {"claims": claims, "links": links, "reports": states, "audit_log": audit_rows(reports, "extracted")}


def resolution(mentions: DataFrame, known: DataFrame, aliases: DataFrame, enabled: bool = True, compatibility: bool = True) -> DataFrame:
    """The decision ladder for a mention against known places, with its reason; lexical evidence only.

    mentions (mention), known (canonical), aliases (name, group_id). A mention
    is generic, or equals a known place when normalised, or shares an alias
    group or a content word with one (the least such name), or is new.
    """
    m = mentions.select("mention", X.place_name(F.col("mention"), compatibility).alias("key")).distinct()
    k = known.select("canonical", X.place_name(F.col("canonical"), compatibility).alias("key")).distinct()
    g = aliases.select(X.place_name(F.col("name"), compatibility).alias("key"), "group_id").distinct()
    exact = m.join(k, "key").groupBy("mention").agg(F.min("canonical").alias("exact"))
    alias = m.join(g, "key").join(k.join(g, "key").select("canonical", "group_id"), "group_id").groupBy("mention").agg(F.min("canonical").alias("alias"))
    word = lambda df, name: df.select(name, F.explode(X.content_tokens(F.col("key"))).alias("w"))
    shared = word(m, "mention").join(word(k, "canonical"), "w").groupBy("mention").agg(F.min("canonical").alias("shared"))
    j = m.join(exact, "mention", "left").join(alias, "mention", "left").join(shared, "mention", "left")
    reason = (
        F.when(X.is_generic(F.col("key")), "generic_or_empty").when(F.lit(not enabled), "disabled").when(F.col("exact").isNotNull(), "exact_normalized_match")
        .when(F.col("alias").isNotNull(), "known_alias").when(F.col("shared").isNotNull(), "shared_content_word").otherwise("name_is_new")
    )
    j = j.withColumn("reason", reason)
    same = F.when(F.col("reason").isin("generic_or_empty", "disabled"), F.lit(None).cast("boolean")).otherwise(F.col("reason") != "name_is_new")
    canonical = F.when(F.col("reason") == "exact_normalized_match", F.col("exact")).when(F.col("reason") == "known_alias", F.col("alias")).when(F.col("reason") == "shared_content_word", F.col("shared")).otherwise(F.col("mention"))
    return j.select("mention", canonical.alias("canonical"), same.alias("same"), F.when(F.col("reason") == "exact_normalized_match", 1.0).when(F.col("reason").isin("known_alias", "shared_content_word"), 0.7).otherwise(0.0).alias("confidence"), "reason")


def repeats(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """gone, kept: claims that repeat another of their report, and the one that stays in their place.

    Of claims of one type and place (or of which one is silent about its place),
    the poorer goes if its count and time add nothing to the richer; ties are
    kept by the earlier segment. Reports are bounded groups; the comparison is a
    self-join within them. What stays is the richest claim that a repeat adds
    nothing to.
    """
    c = claims.withColumn("place", X.place_key(F.col("location_text"), compatibility)).withColumn("rich", F.struct((F.col("place") != "").cast("int").alias("a"), F.col("people_affected").isNotNull().cast("int").alias("b"), F.col("time_reference").isNotNull().cast("int").alias("c"), (-F.col("segment_index")).alias("d"), F.col("event_id").alias("e")))
    side = lambda s: c.select("report_id", "event_type", *[F.col(x).alias(f"{s}_{x}") for x in ("event_id", "place", "people_affected", "time_reference", "rich")])
    same = (F.col("p_place") == F.col("r_place")) | ((F.col("p_place") == "") != (F.col("r_place") == ""))
    nothing = lambda x: F.col(f"p_{x}").isNull() | (F.col(f"p_{x}") == F.col(f"r_{x}"))
    pairs = side("p").join(side("r"), ["report_id", "event_type"]).where((F.col("p_rich") < F.col("r_rich")) & same & nothing("people_affected") & nothing("time_reference"))
    return pairs.groupBy(F.col("p_event_id").alias("gone")).agg(F.max("r_rich").alias("best")).select("gone", F.col("best.e").alias("kept"))


def collapsed(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """The claims without those that repeat another of their report."""
    return claims.join(repeats(claims, compatibility).select(F.col("gone").alias("event_id")), "event_id", "left_anti")


def moved_links(links: DataFrame, repeated: DataFrame) -> DataFrame:
    """links, those of a repeat (gone, kept) leading to the claim that stays."""
    j = links.join(repeated.withColumnRenamed("gone", "event_id"), "event_id", "left")
    return j.withColumn("event_id", F.coalesce("kept", "event_id")).select(*links.columns)


def collapse_audit(repeated: DataFrame) -> DataFrame:
    """An audit row for each repeat that fell away."""
    return repeated.select(F.lit("event").alias("entity_type"), F.col("gone").alias("entity_id"), F.lit("within_report_duplicate_collapsed").alias("action"), F.lit("pipeline").alias("actor"), F.concat(F.lit("kept "), "kept").alias("detail"))
