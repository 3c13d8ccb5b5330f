"""Sources, extraction, places by ladder, streams, and the contract of the entry module."""

import json

import pytest
from pyspark.sql import functions as F

from marram.operators import extraction
from marram.sources import tables
from marram.streaming import reports as streams

D = "/root/testdata/sf0.001"


def test_corpus_and_truth(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"scenario": "s", "t0": "2031-01-01T00:00:00", "seed": 1, "reports": [{"report_id": "A", "raw_text": "x", "source_language": "fr", "reported_at": "2031-01-01T00:05:00", "source_type": "demo", "reporter_id": "p", "metadata": {"k": "v"}}]}))
    (tmp_path / "t.json").write_text(json.dumps({"scenario": "s", "seed": 1, "annotations": [{"report_id": "A", "expected_events": [{"event_type": "fire", "severity": "unknown"}, {"event_type": "flood", "severity": "low"}]}, {"report_id": "B", "expected_events": []}]}))
    r = tables.corpus(spark, str(tmp_path / "c.json")).first()
    assert (r.report_id, r.reported_at.minute, r.metadata) == ("A", 5, {"k": "v"})
    assert {(x.report_id, x.n, x.event_type) for x in tables.ground_truth(spark, str(tmp_path / "t.json")).collect()} == {("A", 0, "fire"), ("A", 1, "flood"), ("B", None, None)}
    assert tables.timeline(spark, "2031-01-01T00:00:00", spark.createDataFrame([(7,)], "minutes int")).first().reported_at.minute == 7


def test_stored_append_and_sinks(spark, tmp_path):
    r = tables.stored(spark, D, "reports")
    tables.append(r.limit(3), str(tmp_path), "reports")
    tables.append(r.limit(2), str(tmp_path), "reports")
    assert tables.stored(spark, str(tmp_path), "reports").count() == 5
    n = spark.createDataFrame([("a", "event", "x")], "id string, kind string, label string")
    tables.write_graph(n, n.select("id"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/nodes")).count() == 1


def test_extraction(spark):
    def rule_extractor():
        def extract(texts):
            return [f'events:[{{type:{"injury" if "hurt" in t else "odd"},location:"{t.split()[-1]}",people:4,severity:high,time:null,desc:"n/a"}}]' for t in texts]

        return extract

    reports = spark.createDataFrame([("r1", False, "A serious case: 4 hurt at Kel. Somebody shouted near Miz."), ("r2", True, "4 hurt and serious at Sor"), ("r3", False, None)], "report_id string, suspected_injection boolean, raw_text string")
    got = {(r.report_id, r.segment_index): r for r in extraction.extracted(reports, rule_extractor).collect()}
    a, b, c = got["r1", 0], got["r1", 1], got["r2", 0]
    assert (a.event_type, a.people_affected, a.severity, a.description) == ("injury", 4, "high", None)
    assert (b.event_type, b.people_affected, b.severity) == ("other", None, "unknown")
    assert b.guards_applied == ["event_type_out_of_taxonomy(odd)->other", "people_not_in_source->null", "severity_unlicensed(high)->unknown"]
    assert c.severity == "unknown" and "injection_flagged->severity_forced_unknown" in c.guards_applied and len({r.event_id for r in got.values()}) == 3

    def broken():
        def extract(texts):
            raise RuntimeError("model is gone")

        return extract

    with pytest.raises(Exception, match="model is gone"):
        extraction.extracted(reports, broken).collect()


def test_processing_a_batch(spark):
    reports = spark.createDataFrame([("r1", "Three people were hurt near the bridge. Three people were hurt near the bridge.", False, None), ("r2", "Short", True, None)], "report_id string, raw_text string, suspected_injection boolean, ingested_at timestamp")
    asked = spark.sparkContext.accumulator(0)

    def make():
        def rules(texts):
            asked.add(len(texts))
            return ['events:[{type:injury,location:"bridge",people:null,severity:high,time:null,desc:null},{type:fire,location:null,people:null,severity:high,time:null,desc:null}]' if "hurt" in t else "events:[]" for t in texts]

        return rules

    out = extraction.processed(reports, make)
    rows = sorted(out["claims"].collect(), key=lambda r: (r.segment_index, r.event_type))
    assert [(r.segment_index, r.event_type) for r in rows] == [(0, "fire"), (0, "injury"), (1, "fire"), (1, "injury")] and len({r.event_id for r in rows}) == 4
    assert asked.value == 2  # equal segments once
    assert out["links"].count() == 2 * (2 + 3) and out["links"].select("link_id").distinct().count() == 10
    assert sorted((r.report_id, r.segment_count, r.claims) for r in out["reports"].collect()) == [("r1", 2, 4), ("r2", 1, 0)]
    assert out["audit_log"].count() == 2


def test_resolution(spark):
    m = spark.createDataFrame([("the road",), ("PONT central",), ("vieux pont central nord",), ("جسر المركزي",), ("gare Miz",), (None,)], "mention string")
    known = spark.createDataFrame([("Pont Central",), ("hôpital Al-Amal",)], "canonical string")
    aliases = spark.createDataFrame([("pont central", 1), ("الجسر المركزي", 1)], "name string, group_id int")
    got = {r.mention: (r.canonical, r.same, r.reason) for r in extraction.resolution(m, known, aliases).collect()}
    assert got["the road"] == ("the road", None, "generic_or_empty") and got["PONT central"] == ("Pont Central", True, "exact_normalized_match")
    assert got["vieux pont central nord"][2] == "shared_content_word" and got["جسر المركزي"] == ("Pont Central", True, "known_alias") and got["gare Miz"] == ("gare Miz", False, "name_is_new")
    assert {r.reason for r in extraction.resolution(m, known, aliases, enabled=False).collect()} == {"generic_or_empty", "disabled"}


def test_collapse(spark):
    rows = [("e1", "r", 0, "injury", "A", 4, None), ("e2", "r", 1, "injury", None, None, None), ("e3", "r", 2, "injury", "a", None, "9:00"), ("e4", "r", 3, "injury", "B", 4, None), ("e5", "s", 0, "injury", "A", None, None), ("e6", "r", 4, "fire", "A", None, None), ("e7", "r", 5, "injury", "A", 4, None)]
    c = spark.createDataFrame(rows, "event_id string, report_id string, segment_index int, event_type string, location_text string, people_affected int, time_reference string")
    assert sorted(r.event_id for r in extraction.collapsed(c).collect()) == ["e1", "e3", "e4", "e5", "e6"]


def test_streams(spark, tmp_path):
    r = tables.stored(spark, D, "reports")
    r.limit(40).unionByName(r.limit(40)).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.first_of_copies(streams.incoming(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("copies").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("copies").count() == r.limit(40).select("raw_text").distinct().count()
    tables.stored(spark, D, "claims").coalesce(1).write.parquet(str(tmp_path / "cl"))
    seen = []
    q = streams.recompute(streams.claims_by_place(streams.incoming(spark, str(tmp_path / "cl"), "claims"), late="0 seconds"), lambda df, i: seen.append(df.count()), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert sum(seen) > 0
    assert "session_window" in streams.bursts(streams.incoming(spark, str(tmp_path / "cl"), "claims")).columns


def test_entry(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 45
    df = entry.entry(spark)
    assert "conflict_type" in df.columns and df.count() >= 0


def test_pushdown(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["reports_listed"](spark, D)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "EqualTo(source_language" in physical or "source_language" in physical.split("PushedFilters: [")[1].split("]")[0]
    assert "raw_text" not in physical.split("ReadSchema")[1].split("\n")[0]
    plan = entry.queries()["metrics_states"](spark, D)._jdf.queryExecution().toString()
    assert "location_text" not in plan.split("== Physical Plan ==")[1]


def test_core_stands_without_the_training_data_package(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("marram.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "marram.llm", None)
    again = importlib.reload(entry)
    assert "p5_found" in again.queries() and not any(k.startswith("p1_") for k in again.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_columns_of_the_schema():
    assert F and tables._columns("a map<string,string>, b int") == ["a map<string,string>", "b int"]
