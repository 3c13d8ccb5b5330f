"""Scores of extracted claims against expected ones: greedy matches, field rules, contradiction shapes, one weighted score.

expected: report_id, n (order), event_type, location_tokens array, people_affected, severity.
predicted: report_id, event_id, n (order), event_type, location_text, resolved_location,
people_affected, severity. One report's claims are a bounded group.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import text as X
from marram.operators import contradictions

# The weights of the components, the score of a match, of a right place, and the examples that a report shows.
WEIGHTS = {"event_type_f1": 0.26, "location_f1": 0.13, "people_f1": 0.13, "severity_f1": 0.18, "grounding": 0.10, "abstention": 0.05, "containment": 0.05, "contradiction_recall": 0.10}
MATCH, RIGHT_PLACE, EXAMPLES = 0.34, 0.5, 20
FIELDS = ["event_type", "location", "people", "severity"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def precision_recall(counts: DataFrame) -> DataFrame:
    """counts (field, correct, wrong, missing, extra) with precision, recall and F1 to four places; 0 for empty denominators."""
    p, r = ratio(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("extra")), ratio(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("missing"))
    return counts.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 4))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets: 1 for two empty ones, 0 for one."""
    n, x, y = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0) | (n == 0), 0.0).otherwise(2.0 * n / (x + y))


def place_tokens(c: Column, accents: bool = True) -> Column:
    """Words of a typed place, without accents (unless the text is known to have none), marks and digits."""
    plain = F.regexp_replace(F.lower(X.unaccented(c) if accents else c), r"[^\p{L}\s]+", "")
    return F.coalesce(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != "")), F.array().cast("array<string>"))


def location_score(expected: Column, typed: Column, resolved: Column, accents: bool = True) -> Column:
    """How well a claim's place fits the expected tokens.

    None expected: 1 for a claim without place, else 0. The typed place decides
    if half of it fits; else the better of typed and resolved place.
    """
    return score_of_tokens(expected, place_tokens(typed, accents), resolved_tokens(resolved), typed, resolved)


def resolved_tokens(resolved: Column) -> Column:
    """Words of a resolved place."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.trim(resolved)), "[_-]", " "), r"\s+"), lambda w: w != ""))


def score_of_tokens(expected: Column, direct: Column, other: Column, typed: Column, resolved: Column) -> Column:
    """location_score of words that are cut already: direct those of the typed place, other those of the resolved one."""
    first, canonical = token_f1(expected, direct), F.when(F.coalesce(F.trim(resolved), F.lit("")) != "", token_f1(expected, other)).otherwise(0.0)
    empty = (F.size(expected) == 0) | expected.isNull()
    return F.when(empty, F.when(F.coalesce(X.strip(typed), F.lit("")) == "", 1.0).otherwise(0.0)).when(first >= RIGHT_PLACE, first).otherwise(F.greatest(first, canonical))


def worded(predicted: DataFrame, accents: bool) -> DataFrame:
    """predicted with the words of its places, cut once a claim before any join: a score reads them many times."""
    return predicted.withColumns({"_typed": place_tokens(F.col("location_text"), accents), "_resolved": resolved_tokens(F.col("resolved_location"))})


def _place_score() -> Column:
    return score_of_tokens(*map(F.col, ("location_tokens", "_typed", "_resolved", "location_text", "resolved_location")))


def matched(expected: DataFrame, predicted: DataFrame, threshold: float = MATCH, accents: bool = True) -> DataFrame:
    """report_id, expected_n, event_id, score: greedy one-to-one matches within each report.

    In the order of the expected claims, each takes the free claim of its type
    whose place scores best, the first of equals, if that reaches the threshold.
    """
    pairs = expected.select("report_id", "event_type", F.col("n").alias("expected_n"), "location_tokens").join(worded(predicted, accents).select("report_id", "event_type", F.col("n").alias("at"), "event_id", "location_text", "resolved_location", "_typed", "_resolved"), ["report_id", "event_type"])
    pairs = pairs.select("report_id", "expected_n", "at", "event_id", _place_score().alias("score")).where(F.col("score") >= threshold)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, done, used = None, None, set()
        for b in batches:
            keep = []
            for i, (r, n, e) in enumerate(zip(*(b.column(k).to_pylist() for k in ("report_id", "expected_n", "event_id")), strict=True)):
                if r != report:
                    report, done, used = r, None, set()
                if n != done and e not in used:
                    done = n
                    used.add(e)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    # rows of a report in the order of the choice, so that one pass over a partition holds one report's claims
    order = ["report_id", "expected_n", F.desc("score"), F.asc_nulls_last("at"), F.asc_nulls_last("event_id")]
    best = pairs.where("expected_n IS NOT NULL").select("report_id", F.col("expected_n").cast("int").alias("expected_n"), "at", "event_id", "score").repartition("report_id").sortWithinPartitions(*order)
    return best.select("report_id", "expected_n", "event_id", "score").mapInArrow(take, "report_id string, expected_n int, event_id string, score double")


def field_counts(expected: DataFrame, predicted: DataFrame, matches: DataFrame, accents: bool = True) -> DataFrame:
    """field, correct, wrong, missing, extra over all expected claims.

    To abstain where nothing is expected is correct; a severity left unknown is
    missing, not wrong; claims without a match are extra in their type alone.
    """
    e = expected.select("report_id", F.col("n").alias("expected_n"), "location_tokens", F.col("people_affected").alias("want_people"), F.coalesce("severity", F.lit("unknown")).alias("want_severity"))
    j = e.join(matches.select("report_id", "expected_n", "event_id"), ["report_id", "expected_n"], "left").join(worded(predicted, accents).select("report_id", "event_id", "location_text", "resolved_location", "_typed", "_resolved", "people_affected", F.coalesce("severity", F.lit("unknown")).alias("severity")), ["report_id", "event_id"], "left")
    hit, typed = F.col("event_id").isNotNull(), F.coalesce("location_text", F.lit("")) != ""
    none = (F.size("location_tokens") == 0) | F.col("location_tokens").isNull()
    fits = _place_score() >= RIGHT_PLACE
    want, got, ws, gs = F.col("want_people"), F.col("people_affected"), F.col("want_severity"), F.col("severity")
    verdict = {
        "event_type": F.lit("correct"),
        "location": F.when(none, F.when(typed, "wrong").otherwise("correct")).when(fits, "correct").when(typed, "wrong").otherwise("missing"),
        "people": F.when(want.isNull(), F.when(got.isNull(), "correct").otherwise("wrong")).when(got.isNull(), "missing").when(got == want, "correct").otherwise("wrong"),
        "severity": F.when(ws == gs, "correct").when(ws == "unknown", "wrong").when(gs == "unknown", "missing").otherwise("wrong"),
    }
    said = j.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(hit, v).otherwise("missing").alias("verdict")) for f, v in verdict.items()])).alias("x")).select("x.*")
    extra = predicted.join(matches.select("report_id", "event_id"), ["report_id", "event_id"], "left_anti").select(F.lit("event_type").alias("field"), F.lit("extra").alias("verdict"))
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    counted = said.unionByName(extra).groupBy("field").agg(*[n(v) for v in ("correct", "wrong", "missing", "extra")])
    every = expected.sparkSession.createDataFrame([(f,) for f in FIELDS], "field string")
    return every.join(counted, "field", "left").na.fill(0)


def fabricated(expected: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """report_id, event_id, people_affected of matched claims that state a count where none is expected."""
    e = expected.where("people_affected IS NULL").select("report_id", F.col("n").alias("expected_n"))
    return matches.join(e, ["report_id", "expected_n"]).join(predicted.where("people_affected IS NOT NULL").select("report_id", "event_id", "people_affected"), ["report_id", "event_id"]).select("report_id", "event_id", "people_affected")


def shape(a: str, b: str) -> Column:
    """What two claims (structs event_type, place) disagree on, whoever reports it: the types, in order, and the place; types as given where the places differ."""
    ta, tb, pa, pb = F.col(f"{a}.event_type"), F.col(f"{b}.event_type"), F.col(f"{a}.place"), F.col(f"{b}.place")
    apart = (pa != "") & (pb != "") & (pa != pb)
    sorted_ = F.struct(F.lit("").alias("kind"), F.least(ta, tb).alias("first_type"), F.greatest(ta, tb).alias("second_type"), F.when(pa != "", pa).otherwise(pb).alias("place"))
    return F.when(apart, F.struct(F.lit("different-place").alias("kind"), ta.alias("first_type"), tb.alias("second_type"), F.lit("").alias("place"))).otherwise(sorted_)


def shapes(pairs: DataFrame, predicted: DataFrame) -> DataFrame:
    """kind, first_type, second_type, place, comparable of report pairs (report_a, report_b) that are meant to disagree: every opposed pair of their claims."""
    p = predicted.select("report_id", F.struct("event_type", F.lower(F.trim(F.coalesce(X.place_of(F.col("resolved_location"), F.col("location_text")), F.lit("")))).alias("place"), "people_affected").alias("c"))
    j = pairs.join(p.select(F.col("report_id").alias("report_a"), F.col("c").alias("a")), "report_a").join(p.select(F.col("report_id").alias("report_b"), F.col("c").alias("b")), "report_b")
    j = j.where(~((F.col("a.event_type") == F.col("b.event_type")) & F.col("a.people_affected").eqNullSafe(F.col("b.people_affected"))))
    both = (F.col("a.place") != "") & (F.col("a.place") == F.col("b.place"))
    return j.select(shape("a", "b").alias("s"), both.alias("comparable")).groupBy("s").agg(F.max("comparable").alias("comparable")).select("s.*", "comparable")


def detected_shapes(conflicts: DataFrame, predicted: DataFrame) -> DataFrame:
    """The shapes of stored contradictions (event_a_id, event_b_id)."""
    p = _labelled(predicted).withColumnRenamed("label", "c")
    j = conflicts.join(p.select(F.col("event_id").alias("event_a_id"), F.col("c").alias("a")), "event_a_id").join(p.select(F.col("event_id").alias("event_b_id"), F.col("c").alias("b")), "event_b_id")
    return j.select(shape("a", "b").alias("s")).distinct().select("s.*")


def _labelled(predicted: DataFrame) -> DataFrame:
    return predicted.select("event_id", F.struct("event_type", F.lower(F.trim(F.coalesce(X.place_of(F.col("resolved_location"), F.col("location_text")), F.lit("")))).alias("place")).alias("label"))


def comparable_shapes(predicted: DataFrame, compatibility: bool = True) -> DataFrame:
    """Of the shapes of all contradictions among these claims, those that are not between different places: all that the recall asks for."""
    pairs = contradictions.opposed(predicted, _labelled(predicted).distinct(), compatibility)
    return pairs.select(shape("a", "b").alias("s")).where("s.kind = ''").distinct().select("s.*")


def contradiction_recall(designed: DataFrame, detected: DataFrame) -> DataFrame:
    """One row: designed, comparable, detected shapes, and the recall over comparable ones (1 where there is none); undetectable shapes are designed ones that no comparison could find."""
    key = ["kind", "first_type", "second_type", "place"]
    d = designed.join(detected.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left")
    n = lambda c: F.count(F.when(c, 1))
    row = d.agg(F.count("*").alias("designed"), n(F.col("comparable")).alias("comparable"), n(F.col("comparable") & F.col("hit")).alias("detected"), n(~F.col("comparable")).alias("undetectable"))
    return row.withColumn("contradiction_recall", F.when(F.col("comparable") == 0, 1.0).otherwise(F.col("detected") / F.col("comparable")))


def components(expected: DataFrame, predicted: DataFrame, matches: DataFrame, links: DataFrame, flagged: DataFrame, designed: DataFrame, detected: DataFrame, accents: bool = True) -> DataFrame:
    """The components of the weighted score in one row.

    links (event_id, report_id) ground a claim in its own report; flagged
    (report_id) are reports whose claims must not be promoted.
    """
    f1 = precision_recall(field_counts(expected, predicted, matches, accents)).groupBy().pivot("field", FIELDS).agg(F.first("f1").alias("f1"), F.first("wrong").alias("wrong"))
    grounded = predicted.join(links.where("event_id IS NOT NULL").select("event_id", "report_id").distinct(), ["event_id", "report_id"], "left_semi").agg(F.count("*").alias("grounded"))
    total = predicted.agg(F.count("*").alias("claims"))
    made = fabricated(expected, predicted, matches).agg(F.count("*").alias("made"))
    bad = predicted.where("verification_state IN ('corroborated', 'verified_by_operator') OR independent_source_count > 0").join(flagged, "report_id", "left_semi").agg(F.count("*").alias("promoted"))
    reports = flagged.agg(F.count("*").alias("flagged"))
    row = f1
    for one in (grounded, total, made, bad, reports, contradiction_recall(designed, detected).select("contradiction_recall")):
        row = row.crossJoin(F.broadcast(one))  # one row each
    return row.select(
        F.col("event_type_f1"), F.col("location_f1"), F.col("people_f1"), F.col("severity_f1"), ratio(F.col("grounded"), F.col("claims")).alias("grounding"), (1 - ratio(F.col("made"), F.col("people_wrong"))).alias("abstention"),
        F.when(F.col("flagged") == 0, 1.0).otherwise(1 - F.col("promoted") / F.col("flagged")).alias("containment"), "contradiction_recall",
    )


def weighted(row: DataFrame) -> DataFrame:
    """The weighted score of a row that holds the components, and whether it is valid."""
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(F.when(F.col("grounding") < 1, "ungrounded claims"), F.when(F.col("containment") < 1, "flagged claims promoted"), F.when(F.col("abstention") < 1, "fabricated counts")))
    return row.withColumn("score", F.round(score, 4)).withColumn("invalid_reasons", F.array_join(reasons, "; ")).withColumn("verdict", F.when(F.size(reasons) > 0, "INVALID").otherwise("VALID"))


def examples(rows: DataFrame, *order: str, most: int = EXAMPLES) -> DataFrame:
    """The first rows by an order, for a report."""
    return rows.orderBy(*order).limit(most)


def rendered(row: dict) -> str:
    """A score row as text, a line a component."""
    lines = [f"score {row['score']:.4f} {row['verdict']}", *(f"  {k:<22}{row[k]:.4f} x {w:.2f}" for k, w in WEIGHTS.items())]
    return "\n".join([*lines, *(["  because: " + row["invalid_reasons"]] if row["invalid_reasons"] else [])])


def letters(text: str | None) -> list[str]:
    """place_tokens of one text, in Python: what the column form is held against."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return list(dict.fromkeys("".join(c for c in plain if c.isalpha() or c.isspace()).split()))
