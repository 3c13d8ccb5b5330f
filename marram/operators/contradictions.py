"""Contradictions between claims on one place.

Two claims are on the same place if both are resolved and their resolved places
are equal, or if not both are resolved and their typed places are equal. Claims
that say the same of one place are a class; contradictions are found between
classes by equi-joins on place and type, so a hot place costs its distinct
statements, not its pairs of claims. A pair of classes stands for the number of
claim pairs it holds.

A later change is a matter of each single pair: opposed statuses whose clocks
run in the order of the claims are changes, the others are contradictions. So
the pairs of such classes are counted in either order, minute by minute, never
by listing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.functions import text as X
from marram.functions import vocab as V
from marram.plans.shared import cut

_KEY = ["branch", "place"]
_SAID = ["known", "event_type", "people_affected", "clock"]


def status_pairs() -> list[tuple[str, str]]:
    """The configured opposites, both ways round."""
    pairs = [tuple(p.split(":")) for p in V.STATUS_PAIRS.split(",")]
    return sorted({*pairs, *((b, a) for a, b in pairs)})


def placed(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """The claims that could contradict another, with their comparison keys: a row in branch resolved and one in branch typed where they have such a place."""
    c = claims.withColumn("clock", F.array_join(X.clocks(F.col("time_reference")), "/"))
    keep = F.col("event_type").isin(sorted({t for p in status_pairs() for t in p})) | (F.col("event_type").isin(V.COUNTABLE_TYPES) & F.col("people_affected").isNotNull()) | (F.col("clock") != "")
    c = c.where(keep).withColumn("known", F.coalesce("resolved_location", F.lit("")) != "")
    c = c.withColumn("branch", F.explode(F.when(F.col("known"), F.array(F.lit("resolved"), F.lit("typed"))).otherwise(F.array(F.lit("typed")))))
    c = c.withColumn("place", X.place_key(F.when(F.col("branch") == "resolved", F.col("resolved_location")).otherwise(F.col("location_text")), compatibility))
    return c.where("branch = 'resolved' OR place <> ''").select("event_id", "report_id", "created_at", "location_text", "time_reference", *_KEY, *_SAID)


def claim_classes(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """Claims that say the same of one place: their number n and the first of them."""
    first = F.struct("created_at", "event_id", "report_id", "location_text", "time_reference")
    return placed(claims, compatibility).groupBy(*_KEY, *_SAID).agg(F.min(first).alias("first"), F.count("*").alias("n"))


def _pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes (a the one with the earlier first claim) that contradict, with kind and rule; split where the order of each claim pair decides."""
    side = lambda s: classes.select(*_KEY, *[F.col(x).alias(f"{s}_{x}") for x in [*_SAID, "first", "n"]])
    opposite = F.create_map(*[F.lit(x) for t in sorted({a for a, _ in status_pairs()}) for x in (t, ",".join(b for a, b in status_pairs() if a == t))])
    earlier = (F.col("a_first.created_at") < F.col("b_first.created_at")) | ((F.col("a_first.created_at") == F.col("b_first.created_at")) & (F.col("a_first.event_id") < F.col("b_first.event_id")))
    meet = earlier & ((F.col("branch") == "resolved") | ~(F.col("a_known") & F.col("b_known")))
    against = side("a").withColumn("b_event_type", F.explode(F.split(opposite[F.col("a_event_type")], ",")))
    timed = (F.col("a_clock") != "") & (F.col("b_clock") != "")
    volatile = F.col("a_event_type").isin(V.VOLATILE_TYPES) & F.col("b_event_type").isin(V.VOLATILE_TYPES)
    status = against.join(side("b"), [*_KEY, "b_event_type"]).where(meet)
    status = status.withColumn("conflict_type", F.lit("status")).withColumn("split", volatile & timed & (F.substring("a_clock", 1, 5) != F.substring("b_clock", 1, 5)))
    same = side("a").withColumn("b_event_type", F.col("a_event_type")).join(side("b"), [*_KEY, "b_event_type"]).where(meet)
    counts = F.col("a_event_type").isin(V.COUNTABLE_TYPES) & (F.col("a_people_affected") != F.col("b_people_affected"))
    kind = F.when(counts, "numeric").when(timed & (F.col("a_clock") != F.col("b_clock")), "temporal")
    same = same.withColumn("conflict_type", kind).where("conflict_type IS NOT NULL").withColumn("split", F.lit(False))
    return status.unionByName(same)


def opposed(claims: DataFrame, labels: DataFrame, compatibility: bool = True) -> DataFrame:
    """a, b: the pairs of labels that the first claims of some contradicting classes have, in either order, without listing the classes' pairs.

    labels: event_id, label (a struct). Classes of one place, type and label are
    a group. Groups of opposed types contradict if any two of their first claims
    differ; groups of one type if two counts or clocks do, which their least and
    greatest tell. First claims that several classes of one type share are no
    pair; such classes are compared one by one, with each other alone.
    """
    at, key = F.struct("first.created_at", "first.event_id"), [*_KEY, "event_type"]
    c = claim_classes(claims, compatibility).where("first.created_at IS NOT NULL AND first.event_id IS NOT NULL").withColumn("at", at)
    c = c.withColumn("shared", F.count("*").over(Window.partitionBy(*key, "at")) > 1)
    c = c.withColumn("people", F.when(F.col("event_type").isin(V.COUNTABLE_TYPES), F.col("people_affected"))).withColumn("clock", F.nullif("clock", F.lit("")))
    c = cut(c.withColumn("event_id", F.col("at.event_id")).join(labels, "event_id").select(*key, "known", "shared", "label", "at", "people", "clock"))
    ends = ["at", "people", "clock"]
    groups = cut(c.groupBy(*key, "known", "shared", "label").agg(*[f(x).alias(f"{n}_{x}") for x in ends for n, f in (("least", F.min), ("most", F.max))]))
    side = lambda df, s: df.select(*key, *[F.col(x).alias(f"{s}_{x}") for x in df.columns if x not in key])
    meet = (F.col("branch") == "resolved") | ~(F.col("a_known") & F.col("b_known"))
    opposite = F.create_map(*[F.lit(x) for t in sorted({a for a, _ in status_pairs()}) for x in (t, ",".join(b for a, b in status_pairs() if a == t))])
    status = side(groups, "a").withColumn("event_type", F.explode(F.split(opposite[F.col("event_type")], ","))).join(side(groups, "b"), key)
    status = status.where(meet & ((F.col("a_least_at") < F.col("b_most_at")) | (F.col("b_least_at") < F.col("a_most_at"))))
    apart = lambda x: F.coalesce((F.col(f"a_least_{x}") != F.col(f"b_most_{x}")) | (F.col(f"a_most_{x}") != F.col(f"b_least_{x}")), F.lit(False))
    same = side(groups, "a").join(side(groups, "b"), key).where(meet & ~(F.col("a_shared") & F.col("b_shared")) & (apart("people") | apart("clock")))
    differ = lambda x: F.coalesce(F.col(f"a_{x}") != F.col(f"b_{x}"), F.lit(False))
    few = c.where("shared")
    single = side(few, "a").join(side(few, "b"), key).where(meet & differ("at") & (differ("people") | differ("clock")))
    return status.select("a_label", "b_label").union(same.select("a_label", "b_label")).union(single.select("a_label", "b_label")).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()


def _ordered(split: DataFrame, claims: DataFrame) -> DataFrame:
    """Of split pairs of classes, in how many claim pairs the claim of a is the earlier one (forward).

    Claims are counted a minute and pair of classes; only those of one minute are
    put in order one by one.
    """
    key = [*_KEY, *[f"{s}_{x}" for s in "ab" for x in _SAID]]
    sides = [split.select(*key, F.lit(s).alias("side"), *[F.col(f"{s}_{x}").alias(x) for x in _SAID]) for s in "ab"]
    same = [F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")) for x in [*_KEY, *_SAID]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    rows = sides[0].unionByName(sides[1]).alias("l").join(claims.select(*_KEY, *_SAID, "created_at", "event_id").alias("r"), on)
    rows = rows.select(*[F.col(f"l.{x}").alias(x) for x in key], "side", "created_at", "event_id").withColumn("minute", F.date_trunc("minute", "created_at"))
    is_a, is_b = (F.when(F.col("side") == s, 1).otherwise(0) for s in "ab")
    minutes = rows.groupBy(*key, "minute").agg(F.sum(is_a).alias("na"), F.sum(is_b).alias("nb"))
    before = Window.partitionBy(*key).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    across = minutes.select(*key, (F.coalesce(F.sum("na").over(before), F.lit(0)) * F.col("nb")).alias("forward"))
    inside = Window.partitionBy(*key, "minute").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select(*key, (F.coalesce(F.sum(is_a).over(inside), F.lit(0)) * is_b).alias("forward"))
    return across.unionByName(within).groupBy(*key).agg(F.sum("forward").alias("forward"))


def _said(first: str, what: str, otherwise: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"{first}.{what}"), F.lit("")), F.lit(otherwise))


def contradictions(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """Pairs of classes that contradict, with the first claims of both, kind, severity, rule, number of claim pairs, evidence and explanation.

    One contradiction a pair of claims: opposed status, else unequal counts, else
    unequal clocks. Classes of opposed statuses with clocks in order give a row
    for each order that occurs, a then being the class of the earlier claims;
    elsewhere a is the class with the earlier first claim.
    """
    # both tables are small beside the claims and are read several times
    pairs = cut(_pairs(cut(claim_classes(claims, compatibility))))
    key = [*_KEY, *[f"{s}_{x}" for s in "ab" for x in _SAID]]
    split = pairs.where("split")
    names = ["branch", "place", "conflict_type", "split", *[f"{s}_{x}" for s in "ab" for x in ["event_type", "people_affected", "clock", "first"]]]
    turn = lambda n: {"a": "b", "b": "a"}[n[0]] + n[1:] if n[1] == "_" else n
    whole = F.col("a_n") * F.col("b_n")
    out = pairs.where("NOT split").select(*names, whole.alias("pairs"))
    if not split.isEmpty():
        counted = split.alias("l").join(_ordered(split, placed(claims, compatibility)).alias("r"), _all_equal(key)).select("l.*", "r.forward")
        orders = F.array(F.struct(F.lit(False).alias("turn"), F.col("forward").alias("pairs")), F.struct(F.lit(True).alias("turn"), (whole - F.col("forward")).alias("pairs")))
        counted = counted.withColumn("o", F.explode(orders)).where("o.pairs > 0")
        out = out.unionByName(counted.select(*[F.when(F.col("o.turn"), F.col(turn(n))).otherwise(F.col(n)).alias(n) for n in names], "o.pairs"))
    later = F.col("split") & (F.substring("b_clock", 1, 5) > F.substring("a_clock", 1, 5))
    delta = F.abs(F.col("a_people_affected") - F.col("b_people_affected"))
    rule = F.when((F.col("conflict_type") == "status") & later, "status_pair_with_temporal_order").when(F.col("conflict_type") == "status", "status_pair_same_location").when(F.col("conflict_type") == "numeric", "count_mismatch_same_event").otherwise("clock_time_mismatch")
    severity = F.when((F.col("conflict_type") == "status") & later, "low").when((F.col("conflict_type") == "status") | (F.col("conflict_type") == "numeric") & (delta > 2), "high").otherwise("medium")
    return out.withColumn("rule", rule).withColumn("severity", severity).select(
        "branch", "place", F.col("a_first.event_id").alias("event_a_id"), F.col("b_first.event_id").alias("event_b_id"), "conflict_type", "severity", "rule", "pairs",
        F.array_join(F.array_sort(F.array_distinct(F.array("a_first.report_id", "b_first.report_id"))), "|").alias("evidence"), explained().alias("explanation"),
    )


def _all_equal(key: list[str]) -> Column:
    on = F.lit(True)
    for x in key:
        on = on & F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}"))
    return on


def explained() -> Column:
    """What differs, both values, no verdict; led by the rule that found it."""
    place, kind, rule = _said("a_first", "location_text", "this place"), F.col("conflict_type"), F.col("rule")
    a, b = F.col("a_event_type"), F.col("b_event_type")
    words = (
        F.when(rule == "status_pair_with_temporal_order", F.concat(F.lit("'"), place, F.lit("' is "), a, F.lit(" at "), _said("a_first", "time_reference", "an earlier time"), F.lit(" and "), b, F.lit(" at "), _said("b_first", "time_reference", "a later time"), F.lit("; its state may have changed, a person has to look")))
        .when(kind == "status", F.concat(F.lit("'"), place, F.lit("' is "), a, F.lit(" by one report and "), b, F.lit(" by another; neither is preferred")))
        .when(kind == "numeric", F.concat(F.lit("people affected by "), a, F.lit(" at '"), place, F.lit("': "), F.col("a_people_affected").cast("string"), F.lit(" or "), F.col("b_people_affected").cast("string"), F.lit("; no value is preferred")))
        .otherwise(F.concat(a, F.lit(" at '"), place, F.lit("' took place at "), F.col("a_clock"), F.lit(" or at "), F.col("b_clock"), F.lit("; both times are kept")))
    )
    return F.concat(F.lit("[detected by rule: "), rule, F.lit("] "), words)


def contested(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """event_id of every claim that contradicts another, by way of its class."""
    key = [*_KEY, *_SAID]
    pairs = _pairs(claim_classes(claims, compatibility))
    sides = [pairs.select(*_KEY, *[F.col(f"{s}_{x}").alias(x) for x in _SAID]) for s in "ab"]
    bad = cut(sides[0].unionByName(sides[1]).distinct())
    return placed(claims, compatibility).alias("l").join(bad.alias("r"), _all_equal(key), "left_semi").select("event_id").distinct()


def disputed(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """The claims with verification_state disputed on both sides of every contradiction; rejected ones stay."""
    hit = contested(claims, compatibility).withColumn("_hit", F.lit(True))
    state = F.when(F.col("_hit") & (F.col("verification_state") != "rejected"), "disputed").otherwise(F.col("verification_state"))
    return claims.join(hit, "event_id", "left").withColumn("verification_state", state).drop("_hit")
