"""Copies hidden by formatting (problem 3).

The operator refines partitions progressively: cheap invariants of every text
(stripped length, letter histogram); inside classes with several members the
hash of the letters and digits in order; inside classes that still hold several
of those the costliest key, the sorted sentence units of every distinct
consistent form. Sequences that share the
units of any of their forms are one text, and so are those that others join. A
form may hide a boundary that its reordered copy shows: sequences of the same
words are also one text if one is made of the other's units in another order.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm import forms, sentences
from marram.operators.components import components
from marram.plans.shared import Kept, checked, cut, salted_join, spread

_STRIPPED = r"regexp_replace(lower(s4), '[^\p{L}\p{M}\p{N}]+', '', 'g')"


#: Words, or single characters in scripts without spaces; sequences, and units, of one bag that meet in a block.
_BAG = re.compile(r"[฀-๿⺀-鿿]|[^\W_]+")
MEETING = 500


def _hash(value: str) -> str:
    """SQL of 64 bits of a text's hash."""
    return f"(md5_number_lower({value})::HUGEINT - 9223372036854775808)::BIGINT"


@lru_cache(1)
def _letter_weights() -> np.ndarray:
    """A random number for each letter, mark or digit, the same in either case; 0 for other characters."""
    draw = np.random.default_rng(7).integers(1, 2**63 - 1, 0x110000, dtype=np.uint64)
    out = np.zeros(0x110000, np.uint64)
    for o in range(0x32000):
        c = chr(o)
        if unicodedata.category(c)[0] in "LMN":
            out[o] = draw[ord(c.lower()[0])]
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Stripped length and letter histogram (as one number) of each text: the same for any order of the same letters and digits."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    off = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    weight = _letter_weights()[code]
    total, count = np.zeros(len(code) + 1, np.uint64), np.zeros(len(code) + 1, np.int32)
    np.cumsum(weight, out=total[1:])
    np.cumsum(weight > 0, out=count[1:])
    return count[off[1:]] - count[off[:-1]], (total[off[1:]] - total[off[:-1]]).view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], sql: str, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for whole in forms.run_sql(batches, sql):
        for i in range(0, whole.num_rows, rows):
            yield whole.slice(i, rows)


def _invariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches, forms.form_sql("text", keep="row_id", outs="row_id, s4")):
        size, hist = letters(b.column("s4").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(size, pa.int32()), pa.array(hist)], names=["row_id", "len", "hist"])


def invariants(rec: DataFrame) -> DataFrame:
    """row_id, len, hist: what is cheap to know of every text."""
    return rec.mapInArrow(_invariants, "row_id string, len int, hist long")


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sql = forms.form_sql("text", keep="row_id", outs=f"row_id, s4, md5({_STRIPPED}) AS k1, {_hash('s4')} AS f")
    for b in _pieces(batches, sql):
        size, hist = letters(b.column("s4").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(size, pa.int32()), pa.array(hist), b.column("k1"), b.column("f")], names=["row_id", "len", "hist", "k1", "f"])


def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little", signed=True)


def _unit_keys(texts: list[str]) -> list[pa.Array]:
    """Of each consistent form: k2, the hash of its units' letters, sorted; bag, that of its words, sorted; its letters in order; its units' letters."""
    whole = [re.sub(r"[\W_]+", "", t.lower()) for t in texts]
    parts = [sorted(k for x, y in sentences.units(t) if (k := re.sub(r"[\W_]+", "", t[x:y].lower()))) for t in texts]
    bags = [_hash64("\n".join(sorted(_BAG.findall(t.lower())))) for t in texts]
    return [pa.array(x, kind) for x, kind in ((map(_hash64, map("\n".join, parts)), pa.int64()), (bags, pa.int64()), (whole, pa.string()), (parts, pa.list_(pa.string())))]


_KEYED = "k2 long, bag long, seq string, units array<string>"


def _sorted_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sql = forms.form_sql("text", keep="text", outs=f"s4, md5({_STRIPPED}) AS k1")
    for b in _pieces(batches, sql):
        yield pa.RecordBatch.from_arrays([b.column("k1"), *_unit_keys(b.column("s4").to_pylist())], names=["k1", "k2", "bag", "seq", "units"])


def tiles(seq: str, units: list[str]) -> bool:
    """Is the sequence made of these units in some order? What was taken up to a place is tried once from there."""
    if len(seq) != sum(map(len, units)):
        return False
    left, kinds = Counter(units), sorted(set(units))
    steps, taken, sums, tried = [(0, iter(kinds))], [], [0], set()
    while steps:
        at, rest = steps[-1]
        if at == len(seq):
            return True
        for u in rest:
            if left[u] and seq.startswith(u, at):
                state = (at + len(u), sums[-1] + hash(u))
                if state in tried:
                    continue
                tried.add(state)
                left[u] -= 1
                taken.append(u)
                sums.append(state[1])
                steps.append((state[0], iter(kinds)))
                break
        else:
            steps.pop()
            if taken:
                left[taken.pop()] += 1
                sums.pop()
    return False


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between nodes of one meeting (bag, u, v): a sequence (units null) and units that it is made of."""
    at, held = None, ([], [])

    def edges() -> pa.RecordBatch:
        pairs = {(min(m, n), max(m, n)) for m, units in held[1] for n, seq in held[0] if m != n and tiles(seq, units)}
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], names=["a", "b"])

    for batch in batches:
        for bag, u, v, node, seq, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bag, u, v) != at:
                if held[0] and held[1]:
                    yield edges()
                at, held = (bag, u, v), ([], [])
            held[units is not None].append((node, seq if units is None else units))
    if held[0] and held[1]:
        yield edges()


def retiled(keys: DataFrame, node: str, keep: Kept) -> DataFrame:
    """Edges a, b between nodes whose letters are the other's units in another order, though no form of both shows the same units.

    Asked within bags: texts of the same words. keys: node, k2, bag, seq, units.
    Members of a large bag meet in blocks of MEETING each.
    """
    ends = [f(c).alias(f"{n}{c}") for c in (node, "k2") for n, f in (("l_", F.min), ("g_", F.max))]
    bags = keys.groupBy("bag").agg(*ends, F.count("*").alias("n")).where(f"l_{node} < g_{node} AND l_k2 < g_k2").select("bag", F.ceil(F.col("n") / MEETING).cast("int").alias("c"))
    rows = keys.join(checked(keep(bags)), "bag").select("bag", "c", F.col(node).alias("node"), "k2", "seq", "units")
    blocks, every = lambda x: F.pmod(F.xxhash64(x), F.col("c")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    sequences = rows.groupBy("bag", "c", "node").agg(F.min("seq").alias("seq")).select("bag", blocks("node").alias("u"), every.alias("v"), "node", "seq", F.lit(None).cast("array<string>").alias("units"))
    units = rows.where(F.size("units") > 1).groupBy("bag", "c", "k2").agg(F.min("node").alias("node"), F.first("units").alias("units")).select("bag", every.alias("u"), blocks("k2").alias("v"), "node", F.lit(None).cast("string").alias("seq"), "units")
    both = sequences.unionByName(units).select("bag", "u", "v", "node", "seq", "units").repartition("bag", "u", "v").sortWithinPartitions("bag", "u", "v")
    return both.mapInArrow(_meetings, "a long, b long")


def _stars(keys: DataFrame, by: str, node: str) -> DataFrame:
    """Edges a, b from the least node of each key to its others."""
    least = keys.groupBy(by).agg(F.min(node).alias("a"), F.max(node).alias("z")).where("a < z").select(by, "a")
    return keys.join(least, by).where(F.col("a") != F.col(node)).select("a", F.col(node).alias("b"))


def _classes(rows: DataFrame, member: str) -> DataFrame:
    """len, hist of the classes that hold different members."""
    return rows.groupBy("len", "hist").agg(F.min(member).alias("a"), F.max(member).alias("z")).where("a < z").select("len", "hist")


def _refined(reports: DataFrame, keep: Kept) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cheap invariants of every row; row_id, k1 of the rows in classes with several members; per letter sequence k1: its first row, its rows n and its class k3.

    Each step reads only what the one before left together. k3 is equal for
    sequences that are the same apart from the order of units in any of their
    consistent forms; sequences in contested classes have all of theirs asked,
    each form once.
    """
    rec = reports.select(F.col("report_id").alias("row_id"), F.col("raw_text").alias("text")).where("row_id IS NOT NULL AND text IS NOT NULL")
    inv = keep(invariants(spread(rec)))
    several = checked(keep(_classes(inv, "row_id")))
    held = keep(rec.join(checked(keep(inv.join(several, ["len", "hist"], "left_semi").select("row_id").distinct())), "row_id", "left_semi"))
    keys = keep(held.mapInArrow(_ordered, "row_id string, len int, hist long, k1 string, f long").join(several, ["len", "hist"], "left_semi"))
    sizes = cut(keys.groupBy("len", "hist", "k1").agg(F.min("row_id").alias("first_id"), F.countDistinct("row_id").alias("n")))
    asked = keys.join(checked(keep(_classes(sizes, "k1"))), ["len", "hist"], "left_semi").groupBy("k1", "f").agg(F.min("row_id").alias("row_id")).select("row_id").distinct()
    units = cut(held.join(checked(keep(asked)), "row_id", "left_semi").select("text").mapInArrow(_sorted_units, f"k1 string, {_KEYED}").withColumn("node", F.xxhash64("k1")))
    same = components(_stars(units.select("node", "k2").distinct(), "k2", "node").union(retiled(units, "node", keep))).select("node", F.col("root").cast("string").alias("root"))
    per = sizes.withColumn("node", F.xxhash64("k1")).join(checked(keep(same)), "node", "left").select("k1", "first_id", "n", F.coalesce("root", "k1").alias("k3"))
    return inv, keys.select("row_id", "k1"), per


def format_groups(reports: DataFrame) -> DataFrame:
    """row_id, first_id, copies for every report in a group of at least two (problem 3)."""
    keep = Kept()
    _, keys, per = _refined(reports, keep)
    whole = per.groupBy("k3").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("copies")).where("copies > 1")
    of = per.select("k1", "k3").join(whole, "k3").select("k1", "first_id", "copies")
    return keep.result(salted_join(keys, of, ["k1"], "row_id").groupBy("row_id").agg(F.min("first_id").alias("first_id"), F.max("copies").alias("copies")))


def format_found(reports: DataFrame) -> DataFrame:
    """p3_found.

    Null texts take no part. Texts without a letter or digit are equal to each
    other. Ties cannot occur: the least report_id names the group.
    """
    return format_groups(reports).where("row_id <> first_id").select(F.col("first_id").alias("first_report_id"), F.col("row_id").alias("report_id"))


def format_records(reports: DataFrame) -> DataFrame:
    """One row per record that is left: its first report_id and its number of copies, single ones included."""
    keep = Kept()
    inv, _, per = _refined(reports, keep)
    alone = inv.groupBy("len", "hist").agg(F.min("row_id").alias("report_id"), F.max("row_id").alias("z")).where("report_id = z").select("report_id", F.lit(1).cast("long").alias("copies"))
    return keep.result(alone.unionByName(per.groupBy("k3").agg(F.min("first_id").alias("report_id"), F.sum("n").alias("copies")).select("report_id", "copies")))
