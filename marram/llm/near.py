"""Near-duplicates (problem 4).

SuperMinHash signatures of character trigrams, banding, a bit sketch, exact
verification, connected components. Copies of a text fall away before it is
signed, in each partition first. Band keys leave their task as sorted binary blocks, one
for each target that will pair them, not as rows; a member of a bucket that is
large in one task already is represented by the bucket's first text of the task.

Every member of a large bucket is held against the bucket's least member. Where
that leaves a bucket in several components, the members outside its largest one
are held against all others of the bucket, in units of bounded size; their
sketches are compared in the task, and only likely pairs leave it. So no link of
the buckets is lost, no group is expanded into its pairs, no bucket fills a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm import forms
from marram.llm.duplicates import _KEYED, _STRIPPED, _hash, _pieces, _stars, _unit_keys, letters, retiled
from marram.operators.components import components
from marram.plans.shared import Kept, checked, cut, salted_join, spread

THRESHOLD = 0.72
#: 64 bands of 8 lanes find 98.7 % of the pairs at the threshold by themselves, 99.7 % at 0.75, all but one in 10,000 at 0.8.
BANDS, ROWS, LANES = 64, 8, 256
#: Texts whose band keys are sorted at once, band rows of one block, band rows that are paired at once.
FLUSH, BLOCK, TARGET = 1 << 15, 4096, 2_000_000
#: Buckets of so many texts are paired at once; larger ones are first held against their least member.
SMALL = 12
#: Members of a divided bucket that meet in one unit, of each side.
UNIT = 4096

# Arabic-Indic and Persian digits, folded in the comparison normal form.
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_AS = "01234567890123456789"

_FOLDED = f"CASE WHEN regexp_matches(s4, '[{DIGITS}ำ]') THEN translate(replace(s4, 'ำ', 'ํา'), '{DIGITS}', '{DIGITS_AS}') ELSE s4 END"
_NORMAL = rf"trim(regexp_replace(lower({_FOLDED}), '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+', ' ', 'g'))"

#: The lanes of each band; a lane serves in more than one band.
_LANE_OF = np.concatenate([np.random.default_rng(17 + i).permutation(LANES) for i in range(-(-BANDS * ROWS // LANES) + 1)])[: BANDS * ROWS].reshape(BANDS, ROWS)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of an array of uint64."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trigram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, trigram) of every trigram of every text, exact in 63 bits; shorter texts are one element."""
    texts = [t + "\0" * max(0, 3 - len(t)) for t in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    key = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    whole = doc[:-2] == doc[2:]
    return doc[:-2][whole], key[whole]


def superminhash(texts: list[str], lanes: int = LANES) -> np.ndarray:
    """SuperMinHash (Ertl 2017) signatures, one row of uint64 a text.

    Every trigram permutes the lanes; its rank in the permutation plus a
    fraction is its value in a lane, the least value wins. Ranks are taken in
    order over a whole batch: a lane taken at a lower rank can't change any
    more, and texts whose lanes are all taken leave early.
    """
    doc, key = trigram_keys(texts)
    inverse, words = pd.factorize(key)
    state = _mix(words)
    base = doc * lanes
    sig = np.full(len(texts) * lanes, np.inf)
    perm = np.tile(np.arange(lanes, dtype=np.uint16), (len(words), 1))
    at = np.arange(len(perm))
    for j in range(lanes):
        state = _mix(state)
        k = j + ((state >> np.uint64(32)) * np.uint64(lanes - j) >> np.uint64(32)).astype(np.int64)
        lane = perm[at, k]
        perm[at, k] = perm[:, j]
        perm[:, j] = lane
        value = j + (state & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32
        to = base + lane.take(inverse)
        open_ = np.flatnonzero(sig.take(to) > j)
        np.minimum.at(sig, to.take(open_), value.take(inverse.take(open_)))
        if j % 4 == 3:
            unfilled = np.isinf(sig.reshape(-1, lanes)).any(1)
            if not unfilled.any():
                break
            stay = unfilled.take(doc)
            if 2 * np.count_nonzero(stay) < len(stay):
                doc, inverse, base = doc[stay], inverse[stay], base[stay]
                used, inverse = np.unique(inverse, return_inverse=True)
                perm, state = perm[used], state[used]
                at = np.arange(len(perm))
    return sig.view(np.uint64).reshape(-1, lanes)


#: row_id, id (hash of the normal form), hist (of the letters as problem 3 compares them), f (hash of the consistent form), form (the normal form; null for later copies in the partition).
_BASE = "row_id string, id long, hist long, f long, form string"
#: loc (place of a text among all), id, a sketch of one bit each of 256 lanes; or a pair of a large bucket (key, a, b); or a block of band rows for a target.
_SIGNED = "loc long, id long, s0 long, s1 long, s2 long, s3 long, key long, a long, b long, target int, block binary"
_NAMES = [c.split()[0] for c in _SIGNED.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in _SIGNED.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _planes(values: np.ndarray) -> bytes:
    """The low bytes of sorted-out numbers as they are, the highest ones compressed."""
    import zstandard

    n = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    low = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    top = zstandard.compress(np.ascontiguousarray(low[:, n - 1]).tobytes(), 1)
    return bytes([n]) + len(top).to_bytes(4, "little") + top + np.ascontiguousarray(low[:, : n - 1].T).tobytes()


def _numbers(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    """The numbers that _planes packed and the bytes they took."""
    import zstandard

    wide, size = data[0], int.from_bytes(data[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, wide - 1] = np.frombuffer(zstandard.decompress(data[5 : 5 + size]), np.uint8)
    end = 5 + size + n * (wide - 1)
    out[:, : wide - 1] = np.frombuffer(data[5 + size : end], np.uint8).reshape(wide - 1, n).T
    return out.view("<u8").reshape(-1), end


def pack(first: int, key: np.ndarray, local: np.ndarray) -> bytes:
    """A block: sorted keys as differences, and the texts (numbers behind `first`, shifted by the flag of a large bucket)."""
    gap = np.diff(key, prepend=key[:1])
    return b"".join([len(key).to_bytes(4, "little"), first.to_bytes(8, "little"), int(key[0]).to_bytes(8, "little"), _planes(gap), _planes(local)])


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, texts and flags of a block."""
    view = memoryview(block)
    n, first, base = int.from_bytes(view[:4], "little"), int.from_bytes(view[4:12], "little"), int.from_bytes(view[12:20], "little")
    gap, at = _numbers(view[20:], n)
    local, _ = _numbers(view[20 + at :], n)
    return np.cumsum(gap, dtype=np.uint64) + np.uint64(base), (local >> np.uint64(1)).astype(np.int64) + first, (local & np.uint64(1)).astype(bool)


def _blocks(keys: np.ndarray, first: int, bits: int, targets: int) -> Iterator[pa.RecordBatch]:
    """The band keys (a row a text, numbered from `first`) as blocks; of buckets that are large here, only the first text, and the rest as pairs."""
    flat = keys.reshape(-1)
    order = np.argsort(flat, kind="stable")
    key, text = flat[order], order // BANDS
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    flag = np.zeros(len(key), np.uint64)
    if (size > SMALL).any():
        large, lead = np.repeat(size > SMALL, size), np.repeat(start, size)
        flag[start[size > SMALL]] = 1
        at = np.flatnonzero(large)
        for i in range(0, len(at), 100_000):
            p = at[i : i + 100_000]
            yield _rows(len(p), key=key[p].astype(np.int64), a=text[lead[p]] + first, b=text[p] + first)
        keep = ~large
        keep[start] = True
        key, text, flag = key[keep], text[keep], flag[keep]
    to = ((key >> np.uint64(bits - 24)) * np.uint64(targets) >> np.uint64(24)).astype(np.int64)
    ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    out_to, out = [], []
    for s, e in zip(ends, ends[1:], strict=False):
        for i in range(s, e, BLOCK):
            j = min(e, i + BLOCK)
            out_to.append(int(to[i]))
            out.append(pack(first, key[i:j], text[i:j].astype(np.uint64) << np.uint64(1) | flag[i:j]))
        if len(out) >= 500:
            yield _rows(len(out), target=out_to, block=out)
            out_to, out = [], []
    if out:
        yield _rows(len(out), target=out_to, block=out)


def _near_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _BASE from row_id, text."""
    sql = forms.form_sql("text", keep="row_id", outs=f"row_id, s4, {_NORMAL} AS n, {_hash('s4')} AS f")
    sql = f"SELECT row_id, s4, n, {_hash('n')} AS id, f FROM ({sql})"
    known: set[int] = set()
    for b in _pieces(batches, sql):
        form = pa.array([None if x in known or known.add(x) else t for x, t in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("id"), pa.array(letters(b.column("s4").to_pylist())[1]), b.column("f"), form], names=["row_id", "id", "hist", "f", "form"])


def _sign(bits: int, targets: int):
    """The rows of _SIGNED from id, form, sorted by id; keys have so many bits that chance meetings stay as rare at any size.

    Places follow from the order of the ids, so a partition that is lost and made again has the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        origin = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        first = count = 0
        last = None
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                part = whole.slice(i, 1000)
                ids = part.column(0).to_numpy()
                fresh = np.r_[last is None or ids[0] != last, ids[1:] != ids[:-1]]
                last = ids[-1]
                ids = ids[fresh]
                if not len(ids):
                    continue
                sig = _mix(superminhash(part.column(1).filter(pa.array(fresh)).to_pylist()))
                bit = np.packbits((sig[:, :256] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                key = np.broadcast_to(_mix(np.arange(BANDS, dtype=np.uint64)), (len(sig), BANDS))
                for r in range(ROWS):
                    key = _mix(key ^ sig[:, _LANE_OF[:, r]])
                held.append(key >> np.uint64(64 - bits))
                yield _rows(len(ids), loc=np.arange(len(ids)) + origin + count, id=ids, **{f"s{c}": np.ascontiguousarray(bit[:, c]) for c in range(4)})
                count += len(ids)
                if count - first >= FLUSH - 1000:
                    yield from _blocks(np.concatenate(held), origin + first, bits, targets)
                    held, first = [], count
        if held:
            yield from _blocks(np.concatenate(held), origin + first, bits, targets)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks that come target by target: candidate pairs (key null), and the members of large buckets (key, leader, member)."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        for target, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if target != at and held:
                yield from _buckets(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            at = target
            held.append(unpack(block.as_buffer()))
    if held:
        yield from _buckets(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _buckets(key: np.ndarray, text: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(key)
    key = key[order]
    twin = key[1:] == key[:-1]
    keep = np.r_[False, twin] | np.r_[twin, False]
    key, order = key[keep], order[keep]
    text, flag = text[order], flag[order]
    if not len(key):
        return
    order = np.lexsort((text, key))
    key, text, flag = key[order], text[order], flag[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    wide = np.repeat((size > SMALL) | np.logical_or.reduceat(flag, start), size)  # a bucket that was large in some task has members that aren't here
    seen: list[np.ndarray] = []
    behind = np.repeat(start + size, size)
    for gap in range(1, SMALL):
        first = np.flatnonzero(~wide & (np.arange(len(key)) + gap < behind))
        seen.append(np.stack([text[first], text[first + gap]], 1))
    lead = np.repeat(text[start], size)
    seen.append(np.stack([lead[wide], text[wide]], 1))
    pairs = np.concatenate(seen)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    for i in range(0, len(pairs), 100_000):
        p = pairs[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["key", "a", "b"])
    if wide.any():
        yield pa.RecordBatch.from_arrays([pa.array(key[wide].astype(np.int64)), pa.array(lead[wide]), pa.array(text[wide])], names=["key", "a", "b"])


#: Equal bits of the sketch that a pair at the threshold has, less five standard deviations: 256 lanes, one bit each.
def least_bits(threshold: float) -> int:
    p = (1 + threshold) / 2
    return int(256 * p - 5 * (256 * p * (1 - p)) ** 0.5)


def _units(threshold: float):
    """Of sorted rows (key, u, v, side, id, root, s0 to s3): the pairs of each unit that lie in different components and whose sketches are close.

    Side 0 holds members of the largest component, met by the others (sides 1 and 2); without it sides 1 and 2 meet, or side 1 itself.
    """
    most = 256 - least_bits(threshold)

    def pairs(side: np.ndarray, ids: np.ndarray, root: np.ndarray, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low, high = side == side.min(), side == side.max()
        if low.all():
            high = low
        lo, hi = np.flatnonzero(low), np.flatnonzero(high)
        step = max(1, 1_000_000 // len(hi))
        for i in range(0, len(lo), step):
            x = lo[i : i + step]
            far = np.bitwise_count(s[x, None] ^ s[None, hi]).sum(2, dtype=np.int32)
            m, n = np.nonzero((far <= most) & (root[x, None] != root[None, hi]))
            yield ids[x[m]], ids[hi[n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            unit = np.stack(cols[:3], 1)
            ends = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(1)])
            for b, e in zip(ends, np.r_[ends[1:], len(unit)], strict=True):
                for x, y in pairs(cols[3][b:e], cols[4][b:e], cols[5][b:e], np.stack([c[b:e] for c in cols[6:]], 1).view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if rest and any(cols[i][0] != rest[-1][i][-1] for i in range(3)):
                yield from flush([np.concatenate(c) for c in zip(*rest, strict=True)])
                rest = []
            # the last unit of the batch may go on in the next one
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if cut_at:
                yield from flush([np.concatenate(c) for c in zip(*rest, [c[:cut_at] for c in cols], strict=True)])
                rest = []
            rest.append([c[cut_at:] for c in cols])
        if rest:
            yield from flush([np.concatenate(c) for c in zip(*rest, strict=True)])

    return run


def _across(wide: DataFrame, places: DataFrame, found: DataFrame, threshold: float, keep: Kept) -> DataFrame:
    """Likely pairs (a, b: ids) of members of one large bucket (key, loc) that lie in different components."""
    w = keep(wide.join(places.select("loc", "id"), "loc").select("key", "id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    per = w.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most < all")
    chunks = lambda n: F.ceil(n / F.lit(UNIT)).cast("int")
    per = keep(per.select("key", "major", chunks(F.col("most")).alias("cm"), chunks(F.col("all") - F.col("most")).alias("co")))
    rows = w.join(checked(per), "key").withColumn("h", F.xxhash64("id"))
    mine, other = F.pmod("h", F.col("cm")).cast("int"), F.pmod("h", F.col("co")).cast("int")
    unit = lambda u, v, side: F.struct(u.alias("u"), v.alias("v"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    of_major = F.transform(F.sequence(F.lit(0), F.col("co") - 1), lambda j: unit(-1 - mine, j, 0))
    of_other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("cm") - 1), lambda i: unit(-1 - i, other, 1)),
        F.transform(F.sequence(F.lit(0), F.col("co") - 1), lambda j: unit(F.least(j, other), F.greatest(j, other), F.when(other <= j, 1).otherwise(2))),
    )
    rows = rows.withColumn("x", F.explode(F.when(F.col("root") == F.col("major"), of_major).otherwise(of_other)))
    rows = rows.join(places.drop("loc"), "id").select("key", "x.u", "x.v", "x.side", "id", "root", "s0", "s1", "s2", "s3")
    return rows.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(_units(threshold), "a long, b long").distinct()


def trigrams(t: str) -> set[str]:
    return {t[i : i + 3] for i in range(len(t) - 2)} or {t}


def jaccard(a: str, b: str) -> float:
    x, y = trigrams(a), trigrams(b)
    n = len(x & y)
    return n / (len(x) + len(y) - n)


def _verify(threshold: float):
    """Keeps the pairs that reach the threshold; pairs that the kept ones of this partition connect already are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        sets: dict[int, set[str]] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        def grams(i: int, form: str) -> set[str]:
            if i not in sets:
                if len(sets) > 4000:
                    sets.clear()
                sets[i] = trigrams(form)
            return sets[i]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ra, rb = root(a), root(b)
                if ra == rb:
                    keep.append(False)
                    continue
                p, q = grams(a, x), grams(b, y)
                n = len(p & q)
                keep.append(n >= threshold * (len(p) + len(q) - n))
                if keep[-1]:
                    parent[max(ra, rb)] = min(ra, rb)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _close(pairs: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ids a < b whose sketches don't rule the threshold out, from candidate pairs of places."""
    half = lambda side: places.select(F.col("loc").alias(side), F.col("id").alias(f"id_{side}"), *[F.col(f"s{i}").alias(f"{side}{i}") for i in range(4)]).hint("shuffle_hash")
    both = pairs.select("a", "b").repartition("a").distinct().join(half("a"), "a").join(half("b"), "b")
    differing = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    near = both.where(differing <= 256 - least_bits(threshold))
    return near.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _texts(base: DataFrame, ids: DataFrame, keep: Kept) -> DataFrame:
    """id, form: the normal form of each of these ids."""
    return base.where("form IS NOT NULL").select("id", "form").join(checked(keep(ids.distinct())), "id", "left_semi").groupBy("id").agg(F.min("form").alias("form"))


def _links(close: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs whose exact similarity reaches the threshold."""
    both = close.join(texts.select(F.col("id").alias("a"), F.col("form").alias("fa")).hint("shuffle_hash"), "a").join(texts.select(F.col("id").alias("b"), F.col("form").alias("fb")).hint("shuffle_hash"), "b")
    return both.select("a", "b", "fa", "fb").mapInArrow(_verify(threshold), "a long, b long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sql = forms.form_sql("text", keep="text", outs=f"s4, {_NORMAL} AS n, md5({_STRIPPED}) AS k1")
    for b in _pieces(batches, f"SELECT s4, {_hash('n')} AS id, k1 FROM ({sql})"):
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k1"), *_unit_keys(b.column("s4").to_pylist())], names=["id", "k1", "k2", "bag", "seq", "units"])


def _same_units(src: DataFrame, rows: DataFrame, keep: Kept) -> DataFrame:
    """Edges between normal forms that are one text apart from formatting and order: every consistent form of those with the same letters is asked."""
    several = rows.groupBy("hist").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("hist")
    asked = rows.join(several, "hist", "left_semi").groupBy("id", "f").agg(F.min("row_id").alias("row_id")).select("row_id").distinct()
    keys = cut(src.join(checked(keep(asked)), "row_id").select("text").mapInArrow(_keyed, f"id long, k1 string, {_KEYED}"))
    return _stars(keys.select("k1", "id").distinct(), "k1", "id").union(_stars(keys.select("k2", "id").distinct(), "k2", "id")).union(retiled(keys, "id", keep))


def near_groups(reports: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row_id, first_id for every report in a group of at least two (problem 4)."""
    spark, keep = reports.sparkSession, Kept()
    src = reports.select(F.col("report_id").alias("row_id"), F.col("raw_text").alias("text")).where("row_id IS NOT NULL AND text IS NOT NULL")
    bands = BANDS * max(1, reports.select().count())
    bits = min(62, max(32, math.ceil(math.log2(bands)) + 12))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    targets = tasks * math.ceil(bands / (tasks * TARGET))
    base = keep(spread(src).mapInArrow(_near_base, _BASE))
    signed = keep(base.where("form IS NOT NULL").select("id", "form").repartition(tasks, "id").sortWithinPartitions("id").mapInArrow(_sign(bits, targets), _SIGNED))
    blocks = signed.where("block IS NOT NULL").select("target", "block").repartitionById(tasks, F.pmod("target", F.lit(tasks)).cast("int"))
    met = keep(blocks.sortWithinPartitions("target").mapInArrow(_meet, "key long, a long, b long"))
    wide = signed.where("key IS NOT NULL").select("key", "a", "b")
    places = keep(signed.where("loc IS NOT NULL").select("loc", "id", "s0", "s1", "s2", "s3").repartition("loc"))
    close = cut(_close(met.unionByName(wide.where("a <> b")), places, threshold))
    # first each text against its least partner; then only pairs between what that left apart
    star = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    texts = keep(_texts(base, close.select(F.col("a").alias("id")).union(close.select("b")), keep))
    found = components(_links(star, texts, threshold).union(_same_units(src, base, keep)))
    label = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = close.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    more = cut(_links(apart.join(star, ["a", "b"], "left_anti"), texts, threshold))
    members = met.where("key IS NOT NULL").unionByName(wide)
    if not members.isEmpty():
        across = cut(_across(members.select("key", F.col("b").alias("loc")), places, found, threshold, keep))
        more = more.union(cut(_links(across, _texts(base, across.select(F.col("a").alias("id")).union(across.select("b")), keep), threshold)))
    if not more.isEmpty():
        found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b").union(more))
    ids = base.select("row_id", "id").distinct()
    named = ids.groupBy("id").agg(F.min("row_id").alias("f"), F.count("*").alias("n")).join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = named.groupBy("root").agg(F.min("f").alias("first_id"), F.sum("n").alias("copies")).where("copies > 1")
    of = named.select("id", "root").join(whole, "root").select("id", "first_id", "copies")
    return keep.result(salted_join(ids, of, ["id"], "row_id").groupBy("row_id").agg(F.min("first_id").alias("first_id"), F.max("copies").alias("copies")))


def near_found(reports: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """p4_found.

    Null texts take no part; texts of fewer than three characters have one
    element, themselves; equal normal forms are one text with several rows; a
    report_id with differing texts belongs to the groups of all of them.
    """
    return near_groups(reports, threshold).where("row_id <> first_id").select(F.col("first_id").alias("first_report_id"), F.col("row_id").alias("report_id"))
