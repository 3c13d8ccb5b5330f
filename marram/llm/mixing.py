"""Mixing sources to target weights (problem 9).

Distinct texts are aggregated by membership pattern (the set of sources that
hold them), with their size in tokens of a public tokenizer. A min-cost flow
routes the patterns' capacity to the sources' quotas: the k-th use of a text
costs k - 1, so repetition is spread as thinly as the quotas allow. The total
is the largest for which every source reaches its target share. Documents are
then taken in a seeded order; prefix sums are kept per hash bucket, whose number
follows from the number of texts, so no pattern is ever sorted in one task. The
flow takes every pattern, however many there are.

Defined results: documents without source, without target or without text take
no part; copies of a text, within a source or between sources, are one text
whose uses count together and never exceed the smallest max_repeats of its
sources; a source without any text gets no tokens, and its share is spread over
the others in proportion.
"""

from __future__ import annotations

import base64
import warnings
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marram.plans.shared import Kept, checked, salted_join, small_rows, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How a text is cut before byte pairs are merged; the pattern that belongs to the vocabulary.
SEP = "\x1f"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_SOURCES = 5_000
#: Patterns beyond which a warning says that the flow, on the driver, takes long.
MOST_PATTERNS = 50_000
#: Texts of a bucket, about, whose prefix sums are taken in one task; bucket count of small corpora; hashes of texts a partition remembers.
A_BUCKET, BUCKETS, KNOWN = 100_000, 256, 200_000


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        known: dict[str, int] = {}
        for b in batches:
            n = []
            for h, t in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True):
                if h not in known:  # copies are counted once a partition
                    if len(known) >= KNOWN:
                        known.clear()
                    known[h] = len(enc.encode_ordinary(t))
                n.append(known[h])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64())], names=["doc_id", "source", "h", "tokens"])

    return run


def sized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, h (hash of the text) and tokens of every document with a source and a text."""
    src = docs.where("source IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.sha2("text", 256).alias("h"))
    return spread(src).mapInArrow(_tokens(tokenizer), "doc_id long, source string, h string, tokens long")


class Flow:
    """Blocking flows over level graphs; arcs may be added between runs."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.out)
            level[s] = 0
            queue = deque([s])
            while queue:
                x = queue.popleft()
                for e in self.out[x]:
                    if self.cap[e] > 0 and level[self.to[e]] < 0:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if level[t] < 0:
                return total
            nxt = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    push = min(self.cap[e] for e in path)
                    total += push
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    cut = next(i for i, e in enumerate(path) if not self.cap[e])
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while nxt[x] < len(self.out[x]):
                    e = self.out[x][nxt[x]]
                    if self.cap[e] > 0 and level[self.to[e]] == level[x] + 1:
                        break
                    nxt[x] += 1
                else:
                    if x == s:
                        break
                    level[x] = -1
                    x = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                x = self.to[e]


def plan(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each of its sources, at the largest total the shares allow."""
    held = {s for p in patterns for s in p}
    whole = sum(v for s, v in shares.items() if s in held)
    want = {s: v / whole for s, v in shares.items() if s in held and v > 0}
    names, pats = sorted(want), sorted(p for p in patterns if any(s in want for s in p))
    most = {p: max(0, min(repeats[s] for s in p if s in want)) for p in pats}

    def solve(total: int):
        """Costs lie on the patterns' arcs alone, so filling them use by use, cheapest first, is a flow of least cost."""
        g = Flow(len(pats) + len(names) + 2)
        s, t = len(pats) + len(names), len(pats) + len(names) + 1
        at = {x: len(pats) + j for j, x in enumerate(names)}
        quota = {x: int(want[x] * total) for x in names}
        for x in names:
            g.arc(at[x], t, quota[x])
        arcs = {(p, x): g.arc(i, at[x], 1 << 60) for i, p in enumerate(pats) for x in p if x in want}
        missing = sum(quota.values())
        for use in range(max(most.values(), default=0)):
            for i, p in enumerate(pats):
                if use < most[p]:
                    g.arc(s, i, patterns[p])
            missing -= g.run(s, t)
            if not missing:
                break
        return not missing, {a: g.cap[e ^ 1] for a, e in arcs.items() if g.cap[e ^ 1]}

    low, high = 0, sum(patterns[p] * most[p] for p in pats)
    while high - low > max(1, high // 100_000):
        mid = (low + high + 1) // 2
        low, high = (mid, high) if solve(mid)[0] else (low, mid - 1)
    return solve(low)[1]


def _patterns(units: DataFrame) -> DataFrame:
    return units.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))


def select(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 11) -> DataFrame:
    """doc_id (the least that holds the text), tokens, source it is used for, and uses there."""
    rows = small_rows(targets.select("source", "target_share", "max_repeats"), "mix_targets", MOST_SOURCES)
    shares, repeats = {r.source: r.target_share for r in rows}, {r.source: int(r.max_repeats) for r in rows}
    rows_df = docs.where(F.col("source").isin(list(shares)))
    units = sized(rows_df, tokenizer).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern")).where("tokens > 0")
    keep = Kept()
    units = keep(units.withColumn("pattern", F.concat_ws(SEP, "pattern")))
    counts = keep(_patterns(units))
    pats = counts.collect()  # all of them: a text counts for every source that holds it
    if len(pats) > MOST_PATTERNS:
        warnings.warn(f"the flow over {len(pats)} membership patterns takes long and much of the driver's memory", stacklevel=2)
    sizes = {tuple(r.pattern.split(SEP)): r.tokens for r in pats}
    buckets = max(BUCKETS, sum(r.texts for r in pats) // A_BUCKET)
    units = units.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(buckets)))
    given = plan(sizes, shares, repeats)
    lanes, at = [], {}
    for (p, s), n in sorted(given.items()):
        a = at.get(p, 0)
        at[p] = a + n
        lanes.append((SEP.join(p), s, a, a + n, sizes[p]))
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("for_source", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("lane_from", "lane_to", "size"))])
    lane = docs.sparkSession.createDataFrame(lanes, schema)
    before = units.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).drop("n")
    inner = Window.partitionBy("pattern", "bucket").orderBy(F.xxhash64("h", F.lit(seed + 1)), "h")
    placed = units.join(before, ["pattern", "bucket"]).withColumn("start", F.col("before") + F.sum("tokens").over(inner) - F.col("tokens"))
    # a pass k places the text at k * size + start; a lane takes the passes that begin inside it
    first = F.greatest(F.lit(0), F.ceil((F.col("lane_from") - F.col("start")) / F.col("size")))
    behind = F.greatest(F.lit(0), F.ceil((F.col("lane_to") - F.col("start")) / F.col("size")))
    chosen = salted_join(placed, checked(lane), ["pattern"], "h").withColumn("uses", (behind - first).cast("int")).where("uses > 0").select("doc_id", "tokens", F.col("for_source").alias("source"), "uses")
    return keep.result(chosen)


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 11) -> DataFrame:
    """Per source: tokens in the mix, target and actual share, documents and the most uses of one."""
    chosen = select(docs, targets, tokenizer, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("repeats_used"))
    whole = chosen.agg(F.sum("tokens").alias("whole"))
    out = targets.select("source", "target_share", "max_repeats").join(chosen, "source", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("source", F.coalesce("tokens", F.lit(0)).alias("tokens"), "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("whole"), 6).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"), "max_repeats")
