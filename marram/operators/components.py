"""Connected components of an edge table, without collecting it anywhere.

Edges are first contracted by union-find inside each partition, then alternate
large-star and small-star steps (Kiveris et al., SOCC 2014) run until no edge
changes. Each step's table is checkpointed, so lost executors cost one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.plans.shared import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of this partition's edges, each node tied to the least of its tree; batch by batch into one union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in list(parent) if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["a", "b"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))) if large else edges.select(F.col("b").alias("v"), F.col("a").alias("w"))
    least = both.groupBy("v").agg(F.min("w").alias("m")).withColumn("m", F.least("m", "v"))
    out = both.join(least, "v")
    if large:
        out = out.where("w > v").select(F.col("m").alias("a"), F.col("w").alias("b"))
    else:
        out = out.select(F.col("m").alias("a"), F.col("w").alias("b")).union(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the least node of its component) for every node on an edge of (a long, b long).

    Loops and repeated edges are ignored, nulls dropped; no edges give no rows.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    e = cut(e.mapInArrow(_forest, "a long, b long").distinct())
    state = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        e = cut(_stars(_stars(e, True), False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
