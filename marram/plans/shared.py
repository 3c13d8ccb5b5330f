"""Shared pieces of plans: the checkpoint folder, salted joins, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointing(spark: SparkSession) -> None:
    """Uses the shared folder the cluster names in spark.checkpoint.dir; a folder of its own only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marram-checkpoint-"))


def checkpoint_folder(spark: SparkSession) -> str:
    checkpointing(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint."""
    checkpointing(df.sparkSession)
    return df.checkpoint(eager=True)


class Kept:
    """Frames that one operator persists; they are released when its result is cut."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist())
        return self.frames[-1]

    def release(self) -> None:
        for f in self.frames:
            f.unpersist()

    def result(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.release()
        return out


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """left join right, spread over `salts` tasks a key by a hash of the left column `by`.

    For a large left side with hot keys and a right side of one small row a key.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def few_splits(df: DataFrame) -> bool:
    """Does a table come in fewer splits than there are cores? For tables as they are read: a plan with shuffles would run them to tell."""
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """A small table that is read in few splits, over all cores; others as they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few_splits(df) else df


#: Rows of one key that a task may get.
ROWS_A_TASK = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, per: int = ROWS_A_TASK) -> DataFrame:
    """left join right on a key whose rows in left are counted (right's column n), each key over as many tasks as it needs.

    The keys that need more than one task are broadcast: there are at most
    rows / per of them, a few bytes each.
    """
    right = right.withColumn("_tasks", F.ceil(F.col("n") / F.lit(per)).cast("int"))
    hot = right.where("_tasks > 1").select(on, F.col("_tasks").alias("_spread"))
    left = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_spread", F.lit(1))).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
    return left.join(right, [on, "_salt"]).drop("_salt", "_tasks", "_spread", "n")


#: Bytes of rows that a broadcast may hold.
MOST_BROADCAST = 32_000_000


def checked(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A frame of plain columns, to be broadcast if its measured bytes are within the bound; beyond it the join shuffles."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def small_rows(df: DataFrame, what: str, most: int) -> list:
    """The rows of a reference table on the driver, after its count was checked against a bound."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"{what} holds more than {most} rows; raise the bound only if the driver and every worker can hold them")
    return rows


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors of a cluster that doesn't have it installed, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="marram-")) / "marram-src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
