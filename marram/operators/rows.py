"""One row a record: redelivered copies fall away before any operator counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.plans.shared import checked, few_splits


def once(df: DataFrame, key: str, *columns: str, wide: str | None = None) -> DataFrame:
    """Distinct rows of the named columns with a key.

    Copies are equal in every column, so a hash aggregate over the columns in
    use does; rows whose key repeats with other values all stay. With a `wide`
    column (long text) only the rows of keys that occur several times are
    shuffled with it: the keys are counted first, which reads one column. Where
    the input is in fewer splits than there are cores, the shuffle of all rows is
    what spreads the work, so it stays.
    """
    rows = df.select(key, *columns).where(F.col(key).isNotNull())
    if wide not in columns or few_splits(rows):
        return rows.distinct()
    several = checked(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    return rows.join(several, key, "left_anti").unionByName(rows.join(several, key, "left_semi").distinct())


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def accept_new(new: DataFrame, stored: DataFrame, key: str, *order: str) -> DataFrame:
    """Idempotent append: of the new rows, the first of each key that is not stored yet."""
    return first_by(new.join(stored.select(key).distinct(), key, "left_anti"), key, *order)
