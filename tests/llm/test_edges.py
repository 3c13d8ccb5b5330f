"""Empty tables and extra columns with clashing names, for every operator over its tables."""

import pytest

from marram.llm import queries

D = "/root/testdata/sf0.001"
TABLES = ["reports", "claims", "entities", "gazetteer", "documents", "eval_items", "level_labels", "mix_targets"]
CLASHING = ["row_id", "text_", "id", "form", "key", "bands", "a", "b", "value", "h", "tokens", "pattern", "label", "part", "score", "n", "s0", "s4", "k1", "_t", "_same", "many"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    empty, wide = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("wide")
    for t in TABLES:
        df = spark.read.parquet(f"{D}/{t}.parquet")
        df.limit(0).write.parquet(f"{empty}/{t}.parquet")
        df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns]).write.parquet(f"{wide}/{t}.parquet")
    return str(empty), str(wide)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, folders, name):
    rows = queries.queries()[name](spark, folders[0]).collect()
    assert not rows


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p7_found", "p8_found", "p9_selection", "p10_found"])
def test_extra_columns_change_nothing(spark, folders, name):
    q = queries.queries()[name]
    assert sorted(map(str, q(spark, folders[1]).collect())) == sorted(map(str, q(spark, D).collect()))
