"""Plans that must not lose their shape: pruned scans, pushed filters, no cross joins."""

from pyspark.sql import functions as F

from strandworks.operators.atoms import grid_pairs
from strandworks.operators.collection import Catalog
from strandworks.operators.periods import periods_and_gaps
from strandworks.plans.spread import spread


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_periods_read_three_columns_and_push_the_filter(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([("a", 1, 2, "x", "y")], "key string, lo int, hi int, other string, more string").write.parquet(path)
    plan = plan_of(periods_and_gaps(spark.read.parquet(path), F.upper(F.trim("key")), "lo", "hi"))
    assert "ReadSchema: struct<key:string,lo:int,hi:int>" in plan and "GreaterThanOrEqual(lo,1)" in plan
    assert "MergingSessions" in plan or "UpdatingSessions" in plan


def test_radius_join_is_an_equality_join(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0)], "structure_id string, atom_idx int, x double, y double, z double")
    plan = plan_of(grid_pairs(df, df, 3.0))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_catalog_predicates_reach_the_scan(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/cat")
    cat.add(spark.createDataFrame([("a", 1, 0)], "id string, chain_type int, level int"))
    assert "EqualTo(chain_type,1)" in plan_of(cat.ids(chain_type=1))


def test_only_small_tables_are_spread(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(100).write.parquet(path)
    small = spark.read.parquet(path)
    assert "Exchange" in plan_of(spread(small, "id"))
    assert "Exchange" not in plan_of(spread(spark.range(0, 1 << 40), "id"))


def test_staged_tables_can_be_cleared(spark):
    from strandworks.plans.scratch import Scratch, clear, path_exists, rows

    scratch = Scratch(spark, "test")
    back, seen = scratch.save(spark.range(7), "t", n=rows())
    assert seen["n"] == back.count() == 7
    scratch.drop(back)
    assert not path_exists(spark, back._scratch_path)
    kept = scratch.save(spark.range(3), "u")
    clear(spark)
    assert not path_exists(spark, kept._scratch_path)
    assert scratch.save(spark.range(0), "empty", n=rows())[1]["n"] == 0
