import random

import pytest
from pyspark.sql import functions as F

from strandworks.llm.splits import assign_groups, assign_loose, components, tied_keys


def union_find(pairs, vertices):
    up = {v: v for v in vertices}

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in pairs:
        up[find(a)] = find(b)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize(("seed", "solo"), [(0, 0), (1, 60), (2, 1 << 17)])
def test_components(spark, seed, solo):
    """All rounds as joins, some, and none."""
    rng = random.Random(seed)
    n = 150
    pairs = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(110)] + [("hub", f"v{i}") for i in range(0, n, 4)]
    pairs += [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("loop", "loop")] + pairs[:5]
    vertices = sorted({v for p in pairs for v in p} | {"alone"})
    got = {r.vertex: r.root for r in components(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([(v,) for v in vertices], "vertex string"), solo).collect()}
    want = union_find(pairs, vertices)
    assert set(got) == set(vertices)
    assert len({(got[v], want[v]) for v in vertices}) == len(set(want.values())) == len(set(got.values()))


def test_tied_keys(spark):
    rows = [("u1", "p1"), ("u2", "p1"), ("u3", None), (None, "p9"), (None, None), ("u2", "p2"), ("u1", "p1"), ("p1", "q"), ("", "e")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "u string, p string, a string")
    got = {tuple(r) for r in tied_keys(df, F.col("u"), F.col("p"), "l", "r").collect()}
    assert got == {
        ("l", "u1", "u1"), ("l", "u2", "u1"), ("r", "p1", "u1"), ("r", "p2", "u1"), ("l", "u3", "u3"), ("r", "p9", "p9"),
        ("l", "p1", "p1"), ("r", "q", "p1"), ("l", "", ""), ("r", "e", ""),
    }
    assert tied_keys(df.limit(0), F.col("u"), F.col("p"), "l", "r").count() == 0


@pytest.mark.parametrize("big", [0, 15_000, 60_000])
def test_shares(spark, big):
    rng = random.Random(2)
    groups = [(f"g{i}", rng.randrange(1, 40)) for i in range(5000)] + ([("big", big)] if big else [])
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    df = spark.createDataFrame(groups, "group_key string, n_rows long")
    rows = assign_groups(df, plan).collect()
    assert sorted((r.group_key, r.n_rows) for r in rows) == sorted(groups)
    total = sum(n for _, n in groups)
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r.n_rows for r in rows if r.split_name == name) / total - share) < 0.01
    assert assign_groups(df.limit(0), plan).count() == 0


def test_loose_rows(spark):
    plan = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, share double")
    df = spark.range(20_000).select(F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    got = {r.split_name: r.n_rows for r in assign_loose(df, plan).collect()}
    assert sum(got.values()) == 20_000 and abs(got["train"] / 20_000 - 0.8) < 0.01
    assert assign_loose(df.limit(0), plan).count() == 0
