import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandworks.operators import residues as R
from strandworks.operators import segments as S


def powerset_best(rows):
    best = (0.0, 0, ())
    for k in range(len(rows) + 1):
        for pick in itertools.combinations(rows, k):
            if all(a[1] < b[0] or b[1] < a[0] for a, b in itertools.combinations(pick, 2)):
                best = max(best, (sum(v for *_, v in pick), -len(pick), ()), key=lambda x: x[:2])
    return best[:2]


@pytest.mark.parametrize("seed", range(4))
def test_overlap_resolution_equals_enumeration(spark, seed):
    rng = random.Random(seed)
    groups = {g: list({(s := rng.randrange(1, 25), s + rng.randrange(0, 8), float(rng.choice([1, 2, 3, 5, -1]))) for _ in range(9)}) for g in "abc"}
    groups = {g: list({(s, e): (s, e, v) for s, e, v in rows}.values()) for g, rows in groups.items()}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows] * 2 + [("a", 0, 0, 9.0), (None, 1, 2, 1.0)], "g string, s int, e int, v double")
    got = S.resolve_overlaps(df, "g", "s", "e", "v").where("g is not null").collect()
    for g, rows in groups.items():
        mine = [(r.s, r.e, r.v) for r in got if r.g == g]
        assert all(a[1] < b[0] or b[1] < a[0] for a, b in itertools.combinations(mine, 2))
        assert (sum(v for *_, v in mine), -len(mine)) == powerset_best([r for r in rows if r[2] > 0])
    assert S.resolve_overlaps(df.limit(0), "g", "s", "e", "v").count() == 0


def test_documented_overlap_set(spark):
    rows = [("x", 1, 3, 1.0), ("y", 2, 5, 3.0), ("z", 4, 6, 1.0), ("q", 8, 9, 1.0)]
    df = spark.createDataFrame([(1, s, e, v) for _, s, e, v in rows], "g int, s int, e int, v double")
    assert {(r.s, r.e) for r in S.resolve_overlaps(df, "g", "s", "e", "v").collect()} == {(2, 5), (8, 9)}
    by_length = df.withColumn("v", (F.col("e") - F.col("s") + 1).cast("double"))
    assert {(r.s, r.e) for r in S.resolve_overlaps(by_length, "g", "s", "e", "v").collect()} == {(1, 3), (4, 6), (8, 9)}


def test_predicates_and_the_empty_segment(spark):
    df = spark.createDataFrame([(2, 3, 1, 5), (5, 6, 1, 5), (6, 7, 1, 5), (0, 0, 1, 5), (1, 5, 0, 0)], "a int, b int, c int, d int")
    c = [F.col(x) for x in "abcd"]
    rows = df.select(S.overlaps(*c), S.bounds(*c), S.bounded_by(*c), S.is_empty(c[0], c[1]), S.length(c[0], c[1])).collect()
    assert [tuple(r) for r in rows] == [(True, False, True, False, 2), (True, False, False, False, 2), (False, False, False, False, 2), (True, True, True, True, 0), (True, True, True, False, 5)]
    named = df.withColumns({"n": F.lit("p"), "m": F.lit("q")})
    got = {(r.ov_name, r.ov_start, r.ov_end) for r in S.intersect(named, ("n", "a", "b"), ("m", "c", "d")).collect()}
    assert got == {("p&q", 2, 3), ("p&q", 5, 5), ("p&q", 1, 5)}


def test_numbering_pairs_positions_with_holes(spark):
    df = spark.createDataFrame([("k", 10, 12, 1, 2), ("k", 13, 14, 5, 6)], "k string, fa int, fb int, ta int, tb int")
    got = sorted((r.at, r.from_pos, r.to_pos) for r in S.segment_numbering(df, ["k"], ("fa", "fb"), ("ta", "tb")).collect())
    assert got == [(1, 10, 1), (2, 11, 2), (3, 12, None), (4, 13, None), (5, 14, 5)]


def test_lookups_first_last_closest_and_nulls(spark):
    rows = [("o", 1, 5, "a"), ("o", 2, None, "b"), ("o", 3, 7, "c"), ("o", 4, 5, "d"), ("p", 1, None, None)]
    df = spark.createDataFrame(rows, "o string, i int, k int, v string")
    assert {(r.k, r.value) for r in R.first_of(df, "o", "k", F.col("v")).collect()} == {(5, "a"), (7, "c")}
    assert {(r.k, r.value) for r in R.last_of(df, "o", "k", F.col("v")).collect()} == {(5, "d"), (7, "c")}
    assert {(r.o, r.at) for r in R.closest(df, "o", "k", 6).collect()} == {("o", 3), ("p", None)}
    assert {(r.o, r.at) for r in R.closest(df, "o", "k", 6, reverse=True).collect()} == {("o", 4), ("p", None)}
    joined = R.relate(df, df, "o", "k", "k", "v", "w")
    assert {(r.o, r.i, r.w) for r in joined.collect()} == {("o", 1, "a"), ("o", 2, "b"), ("o", 3, "c"), ("o", 4, "a"), ("p", 1, None)}


def test_patch_fills_only_linked_jumps(spark):
    df = spark.createDataFrame([("o", 1, 1, 1, "a"), ("o", 2, 2, 2, "b"), ("o", 3, 5, 5, "e"), ("o", 4, 9, None, "i")], "o string, i int, n int, l int, c string")
    template = spark.createDataFrame([("o", k, ch) for k, ch in enumerate("ABCDEFGHI", 1)], "o string, i int, c string")
    got = sorted((r.i, r.c, r.patched) for r in R.patch(df, template, "o", "n", "l", "c").collect())
    assert [c for _, c, _ in got] == list("abCDei") and [p for *_, p in got] == [False, False, True, True, False, False]


def test_bounds_and_names_are_checked(spark):
    df = spark.createDataFrame([("o", 1, "a")], "o string, i int, c string")
    with pytest.raises(IndexError):
        R.take(df, 0, 3)
    with pytest.raises(KeyError):
        R.add_column(df, "o", df.withColumn("value", F.lit(1)), "c")
    with pytest.raises(ValueError):
        R.add_column(df, "o", df.withColumn("value", F.lit(1)), "not a name")
