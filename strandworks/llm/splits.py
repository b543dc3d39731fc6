"""Splits that keep related records together.

Records that share a key are tied; ties make a graph of keys.  Its components are
found by random mates: each round every key tosses a coin, and those with tails
collapse into a neighbour with heads, until no edge is left.  The collapses are
then unwound, and whole components go to the splits by cumulative weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.plans.scratch import Scratch

#: Components heavier than this part of all rows are placed one by one.
BIG = 1 / 1000
#: Contractions, and doublings of pointers, for each table that is written.
STEPS = 2
#: From so many edges on down the rounds are tossed in one task.
SOLO = 1 << 17
BUCKETS = 1024


def _heads(vertex: Column, round_: int) -> Column:
    return F.xxhash64(F.lit(f"coin {round_}"), vertex) % 2 == 0


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contract(edges: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """One toss: the edges left between what is left, and the collapses ``(v, mate)``."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    both = edges.select(F.explode(ends).alias("x")).select("x.v", "x.w")
    mates = both.where(~_heads(F.col("v"), round_) & _heads(F.col("w"), round_)).groupBy("v").agg(F.min("w").alias("mate"))
    to = lambda end: mates.select(F.col("v").alias(end), F.col("mate").alias(f"{end}_mate"))
    moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
    return _tidy(moved.select(F.coalesce("a_mate", "a").alias("a"), F.coalesce("b_mate", "b").alias("b"))), mates


def _toss_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rounds of a graph that fits in one task: ``(v, up)`` with ``up`` final."""
    parts = list(batches)
    if not parts:
        return
    both = pa.chunked_array([b.column(k) for k in (0, 1) for b in parts]).combine_chunks().dictionary_encode()
    names, code = both.dictionary, both.indices.to_numpy()
    a, b = code[: len(code) // 2].astype(np.int64), code[len(code) // 2 :].astype(np.int64)
    up = np.arange(len(names))
    rng = np.random.default_rng(0)
    while len(a):
        heads = rng.random(len(names)) < 0.5
        v, w = np.concatenate([a, b]), np.concatenate([b, a])
        pick = ~heads[v] & heads[w]
        up[v[pick]] = w[pick]
        a, b = up[a], up[b]
        apart = a != b
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        left = np.unique(low * len(names) + high)
        a, b = left // len(names), left % len(names)
    while not np.array_equal(top := up[up], up):
        up = top
    moved = np.flatnonzero(up != np.arange(len(up)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(up[moved]))], ["v", "up"])


def components(edges: DataFrame, vertices: DataFrame, solo: int = SOLO) -> DataFrame:
    """``(vertex, root)`` of every vertex by random-mate contraction.

    Rounds are joins until ``solo`` edges are left; the remaining rounds are tossed in
    one task, which needs no further joins for a graph of bounded size.

    ``edges`` has ``(a, b)``, ``vertices`` a column ``vertex`` with every end.
    Repeated edges and loops change nothing; a vertex without edges is its own root.
    A vertex collapses at most once, into one that stays for the round, so the
    collapses make shallow trees; pointer doubling unwinds them.  Mates are chosen
    by ``min`` with a map-side combine, so a vertex in a third of all edges costs a
    task no more than its combined rows; the relabelling joins are left outer joins
    on the edge side, which adaptive execution splits when skewed.
    """
    scratch = Scratch(edges.sparkSession, "mates")
    kept, seen = scratch.save(_tidy(edges).select(F.lit(True).alias("edge"), "a", "b"), "edges", edges=F.count_if("edge"))
    collapsed: list[DataFrame] = []
    round_ = 0
    while seen["edges"] > solo:
        now = kept.where("edge").select("a", "b")
        found = None
        for _ in range(STEPS):
            now, mates = _contract(now, round_)
            found = mates if found is None else found.unionByName(mates)
            round_ += 1
        both = now.select(F.lit(True).alias("edge"), "a", "b").unionByName(found.select(F.lit(False).alias("edge"), F.col("v").alias("a"), F.col("mate").alias("b")))
        kept, seen = scratch.save(both, "edges", edges=F.count_if("edge"))
        collapsed.append(kept.where("not edge").select(F.col("a").alias("v"), F.col("b").alias("up")))
    if seen["edges"]:
        last = kept.where("edge").select("a", "b").repartition(1).mapInArrow(_toss_alone, "v string, up string")
        collapsed.append(scratch.save(last, "last"))
    if not collapsed:
        return vertices.select("vertex", F.col("vertex").alias("root"))
    tree = collapsed[0]
    for part in collapsed[1:]:
        tree = tree.unionByName(part)
    while True:
        step = tree.withColumn("moved", F.lit(False))
        for _ in range(STEPS):
            above = step.select(F.col("v").alias("up"), F.col("up").alias("top"))
            step = step.join(above, "up", "left").select("v", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        old = tree
        step, seen = scratch.save(step, "tree", moved=F.count_if("moved"))
        scratch.drop(old)
        tree = step.select("v", "up")
        tree._scratch_path = step._scratch_path
        if not seen["moved"]:
            break
    return vertices.join(tree, vertices["vertex"] == tree["v"], "left").select("vertex", F.coalesce("up", "vertex").alias("root"))


def tied_keys(table: DataFrame, left: Column, right: Column, left_kind: str, right_kind: str) -> DataFrame:
    """``(key_kind, record_key, group_key)`` of the distinct non-null keys.

    Keys of a row belong together, and so on through further rows.  ``group_key`` is
    the least left key of the group, or its least right key if it has no left one.
    Rows with one key make that key a group of its own unless other rows tie it;
    rows without keys are in no group.
    """
    scratch = Scratch(table.sparkSession, "ties")
    # left keys sort before right ones, so the least vertex names the group
    pairs = table.select(F.concat(F.lit("0"), left).alias("a"), F.concat(F.lit("1"), right).alias("b")).distinct()
    pairs = scratch.save(pairs, "pairs")
    vertices = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).where("vertex is not null").distinct()
    found = scratch.save(components(pairs.where("a is not null and b is not null"), vertices), "components")
    names = found.groupBy("root").agg(F.min("vertex").alias("least"))
    named = found.join(names, "root")
    kind = F.when(F.startswith("vertex", F.lit("0")), F.lit(left_kind)).otherwise(F.lit(right_kind))
    rest = lambda c: F.substring(c, 2, 1 << 30)
    return named.select(kind.alias("key_kind"), rest("vertex").alias("record_key"), rest("least").alias("group_key"))


def _shares(plan: DataFrame) -> list[tuple[str, float]]:
    rows_ = plan.select("split_name", "share").where("share > 0").orderBy("split_name").take(10_001)
    if len(rows_) > 10_000:
        raise ValueError("a plan of more than 10,000 splits")
    return [(r[0], float(r[1])) for r in rows_]


def assign_loose(table: DataFrame, plan: DataFrame) -> DataFrame:
    """``(split_name, n_rows)`` of rows that nothing ties: each goes by its own hash, so
    equal rows stay together and shares are met on average."""
    shares = _shares(plan)
    place = F.pmod(F.xxhash64(F.lit("loose"), *table.columns), F.lit(1 << 30)) / (1 << 30)
    split, upto = F.lit(shares[-1][0] if shares else None), 1.0
    for name, share in reversed(shares):
        split = F.when(place <= upto, F.lit(name)).otherwise(split)
        upto -= share / sum(s for _, s in shares)
    return table.groupBy(split.alias("split_name")).agg(F.count(F.lit(1)).alias("n_rows"))


def assign_groups(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """``(group_key, n_rows, split_name)``: whole groups to splits by their shares.

    ``groups`` has ``(group_key, n_rows)``, ``plan`` ``(split_name, share)``.  Groups
    above a thousandth of all rows, of which there are less than a thousand, are
    placed from the heaviest down, each where most is missing.  The others stand in
    hash order on a line of cumulative weight, which the splits cut by what they
    still lack; the line is summed in buckets, never in one task.  A share is met
    within a thousandth or so unless one group alone is larger than it.
    """
    shares = _shares(plan)
    total = groups.agg(F.sum("n_rows")).first()[0] or 0
    lacks = {name: share * total / sum(s for _, s in shares) for name, share in shares}
    big = groups.where(F.col("n_rows") > total * BIG)
    placed = []
    for r in big.orderBy(F.desc("n_rows"), "group_key").collect():
        name = max(lacks, key=lambda k: lacks[k])
        lacks[name] -= r["n_rows"]
        placed.append((r["group_key"], name))
    left = sum(max(0.0, v) for v in lacks.values())
    small = groups.where(F.col("n_rows") <= total * BIG)
    place = F.xxhash64(F.lit("split"), "group_key")
    small = small.select("group_key", "n_rows", place.alias("place"), F.pmod(F.shiftright(place, 40), F.lit(BUCKETS)).alias("bucket"))
    sums = small.groupBy("bucket").agg(F.sum("n_rows").alias("s"))
    base = F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("bucket", base.alias("base"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("all"))
    inside = Window.partitionBy("bucket").orderBy("place", "group_key").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("base") + F.sum("n_rows").over(inside) - F.col("n_rows") / 2) / F.col("all")
    line = small.join(F.broadcast(sums), "bucket").select("group_key", "n_rows", at.alias("at"))
    split, upto = F.lit(shares[-1][0] if shares else None), 1.0
    for name, _ in reversed(shares[:-1] if left <= 0 else shares):
        part = max(0.0, lacks[name]) / left if left > 0 else 0.0
        split = F.when(F.col("at") <= upto, F.lit(name)).otherwise(split) if part > 0 else split
        upto -= part
    out = line.select("group_key", "n_rows", split.alias("split_name"))
    if placed:
        fixed = groups.sparkSession.createDataFrame(placed, "group_key string, split_name string")
        out = out.unionByName(big.join(F.broadcast(fixed), "group_key").select("group_key", "n_rows", "split_name"))
    return out
