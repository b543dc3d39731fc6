"""Algebra of closed integer segments as expressions and joins.

A segment is a pair of 1-based inclusive bounds; ``(0, 0)`` is the empty segment.
Every predicate is a Catalyst expression over bound columns, so it can sit in a
filter, a join condition or a projection.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.plans.ship import ship


def is_empty(s: Column, e: Column) -> Column:
    return (s == 0) & (e == 0)


def is_singleton(s: Column, e: Column) -> Column:
    return (s == e) & (s != 0)


def length(s: Column, e: Column) -> Column:
    return F.when(is_empty(s, e), 0).otherwise(e - s + 1)


def is_valid(s: Column, e: Column) -> Column:
    """Bounds are ordered, and positive unless the segment is empty."""
    return is_empty(s, e) | ((s >= 1) & (e >= s))


def overlaps(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Shared positions; an empty segment overlaps everything."""
    return is_empty(s, e) | is_empty(s2, e2) | ((s <= e2) & (s2 <= e))


def bounds(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """The first contains the second; empty segments are contained in all."""
    return is_empty(s, e) | is_empty(s2, e2) | ((s <= s2) & (e2 <= e))


def bounded_by(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    return bounds(s2, e2, s, e)


def shift(s: Column, e: Column, by: Column | int) -> tuple[Column, Column]:
    """New bounds moved by ``by``; the input is left as it is."""
    return s + by, e + by


def segment_id(name: Column, s: Column, e: Column, parent: Column | None = None) -> Column:
    """``name|start-end``, with the parent's id after ``<-`` in parentheses."""
    own = F.concat(name, F.lit("|"), s.cast("string"), F.lit("-"), e.cast("string"))
    if parent is None:
        return own
    return F.when(parent.isNull(), own).otherwise(F.concat(own, F.lit("<-("), parent, F.lit(")")))


def strip_parents(segment: Column) -> Column:
    return F.split_part(segment, F.lit("<-"), F.lit(1))


def intersect(df: DataFrame, left: tuple[str, str, str], right: tuple[str, str, str], mode: str = "merge", sep: str = "&") -> DataFrame:
    """Overlapping part of two segments per row as ``ov_name, ov_start, ov_end``.

    ``left``/``right`` name the name, start and end columns.  Mode ``merge`` joins
    the names by ``sep``; ``self`` and ``other`` keep one.  Rows without an overlap
    are dropped; an empty side yields the other side's bounds.
    """
    n, s, e = (F.col(c) for c in left)
    n2, s2, e2 = (F.col(c) for c in right)
    name = {"merge": F.concat_ws(sep, n, n2), "self": n, "other": n2}[mode]
    pick = lambda a, b, both: F.when(is_empty(s, e), b).when(is_empty(s2, e2), a).otherwise(both)
    return (
        df.where(overlaps(s, e, s2, e2))
        .withColumn("ov_name", name)
        .withColumn("ov_start", pick(s, s2, F.greatest(s, s2)))
        .withColumn("ov_end", pick(e, e2, F.least(e, e2)))
    )


def subsegment(df: DataFrame, s: str, e: str, start: Column, end: Column) -> DataFrame:
    """``sub_start, sub_end, ok``: a part, which must lie inside; ``ok`` tells."""
    inside = bounds(F.col(s), F.col(e), start, end)
    return df.withColumn("ok", inside).withColumn("sub_start", F.when(inside, start)).withColumn("sub_end", F.when(inside, end))


def any_overlap(df: DataFrame, group: list[str], s: str, e: str) -> DataFrame:
    """``group, has_overlap``: whether any two segments of a group share a position."""
    before = F.max(e).over(Window.partitionBy(*group).orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_hit", F.coalesce(F.col(s) <= before, F.lit(False))).groupBy(*group).agg(F.bool_or("_hit").alias("has_overlap"))


def islands(df: DataFrame, group: list[str], s: str, e: str) -> DataFrame:
    """Number the runs of overlapping segments of each group as ``island``."""
    w = Window.partitionBy(*group).orderBy(s, e)
    before = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(s) > before), 1).otherwise(0)
    return df.withColumn("_open", opens).withColumn("island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def resolve_overlaps(df: DataFrame, group: str, s: str, e: str, value: str) -> DataFrame:
    """Best non-overlapping subset of the segments of each group.

    Weighted interval scheduling: maximal total ``value``, then fewest segments,
    then smallest starts.  Only positive values can win; equal segments count once;
    empty segments are left out.  An island is what one task holds: at most the
    distinct segments of one run of overlaps.
    """
    rows = df.where(F.col(s) > 0).groupBy(group, s, e).agg(F.max(value).alias(value)).where(F.col(value) > 0)
    rows = islands(rows, [group], s, e).select(F.col(group).alias("g"), "island", F.col(s).alias("s"), F.col(e).alias("e"), F.col(value).cast("double").alias("v"))
    kind = df.schema[group].dataType.simpleString()
    ship(df.sparkSession)
    single = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g", "island")))
    alone = single.where("n = 1").select("g", F.col("s").cast("int"), F.col("e").cast("int"), "v")
    # islands lie one after the other in sorted partitions; the kernel keeps one at a time
    crowded = single.where("n > 1").drop("n").repartition("g", "island").sortWithinPartitions("g", "island", "e", "s")
    solved = crowded.mapInPandas(_solve_islands, f"g {kind}, s int, e int, v double")
    return alone.unionByName(solved).select(F.col("g").alias(group), F.col("s").alias(s), F.col("e").alias(e), F.col("v").alias(value))


def _best_subset(island: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Weighted interval scheduling of ``(s, e, v)``.

    From the last start back, the best subset of what begins there or later either
    takes the segment or not; a subset is kept as its first segment, from which the
    rest follows, so memory grows with the segments alone.
    """
    island = sorted(island)
    starts, n = [s for s, _, _ in island], len(island)
    after = [bisect_right(starts, e) for _, e, _ in island]
    total, fewer, head = [0.0] * (n + 1), [0] * (n + 1), [n] * (n + 1)

    def earlier(i: int, j: int) -> bool:
        """Whether the subset that begins with i has the smaller starts."""
        while i < n and j < n:
            if starts[i] != starts[j]:
                return starts[i] < starts[j]
            i, j = head[after[i]], head[after[j]]
        return False

    for i in range(n - 1, -1, -1):
        take, skip = (island[i][2] + total[after[i]], fewer[after[i]] - 1), (total[i + 1], fewer[i + 1])
        mine = take > skip or (take == skip and earlier(i, head[i + 1]))
        (total[i], fewer[i]), head[i] = (take, i) if mine else (skip, head[i + 1])
    out, i = [], head[0]
    while i < n:
        out.append(island[i])
        i = head[after[i]]
    return out


def _solve_islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, island, out = None, [], []
    for batch in batches:
        for g, number, s, e, v in zip(*(batch[c].tolist() for c in ("g", "island", "s", "e", "v"))):
            if (g, number) != key:
                out += [(key[0], *x) for x in _best_subset(island)] if key else []
                key, island = (g, number), []
            island.append((s, e, v))
        yield pd.DataFrame(out, columns=["g", "s", "e", "v"])
        out = []
    if key:
        yield pd.DataFrame([(key[0], *x) for x in _best_subset(island)], columns=["g", "s", "e", "v"])


def numbered_spans(df: DataFrame, keys: list[str], frm: tuple[str, str], to: tuple[str, str]) -> DataFrame:
    """``keys, at, from_pos, to_pos, n, n_mapped``: :func:`segment_numbering` as stretches of
    ``n`` positions of which the first ``n_mapped`` have a to-position and the others, a hole, none.
    Segments may repeat.  They are shuffled once, by the keys.
    """
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, F.col(frm[0]).alias("_f"), F.col(frm[1]).alias("_t"), F.col(to[0]).alias("_a"), F.col(to[1]).alias("_b"))
    rows = rows.repartition(*keys).groupBy(*keys, "_a").agg(F.min("_f").alias("_f"), F.max("_t").alias("_t"), F.max("_b").alias("_b"))
    rows = rows.withColumns({"_f": F.min("_f").over(w), "_t": F.max("_t").over(w), "_p": F.min("_a").over(w), "_next": F.lead("_a").over(w.orderBy("_a"))})
    rows = rows.withColumn("_b", F.max("_b").over(w.orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)))
    # from the segment's start to the next one's, or to the end of either side
    a, last = F.col("_a"), F.col("_p").cast("long") + F.col("_t") - F.col("_f")
    end = F.least(F.coalesce(F.col("_next") - 1, F.col("_b")), last).cast("int")
    rows = rows.withColumn("_end", end).where("_end >= _a").withColumn("_before", a - F.col("_p"))
    n, mapped = F.col("_end") - a + 1, F.least("_b", "_end") - a + 1
    return rows.select(*keys, (F.col("_before") + 1).alias("at"), (F.col("_f") + F.col("_before")).alias("from_pos"), a.alias("to_pos"), n.alias("n"), mapped.alias("n_mapped"))


def segment_numbering(df: DataFrame, keys: list[str], frm: tuple[str, str], to: tuple[str, str]) -> DataFrame:
    """Pair the continuous from-range of each key with its to-segments, position by position.

    The from side runs from its least start to its greatest end; the to side is its
    segments in order, their holes filled with nulls; the longer side is cut.
    Columns ``keys, at, from_pos, to_pos``.  Positions come out last and are not shuffled.
    """
    rows = numbered_spans(df, keys, frm, to).select(*keys, "at", "from_pos", "to_pos", "n_mapped", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_k"))
    k = F.col("_k")
    return rows.select(*keys, (F.col("at") + k).alias("at"), (F.col("from_pos") + k).alias("from_pos"), F.when(k < F.col("n_mapped"), F.col("to_pos") + k).alias("to_pos"))
