"""Merging overlapping closed intervals per key, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Start positions are split into blocks of this many, so that one hot key is
#: merged by many tasks before its few periods meet.
BLOCK = 1 << 16


def clean_intervals(df: DataFrame, key: str | Column, start: str | Column, end: str | Column) -> DataFrame:
    """Rows ``(k, s, e)`` with a key and ``1 <= s <= e``; the others do not count.

    Of intervals with the same key and start only the longest can matter, so the
    table is reduced by ``max(e)`` per ``(k, s)`` with a map-side combine: a key
    that holds a third of all rows shuffles no more than its distinct starts.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(key).alias("k"), col(start).cast("long").alias("s"), col(end).cast("long").alias("e"))
    rows = rows.where(F.col("k").isNotNull() & (F.col("s") >= 1) & (F.col("s") <= F.col("e")))
    return rows.groupBy("k", "s").agg(F.max("e").alias("e"))


def merge_periods(intervals: DataFrame) -> DataFrame:
    """Maximal covered periods ``(k, s, e)`` of cleaned intervals.

    A position counts as a second after the epoch: ``session_window`` with the
    row's own length as its duration merges what overlaps, per key and block of
    starts.  Periods that merely touch, or that reach into the next block, are
    joined afterwards by a running maximum over the few periods of the key.
    """
    session = F.session_window(
        F.timestamp_seconds(F.col("s")),
        F.make_interval(secs=(F.col("e") - F.col("s") + 1).cast("decimal(18,6)")),
    )
    block = F.floor(F.col("s") / BLOCK).alias("block")
    merged = intervals.groupBy("k", block, session).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    by_key = Window.partitionBy("k").orderBy("s", "e")
    before = F.max("e").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("s") > before + 1), 1).otherwise(0)
    return (
        merged.select("k", "s", "e", opens.alias("opens"))
        .withColumn("run", F.sum("opens").over(by_key))
        .groupBy("k", "run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select("k", "s", "e")
    )


def periods_and_gaps(df: DataFrame, key, start, end) -> DataFrame:
    """Periods and the gaps between neighbouring ones: ``(k, kind, s, e)``.

    * ``kind`` is ``period`` or ``gap``; bounds are closed.
    * Rows with a null key or bound, a start below 1 or an end before the start
      do not count; repeated rows change nothing; an empty table gives no rows.
    * A key with one period has no gap.
    """
    merged = merge_periods(clean_intervals(df, key, start, end))
    following = F.lead("s").over(Window.partitionBy("k").orderBy("s"))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s"), F.col("e")),
        F.struct(F.lit("gap").alias("kind"), (F.col("e") + 1).alias("s"), (F.col("n") - 1).alias("e")),
    )
    rows = merged.withColumn("n", following).select("k", F.explode(kinds).alias("x"))
    return rows.select("k", "x.kind", "x.s", "x.e").where(F.col("e").isNotNull())
