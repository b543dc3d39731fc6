"""Ranks over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.plans.scratch import Scratch


def ranked(df: DataFrame, *order: Column | str, name: str = "ord") -> DataFrame:
    """``df`` with its place from 1 on in the given order, ties in any order.

    Rows are sorted into range partitions and staged with their place inside, so that
    what is counted is what is read; the partitions' offsets are a running sum over as
    many rows as there are partitions.
    """
    place = F.monotonically_increasing_id()
    rows = df.orderBy(*order).withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)})
    rows = Scratch(df.sparkSession, "ranked").save(rows, "rows")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_base"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")
