"""Spreading small tables over all cores before a Python kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandworks.plans.ship import ship

#: Below so many estimated bytes per core a shuffle costs next to nothing; above,
#: the splits of the scan spread the rows already.
SMALL = 2 << 20


def spread(df: DataFrame, key: str | None = None, per_core: int = 1) -> DataFrame:
    """The same rows over all cores if the table is so small that a scan would leave cores
    idle; as they are otherwise.  Rows are hashed by ``key``, which should be close to
    unique, or dealt out in turn without one, so that no value makes a hot task."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if cores == 1 or size >= SMALL * cores:
        return df
    return df.repartition(cores * per_core, *([key] if key else []))
