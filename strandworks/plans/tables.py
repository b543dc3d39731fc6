"""Access to the input tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandworks.plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns are pruned by the scan, not here."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
