"""Whole objects on disk: sequences, structures and their links below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.plans.scratch import path_exists

PARTS = ("chains", "residues", "atoms", "bonds", "links")


def write_objects(base: str, overwrite: bool = False, **parts: DataFrame) -> None:
    """Each part as a Parquet table, partitioned by nothing: few well-sized files."""
    for name, df in parts.items():
        if name not in PARTS:
            raise KeyError(name)
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{base}/{name}")


def read_objects(spark: SparkSession, base: str, *names: str) -> dict[str, DataFrame | None]:
    """The parts that are there; None for those that are not."""
    return {n: spark.read.parquet(f"{base}/{n}") if path_exists(spark, f"{base}/{n}") else None for n in names or PARTS}


def join_structures(sequences: DataFrame, structures: DataFrame, links: DataFrame) -> DataFrame:
    """Sequences and structures read apart, joined again by their links."""
    return links.join(sequences, "seq_id").join(structures, "structure_id")


def read_tolerant(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Rows of text dumps; a row that cannot be read keeps its text in ``_corrupt``."""
    raw = spark.read.text(path).withColumnRenamed("value", "_raw")
    row = F.from_csv("_raw", F.lit(schema + ", _corrupt string"), {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.select(row.alias("r")).select("r.*")
