"""Registration of queries with their SQL, and the tables they are built on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.operators.residues import explode_sequence
from strandworks.plans.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Registry:
    """Collects ``name -> query`` and ``name -> SQL`` of a module."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            f.__name__ = name
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """``seq_id, chain_id, seq_start, s``: cleaned, non-empty sequences."""
    s = F.regexp_replace(F.upper("seq1"), "[^A-Z]", "")
    return table(spark, d, "chain_sequences").select("seq_id", "chain_id", "seq_start", "seq_end", s.alias("s")).where(F.length("s") > 0)


def residues(spark: SparkSession, d: str) -> DataFrame:
    """``seq_id, i, aa, num``: a numbering with holes at unknown residues."""
    rows = explode_sequence(sequences(spark, d), "seq_id", "s", "aa", ["seq_start"])
    num = F.when(F.col("aa") != "X", F.col("seq_start") + F.col("i") - 1)
    return rows.select("seq_id", F.col("i").cast("int").alias("i"), "aa", num.alias("num"))


SEQUENCES_SQL = """sequences AS (
  SELECT * FROM (SELECT seq_id, chain_id, seq_start, seq_end, regexp_replace(upper(seq1), '[^A-Z]', '', 'g') AS s FROM chain_sequences) WHERE length(s) > 0)"""
RESIDUES_SQL = (
    SEQUENCES_SQL
    + """,
residues AS (
  SELECT seq_id, CAST(i AS INTEGER) AS i, substr(s, i, 1) AS aa, CASE WHEN substr(s, i, 1) <> 'X' THEN CAST(seq_start + i - 1 AS INTEGER) END AS num
  FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM sequences))"""
)


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of :func:`segments` as often as they are there."""
    rows = table(spark, d, "sifts").select(
        F.upper(F.trim("uniprot_id")).alias("g"), F.col("pdb_chain").alias("name"), F.col("uniprot_start").alias("s"),
        F.col("uniprot_end").alias("e"), F.col("pdb_start").alias("ps"), F.col("pdb_end").alias("pe"),
    )
    ok = "g is not null and name is not null and s >= 1 and e >= s and ps >= 1 and pe >= ps"
    return rows.where(ok)


def segments(spark: SparkSession, d: str) -> DataFrame:
    """``g, name, s, e, ps, pe``: distinct valid segments of each protein, on the
    protein (``s, e``) and on the structure chain (``ps, pe``)."""
    return segment_rows(spark, d).distinct()


SEGMENTS_SQL = """segments AS (
  SELECT DISTINCT * FROM (
    SELECT upper(trim(uniprot_id, ' ')) AS g, pdb_chain AS name, uniprot_start AS s, uniprot_end AS e, pdb_start AS ps, pdb_end AS pe FROM sifts)
  WHERE g IS NOT NULL AND name IS NOT NULL AND s >= 1 AND e >= s AND ps >= 1 AND pe >= ps)"""
