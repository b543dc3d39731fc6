"""Protein to structure-chain mappings over a segment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(sifts: DataFrame) -> DataFrame:
    """Distinct segments with uniform keys; rows without chain or protein are dropped."""
    return (
        sifts.select(
            F.upper(F.trim("pdb")).alias("pdb"), F.trim("chain").alias("chain"), F.upper(F.trim("uniprot_id")).alias("uniprot_id"),
            "pdb_start", "pdb_end", "uniprot_start", "uniprot_end",
        )
        .where("pdb is not null and chain is not null and uniprot_id is not null")
        .distinct()
    )


def id_map(rows: DataFrame) -> DataFrame:
    """``kind, id_from, id_to``: protein to chains, chain to proteins, structure to its
    bare chain letters."""
    full = F.concat_ws(":", "pdb", "chain")
    pairs = F.array(
        F.struct(F.lit("uniprot").alias("kind"), F.col("uniprot_id").alias("f"), full.alias("t")),
        F.struct(F.lit("chain").alias("kind"), full.alias("f"), F.col("uniprot_id").alias("t")),
        F.struct(F.lit("pdb").alias("kind"), F.col("pdb").alias("f"), F.col("chain").alias("t")),
    )
    out = rows.select(F.explode(pairs).alias("x")).select("x.*")
    return out.groupBy("kind", F.col("f").alias("id_from")).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("id_to"))


def mapping_plan(rows: DataFrame, proteins: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """``uniprot_id, plan`` as ``PDB:A,B;PDB2:A``: what to load for each protein."""
    kept = rows.join(proteins.select("uniprot_id").distinct(), "uniprot_id", "left_semi")
    if structures is not None:
        kept = kept.join(structures.select("pdb").distinct(), "pdb", "left_semi")
    per = kept.groupBy("uniprot_id", "pdb").agg(F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("cs"))
    item = F.concat_ws(":", "pdb", "cs")
    return per.groupBy("uniprot_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ";").alias("plan"))
