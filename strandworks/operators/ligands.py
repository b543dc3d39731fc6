"""Ligands: which polymer atoms they meet, and how far they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.operators.atoms import KEY, distance, grid_pairs

#: A ligand is named by its chain and residue.
LIGAND_ID = ("chain_id", "res_id")


def _named(atoms: DataFrame, ligand: Column) -> DataFrame:
    return atoms.where(ligand).withColumn("lig", F.concat_ws("_", *LIGAND_ID))


def ligand_contacts(atoms: DataFrame, ligand: Column, polymer: Column, cutoff: float) -> DataFrame:
    """``structure_id, lig, a, a_res, atom_name, dist``: each polymer atom with each
    ligand within ``cutoff`` and its least distance, found through the grid of cells.
    Atoms that are neither and structures without either give no row."""
    ligs, pol = _named(atoms, ligand), atoms.where(polymer)
    near = grid_pairs(pol, ligs, cutoff).join(ligs.select(KEY, F.col("atom_idx").alias("b"), "lig"), [KEY, "b"])
    least = near.groupBy(KEY, "lig", "a").agg(F.min("dist").alias("dist"))
    return least.join(pol.select(KEY, F.col("atom_idx").alias("a"), F.col("res_id").alias("a_res"), "atom_name"), [KEY, "a"])


def ligand_distances(atoms: DataFrame, ligand: Column, chosen: Column) -> DataFrame:
    """``structure_id, lig, a, a_res, atom_name, dist``: the least distance of each
    chosen atom to each ligand of its structure, however far.  A distance without a
    bound needs every pair of a structure, so choose few atoms, as a residue's."""
    lig = _named(atoms, ligand).select(KEY, "lig", *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    pol = atoms.where(chosen).select(KEY, F.col("atom_idx").alias("a"), F.col("res_id").alias("a_res"), "atom_name", *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    return pol.join(lig, KEY).groupBy(KEY, "lig", "a", "a_res", "atom_name").agg(F.min(distance("a", "b")).alias("dist"))


def nearest(left: DataFrame, right: DataFrame, first: float = 4.0, widest: float = 1024.0) -> DataFrame:
    """``structure_id, a, dist``: each left atom's distance to the nearest right atom of
    its structure, however far.  The radius grows for the atoms that have met none, so
    most pairs are never formed; those beyond ``widest`` meet every right atom.  Left
    atoms of structures without right atoms give no row."""
    todo = left.join(right.select(KEY).distinct(), KEY, "left_semi")
    out, radius = None, first
    while radius <= widest:
        found = grid_pairs(todo, right, radius).groupBy(KEY, "a").agg(F.min("dist").alias("dist"))
        out = found if out is None else out.unionByName(found)
        todo = todo.join(found.select(KEY, F.col("a").alias("atom_idx")), [KEY, "atom_idx"], "left_anti")
        radius *= 16
    point = lambda df, s: df.select(KEY, F.col("atom_idx").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in "xyz"])
    far = point(todo, "a").join(point(right, "b"), KEY).groupBy(KEY, "a").agg(F.min(distance("a", "b")).alias("dist"))
    return out.unionByName(far)


def connected(contacts: DataFrame, min_atoms: int = 5, min_residues: int = 3) -> DataFrame:
    """``structure_id, lig, n_contacts, n_residues, connected`` of ligands with contacts."""
    per = contacts.groupBy(KEY, "lig").agg(F.count(F.lit(1)).alias("n_contacts"), F.count_distinct("a_res").alias("n_residues"))
    return per.withColumn("connected", (F.col("n_contacts") >= min_atoms) & (F.col("n_residues") >= min_residues))
