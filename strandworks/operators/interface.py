"""Interfaces between two groups of chains: contacts, components, comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.errors import AmbiguousData, MissingData
from strandworks.functions.kernels import components, superpose
from strandworks.operators.atoms import KEY, grid_pairs, is_solvent
from strandworks.plans.ship import ship


def parse_partners(text: str) -> tuple[list[str], list[str]]:
    """``AB_C`` to chain lists; raises on empty or overlapping sides."""
    left, _, right = text.partition("_")
    if not left or not right:
        raise MissingData(text)
    if set(left) & set(right):
        raise AmbiguousData(text)
    return list(left), list(right)


def partner_columns(text: Column) -> list[Column]:
    """``side_a, side_b, error`` of partner texts, as :func:`parse_partners` reads one:
    ``missing`` if a side is empty, ``shared`` if a letter is on both."""
    a, b = (F.split_part(text, F.lit("_"), F.lit(k)) for k in (1, 2))
    letters = lambda c: F.split(c, "")
    error = F.when((a == "") | (b == ""), "missing").when(F.arrays_overlap(letters(a), letters(b)), "shared")
    return [a.alias("side_a"), b.alias("side_b"), error.alias("error")]


def contacts(atoms: DataFrame, partners: str, cutoff: float = 6.0) -> DataFrame:
    """``structure_id, a, b, dist, a_chain, b_chain, a_res, b_res``: pairs of atoms of
    the two sides within ``cutoff``, solvents left out."""
    left, right = parse_partners(partners)
    dry = atoms.where(~is_solvent(F.col("res_name")))
    pairs = grid_pairs(dry.where(F.col("chain_id").isin(left)), dry.where(F.col("chain_id").isin(right)), cutoff)
    side = lambda s: dry.select(KEY, F.col("atom_idx").alias(s), F.col("chain_id").alias(f"{s}_chain"), F.col("res_id").alias(f"{s}_res"))
    return pairs.join(side("a"), [KEY, "a"]).join(side("b"), [KEY, "b"])


def touching(edges: DataFrame, chains: list[str] | None) -> DataFrame:
    """Contacts with an end in one of the chains; all without a choice."""
    if chains is None:
        return edges
    return edges.where(F.col("a_chain").isin(chains) | F.col("b_chain").isin(chains))


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of each contact: ``structure_id, atom, chain, res``."""
    side = lambda s: F.struct(F.col(s).alias("atom"), F.col(f"{s}_chain").alias("chain"), F.col(f"{s}_res").alias("res"))
    return edges.select(KEY, F.explode(F.array(side("a"), side("b"))).alias("x")).select(KEY, "x.*")


def counts(edges: DataFrame, chains: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Contacts, contact atoms and contact residues per structure.  ``strict`` counts
    only ends in the chains, otherwise both ends of the contacts that touch them."""
    kept = touching(edges, chains)
    points = ends(kept)
    if strict and chains is not None:
        points = points.where(F.col("chain").isin(chains))
    n = kept.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_contacts"))
    return n.join(points.groupBy(KEY).agg(F.count_distinct("atom").alias("n_atoms"), F.count_distinct("chain", "res").alias("n_residues")), KEY, "left")


def contact_components(edges: DataFrame, min_nodes: int = 2) -> DataFrame:
    """``structure_id, atom, component``: components of the contact graph with their
    least atom as name.  Components never cross structures, so each structure is
    solved where its contacts lie."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        atom, least = components(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "atom": atom, "component": least})

    ship(edges.sparkSession)
    found = edges.select(KEY, "a", "b").groupBy(KEY).applyInPandas(run, f"{KEY} string, atom int, component int")
    sizes = found.groupBy(KEY, "component").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, [KEY, "component"]).where(F.col("n") >= min_nodes).select(KEY, "atom", "component")


def split_connected(edges: DataFrame, min_atoms: int = 1, min_res: int = 1, both: bool = True) -> DataFrame:
    """Pairs of chains joined by a component that holds enough atoms and residues on
    both sides (or on one): ``structure_id, a_chain, b_chain, n_components``."""
    named = edges.join(contact_components(edges).withColumnRenamed("atom", "a"), [KEY, "a"])
    side = lambda s: (F.count_distinct(s) >= min_atoms) & (F.count_distinct(f"{s}_res") >= min_res)
    per = named.groupBy(KEY, "component", "a_chain", "b_chain").agg(side("a").alias("ok_a"), side("b").alias("ok_b"))
    ok: Column = F.col("ok_a") & F.col("ok_b") if both else F.col("ok_a") | F.col("ok_b")
    return per.where(ok).groupBy(KEY, "a_chain", "b_chain").agg(F.count(F.lit(1)).alias("n_components"))


def fnat(reference: DataFrame, model: DataFrame, pairwise: bool = False) -> DataFrame:
    """``structure_id, fnat``: part of the reference's contact atoms that the model
    has too; ``pairwise`` compares residue pairs instead, the published form."""
    if pairwise:
        key = ["a_chain", "a_res", "b_chain", "b_res"]
        a, b = reference.select(KEY, *key).distinct(), model.select(KEY, *key).distinct()
    else:
        key = ["atom"]
        a, b = ends(reference).select(KEY, *key).distinct(), ends(model).select(KEY, *key).distinct()
    hit = a.join(b.withColumn("hit", F.lit(1)), [KEY, *key], "left")
    return hit.groupBy(KEY).agg((F.count("hit") / F.count(F.lit(1))).alias("fnat"))


def dockq(fnat: Column, irmsd: Column, lrmsd: Column, strict: bool = False) -> Column:
    """Mean of fnat and the two scaled deviations.  The scales are 8.5 for the
    interface and 1.5 for the ligand; ``strict`` gives each the other's, as published."""
    d_i, d_l = (1.5, 8.5) if strict else (8.5, 1.5)
    scaled = lambda r, d: 1 / (1 + (r / d) ** 2)
    return (fnat + scaled(irmsd, d_i) + scaled(lrmsd, d_l)) / 3


def fnat_contacts(reference: DataFrame, model: DataFrame) -> DataFrame:
    """``structure_id, fnat``: contacts of the model whose both atoms are contact atoms
    of the reference, over the reference's contacts; 0 for a model without contacts."""
    points = ends(reference).select(KEY, "atom").distinct()
    end = lambda s: points.withColumnRenamed("atom", s)
    kept = model.select(KEY, "a", "b").join(end("a"), [KEY, "a"], "left_semi").join(end("b"), [KEY, "b"], "left_semi")
    n = reference.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    hit = kept.groupBy(KEY).agg(F.count(F.lit(1)).alias("hit"))
    return n.join(hit, KEY, "left").select(KEY, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("fnat"))


def state_deviations(reference: DataFrame, mobile: DataFrame, edges: DataFrame, partners: str, chains: list[str] | None = None, ligand: list[str] | None = None, min_atoms: int = 5) -> DataFrame:
    """``structure_id, n_superposed, superposed_rmsd, irmsd, lrmsd, error``: the mobile
    state laid onto the reference over the contact atoms of the reference's contacts
    that touch ``chains`` (side a without a choice), then the deviations over all its
    contact atoms and over the ``ligand`` chains (side b without a choice).

    States must have the same atoms in the same order.  Those that do not, and those
    with fewer than ``min_atoms`` atoms to superpose, are rows with an error.
    """
    left, right = parse_partners(partners)
    left, right = chains or left, ligand or right
    side = lambda df, s: df.select(KEY, "atom_idx", *[F.col(c).alias(f"{s}_{c}") for c in ("chain_id", "atom_name", "x", "y", "z")])
    mask = lambda e, s: ends(e).select(KEY, F.col("atom").alias("atom_idx")).distinct().withColumn(s, F.lit(True))
    rows = side(reference, "r").join(side(mobile, "m"), [KEY, "atom_idx"], "full")
    rows = rows.join(mask(touching(edges, left), "spp"), [KEY, "atom_idx"], "left").join(mask(edges, "contact"), [KEY, "atom_idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def out(n, *values, error=None):
            return pd.DataFrame([(pdf[KEY].iloc[0], n, *(values or (None,) * 3), error)], columns=[KEY, "n_superposed", "superposed_rmsd", "irmsd", "lrmsd", "error"])

        spp, contact = (pdf[c].notna().to_numpy() for c in ("spp", "contact"))
        n = int(spp.sum())
        if not ((pdf["r_chain_id"] == pdf["m_chain_id"]) & (pdf["r_atom_name"] == pdf["m_atom_name"])).all():
            return out(n, error="states are not comparable")
        if n < min_atoms:
            return out(n, error=f"{n} atoms to superpose")
        ref, mob = (pdf[[f"{s}_{c}" for c in "xyz"]].to_numpy(float) for s in "rm")
        rotation, shift, rmsd = superpose(ref[spp], mob[spp])
        off = ((mob @ rotation + shift - ref) ** 2).sum(1)
        over = lambda m: float(np.sqrt(off[m].mean())) if m.any() else None
        return out(n, rmsd, over(contact), over(pdf["r_chain_id"].isin(right).to_numpy()))

    ship(reference.sparkSession)
    return rows.groupBy(KEY).applyInPandas(run, f"{KEY} string, n_superposed int, superposed_rmsd double, irmsd double, lrmsd double, error string")


def compare_states(reference: DataFrame, mobile: DataFrame, partners: str, cutoff: float = 6.0, strict: bool = False, **kwargs) -> DataFrame:
    """:func:`state_deviations` with ``fnat`` and the ``dockq`` that follows from them."""
    edges = contacts(reference, partners, cutoff)
    rows = state_deviations(reference, mobile, edges, partners, **kwargs)
    rows = rows.join(fnat_contacts(edges, contacts(mobile, partners, cutoff)), KEY, "left")
    fnat_ = F.when(F.col("error").isNull(), F.col("fnat"))
    return rows.withColumn("fnat", fnat_).withColumn("dockq", dockq(F.col("fnat"), F.col("irmsd"), F.col("lrmsd"), strict))
