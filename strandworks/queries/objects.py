"""Queries on whole objects: dumps, initialisers, profiles, protocols."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.functions import extension as E
from strandworks.operators import atoms as A
from strandworks.operators import ligands as L
from strandworks.operators import msa as M
from strandworks.operators import profiles as P
from strandworks.operators import structure_variables as SV
from strandworks.operators.segments import segment_id
from strandworks.plans.scratch import Scratch
from strandworks.plans.tables import table
from strandworks.queries._base import SEQUENCES_SQL, Registry, sequences
from strandworks.queries.collection import TREE, tree
from strandworks.queries.msa_and_variables import W_MSA, msa
from strandworks.queries.structures import ATOMS_SQL, _GYRATION, _grown, _LIGATOMS, atoms, is_lig, is_pol
from strandworks.sources import dumps

reg = Registry()
QUERIES, SQL = reg.queries, reg.sql
SEQ, W = f"WITH {SEQUENCES_SQL}", f"WITH {ATOMS_SQL}"


@reg.add("op_2_1_8_structure_store", f"{W} SELECT structure_id, count(*) AS n_atoms, CAST(sum(CASE WHEN res_name = 'HOH' OR length(res_name) <> 3 THEN 2 WHEN res_name = 'LIG' THEN 4 ELSE 8 END) AS BIGINT) AS marks FROM atoms GROUP BY 1")
def _(spark, d):
    """Atoms with their marks, and bonds, stored and read again."""
    path = Scratch(spark, "structures").path("store")
    rows = A.mark_atoms(atoms(spark, d)).withColumn("mark", F.col("mark").bitwiseAND(~64))
    dumps.write_objects(path, atoms=rows, bonds=A.covalent_bonds(atoms(spark, d)))
    back = dumps.read_objects(spark, path)
    return back["atoms"].groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.sum("mark").alias("marks"))


@reg.add("op_2_1_10_chain_structure_dump", f"{W} SELECT structure_id, chain_id, count(*) AS n FROM atoms GROUP BY 1, 2")
def _(spark, d):
    path = Scratch(spark, "chains").path("store")
    rows = atoms(spark, d)
    dumps.write_objects(path, atoms=rows, chains=rows.select("structure_id", "chain_id").distinct())
    back = dumps.read_objects(spark, path, "atoms", "chains")
    return back["chains"].join(back["atoms"], ["structure_id", "chain_id"]).groupBy("structure_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_1_11_chain_dump", f"{SEQ} SELECT seq_id, chain_id, s FROM sequences")
def _(spark, d):
    path = Scratch(spark, "chain").path("store")
    dumps.write_objects(path, chains=sequences(spark, d).select("seq_id", "chain_id", "s"))
    return dumps.read_objects(spark, path, "chains")["chains"]


@reg.add("op_2_1_12_bulk_io", f"{SEQ} SELECT seq_id, CAST(length(s) AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS error FROM sequences UNION ALL SELECT NULL, NULL, 'not' || chr(9) || 'a number'")
def _(spark, d):
    """Text dumps read row by row; what cannot be read is a row with its text."""
    path = Scratch(spark, "bulk").path("out")
    lines = sequences(spark, d).select(F.concat_ws("\t", "seq_id", F.length("s")).alias("value"))
    lines.unionByName(spark.createDataFrame([("not\ta number",)], "value string")).write.text(path)
    return dumps.read_tolerant(spark, path, "seq_id long, n int").select("seq_id", "n", F.col("_corrupt").alias("error"))


@reg.add("op_2_1_13_split_reader", f"{W}, l AS (SELECT DISTINCT seq_id, 's' || (seq_id % 2) AS structure_id FROM chain_sequences) SELECT seq_id, l.structure_id, count(*) AS n FROM l JOIN atoms a ON a.structure_id = l.structure_id GROUP BY 1, 2")
def _(spark, d):
    seqs = table(spark, d, "chain_sequences").select("seq_id").distinct()
    links = seqs.select("seq_id", F.concat(F.lit("s"), F.col("seq_id") % 2).alias("structure_id"))
    sizes = atoms(spark, d).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))
    return dumps.join_structures(seqs, sizes, links).select("seq_id", "structure_id", "n")


@reg.add("op_2_1_13_split_structures", f"{W}, l AS (SELECT DISTINCT seq_id, 's' || (seq_id % (SELECT count(DISTINCT structure_id) FROM atoms)) AS structure_id FROM chain_sequences) SELECT seq_id, l.structure_id, count(*) AS n FROM l JOIN atoms a ON a.structure_id = l.structure_id GROUP BY 1, 2")
def _(spark, d):
    """Sequences dealt out to all structures there are."""
    seqs = table(spark, d, "chain_sequences").select("seq_id").distinct()
    sizes = atoms(spark, d).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))
    count = sizes.agg(F.count(F.lit(1)).alias("k"))
    links = seqs.crossJoin(count).select("seq_id", F.concat(F.lit("s"), F.col("seq_id") % F.col("k")).alias("structure_id"))
    return dumps.join_structures(seqs, sizes, links).select("seq_id", "structure_id", "n")


@reg.add("op_2_1_19_chain_from_sequence", f"{SEQ} SELECT seq_id, 'chain_' || seq_id || '|1-' || length(s) AS id, s FROM sequences")
def _(spark, d):
    name = F.concat(F.lit("chain_"), F.col("seq_id"))
    return sequences(spark, d).select("seq_id", segment_id(name, F.lit(1), F.length("s")).alias("id"), "s")


def _mapped(spark, d):
    """Each chain's first sequence against its others."""
    w = Window.partitionBy("chain_id").orderBy("seq_id")
    rows = sequences(spark, d).where("chain_id is not null")
    rows = rows.select("chain_id", "seq_id", "s", F.first("s").over(w).alias("canonical"), F.row_number().over(w).alias("k")).where("k > 1")
    return M.align(rows, "s", "canonical")


@reg.add("op_2_1_21_mapping_initializer")
def _(spark, d):
    """Sequences keyed by chain, each aligned to its key: the canonical map."""
    out = _mapped(spark, d).select("chain_id", "seq_id", F.posexplode("aln.numbers").alias("k", "map_canonical"))
    return out.select("chain_id", "seq_id", (F.col("k") + 1).alias("i"), "map_canonical")


@reg.add("op_2_6_2_batch_numbering", f"{SEQ}, n AS (SELECT chain_id, seq_id, row_number() OVER (PARTITION BY chain_id ORDER BY seq_id) AS k, length(s) AS n FROM sequences WHERE chain_id IS NOT NULL) SELECT chain_id, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n_numbers FROM n WHERE k > 1 GROUP BY 1")
def _(spark, d):
    """Sizes of the numberings of all groups: one number per letter."""
    return _mapped(spark, d).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.size("aln.numbers")).alias("n_numbers"))


@reg.add("op_2_9_4_add_structure", f"{SEQ}, n AS (SELECT chain_id, seq_id, row_number() OVER (PARTITION BY chain_id ORDER BY seq_id) AS k FROM sequences WHERE chain_id IS NOT NULL), twice AS (SELECT chain_id, seq_id FROM n WHERE k > 1 UNION ALL SELECT chain_id, seq_id FROM n WHERE k > 1 AND seq_id % 5 = 0) SELECT chain_id, seq_id, count(*) OVER (PARTITION BY chain_id, seq_id) = 1 AS added FROM twice")
def _(spark, d):
    """Additions with a unique id and an alignment to their chain; every fifth comes
    twice, and neither of the two is added."""
    rows = _mapped(spark, d)
    rows = rows.unionByName(rows.where("seq_id % 5 = 0"))
    once = F.count(F.lit(1)).over(Window.partitionBy("chain_id", "seq_id"))
    return rows.select("chain_id", "seq_id", ((once == 1) & F.col("aln").isNotNull()).alias("added"))


@reg.add("op_2_6_6_msa_add", f"{W_MSA}, b AS (SELECT msa_id, max(length(aligned)) AS w, max(ord) AS last FROM msa GROUP BY 1) SELECT m.msa_id, m.seq_id, CAST(w AS INTEGER) AS n_cols, CASE WHEN ord < last OR last = 1 THEN aligned END AS kept FROM msa m JOIN b USING (msa_id)")
def _(spark, d):
    """Alignments without their last rows, which are aligned to the rest and added: the
    others keep their columns, and the added ones have as many."""
    rows = msa(spark, d)
    last = rows.groupBy("msa_id").agg(F.max_by("seq_id", "ord").alias("seq_id"), F.max("ord").alias("n")).where("n > 1")
    rest = M.remove_rows(rows, last)
    new = last.join(sequences(spark, d).select("seq_id", "s"), "seq_id").select("msa_id", "seq_id", "s")
    added = M.add_rows(rest, new)
    return rest.select("msa_id", "seq_id", F.length("aligned").alias("n_cols"), F.col("aligned").alias("kept")).unionByName(
        added.select("msa_id", "seq_id", F.length("aligned").alias("n_cols"), F.lit(None).cast("string").alias("kept"))
    )


@reg.add(
    "op_2_6_7_profile_build",
    f"""{W_MSA}, cells AS (SELECT msa_id, pos, substr(aligned, pos, 1) AS aa FROM (SELECT *, unnest(range(1, length(aligned) + 1)) AS pos FROM msa)),
tot AS (SELECT msa_id, pos, count(*) AS n, count(*) FILTER (aa = '-') AS g FROM cells GROUP BY 1, 2), kept AS (SELECT *, row_number() OVER (PARTITION BY msa_id ORDER BY pos) AS p FROM tot WHERE g <= 0.5 * n),
per AS (SELECT msa_id, pos, aa, count(*) AS k FROM cells GROUP BY 1, 2, 3)
SELECT kept.msa_id, CAST(p AS INTEGER) AS pos, count(*) AS n_letters, round(max(ln((coalesce(k, 0) + 0.05) / (n - g + 1.0) * 20)), 6) AS best, round(min(ln((coalesce(k, 0) + 0.05) / (n - g + 1.0) * 20)), 6) AS worst FROM kept CROSS JOIN (SELECT unnest(string_split('A C D E F G H I K L M N P Q R S T V W Y', ' ')) AS aa) l LEFT JOIN per ON per.msa_id = kept.msa_id AND per.pos = kept.pos AND per.aa = l.aa GROUP BY 1, 2""",
)
def _(spark, d):
    """Every profile, summed up by its best and worst letter in each column."""
    return P.extremes(msa(spark, d), 6)


def _hits(spark, d):
    return P.search(sequences(spark, d), "seq_id", "s", P.build_packed(msa(spark, d)))


@reg.add("op_2_6_8_profile_search")
def _(spark, d):
    """All matches of all sequences with the profiles of all alignments."""
    return _hits(spark, d).withColumn("score", F.round("score", 4))


@reg.add("op_2_6_9_profile_annotate")
def _(spark, d):
    return P.annotate(_hits(spark, d), sequences(spark, d).select("seq_id", F.length("s").alias("size")), "seq_id", min_score=4.0, min_size=5)


@reg.add("op_2_2_12_chain_accessors", f"{SEQ} SELECT seq_id, 'Chain(' || seq_id || '|' || seq_start || '-' || seq_end || ')' AS id, seq_start AS start_pos, seq_end AS end_pos FROM sequences")
def _(spark, d):
    own = segment_id(F.col("seq_id").cast("string"), F.col("seq_start"), F.col("seq_end"))
    return sequences(spark, d).select("seq_id", F.concat(F.lit("Chain("), own, F.lit(")")).alias("id"), F.col("seq_start").alias("start_pos"), F.col("seq_end").alias("end_pos"))


@reg.add("op_2_2_25_structure_summary", f"{W} SELECT structure_id AS object_id, NULL AS ligand, count(*) AS n FROM atoms GROUP BY 1 UNION ALL SELECT structure_id, chain_id || '_' || res_id, count(*) FROM atoms WHERE hetero GROUP BY 1, 2")
def _(spark, d):
    rows = atoms(spark, d)
    top = rows.groupBy(F.col("structure_id").alias("object_id")).agg(F.count(F.lit(1)).alias("n"))
    ligands = rows.where("hetero").groupBy(F.col("structure_id").alias("object_id"), F.concat_ws("_", "chain_id", "res_id").alias("ligand")).agg(F.count(F.lit(1)).alias("n"))
    return top.unionByName(ligands, allowMissingColumns=True)


@reg.add("op_2_2_26_ligand_summary", f"{W}, {_LIGATOMS} SELECT structure_id, lig, count(*) AS n_polymer_atoms, round(min(dist), 6) AS nearest FROM ligatoms GROUP BY 1, 2")
def _(spark, d):
    rows = atoms(spark, d)
    ligs = rows.where(is_lig()).select("structure_id", F.col("atom_idx").alias("a"), F.concat_ws("_", "chain_id", "res_id").alias("lig"))
    near = L.nearest(rows.where(is_lig()), rows.where(is_pol())).join(ligs, ["structure_id", "a"]).groupBy("structure_id", "lig").agg(F.round(F.min("dist"), 6).alias("nearest"))
    return near.join(rows.where(is_pol()).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_polymer_atoms")), "structure_id")


@reg.add("op_2_2_27_sequence_child_apply", f"{TREE} SELECT id, length(id) AS n FROM tree WHERE level = 2 AND id LIKE 'c%'")
def _(spark, d):
    return E.apply_columns(tree(spark, d).where("level = 2 and id like 'c%'"), n=lambda t: F.length("id").cast("long")).select("id", "n")


@reg.add("op_2_2_28_structure_child_apply", f"{TREE} SELECT id, reverse(id) AS tag FROM tree WHERE level = 2 AND id LIKE 's%'")
def _(spark, d):
    return tree(spark, d).where("level = 2 and id like 's%'").select("id", F.reverse("id").alias("tag"))


@reg.add("op_2_2_29_convert_to_chain", f"{SEQ} SELECT 'seq_' || seq_id || '|' || seq_start || '-' || seq_end AS id, 3 AS chain_type, 0 AS level, CAST(length(s) AS INTEGER) AS n_letters, CAST(NULL AS VARCHAR) AS parent_id FROM sequences UNION ALL SELECT 'seq_' || seq_id || '|' || seq_start || '-' || seq_end || '<-(child)', 3, 1, 5, 'seq_' || seq_id || '|' || seq_start || '-' || seq_end FROM sequences WHERE length(s) > 200")
def _(spark, d):
    """Sequences, and children of the longer ones, as rows of a chain tree."""
    own = segment_id(F.concat(F.lit("seq_"), "seq_id"), F.col("seq_start"), F.col("seq_end"))
    chain = lambda df, id_, level, n, parent: df.select(id_.alias("id"), F.lit(3).alias("chain_type"), F.lit(level).alias("level"), n.alias("n_letters"), parent.alias("parent_id"))
    rows = sequences(spark, d)
    top = chain(rows, own, 0, F.length("s"), F.lit(None).cast("string"))
    kids = rows.where(F.length("s") > 200).withColumn("part", F.substring("s", 3, 5))
    return top.unionByName(chain(kids, F.concat(own, F.lit("<-(child)")), 1, F.length("part"), own))


@reg.add("op_2_3_8_sequence_child_filter", f"{TREE} SELECT id FROM tree WHERE level = 2 AND id LIKE 'c%' AND root = 'r0'")
def _(spark, d):
    return tree(spark, d).where("level = 2 and id like 'c%' and root = 'r0'").select("id")


@reg.add("op_2_3_9_structure_child_filter", f"{TREE} SELECT id FROM tree WHERE level = 2 AND id LIKE 's%' AND root = 'r0'")
def _(spark, d):
    return tree(spark, d).where("level = 2 and id like 's%' and root = 'r0'").select("id")


@reg.add("op_2_4_21_subset_to_matching")
def _(spark, d):
    """Residues of neighbouring sequences that the optimal alignment pairs."""
    out = _mapped(spark, d).select("seq_id", F.posexplode("aln.numbers").alias("k", "to_i")).where("to_i is not null")
    return out.select("seq_id", (F.col("k") + 1).alias("from_i"), "to_i")


@reg.add("op_2_6_20_chain_superposition", f"{W} SELECT structure_id AS fixed_id, structure_id || 't' AS mobile_id, CAST(count(*) AS INTEGER) AS n, round(0.1 * {_GYRATION}, 5) AS rmsd FROM atoms WHERE atom_name IN ('N', 'CA', 'C') AND chain_id = 'A' GROUP BY 1")
def _(spark, d):
    """Chain A onto its grown copy by three atoms of each residue, renumbered by a map
    that the mobile chain brings along."""
    rows = atoms(spark, d).where("chain_id = 'A' and atom_name in ('N', 'CA', 'C')")
    mobile = _grown(rows.withColumn("res_id", F.col("res_id") + 100))
    to = mobile.select("structure_id", "res_id", (F.col("res_id") - 100).alias("position")).distinct()
    pairs = rows.select(F.col("structure_id").alias("fixed_id"), F.concat("structure_id", F.lit("t")).alias("mobile_id")).distinct()
    return A.superpose_strict(pairs, rows, SV.mapped(mobile, to)).select("fixed_id", "mobile_id", "n", F.round("rmsd", 5).alias("rmsd"))


_KINDS = {"Count": "int", "PFP": "float", "SeqEl": "str", "Contacts": "str", "ClosestLigandNames": "str", "ClosestLigandContactsCount": "int"} | dict.fromkeys(
    "Dist AggDist Dihedral PseudoDihedral Phi Psi Omega Chi1 Chi2 SASA ClosestLigandDist LigandDist".split(), "float"
)


@reg.add("op_2_11_1_variable_contract", f"SELECT * FROM (VALUES {', '.join(str(pair) for pair in _KINDS.items())}) t(name, rtype)")
def _(spark, d):
    """All registered kinds of variables and the types of their values."""
    from strandworks.operators.variables import REGISTRY

    kinds = {k: v[1] for k, v in REGISTRY.items()} | {k: v.rtype for k, v in SV.REGISTRY.items()}
    return spark.createDataFrame(list(kinds.items()), "name string, rtype string")


@reg.add("op_2_11_9_user_callables", f"{SEQ} SELECT seq_id, unnest([1, 2]) AS part, CAST(length(s) AS BIGINT) * unnest([1, 2]) AS n FROM sequences")
def _(spark, d):
    """A vectorised user function, then one that makes rows."""
    rows = E.apply_series(sequences(spark, d), "n", "long", lambda s: s.str.len().astype(np.int64), "s")
    out = E.apply_rows(rows.select("seq_id", "n"), lambda r: [{"seq_id": r["seq_id"], "part": k, "n": r["n"] * k} for k in (1, 2)], "seq_id long, part int, n long")
    assert E.has_schema(out, {"part": "int"})
    return out


@reg.add("op_2_2_21_realign_rows", f"{W_MSA} SELECT msa_id, seq_id, replace(aligned, '-', '') AS s, true AS square FROM msa")
def _(spark, d):
    """Alignments made anew from their letters: every row keeps them, all are as wide."""
    out, w = M.realign(msa(spark, d)), Window.partitionBy("msa_id")
    width = F.length("aligned")
    return out.select("msa_id", "seq_id", F.replace("aligned", F.lit("-"), F.lit("")).alias("s"), (F.min(width).over(w) == F.max(width).over(w)).alias("square"))
