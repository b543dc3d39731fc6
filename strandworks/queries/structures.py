"""Queries on atoms, contacts, ligands and interfaces.

The input has vectors instead of structures: 250 of them make eight, each from three
other dimensions as coordinates, and names follow from the place in the structure.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandworks.functions.tables import AMINO, BACKBONE, NUCLEOTIDES, RADII, SIDE_CHAIN
from strandworks.operators import atoms as A
from strandworks.operators import interface as I
from strandworks.operators import ligands as L
from strandworks.operators import residues as R
from strandworks.operators import structure_variables as SV
from strandworks.operators.pocket import pocket
from strandworks.plans.tables import table
from strandworks.queries._base import Registry

reg = Registry()
QUERIES, SQL = reg.queries, reg.sql

NAMES = ["N", "CA", "C", "O", "CB", "CG", "CD", "CE"]
ELEMENTS = ["N", "C", "C", "O", "C", "C", "C", "S"]
RESIDUES = sorted(AMINO)


def atoms(spark, d, scale=100):
    """250 vectors a structure, eight atoms a residue, three chains; every tenth
    residue a ligand and the one before it water; some alternate locations."""
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    t = t.select("v", "k", *[F.round(F.col("embedding")[F.col("k") * 3 + i].cast("double") * scale, 3).alias(c) for i, c in enumerate("xyz")])
    at = F.col("v") % 250
    res = F.floor(at / 8).cast("int")
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    return t.select(
        F.concat(F.lit("s"), (F.floor(F.col("v") / 250) * 8 + F.col("k")).cast("string")).alias("structure_id"),
        at.cast("int").alias("atom_idx"),
        F.when(res < 12, "A").when(res < 22, "B").otherwise("C").alias("chain_id"),
        res.alias("res_id"),
        F.when(res % 10 == 9, "LIG").when(res % 10 == 8, "HOH").otherwise(pick(RESIDUES, res % 20)).alias("res_name"),
        pick(NAMES, at % 8).alias("atom_name"),
        pick(ELEMENTS, at % 8).alias("element"),
        (res % 10 == 9).alias("hetero"),
        F.when(at % 50 == 0, "A").when(at % 50 == 1, "B").otherwise("").alias("altloc_id"),
        "x", "y", "z",
    )


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
ATOMS_SQL = f"""base AS (
  SELECT vec_id // 250 * 8 + k AS number, CAST(vec_id % 250 AS INTEGER) AS atom_idx, CAST((vec_id % 250) // 8 AS INTEGER) AS res_id,
    round(CAST(embedding[3 * k + 1] AS DOUBLE) * 100, 3) AS x, round(CAST(embedding[3 * k + 2] AS DOUBLE) * 100, 3) AS y, round(CAST(embedding[3 * k + 3] AS DOUBLE) * 100, 3) AS z FROM embeddings, range(8) t(k)),
atoms AS (
  SELECT 's' || CAST(number AS VARCHAR) AS structure_id, atom_idx, CASE WHEN res_id < 12 THEN 'A' WHEN res_id < 22 THEN 'B' ELSE 'C' END AS chain_id, res_id,
    CASE WHEN res_id % 10 = 9 THEN 'LIG' WHEN res_id % 10 = 8 THEN 'HOH' ELSE {_LIST(RESIDUES)}[res_id % 20 + 1] END AS res_name,
    {_LIST(NAMES)}[atom_idx % 8 + 1] AS atom_name, {_LIST(ELEMENTS)}[atom_idx % 8 + 1] AS element, res_id % 10 = 9 AS hetero,
    CASE WHEN atom_idx % 50 = 0 THEN 'A' WHEN atom_idx % 50 = 1 THEN 'B' ELSE '' END AS altloc_id, x, y, z FROM base),
pairs AS (
  SELECT a.structure_id, a.atom_idx AS a, b.atom_idx AS b, a.chain_id AS a_chain, b.chain_id AS b_chain, a.res_id AS a_res, b.res_id AS b_res, a.res_name AS a_name, b.res_name AS b_name,
    sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id)"""
W = f"WITH {ATOMS_SQL}"


@reg.add("op_2_2_10_structure_accessors", f"{W} SELECT structure_id, count(*) AS n_atoms, string_agg(DISTINCT chain_id, '' ORDER BY chain_id) AS chains, string_agg(DISTINCT altloc_id, '' ORDER BY altloc_id) AS altlocs FROM atoms GROUP BY 1")
def _(spark, d):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "")
    return atoms(spark, d).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"), joined("chain_id").alias("chains"), joined("altloc_id").alias("altlocs"))


@reg.add("op_2_2_11_chain_structure_check", f"{W} SELECT structure_id, count(DISTINCT chain_id) = 1 AND count(DISTINCT altloc_id) FILTER (altloc_id <> '') <= 1 AS ok FROM atoms GROUP BY 1")
def _(spark, d):
    one = (F.count_distinct("chain_id") == 1) & (F.count_distinct(F.when(F.col("altloc_id") != "", F.col("altloc_id"))) <= 1)
    return atoms(spark, d).groupBy("structure_id").agg(one.alias("ok"))


_CODES = "CASE res_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AMINO.items()) + " ELSE 'X' END"


@reg.add("op_2_1_17_structure_sequence", f"{W} SELECT structure_id, chain_id, string_agg(code, '' ORDER BY res_id) AS seq1 FROM (SELECT DISTINCT structure_id, chain_id, res_id, {_CODES} AS code FROM atoms WHERE res_name <> 'HOH') GROUP BY 1, 2")
def _(spark, d):
    first = atoms(spark, d).where("res_name <> 'HOH'").groupBy("structure_id", "chain_id", F.col("res_id").alias("i")).agg(F.min_by("res_name", "atom_idx").alias("name"))
    first = first.withColumn("code", R.residue_letters(F.col("name"), AMINO)).withColumn("obj", F.struct("structure_id", "chain_id"))
    return R.collapse_sequence(first, "obj", "code").select("obj.structure_id", "obj.chain_id", "seq1")


@reg.add("op_2_1_18_residue_dictionary", "SELECT unnest(" + _LIST(sorted(AMINO)) + ") AS res_name, unnest(" + _LIST([AMINO[k] for k in sorted(AMINO)]) + ") AS code")
def _(spark, d):
    return spark.createDataFrame(sorted(AMINO.items()), "res_name string, code string")


@reg.add("op_2_3_14_atom_selection", f"{W} SELECT structure_id, atom_idx FROM atoms WHERE (res_id IN (2, 5) AND atom_name IN ('CA', 'CB')) OR res_id = 7")
def _(spark, d):
    wanted = spark.createDataFrame([(2, "CA"), (2, "CB"), (5, "CA"), (5, "CB"), (7, None)], "res_id int, atom_name string")
    return A.select_atoms(atoms(spark, d), wanted).select("structure_id", "atom_idx")


@reg.add("op_2_3_15_extended_selection", f"{W} SELECT structure_id, atom_idx FROM atoms WHERE res_id IN (1, 3) AND element <> 'S' AND atom_name IN ('CA', 'CE', 'N')")
def _(spark, d):
    rows = A.select_atoms(atoms(spark, d).where("element <> 'S'"), spark.createDataFrame([(r, n) for r in (1, 3) for n in ("CA", "CE", "N")], "res_id int, atom_name string"))
    return rows.select("structure_id", "atom_idx")


@reg.add(
    "op_2_3_16_common_atoms",
    f"""{W}, r AS (SELECT *, dense_rank() OVER (PARTITION BY structure_id ORDER BY chain_id, res_id) AS ord FROM atoms WHERE altloc_id <> 'B'),
q AS (SELECT *, dense_rank() OVER (PARTITION BY structure_id ORDER BY chain_id, res_id) AS ord FROM atoms WHERE altloc_id <> 'A' AND res_id > 0)
SELECT r.structure_id, r.ord, r.atom_idx AS a_idx, q.atom_idx AS b_idx FROM r JOIN q ON r.structure_id = q.structure_id AND r.ord = q.ord AND r.atom_name = q.atom_name
WHERE r.res_name = q.res_name OR r.atom_name IN ('N', 'CA', 'C', 'CB')""",
)
def _(spark, d):
    rows = atoms(spark, d)
    out = A.common_atoms(rows.where("altloc_id <> 'B'"), rows.where("altloc_id <> 'A' and res_id > 0"), ["structure_id"], allow_mismatch=True)
    return out.withColumn("ord", F.col("ord").cast("long"))


_SOLV = "(res_name = 'HOH' OR (length(res_name) <> 3))"
_POLY = "res_name IN (" + ", ".join(f"'{x}'" for x in AMINO) + ")"


@reg.add("op_2_3_17_polymer_filters", f"{W} SELECT structure_id, atom_idx, {_POLY} AS polymer, NOT {_POLY} AND res_name <> 'HOH' AS ligand FROM atoms")
def _(spark, d):
    polymer = A.polymer_kind(F.col("res_name")).isNotNull()
    return atoms(spark, d).select("structure_id", "atom_idx", polymer.alias("polymer"), (~polymer & ~A.is_solvent(F.col("res_name"))).alias("ligand"))


@reg.add("op_2_3_18_solvent_filter", f"{W} SELECT structure_id, atom_idx FROM atoms WHERE {_SOLV}")
def _(spark, d):
    return atoms(spark, d).where(A.is_solvent(F.col("res_name"))).select("structure_id", "atom_idx")


@reg.add("op_2_3_19_residue_and_altloc_masks", f"{W} SELECT structure_id, atom_idx, CAST(res_id + 1 AS BIGINT) AS run, altloc_id IN ('', 'A') AS in_a FROM atoms")
def _(spark, d):
    rows = A.residue_runs(atoms(spark, d))
    return rows.select("structure_id", "atom_idx", "run", F.col("altloc_id").isin("", "A").alias("in_a"))


_DRY = "a_name <> 'HOH' AND b_name <> 'HOH'"
_EDGES = f"edges AS (SELECT * FROM pairs WHERE a_chain = 'A' AND b_chain IN ('B', 'C') AND {_DRY} AND dist <= 12.0)"


def _edges(spark, d):
    return I.contacts(atoms(spark, d), "A_BC", 12.0)


@reg.add("op_2_4_14_contact_join", f"{W}, {_EDGES} SELECT structure_id, a, b, round(dist, 6) AS dist FROM edges")
def _(spark, d):
    return _edges(spark, d).select("structure_id", "a", "b", F.round("dist", 6).alias("dist"))


@reg.add(
    "op_2_4_15_nearest_partner",
    f"""{W}, near AS (SELECT a.structure_id, a.atom_idx AS a, b.atom_idx AS b, sqrt((CAST(round(CAST(a.x AS DECIMAL(18, 3)), 2) AS DOUBLE) - CAST(round(CAST(b.x AS DECIMAL(18, 3)), 2) AS DOUBLE)) ** 2 + (CAST(round(CAST(a.y AS DECIMAL(18, 3)), 2) AS DOUBLE) - CAST(round(CAST(b.y AS DECIMAL(18, 3)), 2) AS DOUBLE)) ** 2 + (CAST(round(CAST(a.z AS DECIMAL(18, 3)), 2) AS DOUBLE) - CAST(round(CAST(b.z AS DECIMAL(18, 3)), 2) AS DOUBLE)) ** 2) AS dist
  FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND NOT a.hetero AND b.hetero)
SELECT structure_id, a, arg_min(b, (dist, b)) AS b, round(min(dist), 6) AS dist FROM near WHERE dist < 15.0 GROUP BY 1, 2""",
)
def _(spark, d):
    return A.contacts_within(atoms(spark, d), F.col("hetero"), 15.0).withColumn("dist", F.round("dist", 6))


@reg.add("op_2_4_16_contacts_variable", f"{W} SELECT structure_id, string_agg(CAST(b_res AS VARCHAR), ',' ORDER BY b_res) AS contacts FROM (SELECT DISTINCT structure_id, b_res FROM pairs WHERE a_res = 4 AND b_res <> 4 AND dist <= 14.0) GROUP BY 1")
def _(spark, d):
    return A.residue_contacts(atoms(spark, d), 4, 14.0)


_BOND = """SELECT p.structure_id, p.a, p.b FROM pairs p JOIN atoms u ON u.structure_id = p.structure_id AND u.atom_idx = p.a JOIN atoms w ON w.structure_id = p.structure_id AND w.atom_idx = p.b
JOIN (VALUES {}) AS l(pair, lo, hi) ON l.pair = least(u.element, w.element) || '-' || greatest(u.element, w.element)
WHERE p.a < p.b AND p.dist > l.lo AND p.dist < l.hi AND (u.altloc_id = w.altloc_id OR u.altloc_id = '' OR w.altloc_id = '')"""


def _bond_sql():
    from strandworks.functions.tables import BONDS

    return _BOND.format(", ".join(f"('{k}', {a}, {b})" for k, (a, b) in BONDS.items() if k != "NC-NC"))


@reg.add("op_2_4_17_bond_graph", f"{W.replace('* 100', '* 20')} {_bond_sql()}")
def _(spark, d):
    """Covalent bonds, on coordinates scaled so that some atoms are that close."""
    return A.covalent_bonds(atoms(spark, d, 20)).select("structure_id", "a", "b")


@reg.add("op_2_5_4_distance_aggregate", f"{W} SELECT structure_id, round(min(dist), 6) AS lo, round(max(dist), 6) AS hi, round(avg(dist), 6) AS mean, round(median(dist), 6) AS med FROM pairs WHERE a_res = 3 AND b_res = 9 GROUP BY 1")
def _(spark, d):
    out = A.agg_dist(atoms(spark, d), 3, 9)
    return out.select("structure_id", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "med")])


_LIGATOMS = "ligatoms AS (SELECT p.structure_id, b_chain || '_' || b_res AS lig, a, a_res, min(dist) AS dist FROM pairs p WHERE b_name = 'LIG' AND a_name NOT IN ('LIG', 'HOH') GROUP BY ALL)"


def is_lig():
    return F.col("res_name") == "LIG"


def is_pol():
    return ~F.col("res_name").isin("LIG", "HOH")


def _ligand_atoms(spark, d, cutoff=15.0):
    """Each polymer atom with each ligand closer than the cutoff: the least distance."""
    return L.ligand_contacts(atoms(spark, d), is_lig(), is_pol(), cutoff).where(F.col("dist") < cutoff)


def _near_ligands(spark, d):
    """Polymer atoms and residues of the structures that have a ligand."""
    rows = atoms(spark, d)
    return rows.where(is_pol()).join(rows.where(is_lig()).select("structure_id").distinct(), "structure_id", "left_semi")


def _ligands(spark, d):
    """Ligands of the structures that have polymer atoms."""
    rows = atoms(spark, d)
    named = rows.where(is_lig()).select("structure_id", F.concat_ws("_", "chain_id", "res_id").alias("lig")).distinct()
    return named.join(rows.where(is_pol()).select("structure_id").distinct(), "structure_id", "left_semi")


@reg.add("op_2_5_6_ligand_contact_count", f"{W}, {_LIGATOMS} SELECT structure_id, a_res, count(*) FILTER (dist < 15.0) AS n FROM ligatoms GROUP BY 1, 2")
def _(spark, d):
    every = _near_ligands(spark, d).select("structure_id", F.col("res_id").alias("a_res")).distinct()
    n = _ligand_atoms(spark, d).groupBy("structure_id", "a_res").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["structure_id", "a_res"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@reg.add("op_2_5_7_ligand_names", f"{W}, {_LIGATOMS} SELECT structure_id, a_res, string_agg(DISTINCT lig, ',' ORDER BY lig) AS names FROM ligatoms WHERE dist < 15.0 GROUP BY 1, 2")
def _(spark, d):
    return _ligand_atoms(spark, d).groupBy("structure_id", "a_res").agg(F.array_join(F.array_sort(F.collect_set("lig")), ",").alias("names"))


@reg.add("op_2_5_8_ligand_distance", f"{W}, {_LIGATOMS}, x AS (SELECT structure_id, a_res, a, min(dist) AS m FROM ligatoms GROUP BY ALL), r AS (SELECT structure_id, a_res, round(max(m), 6) AS dist FROM x GROUP BY 1, 2) SELECT u.structure_id, u.res_id AS a_res, coalesce(dist, -1.0) AS dist FROM (SELECT DISTINCT structure_id, res_id FROM atoms) u LEFT JOIN r ON r.structure_id = u.structure_id AND r.a_res = u.res_id")
def _(spark, d):
    rows = atoms(spark, d)
    near = L.nearest(rows.where(is_pol()), rows.where(is_lig())).join(rows.select("structure_id", F.col("atom_idx").alias("a"), F.col("res_id").alias("a_res")), ["structure_id", "a"])
    per = near.groupBy("structure_id", "a_res").agg(F.round(F.max("dist"), 6).alias("dist"))
    every = rows.select("structure_id", F.col("res_id").alias("a_res")).distinct()
    return every.join(per, ["structure_id", "a_res"], "left").withColumn("dist", F.coalesce("dist", F.lit(-1.0)))


@reg.add("op_2_5_9_ligand_centric_distance", f"{W}, {_LIGATOMS} SELECT structure_id, lig, round(min(dist), 6) AS dist FROM ligatoms WHERE a_res = 3 GROUP BY 1, 2")
def _(spark, d):
    rows = L.ligand_distances(atoms(spark, d), is_lig(), is_pol() & (F.col("res_id") == 3))
    return rows.groupBy("structure_id", "lig").agg(F.round(F.min("dist"), 6).alias("dist"))


@reg.add("op_2_3_21_ligand_connectivity", f"{W}, {_LIGATOMS} SELECT structure_id, lig, count(*) FILTER (dist < 15.0) >= 5 AND count(DISTINCT a_res) FILTER (dist < 15.0) >= 3 AS connected FROM ligatoms GROUP BY 1, 2")
def _(spark, d):
    near = L.connected(_ligand_atoms(spark, d)).select("structure_id", "lig", "connected")
    return _ligands(spark, d).join(near, ["structure_id", "lig"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


@reg.add("op_2_3_22_pocket_predicate", f"{W}, {_LIGATOMS} SELECT structure_id, lig, count(*) FILTER (a_res IN (1, 2, 3) AND dist < 25.0) >= 2 AND (count(DISTINCT CASE WHEN a_res IN (4, 5, 6) AND dist < 25.0 THEN a_res END) >= 1 OR bool_or(a_res IN (7, 10) AND dist <= 9.5)) AS inside FROM ligatoms GROUP BY 1, 2")
def _(spark, d):
    rows = _ligand_atoms(spark, d, 25.0).select("structure_id", "lig", F.col("a_res").alias("res_id"), "atom_name", F.lit(True).alias("is_contact"), "dist")
    inside = rows.groupBy("structure_id", "lig").agg(pocket("c:1,2,3:any >= 2 & (cs:4,5,6:any >= 1 | da:7,10:any <= 9.5)").alias("inside"))
    return _ligands(spark, d).join(inside, ["structure_id", "lig"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


@reg.add("op_2_2_13_ligand_accessors", f"{W} SELECT structure_id, chain_id, res_id, res_name, count(*) AS n_atoms FROM atoms WHERE hetero GROUP BY ALL")
def _(spark, d):
    return atoms(spark, d).where("hetero").groupBy("structure_id", "chain_id", "res_id", "res_name").agg(F.count(F.lit(1)).alias("n_atoms"))


@reg.add("op_2_6_24_ligand_detection", f"{W}, {_LIGATOMS}, n AS (SELECT structure_id, chain_id || '_' || res_id AS lig, count(*) AS n_atoms FROM atoms WHERE res_name = 'LIG' GROUP BY 1, 2) SELECT n.structure_id, n.lig, n.n_atoms FROM n JOIN ligatoms l ON l.structure_id = n.structure_id AND l.lig = n.lig WHERE dist < 15.0 GROUP BY ALL HAVING n.n_atoms >= 6 AND count(*) >= 5 AND count(DISTINCT a_res) >= 3")
def _(spark, d):
    n = atoms(spark, d).where("res_name = 'LIG'").groupBy("structure_id", F.concat_ws("_", "chain_id", "res_id").alias("lig")).agg(F.count(F.lit(1)).alias("n_atoms"))
    return n.join(L.connected(_ligand_atoms(spark, d)).where("connected"), ["structure_id", "lig"]).where("n_atoms >= 6").select("structure_id", "lig", "n_atoms")


@reg.add(
    "op_2_5_11_interface_counts",
    f"""{W}, {_EDGES}, e AS (SELECT * FROM edges WHERE b_chain = 'B'), p AS (SELECT structure_id, a AS atom, a_chain AS c, a_res AS r FROM e UNION ALL SELECT structure_id, b, b_chain, b_res FROM e)
SELECT structure_id, (SELECT count(*) FROM e WHERE e.structure_id = p.structure_id) AS n_contacts, count(DISTINCT atom) AS n_atoms, count(DISTINCT (c, r)) AS n_residues FROM p GROUP BY 1""",
)
def _(spark, d):
    return I.counts(_edges(spark, d), ["B"])


@reg.add("op_2_5_12_contact_atoms", f"{W}, {_EDGES} SELECT DISTINCT structure_id, atom FROM (SELECT structure_id, a AS atom FROM edges WHERE b_chain = 'C' UNION ALL SELECT structure_id, b FROM edges WHERE b_chain = 'C')")
def _(spark, d):
    return I.ends(I.touching(_edges(spark, d), ["C"])).select("structure_id", "atom").distinct()


@reg.add("op_2_2_14_interface_accessors", f"{W} SELECT structure_id, chain_id = 'A' AS side_a, count(*) AS n FROM atoms GROUP BY 1, 2")
def _(spark, d):
    left, _right = I.parse_partners("A_BC")
    return atoms(spark, d).groupBy("structure_id", F.col("chain_id").isin(left).alias("side_a")).agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_3_23_retain_condition", f"{W}, {_EDGES} SELECT structure_id FROM edges GROUP BY 1 HAVING count(DISTINCT a) >= 3 AND count(DISTINCT a_res) >= 2")
def _(spark, d):
    return _edges(spark, d).groupBy("structure_id").agg((F.count_distinct("a") >= 3).alias("p"), (F.count_distinct("a_res") >= 2).alias("q")).where("p and q").select("structure_id")


_ODD = "CAST(substr(structure_id, 2) AS INTEGER) % 2 = 1"


def _odd():
    return F.substring("structure_id", 2, 99).cast("int") % 2 == 1


@reg.add(
    "op_2_3_24_comparability",
    f"""{W}, b AS (SELECT structure_id, atom_idx, chain_id, CASE WHEN {_ODD} AND atom_idx = 5 THEN 'QQ' ELSE atom_name END AS atom_name FROM atoms WHERE NOT (atom_idx = 249 AND structure_id LIKE '%4'))
SELECT structure_id, bool_and(coalesce(a.atom_name = b.atom_name AND a.chain_id = b.chain_id, false)) AS same FROM atoms a FULL JOIN b USING (structure_id, atom_idx) GROUP BY 1""",
)
def _(spark, d):
    """States with another name in odd structures, an atom less in some, and all moved."""
    rows = atoms(spark, d)
    other = rows.withColumns({"x": F.col("x") + 9, "atom_name": F.when(_odd() & (F.col("atom_idx") == 5), "QQ").otherwise(F.col("atom_name"))})
    return A.comparable(rows, other.where("not (atom_idx = 249 and structure_id like '%4')"))


@reg.add(
    "op_2_6_11_array_compare",
    f"""{W}, b AS (SELECT structure_id, atom_idx, x, y + CASE WHEN {_ODD} AND atom_idx = 5 THEN 0.01 ELSE 0.0001 END AS y, z FROM atoms)
SELECT structure_id, bool_and(abs(a.x - b.x) < 0.001 AND abs(a.y - b.y) < 0.001 AND abs(a.z - b.z) < 0.001) AS same FROM atoms a JOIN b USING (structure_id, atom_idx) GROUP BY 1""",
)
def _(spark, d):
    """Copies moved a little, in odd structures one atom too far."""
    rows = atoms(spark, d)
    return A.compare_atoms(rows, rows.withColumn("y", F.col("y") + F.when(_odd() & (F.col("atom_idx") == 5), 0.01).otherwise(0.0001)))


@reg.add(
    "op_2_5_15_observed_atoms",
    f"{W} SELECT structure_id, res_id, string_agg(DISTINCT atom_name, ',' ORDER BY atom_name) AS extra FROM atoms WHERE res_name = 'GLY' AND atom_name NOT IN ('N', 'CA', 'C', 'O') GROUP BY 1, 2",
)
def _(spark, d):
    """Names that a glycine should not have; the fraction itself is checked in tests."""
    rows = atoms(spark, d).where("res_name = 'GLY'")
    seen = A.observed_fraction(rows).where("observed = 1.0").select("structure_id", "res_id")
    extra = rows.where("atom_name not in ('N', 'CA', 'C', 'O')").groupBy("structure_id", "res_id").agg(F.array_join(F.array_sort(F.collect_set("atom_name")), ",").alias("extra"))
    return extra.join(seen, ["structure_id", "res_id"], "left_semi")


_CANONICAL = ", ".join(f"('{r}', {_LIST([*BACKBONE, *SIDE_CHAIN[r].split()])})" for r in RESIDUES)


@reg.add(
    "op_2_5_15_observed_fractions",
    f"""{W}, have AS (SELECT structure_id, chain_id, res_id, res_name, list(DISTINCT atom_name) AS names FROM atoms WHERE element <> 'H' AND atom_name <> 'OXT' GROUP BY 1, 2, 3, 4),
want AS (SELECT * FROM (VALUES {_CANONICAL}) t(res_name, wanted)), m AS (SELECT have.*, wanted, list_sort(list_filter(wanted, lambda x: NOT list_contains(names, x))) AS gone FROM have LEFT JOIN want USING (res_name))
SELECT structure_id, chain_id, res_id, array_to_string(gone, ',') AS missing, (len(wanted) - len(gone)) / CAST(len(wanted) AS DOUBLE) AS observed FROM m""",
)
def _(spark, d):
    """Missing names and the observed fraction of all residues, null for unknown ones."""
    return A.observed_fraction(atoms(spark, d))


@reg.add("op_2_5_16_residue_count", f"{W} SELECT structure_id, count(DISTINCT res_id) AS n_residues, count(DISTINCT chain_id) AS n_chains FROM atoms GROUP BY 1")
def _(spark, d):
    return A.residue_runs(atoms(spark, d)).groupBy("structure_id").agg(F.max("run").alias("n_residues"), F.count_distinct("chain_id").alias("n_chains"))


_NUC = ", ".join(f"'{x}'" for x in NUCLEOTIDES)
_MIXED = f"mixed AS (SELECT structure_id, atom_idx, chain_id, res_id, CASE WHEN {_ODD} AND chain_id <> 'A' AND res_name NOT IN ('LIG', 'HOH') THEN {_LIST(NUCLEOTIDES)}[res_id % {len(NUCLEOTIDES)} + 1] ELSE res_name END AS res_name FROM atoms)"


@reg.add(
    "op_2_5_17_polymer_type",
    f"""{W}, {_MIXED}, k AS (SELECT *, CASE WHEN {_POLY} THEN 'p' WHEN res_name IN ({_NUC}) THEN 'n' END AS kind FROM mixed),
per AS (SELECT structure_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT res_id) >= 2)
SELECT s.structure_id, coalesce(arg_max(per.kind, (per.n, per.kind)), 'x') AS kind FROM (SELECT DISTINCT structure_id FROM atoms) s LEFT JOIN per ON per.structure_id = s.structure_id GROUP BY 1""",
)
def _(spark, d):
    """Odd structures are nucleic acids but for chain A."""
    rows = atoms(spark, d)
    name = F.element_at(F.array(*[F.lit(x) for x in NUCLEOTIDES]), F.col("res_id") % len(NUCLEOTIDES) + 1)
    return A.primary_polymer(rows.withColumn("res_name", F.when(_odd() & (F.col("chain_id") != "A") & is_pol(), name).otherwise(F.col("res_name"))))


@reg.add("op_2_5_18_continuity_breaks", f"{W} SELECT structure_id, atom_idx FROM (SELECT *, lag(hetero) OVER (PARTITION BY structure_id ORDER BY atom_idx) AS b FROM atoms) WHERE b IS NOT NULL AND b <> hetero")
def _(spark, d):
    return A.continuity_breaks(atoms(spark, d), F.col("hetero"))


def _dihedral_sql(points: list[tuple[str, int]]) -> str:
    v = lambda a, b, c: f"(p{b}.{c} - p{a}.{c})"
    cross = lambda u, w, c: (lambda i, j: f"({v(*u, i)} * {v(*w, j)} - {v(*u, j)} * {v(*w, i)})")(*{"x": "yz", "y": "zx", "z": "xy"}[c])
    joins = " ".join(f"LEFT JOIN atoms p{k} ON p{k}.structure_id = r.structure_id AND p{k}.chain_id = r.chain_id AND p{k}.res_id = r.res_id + {o} AND p{k}.atom_name = '{n}'" for k, (n, o) in enumerate(points))
    n1 = {c: cross((0, 1), (1, 2), c) for c in "xyz"}
    n2 = {c: cross((1, 2), (2, 3), c) for c in "xyz"}
    lets = ", ".join([*(f"{n1[c]} AS a{c}" for c in "xyz"), *(f"{n2[c]} AS w{c}" for c in "xyz"), *(f"{v(1, 2, c)} AS v{c}" for c in "xyz")])
    return f"""SELECT structure_id, chain_id, res_id, atan2(((ay * wz - az * wy) * vx + (az * wx - ax * wz) * vy + (ax * wy - ay * wx) * vz) / sqrt(vx * vx + vy * vy + vz * vz), ax * wx + ay * wy + az * wz) AS angle
FROM (SELECT r.structure_id, r.chain_id, r.res_id, {lets} FROM (SELECT DISTINCT structure_id, chain_id, res_id FROM atoms) r {joins})"""


_PHI, _PSI, _OMEGA = (_dihedral_sql(p) for p in ([("C", -1), ("N", 0), ("CA", 0), ("C", 0)], [("N", 0), ("CA", 0), ("C", 0), ("N", 1)], [("CA", 0), ("C", 0), ("N", 1), ("CA", 1)]))


@reg.add(
    "op_2_6_13_dihedrals",
    f"{W}, f AS ({_PHI}), s AS ({_PSI}), o AS ({_OMEGA}) SELECT f.structure_id, f.chain_id, f.res_id, round(f.angle, 6) AS phi, round(s.angle, 6) AS psi, round(o.angle, 6) AS omega FROM f JOIN s USING (structure_id, chain_id, res_id) JOIN o USING (structure_id, chain_id, res_id)",
)
def _(spark, d):
    out = A.backbone_dihedrals(atoms(spark, d))
    return out.select("structure_id", "chain_id", "res_id", *[F.round(c, 6).alias(c) for c in ("phi", "psi", "omega")])


@reg.add("op_2_6_10_dihedral_kernel", f"{W}, f AS ({_dihedral_sql([('N', 0), ('CA', 0), ('CB', 0), ('CG', 0)])}) SELECT structure_id, chain_id, res_id, round(angle, 6) AS angle FROM f")
def _(spark, d):
    out = A.first_dihedral(atoms(spark, d), [("N", "CA", "CB", "CG")])
    return out.withColumn("angle", F.round("angle", 6))


@reg.add("op_2_6_14_composite_dihedrals", f"{W}, f AS ({_dihedral_sql([('N', 0), ('CA', 0), ('CB', 0), ('CG', 0)])}), g AS ({_dihedral_sql([('CA', 0), ('CB', 0), ('CG', 0), ('CD', 0)])}) SELECT f.structure_id, f.chain_id, f.res_id, round(f.angle, 6) AS chi1, round(g.angle, 6) AS chi2 FROM f JOIN g USING (structure_id, chain_id, res_id)")
def _(spark, d):
    rows = atoms(spark, d)
    key = ["structure_id", "chain_id", "res_id"]
    one = A.first_dihedral(rows, A.CHI1).withColumn("chi1", F.round("angle", 6)).drop("angle")
    return one.join(A.first_dihedral(rows, A.CHI2).withColumn("chi2", F.round("angle", 6)).drop("angle"), key)


@reg.add("op_2_6_12_distance", f"{W}, o AS (SELECT DISTINCT structure_id FROM atoms), p AS (SELECT structure_id, dist FROM pairs JOIN (SELECT structure_id AS sa, atom_idx AS ia FROM atoms WHERE atom_name = 'CA') ON sa = structure_id AND ia = a JOIN (SELECT structure_id AS sb, atom_idx AS ib FROM atoms WHERE atom_name = 'CB') ON sb = structure_id AND ib = b WHERE a_res = 2 AND b_res = 6) SELECT structure_id, dist IS NOT NULL AS ok, round(dist, 6) AS dist FROM o LEFT JOIN p USING (structure_id)")
def _(spark, d):
    return A.dist_between(atoms(spark, d), 2, 6, "CA", "CB").withColumn("dist", F.round("dist", 6))


@reg.add("op_2_6_18_atom_pick", f"{W} SELECT structure_id, count(*) FILTER (res_id = 2 AND atom_name = 'CA') = 1 AS ok FROM atoms GROUP BY 1")
def _(spark, d):
    rows = atoms(spark, d)
    got = rows.select("structure_id").distinct().join(A.pick(rows, 2, "CA", "p"), "structure_id", "left")
    return got.select("structure_id", (F.coalesce("p_n", F.lit(0)) == 1).alias("ok"))


@reg.add("op_2_6_23_atom_marking", f"{W} SELECT structure_id, atom_idx, CASE WHEN {_SOLV} THEN 2 WHEN {_POLY} THEN 8 ELSE 4 END AS mark FROM atoms")
def _(spark, d):
    """Marks without the covalent bit, which the bond query's geometry decides."""
    return A.mark_atoms(atoms(spark, d)).select("structure_id", "atom_idx", F.col("mark").bitwiseAND(~64).alias("mark"))


@reg.add("op_2_6_23_component_marking")
def _(spark, d):
    """All bits of the marks, from the components of the bond graph."""
    return A.mark_components(atoms(spark, d))


@reg.add("op_2_7_8_residue_boundaries", f"{W} SELECT structure_id, min(atom_idx) AS first_atom, max(atom_idx) AS last_atom FROM atoms GROUP BY structure_id, res_id")
def _(spark, d):
    return A.residue_runs(atoms(spark, d)).groupBy("structure_id", "run").agg(F.min("atom_idx").alias("first_atom"), F.max("atom_idx").alias("last_atom")).drop("run")


@reg.add(
    "op_2_9_10_connected_components",
    f"""WITH RECURSIVE {ATOMS_SQL}, {_EDGES}, ends AS (SELECT structure_id, a AS v, b AS w FROM edges UNION SELECT structure_id, b, a FROM edges),
reach(structure_id, v, r) AS (SELECT structure_id, v, v FROM ends UNION SELECT reach.structure_id, ends.w, reach.r FROM reach JOIN ends ON ends.structure_id = reach.structure_id AND ends.v = reach.v)
SELECT structure_id, v AS atom, min(r) AS component FROM reach GROUP BY 1, 2""",
)
def _(spark, d):
    return I.contact_components(_edges(spark, d))


@reg.add(
    "op_2_9_11_split_interface",
    f"""WITH RECURSIVE {ATOMS_SQL}, {_EDGES}, links AS (SELECT structure_id, a AS v, b AS w FROM edges UNION SELECT structure_id, b, a FROM edges),
reach(structure_id, v, w) AS (SELECT structure_id, v, v FROM links UNION SELECT r.structure_id, r.v, l.w FROM reach r JOIN links l ON l.structure_id = r.structure_id AND l.v = r.w),
part AS (SELECT structure_id, v, min(w) AS component FROM reach GROUP BY 1, 2)
SELECT e.structure_id, a_chain, b_chain, count(DISTINCT component) AS n_components FROM edges e JOIN part p ON p.structure_id = e.structure_id AND p.v = e.a GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return I.split_connected(_edges(spark, d), min_atoms=1, min_res=1)


@reg.add("op_2_9_12_subset_structure", f"{W}, {_LIGATOMS}, k AS (SELECT structure_id, lig FROM ligatoms WHERE dist < 15.0 AND a_res <= 11 GROUP BY 1, 2) SELECT structure_id, atom_idx FROM atoms WHERE (chain_id = 'A' AND res_name <> 'HOH') OR (hetero AND (structure_id, chain_id || '_' || res_id) IN (SELECT (structure_id, lig) FROM k))")
def _(spark, d):
    """Chain A without water, with the ligands that touch it."""
    rows = atoms(spark, d)
    kept = _ligand_atoms(spark, d).where("a_res <= 11").select("structure_id", "lig").distinct()
    named = rows.withColumn("lig", F.concat_ws("_", "chain_id", "res_id")).join(kept.withColumn("k", F.lit(True)), ["structure_id", "lig"], "left")
    return named.where("(chain_id = 'A' and res_name <> 'HOH') or (hetero and k)").select("structure_id", "atom_idx")


@reg.add("op_2_9_13_split_altlocs", f"{W} SELECT structure_id, al AS altloc, count(*) AS n FROM atoms, (VALUES ('A'), ('B')) v(al) WHERE altloc_id = '' OR altloc_id = al GROUP BY 1, 2")
def _(spark, d):
    return A.split_altlocs(atoms(spark, d)).groupBy("structure_id", "altloc").agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_9_14_extract_segment", f"{W} SELECT structure_id, atom_idx FROM atoms WHERE chain_id = 'B' AND res_id BETWEEN 14 AND 18")
def _(spark, d):
    return atoms(spark, d).where((F.col("chain_id") == "B") & F.col("res_id").between(14, 18)).select("structure_id", "atom_idx")


@reg.add("op_2_9_15_remove_solvent", f"{W} SELECT structure_id, atom_idx FROM atoms WHERE NOT {_SOLV}")
def _(spark, d):
    return atoms(spark, d).where(~A.is_solvent(F.col("res_name"))).select("structure_id", "atom_idx")


@reg.add("op_2_9_2_spawn_structure_child", f"{W} SELECT structure_id, structure_id || '|3-8' AS child, atom_idx FROM atoms WHERE res_id BETWEEN 3 AND 8 AND chain_id = 'A'")
def _(spark, d):
    rows = atoms(spark, d).where("chain_id = 'A'").withColumn("i", F.col("res_id"))
    ranges = rows.select("structure_id").distinct().select("structure_id", F.lit(3).alias("from_i"), F.lit(8).alias("to_i"))
    return R.spawn_child(rows, "structure_id", ranges, F.concat("structure_id", F.lit("|3-8"))).select("structure_id", "child", "atom_idx")


def _areas_sql(rows: str, points: int = 100) -> str:
    """Areas of the atoms of a table in SQL: dots on each sphere, those that a sphere
    nearby covers, and the part of the sphere that the others stand for."""
    radius = "CASE element " + " ".join(f"WHEN '{e}' THEN {r + 1.4!r}" for e, r in RADII.items()) + " END"
    ball = f"SELECT structure_id, atom_idx, x, y, z, {radius} AS r FROM {rows}"
    return f"""SELECT a.structure_id, a.atom_idx, 4 * pi() * r * r * (1 - coalesce(hidden, 0) / {points}.0) AS area FROM ({ball}) a LEFT JOIN (
  SELECT structure_id, atom_idx, count(DISTINCT k) AS hidden FROM (
    SELECT a.structure_id, a.atom_idx, a.r, a.x - b.x AS x, a.y - b.y AS y, a.z - b.z AS z, b.r AS br FROM ({ball}) a JOIN ({ball}) b ON a.structure_id = b.structure_id AND a.atom_idx <> b.atom_idx
    WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < (a.r + b.r) ** 2) n,
    (SELECT k, sqrt(1 - z * z) * cos(phi) AS ux, sqrt(1 - z * z) * sin(phi) AS uy, z AS uz FROM (SELECT k, 1 - 2 * k / {points}.0 AS z, k * pi() * (3 - sqrt(5)) AS phi FROM (SELECT unnest(range(0, {points})) + 0.5 AS k)))
  WHERE (x + r * ux) ** 2 + (y + r * uy) ** 2 + (z + r * uz) ** 2 < br * br GROUP BY 1, 2) h ON h.structure_id = a.structure_id AND h.atom_idx = a.atom_idx"""


@reg.add("op_2_5_14_surface_area", f"{W} SELECT structure_id, atom_idx, round(area, 6) AS area FROM ({_areas_sql('atoms')})")
def _(spark, d):
    return A.areas(atoms(spark, d)).withColumn("area", F.round("area", 6))


@reg.add(
    "op_2_5_13_surface_totals",
    f"""{W}, dry AS (SELECT * FROM atoms WHERE res_name <> 'HOH'), one AS (SELECT * FROM dry WHERE chain_id = 'A'),
free AS (SELECT structure_id, sum(area) AS free FROM ({_areas_sql('one')}) GROUP BY 1),
bound AS (SELECT structure_id, sum(area) AS bound FROM ({_areas_sql('dry')}) JOIN (SELECT structure_id, atom_idx FROM one) USING (structure_id, atom_idx) GROUP BY 1)
SELECT structure_id, round(free, 4) AS free, round(bound, 4) AS bound, round(free - bound, 4) AS buried FROM free JOIN bound USING (structure_id)""",
)
def _(spark, d):
    """Free, complex and buried areas of chain A against the rest."""
    rows = atoms(spark, d).where("res_name <> 'HOH'")
    total = lambda df, n: A.areas(df).join(df.where("chain_id = 'A'").select("structure_id", "atom_idx"), ["structure_id", "atom_idx"], "left_semi").groupBy("structure_id").agg(F.sum("area").alias(n))
    both = total(rows.where("chain_id = 'A'"), "free").join(total(rows, "bound"), "structure_id")
    return both.select("structure_id", F.round("free", 4).alias("free"), F.round("bound", 4).alias("bound"), F.round(F.col("free") - F.col("bound"), 4).alias("buried"))


def _structure_pairs(spark, d):
    """Each structure with the next one."""
    ids = atoms(spark, d).select(F.substring("structure_id", 2, 99).cast("int").alias("n")).distinct()
    nxt = ids.select((F.col("n") - 1).alias("n"))
    return ids.join(nxt, "n").select(F.concat(F.lit("s"), "n").alias("fixed_id"), F.concat(F.lit("s"), F.col("n") + 1).alias("mobile_id"))


@reg.add("op_2_4_13_pairwise_superposition")
def _(spark, d):
    ca = atoms(spark, d).where("atom_name = 'CA'")
    return A.superpose_strict(_structure_pairs(spark, d), ca, ca).withColumn("rmsd", F.round("rmsd", 6))


def _grown(rows, factor=1.1):
    """A copy grown about its centre, turned and moved: the deviation that is left is
    the growth times the radius of gyration."""
    return rows.withColumns({"x": 3 - factor * F.col("y"), "y": factor * F.col("x") - 5, "z": factor * F.col("z") + 1, "structure_id": F.concat("structure_id", F.lit("t"))})


_GYRATION = "sqrt(avg(x * x + y * y + z * z) - avg(x) ** 2 - avg(y) ** 2 - avg(z) ** 2)"


@reg.add("op_2_6_19_superposition", f"{W} SELECT structure_id AS fixed_id, structure_id || 't' AS mobile_id, CAST(count(*) AS INTEGER) AS n, round(0.1 * {_GYRATION}, 5) AS rmsd FROM atoms WHERE atom_name = 'CA' GROUP BY 1")
def _(spark, d):
    ca = atoms(spark, d).where("atom_name = 'CA'")
    pairs = ca.select(F.col("structure_id").alias("fixed_id"), F.concat("structure_id", F.lit("t")).alias("mobile_id")).distinct()
    return A.superpose_strict(pairs, ca, _grown(ca)).select("fixed_id", "mobile_id", "n", F.round("rmsd", 5).alias("rmsd"))


@reg.add(
    "op_2_6_22_interface_comparator",
    f"""{W}, {_EDGES}, m AS (SELECT * FROM edges WHERE dist <= 11.0), p AS (SELECT structure_id, a AS atom FROM edges UNION SELECT structure_id, b FROM edges), q AS (SELECT structure_id, a AS atom FROM m UNION SELECT structure_id, b FROM m),
f AS (SELECT p.structure_id, count(q.atom) / count(*) AS fnat FROM p LEFT JOIN q ON p.structure_id = q.structure_id AND p.atom = q.atom GROUP BY 1)
SELECT structure_id, round(fnat, 6) AS fnat, round((fnat + 1 / (1 + (2.0 / 8.5) ** 2) + 1 / (1 + (3.0 / 1.5) ** 2)) / 3, 6) AS dockq FROM f""",
)
def _(spark, d):
    edges = _edges(spark, d)
    out = I.fnat(edges, edges.where("dist <= 11.0"))
    return out.select("structure_id", F.round("fnat", 6).alias("fnat"), F.round(I.dockq(F.col("fnat"), F.lit(2.0), F.lit(3.0)), 6).alias("dockq"))


def _mobile(rows):
    """A second state: the first one turned and moved as a whole, and its chains B and
    C turned a little on their own."""
    bent = F.col("chain_id") != "A"
    x = F.when(bent, F.col("x") * 0.96 - F.col("y") * 0.28 + 1).otherwise(F.col("x"))
    y = F.when(bent, F.col("x") * 0.28 + F.col("y") * 0.96 - 2).otherwise(F.col("y"))
    return rows.withColumns({"x": 3 - y, "y": x - 5, "z": F.col("z") + 1})


@reg.add("op_2_6_22_interface_states")
def _(spark, d):
    """Both states superposed by structure: the deviations, fnat and the score from them."""
    rows = atoms(spark, d)
    out = I.compare_states(rows, _mobile(rows), "A_BC", 12.0)
    return out.select("structure_id", "n_superposed", *[F.round(c, 6).alias(c) for c in ("superposed_rmsd", "irmsd", "lrmsd", "fnat", "dockq")], "error")


@reg.add("op_2_7_7_adjacent_comparison", f"{W}, r AS (SELECT structure_id, res_id, lead(res_id) OVER (PARTITION BY structure_id ORDER BY res_id) AS n FROM (SELECT DISTINCT structure_id, res_id FROM atoms WHERE NOT hetero)) SELECT structure_id, coalesce(bool_and(n - res_id = 1), true) AS consecutive FROM r GROUP BY 1")
def _(spark, d):
    from pyspark.sql.window import Window

    rows = atoms(spark, d).where("not hetero").select("structure_id", "res_id").distinct()
    nxt = F.lead("res_id").over(Window.partitionBy("structure_id").orderBy("res_id"))
    return rows.withColumn("n", nxt).groupBy("structure_id").agg(F.coalesce(F.bool_and(F.col("n") - F.col("res_id") == 1), F.lit(True)).alias("consecutive"))


STRUCTURE_IDS = [
    "Dist(1,3,CA,CB)", "Dist(2,6,com=True)", "Dist(1,300,CA,CA)", "AggDist(3,9)", "AggDist(3,9,median)", "AggDist(3,900)", "Phi(3)", "Psi(3)", "Omega(3)", "Phi(0)",
    "PseudoDihedral(1,2,3,4)", "Dihedral(1,1,2,2,N,CA,N,CA)", "Chi1(5)", "Chi2(5)", "Contacts(4,14.0)", "Contacts(400)", "ClosestLigandContactsCount(3)",
    "ClosestLigandNames(3)", "ClosestLigandDist(3)", "ClosestLigandDist(3,CA,agg_lig=max)", "ClosestLigandDist(3,agg_res=max)", "LigandDist(3)", "LigandDist(3,CA,CB,max)",
]


def _one_dihedral(points: list[tuple[int, str]]) -> str:
    """The angle of four named atoms in SQL, by the same text as that of residues."""
    base = points[0][0]
    return f"SELECT structure_id, angle AS v FROM ({_dihedral_sql([(n, r - base) for r, n in points])}) WHERE res_id = {base}"


def _variables_sql() -> str:
    named = lambda p, q, x, y: f"SELECT p.structure_id, dist AS v FROM pairs p JOIN atoms i ON i.structure_id = p.structure_id AND i.atom_idx = a AND i.atom_name = '{x}' JOIN atoms j ON j.structure_id = p.structure_id AND j.atom_idx = b AND j.atom_name = '{y}' WHERE a_res = {p} AND b_res = {q}"
    centre = lambda p: f"(SELECT structure_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms WHERE res_id = {p} GROUP BY 1)"
    lig = "SELECT p.structure_id, b_chain || '_' || b_res AS lig, a, i.atom_name AS an, j.atom_name AS bn, dist FROM pairs p JOIN atoms i ON i.structure_id = p.structure_id AND i.atom_idx = a JOIN atoms j ON j.structure_id = p.structure_id AND j.atom_idx = b WHERE a_res = 3 AND b_name = 'LIG'"
    near = f"SELECT structure_id, lig, a, an, min(dist) AS m FROM ({lig}) GROUP BY ALL"
    numbers = {
        "Dist(1,3,CA,CB)": named(1, 3, "CA", "CB"),
        "Dist(2,6,com=True)": f"SELECT structure_id, sqrt((u.x - w.x) ** 2 + (u.y - w.y) ** 2 + (u.z - w.z) ** 2) AS v FROM {centre(2)} u JOIN {centre(6)} w USING (structure_id)",
        "Dist(1,300,CA,CA)": named(1, 300, "CA", "CA"),
        "AggDist(3,9)": "SELECT structure_id, min(dist) AS v FROM pairs WHERE a_res = 3 AND b_res = 9 GROUP BY 1",
        "AggDist(3,9,median)": "SELECT structure_id, median(dist) AS v FROM pairs WHERE a_res = 3 AND b_res = 9 GROUP BY 1",
        "AggDist(3,900)": "SELECT structure_id, min(dist) AS v FROM pairs WHERE a_res = 3 AND b_res = 900 GROUP BY 1",
        "Phi(3)": f"SELECT structure_id, angle AS v FROM ({_PHI}) WHERE res_id = 3",
        "Psi(3)": f"SELECT structure_id, angle AS v FROM ({_PSI}) WHERE res_id = 3",
        "Omega(3)": f"SELECT structure_id, angle AS v FROM ({_OMEGA}) WHERE res_id = 3",
        "Phi(0)": f"SELECT structure_id, angle AS v FROM ({_PHI}) WHERE res_id = 0",
        "PseudoDihedral(1,2,3,4)": _one_dihedral([(1, "CA"), (2, "CA"), (3, "CA"), (4, "CA")]),
        "Dihedral(1,1,2,2,N,CA,N,CA)": _one_dihedral([(1, "N"), (1, "CA"), (2, "N"), (2, "CA")]),
        "Chi1(5)": _one_dihedral([(5, "N"), (5, "CA"), (5, "CB"), (5, "CG")]),
        "Chi2(5)": _one_dihedral([(5, "CA"), (5, "CB"), (5, "CG"), (5, "CD")]),
        "ClosestLigandContactsCount(3)": f"SELECT s.structure_id, count(n.a) AS v FROM (SELECT DISTINCT structure_id FROM atoms) s LEFT JOIN (SELECT * FROM ({near}) WHERE m <= 5.0) n USING (structure_id) GROUP BY 1",
        "ClosestLigandDist(3)": f"SELECT structure_id, min(m) AS v FROM ({near}) GROUP BY 1",
        "ClosestLigandDist(3,CA,agg_lig=max)": f"SELECT structure_id, max(m) AS v FROM ({near}) WHERE an = 'CA' GROUP BY 1",
        "ClosestLigandDist(3,agg_res=max)": f"SELECT structure_id, max(m) AS v FROM (SELECT structure_id, a, min(m) AS m FROM ({near}) GROUP BY 1, 2) GROUP BY 1",
    }
    texts = {
        "Contacts(4,14.0)": "SELECT structure_id, string_agg(CAST(b_res AS VARCHAR), ',' ORDER BY b_res) AS t FROM (SELECT DISTINCT structure_id, b_res FROM pairs WHERE a_res = 4 AND b_res <> 4 AND dist <= 14.0) GROUP BY 1",
        "Contacts(400)": "SELECT structure_id, '' AS t FROM atoms WHERE res_id = 400",
        "ClosestLigandNames(3)": f"SELECT s.structure_id, coalesce(string_agg(CASE WHEN l.lig IS NOT NULL THEN 'LIG' END, ','), '') AS t FROM (SELECT DISTINCT structure_id FROM atoms) s LEFT JOIN (SELECT DISTINCT structure_id, lig FROM ({near}) WHERE m <= 5.0) l USING (structure_id) GROUP BY 1",
    }
    ids = ["'" + i + "'" for i in [*numbers, *texts]]
    rows = [f"SELECT structure_id, '{i}' AS i, CAST(v AS DOUBLE) AS v, NULL AS t FROM ({q})" for i, q in numbers.items()] + [f"SELECT structure_id, '{i}', NULL, t FROM ({q})" for i, q in texts.items()]
    ligands = {"LigandDist(3)": f"SELECT structure_id, lig, min(dist) AS v FROM ({lig}) GROUP BY 1, 2", "LigandDist(3,CA,CB,max)": f"SELECT structure_id, lig, max(dist) AS v FROM ({lig}) WHERE an = 'CA' AND bn = 'CB' GROUP BY 1, 2"}
    own = " UNION ALL ".join(f"SELECT structure_id || ':' || lig AS object_id, '{i}' AS variable_id, true AS ok, round(v, 6) AS number, NULL AS \"text\" FROM ({q})" for i, q in ligands.items())
    return f"""{W}, found AS ({" UNION ALL ".join(rows)})
SELECT s.structure_id AS object_id, k.i AS variable_id, coalesce(found.v, CASE WHEN t IS NOT NULL THEN 1 END) IS NOT NULL AS ok, round(v, 6) AS number, t AS "text"
FROM (SELECT DISTINCT structure_id FROM atoms) s CROSS JOIN (SELECT unnest([{", ".join(ids)}]) AS i) k LEFT JOIN found ON found.structure_id = s.structure_id AND found.i = k.i
UNION ALL {own}"""


def _structure_results(spark, d):
    return SV.calculate(atoms(spark, d), STRUCTURE_IDS, is_lig())


@reg.add("op_2_11_4_structure_variables", _variables_sql())
def _(spark, d):
    """Every kind of structure and ligand variable, failures among them."""
    rows = _structure_results(spark, d)
    number = F.when(F.col("rtype") != "str", F.round(F.col("value").cast("double"), 6))
    return rows.select("object_id", "variable_id", "ok", number.alias("number"), F.when(F.col("rtype") == "str", F.col("value")).alias("text"))


@reg.add(
    "op_2_11_4_surface_variables",
    f"""{W}, area AS ({_areas_sql('atoms')}), s AS (SELECT DISTINCT structure_id FROM atoms), v AS (SELECT structure_id, atom_name, area FROM area JOIN atoms USING (structure_id, atom_idx) WHERE res_id = 3)
SELECT structure_id AS object_id, 'SASA(3)' AS variable_id, true AS ok, round(sum(area), 4) AS value, NULL AS error, 'float' AS rtype FROM v GROUP BY 1
UNION ALL SELECT structure_id, 'SASA(3,CA)', true, round(sum(area), 4), NULL, 'float' FROM v WHERE atom_name = 'CA' GROUP BY 1
UNION ALL SELECT structure_id, 'SASA(900)', false, NULL, 'empty selection', 'float' FROM s""",
)
def _(spark, d):
    """Areas of a residue, of one of its atoms, and of a residue that is not there."""
    return SV.calculate(atoms(spark, d), ["SASA(3)", "SASA(3,CA)", "SASA(900)"], is_lig()).withColumn("value", F.round(F.col("value").cast("double"), 4))


@reg.add(
    "op_2_11_7_structures_wide",
    f"WITH long AS ({_variables_sql()}) SELECT object_id, " + ", ".join(f"max(number) FILTER (variable_id = '{i}') AS v{k}" for k, i in enumerate(("Phi(3)", "Psi(3)", "Chi1(5)", "AggDist(3,9)"))) + " FROM long WHERE object_id NOT LIKE '%:%' GROUP BY 1",
)
def _(spark, d):
    """Structure variables as one row per structure."""
    from strandworks.operators.variables import wide

    ids = ["Phi(3)", "Psi(3)", "Chi1(5)", "AggDist(3,9)"]
    out = wide(SV.calculate(atoms(spark, d), ids, is_lig()), ids)
    return out.select("object_id", *[F.round(F.col(f"`{i}`").cast("double"), 6).alias(f"v{k}") for k, i in enumerate(ids)])


def _pruned(rows):
    """Copies without two atoms, and in odd structures with another residue 4."""
    name = F.when(_odd() & (F.col("res_id") == 4), "GLY").otherwise(F.col("res_name"))
    return _grown(rows.where("atom_idx not in (9, 17)").withColumn("res_name", name))


@reg.add(
    "op_2_6_21_strict_pairs",
    f"""{W}, f AS (SELECT * FROM atoms WHERE atom_name IN ('CA', 'CB') AND chain_id = 'A') SELECT structure_id AS fixed_id, structure_id || 't' AS mobile_id, CAST(count(*) FILTER (atom_idx NOT IN (9, 17)) AS INTEGER) AS n, CAST(NULL AS DOUBLE) AS rmsd, 'selections differ' AS error FROM f GROUP BY 1
UNION ALL SELECT structure_id, structure_id || 'tt', CAST(count(*) AS INTEGER), round(0.21 * {_GYRATION}, 5), NULL FROM f GROUP BY 1""",
)
def _(spark, d):
    """Equal selections are superposed, unequal ones set aside."""
    rows = atoms(spark, d).where("atom_name in ('CA', 'CB') and chain_id = 'A'")
    whole = _grown(_grown(rows))
    mobile = _pruned(rows).unionByName(whole)
    pair = lambda s: rows.select(F.col("structure_id").alias("fixed_id"), F.concat("structure_id", F.lit(s)).alias("mobile_id")).distinct()
    out = A.superpose_strict(pair("t").unionByName(pair("tt")), rows, mobile)
    return out.select("fixed_id", "mobile_id", "n", F.round("rmsd", 5).alias("rmsd"), "error")


@reg.add("op_2_6_21_flexible_pairs")
def _(spark, d):
    """Sequences aligned, common atoms superposed, and the deviation of the ligands
    under the same motion (no SQL: alignment and superposition)."""
    rows = atoms(spark, d).where("altloc_id in ('', 'A')")
    other = _pruned(rows)
    pairs = rows.select(F.col("structure_id").alias("fixed_id"), F.concat("structure_id", F.lit("t")).alias("mobile_id")).distinct()
    out = A.superpose_flexible(pairs, rows.where(is_pol() & (F.col("chain_id") == "A")), other.where(is_pol() & (F.col("chain_id") == "A")), rows.where(is_lig()), other.where(is_lig()))
    return out.select("fixed_id", "mobile_id", "n", F.round("rmsd", 5).alias("rmsd"), F.round("distance", 5).alias("distance"), "error")


@reg.add("op_2_6_25_structure_subtypes")
def _(spark, d):
    """Marks with each kind of polymer taken for primary (no SQL: components)."""
    rows, out = atoms(spark, d), None
    for name in A.SUBTYPES:
        part = A.mark_components(rows, subtype=name).select("structure_id", "atom_idx", "mark", F.lit(name).alias("subtype"))
        out = part if out is None else out.unionByName(part)
    return out
