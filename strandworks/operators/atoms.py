"""Structures as one row per atom:

``structure_id, atom_idx, chain_id, res_id, res_name, atom_name, element, hetero,
altloc_id, x, y, z``.  All joins are keyed by the structure, so structures spread
over tasks and none meets another.  Radius joins go through a grid of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.functions.kernels import superpose, surface_areas
from strandworks.functions.tables import AMINO, BACKBONE, BONDS, CARBOHYDRATES, LIGAND_MIN_ATOM_CONTACTS, LIGAND_MIN_ATOMS, LIGAND_MIN_RESIDUE_CONTACTS, MARK, NUCLEOTIDES, SIDE_CHAIN, SOLVENTS
from strandworks.plans.ship import ship

KEY = "structure_id"


def distance(a: str, b: str) -> Column:
    """Between two atoms whose coordinates are ``a_x`` and so on."""
    return F.sqrt(sum(((F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))


def dihedral(p: list[tuple[Column, Column, Column]]) -> Column:
    """Signed angle in radians of four points, as arithmetic on their coordinates."""
    sub = lambda u, v: tuple(a - b for a, b in zip(u, v))
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    v1, v2, v3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(v1, v2), cross(v2, v3)
    return F.atan2(dot(cross(n1, n2), v2) / F.sqrt(dot(v2, v2)), dot(n1, n2))


def grid_pairs(left: DataFrame, right: DataFrame, cutoff: float, columns: dict[str, str] | None = None) -> DataFrame:
    """Pairs of atoms of one structure within ``cutoff``: ``structure_id, a, b, dist``.

    Space is cut into cells as wide as the cutoff.  Each left atom looks into the 27
    cells around it, so the join is an equality on structure and cell; the exact
    distance is tested after.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff).cast("int")
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = left.select(KEY, F.col("atom_idx").alias("a"), *[F.col(c).alias(f"a_{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    for c in "xyz":
        a = a.withColumn("_d", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
    b = right.select(KEY, F.col("atom_idx").alias("b"), *[F.col(c).alias(f"b_{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    met = a.join(b, [KEY, "cx", "cy", "cz"]).withColumn("dist", distance("a", "b"))
    return met.where(F.col("dist") <= cutoff).select(KEY, "a", "b", "dist")


def bond_limits(spark) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in BONDS.items()], "pair string, lower double, upper double")


def covalent_bonds(atoms: DataFrame, split_chains: bool = False) -> DataFrame:
    """``structure_id, a, b, dist``, a < b: pairs strictly within their elements'
    bounds, of compatible alternate locations; optionally within one chain.

    The bounds are a fixed table of 53 rows and are broadcast."""
    widest = max(b for k, (_, b) in BONDS.items() if k != "NC-NC")
    pairs = grid_pairs(atoms, atoms, widest).where("a < b")
    side = lambda s: atoms.select(KEY, F.col("atom_idx").alias(s), F.upper("element").alias(f"{s}_el"), F.col("altloc_id").alias(f"{s}_alt"), F.col("chain_id").alias(f"{s}_ch"))
    rows = pairs.join(side("a"), [KEY, "a"]).join(side("b"), [KEY, "b"])
    rows = rows.where((F.col("a_alt") == F.col("b_alt")) | (F.col("a_alt") == "") | (F.col("b_alt") == ""))
    if split_chains:
        rows = rows.where("a_ch = b_ch")
    rows = rows.withColumn("pair", F.concat_ws("-", F.least("a_el", "b_el"), F.greatest("a_el", "b_el")))
    limits = F.broadcast(bond_limits(atoms.sparkSession).where("pair <> 'NC-NC'"))
    return rows.join(limits, "pair").where("dist > lower and dist < upper").select(KEY, "a", "b", "dist")


def contacts_within(atoms: DataFrame, mask: Column, cutoff: float = 5.0) -> DataFrame:
    """Nearest partner of each atom among the masked ones, if closer than ``cutoff``:
    ``structure_id, a, b, dist``; coordinates count rounded to two decimals."""
    rounded = atoms.withColumns({c: F.round(c, 2) for c in "xyz"})
    pairs = grid_pairs(rounded.where(~mask), rounded.where(mask), cutoff).where(F.col("dist") < cutoff)
    best = pairs.groupBy(KEY, "a").agg(F.min(F.struct("dist", "b")).alias("m"))
    return best.select(KEY, "a", F.col("m.b").alias("b"), F.col("m.dist").alias("dist"))


def residue_contacts(atoms: DataFrame, position: int, radius: float = 5.0) -> DataFrame:
    """``structure_id, contacts``: the other residues within ``radius`` of any atom of
    a residue, sorted and joined by commas."""
    at = atoms.where(F.col("res_id") == position)
    pairs = grid_pairs(at, atoms.where(F.col("res_id") != position), radius)
    named = pairs.join(atoms.select(KEY, F.col("atom_idx").alias("b"), "res_id"), [KEY, "b"])
    ids = F.transform(F.array_sort(F.collect_set("res_id")), lambda v: v.cast("string"))
    return named.groupBy(KEY).agg(F.array_join(ids, ",").alias("contacts"))


def pick(atoms: DataFrame, residue: int, name: str | None, prefix: str) -> DataFrame:
    """One named atom per structure, or the centroid of a residue, as
    ``prefix_x, prefix_y, prefix_z, prefix_n``; a name must be unique to count."""
    rows = atoms.where(F.col("res_id") == residue)
    if name is not None:
        rows = rows.where(F.col("atom_name") == name)
    return rows.groupBy(KEY).agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in "xyz"], F.count(F.lit(1)).alias(f"{prefix}_n"))


def dist_between(atoms: DataFrame, r1: int, r2: int, a1: str | None = None, a2: str | None = None) -> DataFrame:
    """``structure_id, ok, dist`` of two named atoms, or of residue centroids."""
    objects = atoms.select(KEY).distinct()
    rows = objects.join(pick(atoms, r1, a1, "a"), KEY, "left").join(pick(atoms, r2, a2, "b"), KEY, "left")
    ok = F.lit(True)
    for side, name in (("a", a1), ("b", a2)):
        ok = ok & (F.coalesce(F.col(f"{side}_n"), F.lit(0)) == 1 if name is not None else F.coalesce(F.col(f"{side}_n"), F.lit(0)) > 0)
    return rows.select(KEY, ok.alias("ok"), F.when(ok, distance("a", "b")).alias("dist"))


def agg_dist(atoms: DataFrame, r1: int, r2: int) -> DataFrame:
    """Min, max, mean and median over all atom pairs of two residues."""
    side = lambda r, s: atoms.where(F.col("res_id") == r).select(KEY, *[F.col(c).alias(f"{s}_{c}") for c in "xyz"])
    rows = side(r1, "a").join(side(r2, "b"), KEY).select(KEY, distance("a", "b").alias("d"))
    return rows.groupBy(KEY).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.avg("d").alias("mean"), F.median("d").alias("med"))


def backbone_dihedrals(atoms: DataFrame) -> DataFrame:
    """``structure_id, res_id, phi, psi, omega`` from one pass per structure: the
    backbone atoms of a residue as columns, its neighbours by lag and lead; null
    where an atom is missing or the neighbour's number does not follow."""
    xyz = F.struct("x", "y", "z")
    one = lambda n: F.first(F.when(F.col("atom_name") == n, xyz), ignorenulls=True).alias(n)
    rows = atoms.groupBy(KEY, "chain_id", "res_id").agg(*[one(n) for n in ("N", "CA", "C")])
    w = Window.partitionBy(KEY, "chain_id").orderBy("res_id")
    follows = lambda f, by: F.when(f("res_id").over(w) - F.col("res_id") == by, F.lit(True))
    prev = lambda n: F.when(follows(F.lag, -1), F.lag(n).over(w)).alias(f"p{n}")
    nxt = lambda n: F.when(follows(F.lead, 1), F.lead(n).over(w)).alias(f"n{n}")
    rows = rows.select(KEY, "chain_id", "res_id", "N", "CA", "C", prev("C"), nxt("N"), nxt("CA"))
    pt = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{c}.z"))
    angle = lambda *n: dihedral([pt(c) for c in n])
    return rows.select(KEY, "chain_id", "res_id", angle("pC", "N", "CA", "C").alias("phi"), angle("N", "CA", "C", "nN").alias("psi"), angle("CA", "C", "nN", "nCA").alias("omega"))


def first_dihedral(atoms: DataFrame, choices: list[tuple[str, str, str, str]]) -> DataFrame:
    """``structure_id, chain_id, res_id, angle``: the first quadruple of atom names
    that a residue has, null if it has none."""
    names = sorted({n for q in choices for n in q})
    xyz = F.struct("x", "y", "z")
    rows = atoms.groupBy(KEY, "chain_id", "res_id").agg(*[F.first(F.when(F.col("atom_name") == n, xyz), ignorenulls=True).alias(n) for n in names])
    angle = lambda q: dihedral([(F.col(f"{n}.x"), F.col(f"{n}.y"), F.col(f"{n}.z")) for n in q])
    return rows.select(KEY, "chain_id", "res_id", F.coalesce(*[angle(q) for q in choices]).alias("angle"))


CHI1 = [("N", "CA", "CB", x) for x in ("CG", "CG1", "OG", "OG1", "SG")]
CHI2 = [("CA", "CB", "CG", x) for x in ("CD", "OD1", "ND1")] + [("CA", "CB", "CG1", "CD")] + [("CA", "CB", "CG", x) for x in ("CD1", "SD")]


def select_atoms(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Atoms whose ``(res_id, atom_name)`` is wanted; a null name wants the residue."""
    named = wanted.where("atom_name is not null").select("res_id", "atom_name").distinct()
    whole = wanted.where("atom_name is null").select("res_id").distinct()
    by_name = atoms.join(named, ["res_id", "atom_name"], "left_semi")
    rest = atoms.join(named, ["res_id", "atom_name"], "left_anti").join(whole, "res_id", "left_semi")
    return by_name.select(atoms.columns).unionByName(rest.select(atoms.columns))


def common_atoms(a: DataFrame, b: DataFrame, key: list[str], allow_mismatch: bool = False) -> DataFrame:
    """Pairs ``key, ord, a_idx, b_idx`` of atoms two structures share: residues pair by
    ordinal, atoms by name; with different residue names only the four atoms around
    the alpha carbon can pair, and only if allowed."""
    def ranked(df: DataFrame, s: str) -> DataFrame:
        ord_ = F.dense_rank().over(Window.partitionBy(*key).orderBy("chain_id", "res_id"))
        return df.select(*key, ord_.alias("ord"), "atom_name", F.col("res_name").alias(f"{s}_res"), F.col("atom_idx").alias(f"{s}_idx"))

    rows = ranked(a, "a").join(ranked(b, "b"), [*key, "ord", "atom_name"])
    ok = F.col("a_res") == F.col("b_res")
    if allow_mismatch:
        ok = ok | F.col("atom_name").isin("N", "CA", "C", "CB")
    return rows.where(ok).select(*key, "ord", "a_idx", "b_idx")


def is_solvent(name: Column) -> Column:
    """Known solvents, and names of another length than three that are no nucleotides."""
    return name.isin(*SOLVENTS) | ((F.length(name) != 3) & ~name.isin(*NUCLEOTIDES))


def polymer_kind(name: Column) -> Column:
    """``p`` amino acid, ``n`` nucleotide, null otherwise."""
    return F.when(name.isin(*AMINO), "p").when(name.isin(*NUCLEOTIDES), "n")


def residue_runs(atoms: DataFrame, columns: tuple[str, ...] = ("chain_id", "res_id", "res_name")) -> DataFrame:
    """Number the residues as runs of atoms: a new one where any column changes."""
    w = Window.partitionBy(KEY).orderBy("atom_idx")
    same = F.lit(True)
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    turn = F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)
    return atoms.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def continuity_breaks(atoms: DataFrame, flag: Column) -> DataFrame:
    """``structure_id, atom_idx`` of the atoms where a flag changes."""
    w = Window.partitionBy(KEY).orderBy("atom_idx")
    rows = atoms.select(KEY, "atom_idx", flag.alias("f"))
    return rows.withColumn("b", F.lag("f").over(w)).where(~F.col("f").eqNullSafe(F.col("b")) & F.col("b").isNotNull()).select(KEY, "atom_idx")


def primary_polymer(atoms: DataFrame, min_size: int = 2) -> DataFrame:
    """``structure_id, kind``: the polymer kind with the most atoms among those of at
    least ``min_size`` residues; ``x`` if there is none."""
    rows = residue_runs(atoms).withColumn("kind", polymer_kind(F.col("res_name")))
    per = rows.where("kind is not null").groupBy(KEY, "kind").agg(F.count_distinct("run").alias("n_res"), F.count(F.lit(1)).alias("n"))
    best = per.where(F.col("n_res") >= min_size).groupBy(KEY).agg(F.max(F.struct("n", "kind")).alias("m"))
    return atoms.select(KEY).distinct().join(best, KEY, "left").select(KEY, F.coalesce("m.kind", F.lit("x")).alias("kind"))


def mark_atoms(atoms: DataFrame) -> DataFrame:
    """Bit marks by residue: solvent, polymer kinds, ligand, and covalent for other
    residues bonded to a polymer atom."""
    kind = polymer_kind(F.col("res_name"))
    base = F.when(is_solvent(F.col("res_name")), MARK["SOLVENT"]).when(kind == "p", MARK["PEP"]).when(kind == "n", MARK["NUC"]).otherwise(MARK["LIGAND"])
    rows = atoms.withColumn("mark", base.cast("int"))
    bonds = covalent_bonds(atoms)
    ends = bonds.select(KEY, F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("x")).select(KEY, "x.i", "x.j")
    info = rows.select(KEY, F.col("atom_idx").alias("j"), F.col("mark").alias("jm"))
    own = rows.select(KEY, F.col("atom_idx").alias("i"), "chain_id", "res_id", "mark")
    tied = ends.join(info, [KEY, "j"]).where(F.col("jm").isin(MARK["PEP"], MARK["NUC"])).join(own, [KEY, "i"]).where(F.col("mark") == MARK["LIGAND"])
    tied = tied.select(KEY, "chain_id", "res_id").distinct().withColumn("_tied", F.lit(MARK["COVALENT"]))
    out = rows.join(tied, [KEY, "chain_id", "res_id"], "left")
    return out.withColumn("mark", F.col("mark").bitwiseOR(F.when(F.col("mark") == MARK["LIGAND"], F.coalesce("_tied", F.lit(0))).otherwise(0))).drop("_tied")


def _components(n: int, pairs, keep: np.ndarray) -> list[list[int]]:
    """Components of the kept ones of ``n`` atoms, in the order of their least atoms."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if keep[a] and keep[b]:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    out: dict[int, list[int]] = {}
    for i in np.flatnonzero(keep):
        out.setdefault(find(int(i)), []).append(int(i))
    return list(out.values())


def _mark_structure(a: pd.DataFrame, pairs: list[tuple[int, int]], n_monomers: int, forced: str | None = None) -> np.ndarray:
    """Marks of one structure's atoms in order; ``pairs`` are bonded places."""
    n = len(a)
    xyz = a[["x", "y", "z"]].to_numpy(float).round(2)
    names, chains, ids, hetero = (a[c].to_numpy() for c in ("res_name", "chain_id", "res_id", "hetero"))
    kinds = {"p": np.isin(names, list(AMINO)), "n": np.isin(names, NUCLEOTIDES), "c": np.isin(names, CARBOHYDRATES)}
    bits = {"p": MARK["PEP"], "n": MARK["NUC"], "c": MARK["CARB"]}
    marks = np.full(n, MARK["UNK"])

    def starts(mask):
        at = np.flatnonzero(mask)
        turn = (names[at][1:] != names[at][:-1]) | (chains[at][1:] != chains[at][:-1]) | (ids[at][1:] != ids[at][:-1])
        return at[np.concatenate([[True], turn])] if len(at) else at

    runs = np.searchsorted(starts(np.ones(n, bool)), np.arange(n), "right")
    size = lambda mask: len(starts(mask))
    whole = lambda idx: np.isin(ids, ids[idx]) & np.isin(chains, chains[idx])
    residues = lambda idx: [runs == r for r in np.unique(runs[idx])]
    kind = lambda mask, least: next((k for k in "pnc" if size(mask & kinds[k]) >= least), "x")

    def ligand(mask, pol):
        if mask.sum() < LIGAND_MIN_ATOMS or len(set(chains[mask])) != 1:
            return False
        near = np.full(n, np.inf)
        for i in np.flatnonzero(mask):
            near = np.minimum(near, ((xyz - xyz[i]) ** 2).sum(1))
        met = (np.sqrt(near) < BONDS["NC-NC"][1]) & pol
        return met.sum() >= LIGAND_MIN_ATOM_CONTACTS and size(met) >= LIGAND_MIN_RESIDUE_CONTACTS

    polymers: dict[str, list] = {}
    sizes: dict[str, int] = {}
    for idx in _components(n, pairs, np.ones(n, bool)):
        mask = whole(idx)
        k = size(mask)
        if k == 1:
            if names[mask][0] in SOLVENTS:
                marks[mask] = MARK["SOLVENT"]
        elif k >= n_monomers and (t := kind(mask, n_monomers)) != "x":
            polymers.setdefault(t, []).append(mask)
            sizes[t] = sizes.get(t, 0) + k
    if not polymers:
        return marks
    primary = forced or max(sizes, key=sizes.get)
    if primary not in polymers:
        return marks
    pol = np.zeros(n, bool)
    for mask in polymers[primary]:
        if hetero[mask].sum() < mask.sum() / 2:
            pol |= mask
    if not pol.any():
        return marks
    marks[pol] = bits[primary]
    for mask in residues(np.flatnonzero(hetero.astype(bool) & pol)):
        if kind(mask, 1) != primary:
            marks[mask] = MARK["COVALENT"] | (MARK["LIGAND"] if ligand(mask, pol & ~mask) else MARK["SOLVENT"])
    seen = np.zeros(n, bool)
    for idx in _components(n, pairs, marks == MARK["UNK"]):
        mask = whole(idx) & ~seen
        seen |= mask
        if not mask.any() or not ligand(mask, pol):
            continue
        t = kind(mask, 2) if size(mask) > 1 else None
        if t == "x":
            for one in residues(idx):
                if ligand(one, pol & ~one):
                    marks[one] = MARK["LIGAND"]
        else:
            marks[mask] = MARK["LIGAND"] | bits.get(t, 0)
    return marks


#: Structure subtypes and the polymer kind that each takes for primary.
SUBTYPES = {"protein": "p", "nucleotide": "n", "carbohydrate": "c"}


def mark_components(atoms: DataFrame, n_monomers: int = 2, subtype: str | None = None) -> DataFrame:
    """``structure_id, atom_idx, mark`` from the components of the bond graph within
    chains.  The polymer kind with the most monomers is the primary one; other polymers
    and molecules are ligands if they touch it enough, a hetero residue inside it is
    covalent, and what fits nothing stays unknown.  Each structure is marked where it
    lies.  A ``subtype`` fixes the primary kind; structures without it stay unknown."""
    forced = SUBTYPES[subtype] if subtype else None

    def run(a: pd.DataFrame, bonds: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("atom_idx", ignore_index=True)
        place = {int(x): i for i, x in enumerate(a["atom_idx"])}
        pairs = [(place[int(x)], place[int(y)]) for x, y in zip(bonds["a"], bonds["b"])]
        return a[[KEY, "atom_idx"]].assign(mark=_mark_structure(a, pairs, n_monomers, forced).astype("int32"))

    ship(atoms.sparkSession)
    rows = atoms.select(KEY, "atom_idx", "chain_id", "res_id", "res_name", "hetero", "x", "y", "z")
    bonds = covalent_bonds(atoms, split_chains=True).select(F.col(KEY).alias("bond_of"), F.col("a").alias("a"), F.col("b").alias("b"))
    return rows.groupBy(KEY).cogroup(bonds.groupBy("bond_of")).applyInPandas(run, f"{KEY} string, atom_idx int, mark int")


def observed_fraction(atoms: DataFrame) -> DataFrame:
    """``structure_id, chain_id, res_id, missing, observed``: canonical heavy atoms a
    residue lacks, and the fraction it has; null for unknown residues."""
    known = {r: (*BACKBONE, *SIDE_CHAIN[r].split()) for r in AMINO}
    table = F.create_map(*[x for r, names in sorted(known.items()) for x in (F.lit(r), F.array(*[F.lit(n) for n in names]))])
    rows = atoms.where((F.col("element") != "H") & (F.col("atom_name") != "OXT")).groupBy(KEY, "chain_id", "res_id", "res_name").agg(F.collect_set("atom_name").alias("have"))
    rows = rows.withColumn("want", F.try_element_at(table, F.col("res_name")))
    gone = F.array_sort(F.array_except("want", "have"))
    return rows.select(KEY, "chain_id", "res_id", F.array_join(gone, ",").alias("missing"), ((F.size("want") - F.size(gone)) / F.when(F.size("want") > 0, F.size("want"))).alias("observed"))


def split_altlocs(atoms: DataFrame) -> DataFrame:
    """One copy per alternate location, ``altloc``; atoms without one are in each."""
    ids = atoms.where("altloc_id <> ''").groupBy(KEY).agg(F.array_sort(F.collect_set("altloc_id")).alias("ids"))
    rows = atoms.join(ids, KEY, "left").withColumn("altloc", F.explode(F.coalesce("ids", F.array(F.lit(""))))).drop("ids")
    return rows.where((F.col("altloc_id") == "") | (F.col("altloc_id") == F.col("altloc")))


def compare_atoms(a: DataFrame, b: DataFrame, eps: float = 1e-3) -> DataFrame:
    """``structure_id, same``: as many atoms, each within ``eps`` per coordinate."""
    side = lambda df, s: df.select(KEY, "atom_idx", *[F.col(c).alias(f"{s}_{c}") for c in "xyz"])
    rows = side(a, "a").join(side(b, "b"), [KEY, "atom_idx"], "full")
    near = F.lit(True)
    for c in "xyz":
        near = near & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) < eps)
    return rows.groupBy(KEY).agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("same"))


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """``structure_id, same``: as many atoms, with the same names and chains in order."""
    side = lambda df, s: df.select(KEY, "atom_idx", F.col("atom_name").alias(f"{s}_name"), F.col("chain_id").alias(f"{s}_chain"))
    rows = side(a, "a").join(side(b, "b"), [KEY, "atom_idx"], "full")
    equal = (F.col("a_name") == F.col("b_name")) & (F.col("a_chain") == F.col("b_chain"))
    return rows.groupBy(KEY).agg(F.bool_and(F.coalesce(equal, F.lit(False))).alias("same"))


def areas(atoms: DataFrame, probe: float = 1.4, points: int = 100) -> DataFrame:
    """Accessible surface of each atom, one structure per kernel call."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("atom_idx")
        return pdf[[KEY, "atom_idx"]].assign(area=surface_areas(pdf[["x", "y", "z"]].to_numpy(float), pdf["element"].tolist(), probe, points))

    ship(atoms.sparkSession)
    return atoms.select(KEY, "atom_idx", "element", "x", "y", "z").groupBy(KEY).applyInPandas(run, f"{KEY} string, atom_idx int, area double")


PAIR = ("fixed_id", "mobile_id")
_PAIRED = "fixed_id string, mobile_id string, n int, rmsd double, distance double, error string"


def _superpose(paired: DataFrame, min_atoms: int) -> DataFrame:
    """Superpose the paired atoms ``(fixed_id, mobile_id, fx, .., mz, role)``, one pair of
    structures per kernel call.  Rows of role ``s`` are laid onto each other, those of
    role ``d`` measured after, those of role ``x`` have no partner."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spp, far = pdf[pdf["role"] == "s"], pdf[pdf["role"] == "d"]
        rmsd = distance_ = error = None
        if (pdf["role"] == "x").any():
            error = "selections differ"
        elif len(spp) < min_atoms:
            error = f"{len(spp)} atoms to superpose"
        else:
            fixed, mobile = (["fx", "fy", "fz"], ["mx", "my", "mz"])
            rotation, shift, rmsd = superpose(spp[fixed].to_numpy(float), spp[mobile].to_numpy(float))
            if len(far):
                distance_ = float(np.sqrt(((far[mobile].to_numpy(float) @ rotation + shift - far[fixed].to_numpy(float)) ** 2).sum(1).mean()))
        return pd.DataFrame([(pdf["fixed_id"].iloc[0], pdf["mobile_id"].iloc[0], len(spp), rmsd, distance_, error)], columns=[*PAIR, "n", "rmsd", "distance", "error"])

    ship(paired.sparkSession)
    return paired.groupBy(*PAIR).applyInPandas(run, _PAIRED)


def _sides(pairs: DataFrame, fixed: DataFrame, mobile: DataFrame, how: str) -> DataFrame:
    """Atoms of both structures of each pair, by chain, residue and name.  Pairs come
    first, so the join is by structure and no residue number is a hot key."""
    at = ["chain_id", "res_id", "atom_name", "altloc_id"]
    side = lambda df, s: pairs.join(df.select(F.col(KEY).alias(f"{'fixed' if s == 'f' else 'mobile'}_id"), *at, *[F.col(c).alias(f"{s}{c}") for c in "xyz"]), "fixed_id" if s == "f" else "mobile_id")
    return side(fixed, "f").join(side(mobile, "m"), [*PAIR, *at], how)


def superpose_strict(pairs: DataFrame, fixed: DataFrame, mobile: DataFrame, fixed_far: DataFrame | None = None, mobile_far: DataFrame | None = None, min_atoms: int = 3) -> DataFrame:
    """``fixed_id, mobile_id, n, rmsd, distance, error`` of pairs ``(fixed_id, mobile_id)``
    of structures whose selections must have the same atoms.

    Pairs whose selections differ in any atom, or have fewer than ``min_atoms``, are
    rows with an error.  ``distance`` is the deviation over a second selection moved
    along; null without one.  Pairs without any atom on either side give no row.
    """
    rows = _sides(pairs, fixed, mobile, "full").withColumn("role", F.when(F.col("fx").isNull() | F.col("mx").isNull(), "x").otherwise("s"))
    if fixed_far is not None:
        rows = rows.unionByName(_sides(pairs, fixed_far, mobile_far, "inner").withColumn("role", F.lit("d")))
    return _superpose(rows.select(*PAIR, "fx", "fy", "fz", "mx", "my", "mz", "role"), min_atoms)


def superpose_flexible(pairs: DataFrame, fixed: DataFrame, mobile: DataFrame, fixed_far: DataFrame | None = None, mobile_far: DataFrame | None = None, min_atoms: int = 3) -> DataFrame:
    """As :func:`superpose_strict`, for selections of different sequences: these are
    aligned, aligned residues pair their atoms by name (with different residue names
    only those around the alpha carbon), and what pairs is superposed."""
    from strandworks.operators.msa import align

    def residues(df: DataFrame, s: str) -> DataFrame:
        letters = F.create_map(*[F.lit(x) for pair in AMINO.items() for x in pair])
        one = df.groupBy(KEY, "chain_id", "res_id").agg(F.min_by("res_name", "atom_idx").alias("res_name"))
        one = one.withColumn("letter", F.coalesce(F.try_element_at(letters, F.col("res_name")), F.lit("X")))
        rows = F.array_sort(F.collect_list(F.struct("chain_id", "res_id", "letter", "res_name")))
        return one.groupBy(F.col(KEY).alias(f"{s}_id")).agg(rows.alias(f"{s}_res"))

    text = lambda c: F.array_join(F.transform(c, lambda r: r["letter"]), "")
    both = pairs.join(residues(fixed, "fixed"), "fixed_id").join(residues(mobile, "mobile"), "mobile_id")
    both = align(both.withColumns({"_a": text("fixed_res"), "_b": text("mobile_res")}), "_a", "_b")
    met = both.select(*PAIR, "fixed_res", "mobile_res", F.posexplode("aln.numbers").alias("k", "to")).where("to is not null")
    f, m = F.col("fixed_res")[F.col("k")], F.element_at("mobile_res", F.col("to"))
    met = met.select(*PAIR, f["chain_id"].alias("f_chain"), f["res_id"].alias("f_res"), m["chain_id"].alias("m_chain"), m["res_id"].alias("m_res"), (f["res_name"] == m["res_name"]).alias("alike"))
    side = lambda df, s, name: df.select(F.col(KEY).alias(name), F.col("chain_id").alias(f"{s}_chain"), F.col("res_id").alias(f"{s}_res"), "atom_name", *[F.col(c).alias(f"{s}{c}") for c in "xyz"])
    rows = met.join(side(fixed, "f", "fixed_id"), ["fixed_id", "f_chain", "f_res"]).join(side(mobile, "m", "mobile_id"), ["mobile_id", "m_chain", "m_res", "atom_name"])
    rows = rows.where(F.col("alike") | F.col("atom_name").isin("N", "CA", "C", "CB")).withColumn("role", F.lit("s"))
    rows = rows.select(*PAIR, "fx", "fy", "fz", "mx", "my", "mz", "role")
    if fixed_far is not None:
        far = _sides(pairs, fixed_far, mobile_far, "inner").withColumn("role", F.lit("d"))
        rows = rows.unionByName(far.select(rows.columns))
    return _superpose(rows, min_atoms)


def superpose_pairs(pairs: DataFrame) -> DataFrame:
    """``fixed_id, mobile_id, n, rmsd`` of paired atoms ``(fixed_id, mobile_id,
    fx, fy, fz, mx, my, mz)``."""
    return _superpose(pairs.withColumn("role", F.lit("s")), 1).select(*PAIR, "n", "rmsd")


def transform(xyz: np.ndarray, rotation: np.ndarray, translation: np.ndarray) -> np.ndarray:
    return xyz @ rotation + translation
