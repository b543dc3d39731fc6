"""Variables of structures and ligands, with failures as values.

Ids are constructor texts as those of sequence variables.  All variables of named
atoms are one aggregation per structure, whose columns are the atoms they name; the
others are one plan for each kind, whatever the number of variables.  A position is
a residue number, or what ``mapping`` makes of it.
"""

from __future__ import annotations

import inspect
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions.tables import BONDS
from strandworks.operators.atoms import CHI1, CHI2, KEY, areas, dihedral, distance, grid_pairs
from strandworks.operators.ligands import ligand_contacts, ligand_distances

_ID = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*$")
NEAR = BONDS["NC-NC"][1]
AGGREGATES = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}
RESULT = ("object_id", "variable_id", "ok", "value", "error", "rtype")


class Dist:
    rtype = "float"

    def __init__(self, p1: int, p2: int, a1: str | None = None, a2: str | None = None, com: bool = False):
        if not com and (a1 is None or a2 is None):
            raise ValueError("name both atoms, or take centroids")
        self.points = [(p1, None if com else a1), (p2, None if com else a2)]

    def column(self, at) -> Column:
        (ax, ay, az), (bx, by, bz) = (at(p) for p in self.points)
        return F.sqrt((ax - bx) ** 2 + (ay - by) ** 2 + (az - bz) ** 2)


class Dihedral:
    rtype = "float"

    def __init__(self, p1: int, p2: int, p3: int, p4: int, a1: str, a2: str, a3: str, a4: str):
        self.points = [(p1, a1), (p2, a2), (p3, a3), (p4, a4)]

    def column(self, at) -> Column:
        return dihedral([at(p) for p in self.points])


class PseudoDihedral(Dihedral):
    def __init__(self, p1: int, p2: int, p3: int, p4: int):
        super().__init__(p1, p2, p3, p4, "CA", "CA", "CA", "CA")


class Phi(Dihedral):
    def __init__(self, p: int):
        super().__init__(p - 1, p, p, p, "C", "N", "CA", "C")


class Psi(Dihedral):
    def __init__(self, p: int):
        super().__init__(p, p, p, p + 1, "N", "CA", "C", "N")


class Omega(Dihedral):
    def __init__(self, p: int):
        super().__init__(p, p, p + 1, p + 1, "CA", "C", "N", "CA")


class Chi1:
    """The first quadruple of atom names that the residue has."""

    rtype, names = "float", CHI1

    def __init__(self, p: int):
        self.choices = [[(p, n) for n in quad] for quad in self.names]
        self.points = sorted({x for quad in self.choices for x in quad}, key=str)

    def column(self, at) -> Column:
        return F.coalesce(*[dihedral([at(p) for p in quad]) for quad in self.choices])


class Chi2(Chi1):
    names = CHI2


class AggDist:
    rtype = "float"

    def __init__(self, p1: int, p2: int, key: str = "min"):
        self.p1, self.p2, self.key = p1, p2, _known(key)


class Contacts:
    rtype = "str"

    def __init__(self, p: int, r: float = NEAR):
        self.p, self.r = p, r


class SASA:
    rtype = "float"

    def __init__(self, p: int, a: str | None = None):
        self.p, self.a = p, a


class ClosestLigandContactsCount(SASA):
    rtype = "int"


class ClosestLigandNames(SASA):
    rtype = "str"


class ClosestLigandDist:
    rtype = "float"

    def __init__(self, p: int, a: str | None = None, agg_lig: str = "min", agg_res: str = "min"):
        self.p, self.a, self.agg_lig, self.agg_res = p, a, _known(agg_lig), _known(agg_res)


class LigandDist:
    """Between a ligand and a residue of its structure; objects are ligands."""

    rtype = "float"

    def __init__(self, p: int, a: str | None = None, la: str | None = None, agg: str = "min"):
        self.p, self.a, self.la, self.agg = p, a, la, _known(agg)


def _known(key: str) -> str:
    if key not in AGGREGATES:
        raise ValueError(f"no aggregate {key!r} among {sorted(AGGREGATES)}")
    return key


REGISTRY = {c.__name__: c for c in (Dist, AggDist, Dihedral, PseudoDihedral, Phi, Psi, Omega, Chi1, Chi2, SASA, ClosestLigandContactsCount, ClosestLigandNames, ClosestLigandDist, Contacts, LigandDist)}


def parse(text: str):
    """The variable an id names, as ``(id, variable)``; arguments may be named, text may
    be quoted, ``None`` is none.  Raises on anything else."""
    m = _ID.match(text)
    if not m or m.group(1) not in REGISTRY:
        raise ValueError(f"not a structure variable: {text!r}")
    kind = REGISTRY[m.group(1)]
    signature = inspect.signature(kind)
    args, named = [], {}
    for part in filter(None, (x.strip() for x in m.group(2).split(","))):
        key, _, value = part.rpartition("=")
        (named.__setitem__(key.strip(), value.strip()) if key else args.append(value))
    bound = signature.bind(*args, **named)
    for name, value in bound.arguments.items():
        want, bare = str(signature.parameters[name].annotation), value.strip("'\"")
        bound.arguments[name] = None if bare == "None" else int(bare) if want == "int" else float(bare) if want == "float" else bare == "True" if want == "bool" else bare
    return f"{kind.__name__}({','.join(x.strip() for x in m.group(2).split(','))})", kind(*bound.args, **bound.kwargs)


def _results(rows: DataFrame, obj: Column, variable: Column, ok: Column, value: Column, error: Column, rtype: Column) -> DataFrame:
    good = F.coalesce(ok, F.lit(False))
    return rows.select(
        obj.alias("object_id"), variable.alias("variable_id"), good.alias("ok"), F.when(good, value.cast("string")).alias("value"),
        F.when(~good, error).alias("error"), rtype.alias("rtype"),
    )


def _of_atoms(atoms: DataFrame, wanted: list[tuple[str, object]]) -> DataFrame:
    """Variables of named atoms and centroids: one aggregation with a struct for each
    point, then an array of results."""
    points = sorted({p for _, v in wanted for p in v.points}, key=str)
    name = {p: f"p{k}" for k, p in enumerate(points)}

    def point(p: tuple[int, str | None]) -> Column:
        hit = F.col("res_id") == p[0]
        if p[1] is not None:
            hit = hit & (F.col("atom_name") == p[1])
        mean = F.struct(*[F.avg(F.when(hit, F.col(c))).alias(c) for c in "xyz"])
        single = F.count_if(hit) == 1 if p[1] is not None else F.min(F.when(hit, F.col("chain_id"))) == F.max(F.when(hit, F.col("chain_id")))
        return F.when(single, mean).alias(name[p])

    used = atoms.where(F.col("res_id").isin(sorted({p for p, _ in points})))
    rows = atoms.select(KEY).distinct().join(used.groupBy(KEY).agg(*[point(p) for p in points]), KEY, "left")
    at = lambda p: tuple(F.col(name[p])[c] for c in "xyz")
    items = [F.struct(F.lit(i).alias("i"), v.column(at).alias("v")) for i, v in wanted]
    rows = rows.select(KEY, F.explode(F.array(*items)).alias("r"))
    return _results(rows, F.col(KEY), F.col("r.i"), F.col("r.v").isNotNull(), F.col("r.v"), F.lit("an atom is missing or not unique"), F.lit("float"))


def _table(atoms: DataFrame, wanted: list[tuple[str, object]], fields: str, rtype: str) -> DataFrame:
    """The wanted variables as a small table, whose size is that of the request."""
    names = [f.split()[0] for f in fields.split(", ")]
    rows = [(i, *[getattr(v, n) for n in names]) for i, v in wanted]
    return F.broadcast(atoms.sparkSession.createDataFrame(rows, f"variable_id string, {fields}").withColumn("rtype", F.lit(rtype)))


def _every(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """Each structure with each wanted variable."""
    return atoms.select(KEY).distinct().crossJoin(table)


def _selected(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """Atoms at the positions of the variables, by name where one is given."""
    rows = atoms.join(table.select("variable_id", F.col("p").alias("res_id"), "a"), "res_id")
    return rows.where(F.col("a").isNull() | (F.col("a") == F.col("atom_name")))


def _agg_dist(atoms: DataFrame, wanted: list) -> DataFrame:
    t = _table(atoms, wanted, "p1 int, p2 int, key string", "float")
    side = lambda p, s: atoms.join(t.select("variable_id", F.col(p).alias("res_id")), "res_id").select(KEY, "variable_id", *[F.col(c).alias(f"{s}_{c}") for c in "xyz"])
    d = side("p1", "a").join(side("p2", "b"), [KEY, "variable_id"]).select(KEY, "variable_id", distance("a", "b").alias("d"))
    rows = _every(atoms, t).join(d.groupBy(KEY, "variable_id").agg(*[f("d").alias(k) for k, f in AGGREGATES.items()]), [KEY, "variable_id"], "left")
    value = F.coalesce(*[F.when(F.col("key") == k, F.col(k)) for k in AGGREGATES])
    return _results(rows, F.col(KEY), F.col("variable_id"), value.isNotNull(), value, F.lit("a residue is missing"), F.col("rtype"))


def _contacts(atoms: DataFrame, wanted: list) -> DataFrame:
    t = _table(atoms, wanted, "p int, r double", "str")
    at = sorted({v.p for _, v in wanted})
    there = atoms.where(F.col("res_id").isin(at)).select(KEY, F.col("res_id").alias("p")).distinct().withColumn("there", F.lit(True))
    near = grid_pairs(atoms.where(F.col("res_id").isin(at)), atoms, max(v.r for _, v in wanted))
    end = lambda s: atoms.select(KEY, F.col("atom_idx").alias(s), F.col("res_id").alias(f"{s}_res"))
    near = near.join(end("a"), [KEY, "a"]).join(end("b"), [KEY, "b"]).where("a_res <> b_res")
    near = near.join(t.select("variable_id", F.col("p").alias("a_res"), "r"), "a_res").where("dist <= r")
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("b_res")), lambda v: v.cast("string")), ",")
    found = near.groupBy(KEY, "variable_id").agg(ids.alias("v"))
    rows = _every(atoms, t).join(there, [KEY, "p"], "left").join(found, [KEY, "variable_id"], "left")
    return _results(rows, F.col(KEY), F.col("variable_id"), F.col("there"), F.coalesce("v", F.lit("")), F.lit("the residue is missing"), F.col("rtype"))


def _sasa(atoms: DataFrame, wanted: list) -> DataFrame:
    t = _table(atoms, wanted, "p int, a string", "float")
    per = _selected(atoms.join(areas(atoms), [KEY, "atom_idx"]), t).groupBy(KEY, "variable_id").agg(F.sum("area").alias("v"))
    rows = _every(atoms, t).join(per, [KEY, "variable_id"], "left")
    return _results(rows, F.col(KEY), F.col("variable_id"), F.col("v").isNotNull(), F.col("v"), F.lit("empty selection"), F.col("rtype"))


def _present(atoms: DataFrame, t: DataFrame) -> DataFrame:
    """``structure_id, variable_id, there``: a residue, or exactly one atom of the name."""
    n = _selected(atoms, t).groupBy(KEY, "variable_id", "a").agg(F.count(F.lit(1)).alias("n"))
    return n.select(KEY, "variable_id", (F.col("a").isNull() | (F.col("n") == 1)).alias("there"))


def _ligand_contacts(atoms: DataFrame, counts: list, names: list, ligand: Column) -> list[DataFrame]:
    both = [(i, v, "int") for i, v in counts] + [(i, v, "str") for i, v in names]
    rows = [(i, v.p, v.a, kind) for i, v, kind in both]
    t = F.broadcast(atoms.sparkSession.createDataFrame(rows, "variable_id string, p int, a string, rtype string"))
    met = ligand_contacts(atoms, ligand, F.col("res_id").isin(sorted({v.p for _, v, _ in both})) & ~ligand, NEAR)
    met = met.join(t.select("variable_id", F.col("p").alias("a_res"), F.col("a").alias("want")), "a_res").where(F.col("want").isNull() | (F.col("want") == F.col("atom_name")))
    res = atoms.where(ligand).select(KEY, F.concat_ws("_", "chain_id", "res_id").alias("lig"), F.col("res_name").alias("lig_name")).distinct()
    per = met.join(res, [KEY, "lig"]).groupBy(KEY, "variable_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("lig", "lig_name"))), lambda s: s["lig_name"]), ",").alias("names"))
    out = _every(atoms, t).join(_present(atoms, t), [KEY, "variable_id"], "left").join(per, [KEY, "variable_id"], "left")
    value = F.when(F.col("rtype") == "int", F.coalesce("n", F.lit(0)).cast("string")).otherwise(F.coalesce("names", F.lit("")))
    return [_results(out, F.col(KEY), F.col("variable_id"), F.col("there"), value, F.lit("the residue or atom is missing or not unique"), F.col("rtype"))]


def _ligand_dist(atoms: DataFrame, wanted: list, ligand: Column) -> DataFrame:
    t = _table(atoms, wanted, "p int, a string, agg_lig string, agg_res string", "float")
    d = ligand_distances(atoms, ligand, F.col("res_id").isin(sorted({v.p for _, v in wanted})))
    d = d.join(t.select("variable_id", F.col("p").alias("a_res"), F.col("a").alias("want"), "agg_lig", "agg_res"), "a_res").where(F.col("want").isNull() | (F.col("want") == F.col("atom_name")))
    choose = lambda key, c: F.coalesce(*[F.when(F.first(key) == k, f(c)) for k, f in AGGREGATES.items()])
    per = d.groupBy(KEY, "variable_id", "a", "agg_res").agg(choose("agg_lig", "dist").alias("m")).groupBy(KEY, "variable_id").agg(choose("agg_res", "m").alias("v"))
    rows = _every(atoms, t).join(_present(atoms, t), [KEY, "variable_id"], "left").join(per, [KEY, "variable_id"], "left")
    return _results(rows, F.col(KEY), F.col("variable_id"), F.col("there"), F.coalesce("v", F.lit(-1.0)), F.lit("the residue or atom is missing or not unique"), F.col("rtype"))


def _of_ligands(atoms: DataFrame, wanted: list, ligand: Column) -> DataFrame:
    t = _table(atoms, wanted, "p int, a string, la string, agg string", "float")
    ligs = atoms.where(ligand).withColumn("lig", F.concat_ws("_", "chain_id", "res_id"))
    obj = F.concat_ws(":", KEY, "lig").alias("object_id")
    pol = _selected(atoms, t).select(KEY, "variable_id", *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    lig = ligs.crossJoin(t.select("variable_id", "la")).where(F.col("la").isNull() | (F.col("la") == F.col("atom_name")))
    d = lig.select(KEY, "lig", "variable_id", *[F.col(c).alias(f"b_{c}") for c in "xyz"]).join(pol, [KEY, "variable_id"]).select(KEY, "lig", "variable_id", distance("a", "b").alias("d"))
    per = d.groupBy(KEY, "lig", "variable_id").agg(*[f("d").alias(k) for k, f in AGGREGATES.items()])
    one = ligs.crossJoin(t.select("variable_id", "la")).where(F.col("la").isNotNull()).groupBy(KEY, "lig", "variable_id").agg((F.count_if(F.col("la") == F.col("atom_name")) == 1).alias("named"))
    rows = ligs.select(KEY, "lig").distinct().crossJoin(t).join(per, [KEY, "lig", "variable_id"], "left").join(_present(atoms, t), [KEY, "variable_id"], "left").join(one, [KEY, "lig", "variable_id"], "left")
    value = F.coalesce(*[F.when(F.col("agg") == k, F.col(k)) for k in AGGREGATES])
    ok = F.col("there") & F.coalesce("named", F.lit(True)) & value.isNotNull()
    return _results(rows, obj, F.col("variable_id"), ok, value, F.lit("an atom is missing or not unique"), F.col("rtype"))


def mapped(atoms: DataFrame, mapping: DataFrame) -> DataFrame:
    """Atoms whose residues are renumbered by ``mapping`` ``(structure_id, position,
    res_id)``; residues it does not name are left out, as they have no position."""
    to = mapping.select(KEY, "res_id", F.col("position").alias("_to"))
    return atoms.join(to, [KEY, "res_id"]).withColumn("res_id", F.col("_to")).drop("_to").select(atoms.columns)


def calculate(atoms: DataFrame, ids: list[str], ligand: Column | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """``object_id, variable_id, ok, value, error, rtype``: every variable on every
    structure; ``LigandDist`` on every ligand, whose id is ``structure:chain_residue``.

    ``ligand`` says which atoms are ligands' (by default the hetero ones).  A failure is
    a row with its message, never an exception; an empty table gives no rows.  Residue
    numbers of ligands stay as they are under a ``mapping``.
    """
    ligand = F.col("hetero") if ligand is None else ligand
    if mapping is not None:
        atoms = mapped(atoms.where(~ligand), mapping).unionByName(atoms.where(ligand))
    wanted: dict[type, list] = {}
    for i, v in dict(parse(x) for x in ids).items():
        wanted.setdefault(type(v), []).append((i, v))
    take = lambda *kinds: [x for k in kinds for x in wanted.get(k, ())]
    parts: list[DataFrame] = []
    if points := take(Dist, Dihedral, PseudoDihedral, Phi, Psi, Omega, Chi1, Chi2):
        parts.append(_of_atoms(atoms, points))
    for kind, run in ((AggDist, _agg_dist), (Contacts, _contacts), (SASA, _sasa)):
        if kind in wanted:
            parts.append(run(atoms, wanted[kind]))
    if take(ClosestLigandContactsCount, ClosestLigandNames):
        parts += _ligand_contacts(atoms, take(ClosestLigandContactsCount), take(ClosestLigandNames), ligand)
    if ClosestLigandDist in wanted:
        parts.append(_ligand_dist(atoms, wanted[ClosestLigandDist], ligand))
    if LigandDist in wanted:
        parts.append(_of_ligands(atoms, wanted[LigandDist], ligand))
    if not parts:
        raise ValueError("no variables")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
