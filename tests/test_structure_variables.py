import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions.kernels import components, surface_areas
from strandworks.functions.tables import RADII
from strandworks.operators import atoms as A
from strandworks.operators import ligands as L
from strandworks.operators import structure_variables as SV

SCHEMA = "structure_id string, atom_idx int, chain_id string, res_id int, res_name string, atom_name string, element string, hetero boolean, altloc_id string, x double, y double, z double"
NAMES = ["N", "CA", "C", "O", "CB", "CG", "CD"]


def structure(name, seed, n_res=6, ligand=True):
    rng = np.random.default_rng(seed)
    rows = [(name, 7 * r + k, "A", r + 1, "ALA", a, a[0], False, "", *map(float, rng.normal(0, 6, 3))) for r in range(n_res) for k, a in enumerate(NAMES)]
    if ligand:
        rows += [(name, 7 * n_res + k, "B", 90 + k // 3, "LIG", f"L{k % 3}", "C", True, "", *map(float, rng.normal(0, 6, 3))) for k in range(6)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return structure("s1", 1) + structure("s2", 2, 4, ligand=False) + [("s3", 0, "A", 1, "GLY", "CA", "C", False, "", 0.0, 0.0, 0.0), ("s3", 1, "A", 1, "GLY", "CA", "C", False, "", 1.0, 0.0, 0.0)]


def angle(p):
    p = [np.array(x) for x in p]
    a, b, c = p[1] - p[0], p[2] - p[1], p[3] - p[2]
    n, m = np.cross(a, b), np.cross(b, c)
    return math.atan2(np.dot(np.cross(n, m), b / np.linalg.norm(b)), np.dot(n, m))


def test_every_kind_equals_numpy_and_fails_as_a_row(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    ids = [
        "Dist(1,2,CA,CB)", "Dist(1,2,com=True)", "AggDist(1,3,max)", "AggDist(1,3,median)", "Phi(2)", "Psi(2)", "Omega(2)", "Chi1(1)", "Chi2(1)", "PseudoDihedral(1,2,3,4)",
        "Dihedral(1,1,2,3,N,CA,CB,C)", "Contacts(2,7.5)", "SASA(2)", "SASA(2,CA)", "ClosestLigandContactsCount(1)", "ClosestLigandNames(1)", "ClosestLigandDist(1)",
        "ClosestLigandDist(1,CA,max,min)", "LigandDist(1)", "LigandDist(1,CA,L1,max)", "LigandDist(1,CA,QQ)",
    ]
    got = {(r.object_id, r.variable_id): r for r in SV.calculate(df, ids).collect()}
    for name in ("s1", "s2"):
        own = [r for r in rows if r[0] == name]
        at = {(r[3], r[5]): np.array(r[9:]) for r in own}
        res = lambda i: np.array([r[9:] for r in own if r[3] == i])  # noqa: B023, E731
        lig = {i: res(i) for i in (90, 91) if len(res(i))}
        all_d = lambda a, b: np.linalg.norm(a[:, None] - b[None], axis=2)
        want = {
            "Dist(1,2,CA,CB)": np.linalg.norm(at[1, "CA"] - at[2, "CB"]),
            "Dist(1,2,com=True)": np.linalg.norm(res(1).mean(0) - res(2).mean(0)),
            "AggDist(1,3,max)": all_d(res(1), res(3)).max(),
            "AggDist(1,3,median)": np.median(all_d(res(1), res(3))),
            "Phi(2)": angle([at[1, "C"], at[2, "N"], at[2, "CA"], at[2, "C"]]),
            "Psi(2)": angle([at[2, "N"], at[2, "CA"], at[2, "C"], at[3, "N"]]),
            "Omega(2)": angle([at[2, "CA"], at[2, "C"], at[3, "N"], at[3, "CA"]]),
            "Chi1(1)": angle([at[1, "N"], at[1, "CA"], at[1, "CB"], at[1, "CG"]]),
            "Chi2(1)": angle([at[1, "CA"], at[1, "CB"], at[1, "CG"], at[1, "CD"]]),
            "PseudoDihedral(1,2,3,4)": angle([at[i, "CA"] for i in (1, 2, 3, 4)]),
            "Dihedral(1,1,2,3,N,CA,CB,C)": angle([at[1, "N"], at[1, "CA"], at[2, "CB"], at[3, "C"]]),
            "ClosestLigandContactsCount(1)": sum((all_d(res(1), x).min(1) <= SV.NEAR).sum() for x in lig.values()),
            "ClosestLigandDist(1)": min((all_d(res(1), x).min() for x in lig.values()), default=-1.0),
            "ClosestLigandDist(1,CA,max,min)": max((all_d(at[1, "CA"][None], x).min() for x in lig.values()), default=-1.0),
        }
        area = surface_areas(np.array([r[9:] for r in own]), [r[6] for r in own])
        want["SASA(2)"] = sum(a for a, r in zip(area, own) if r[3] == 2)
        want["SASA(2,CA)"] = sum(a for a, r in zip(area, own) if r[3] == 2 and r[5] == "CA")
        for i, value in want.items():
            assert got[name, i].ok and float(got[name, i].value) == pytest.approx(float(value), abs=1e-6), (name, i)
        near = sorted({r[3] for r in own if r[3] != 2 and all_d(res(2), np.array([r[9:]])).min() <= 7.5})
        assert got[name, "Contacts(2,7.5)"].value == ",".join(map(str, near))
        for i, x in lig.items():
            assert float(got[f"{name}:B_{i}", "LigandDist(1)"].value) == pytest.approx(all_d(res(1), x).min())
            assert float(got[f"{name}:B_{i}", "LigandDist(1,CA,L1,max)"].value) == pytest.approx(np.linalg.norm(at[1, "CA"] - at[i, "L1"]))
            assert not got[f"{name}:B_{i}", "LigandDist(1,CA,QQ)"].ok
    assert got["s2", "ClosestLigandNames(1)"].value == "" and not any(k[0].startswith("s2:") for k in got)
    bad = got["s3", "Dist(1,2,CA,CB)"]
    assert not bad.ok and bad.value is None and bad.error
    assert not got["s3", "Phi(2)"].ok and not got["s3", "SASA(2)"].ok and not got["s3", "Contacts(2,7.5)"].ok
    assert SV.calculate(df.limit(0), ids).count() == 0


def test_mapping_and_parsing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    to = spark.createDataFrame([("s1", 10, 1), ("s1", 20, 2)], "structure_id string, position int, res_id int")
    got = {r.object_id: r for r in SV.calculate(df, ["Dist(10,20,CA,CB)", "Dist(1,2,CA,CB)"], mapping=to).where("variable_id like 'Dist(10%'").collect()}
    plain = {r.object_id: r for r in SV.calculate(df, ["Dist(1,2,CA,CB)"]).collect()}
    assert float(got["s1"].value) == pytest.approx(float(plain["s1"].value)) and "s2" not in got
    for text in ("Dist(1,2)", "AggDist(1,2,sum)", "Nothing(1)", "Phi(x)", "Phi", "Phi(1,2,3)"):
        with pytest.raises((ValueError, TypeError)):
            SV.parse(text)


def test_nearest_whatever_the_distance(spark):
    rng = np.random.default_rng(3)
    point = lambda k, c, scale: ("s", k, c, k, "ALA", "CA", "C", False, "", *map(float, rng.normal(0, scale, 3)))
    left, right = [point(k, "A", s) for k, s in enumerate([1, 30, 900, 9000] * 5)], [point(k, "B", 5) for k in range(100, 110)]
    df = spark.createDataFrame(left + right, SCHEMA)
    got = {r.a: r.dist for r in L.nearest(df.where("chain_id = 'A'"), df.where("chain_id = 'B'")).collect()}
    want = {a[1]: min(math.dist(a[9:], b[9:]) for b in right) for a in left}
    assert got == pytest.approx(want)


def test_strict_and_flexible_pairs(spark):
    base = structure("f", 5, ligand=False)
    turn = lambda r, name: (name, *r[1:9], 3 - r[10], r[9] - 5, r[11] + 1)
    same, less = [turn(r, "same") for r in base], [turn(r, "less") for r in base if r[1] not in (3, 8)]
    shifted = [(*r[:3], r[3] + 40, *r[4:]) for r in (turn(r, "far") for r in base if r[3] > 1)]
    df = spark.createDataFrame(base + same + less + shifted, SCHEMA)
    pairs = spark.createDataFrame([("f", m) for m in ("same", "less", "far", "none")], "fixed_id string, mobile_id string")
    strict = {r.mobile_id: r for r in A.superpose_strict(pairs, df, df).collect()}
    assert strict["same"].rmsd == pytest.approx(0, abs=1e-6) and strict["same"].error is None
    assert strict["less"].error == strict["far"].error == strict["none"].error == "selections differ" and strict["less"].rmsd is None
    flexible = {r.mobile_id: r for r in A.superpose_flexible(pairs, df, df, df.where("res_id = 2"), df.where("res_id = 2")).collect()}
    assert flexible["less"].rmsd == pytest.approx(0, abs=1e-6) and flexible["less"].distance == pytest.approx(0, abs=1e-6)
    assert flexible["far"].n == 35 and flexible["far"].distance is None


def test_areas_by_cells_and_components():
    rng = np.random.default_rng(0)
    xyz, elements = rng.normal(0, 8, (120, 3)), rng.choice(["C", "N", "QQ"], 120).tolist()
    got = surface_areas(xyz, elements, points=50)
    from strandworks.functions.kernels import sphere

    for i, e in enumerate(elements):
        if e == "QQ":
            assert np.isnan(got[i])
            continue
        r = RADII[e] + 1.4
        dots = xyz[i] + sphere(50) * r
        free = sum(all(np.linalg.norm(d - xyz[j]) >= RADII[f] + 1.4 for j, f in enumerate(elements) if j != i and f != "QQ") for d in dots)
        assert got[i] == pytest.approx(4 * np.pi * r * r * free / 50)
    names, least = components(np.array([9, 3, 3, 20]), np.array([5, 5, 3, 21]))
    assert dict(zip(names.tolist(), least.tolist())) == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20}


def test_comparable(spark):
    a = structure("s", 1)
    b = [(*r[:5], "QQ" if r[1] == 2 else r[5], *r[6:]) for r in a]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    moved = df(a).withColumn("x", F.col("x") + 5)
    same = lambda x, y: A.comparable(x, y).first().same
    assert same(df(a), moved) and not same(df(a), df(b)) and not same(df(a), df(a[:-1]))
