import gzip
import math

import pytest
from pyspark.sql import functions as F

from strandworks.operators import atoms as A
from strandworks.operators import interface as I
from strandworks.operators.pocket import FormatError, pocket
from strandworks.sources import fasta, records
from strandworks.sources import structure_text as S

CIF = """data_X
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . ALA A 5 1.0 2.0 3.0 1
HETATM 2 O "O5'" B LIG B 7 -1.5 0.25 9 1
ATOM 3 C CA . ALA A 5 1.0 2.0 4.0 2
#
"""


def atom_rows(spark, rows):
    schema = "structure_id string, atom_idx int, chain_id string, res_id int, res_name string, atom_name string, element string, altloc_id string, x double, y double, z double"
    return spark.createDataFrame(rows, schema)


def test_mmcif_pdb_and_gzip(spark, tmp_path):
    rows = S.parse_mmcif(CIF, "X")
    assert [(r[2], r[3], r[5], r[6], r[8], r[9], r[10]) for r in rows] == [("A", 5, "ALA", "N", False, "", 1.0), ("B", 7, "LIG", "O5'", True, "B", -1.5)]
    (tmp_path / "X.cif").write_text(CIF)
    (tmp_path / "Y.cif.gz").write_bytes(gzip.compress(CIF.encode()))
    (tmp_path / "Z.pdb").write_text(S.format_pdb(rows))
    got = S.read_structures(spark, f"file://{tmp_path}").orderBy("structure_id", "atom_idx").collect()
    assert [r.structure_id for r in got] == ["X", "X", "Y", "Y", "Z", "Z"]
    assert [tuple(r)[1:] for r in got[:2]] == [tuple(r)[1:] for r in got[4:]]
    assert S.parse_mmcif("", "E") == [] and S.parse_pdb("HEADER", "E") == []


def test_fasta_scan_data_source_and_writer(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">seq1 first\nMKVLA\nAGIK\n\n>seq2\nMKTAY\n")
    want = {("seq1", "MKVLAAGIK"), ("seq2", "MKTAY")}
    assert {(r.seq_id, r.seq1) for r in fasta.read_fasta(spark, f"file://{tmp_path}").collect()} == want
    assert {r.seq_id for r in fasta.read_fasta(spark, f"file://{tmp_path}", strip_id=False).collect()} == {"seq1 first", "seq2"}
    spark.dataSource.register(fasta.FastaDataSource)
    assert {(r.seq_id, r.seq1) for r in spark.read.format("fasta").option("path", f"{tmp_path}/*.fasta").load().collect()} == want


def test_dihedral_sign_and_value(spark):
    pts = [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (math.cos(0.7), math.sin(0.7), 1.0)]
    df = spark.range(1).select(A.dihedral([tuple(F.lit(v) for v in p) for p in pts]).alias("a"))
    assert df.first().a == pytest.approx(0.7)


def test_grid_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(f"s{i % 2}", i, "A", i // 4, "ALA", "CA", "C", "", *(rng.uniform(-9, 9) for _ in range(3))) for i in range(120)]
    df = atom_rows(spark, rows)
    for cutoff in (1.0, 4.0, 30.0):
        got = {(r.structure_id, r.a, r.b) for r in A.grid_pairs(df, df, cutoff).collect()}
        want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and math.dist(p[8:], q[8:]) <= cutoff}
        assert got == want
    assert A.grid_pairs(df.limit(0), df, 3.0).count() == 0


def test_observed_atoms(spark):
    full = ["N", "CA", "C", "O", "CB", "OG"]
    rows = [("s", k, "A", 1, "SER", n, n[:1], "", 0.0, 0.0, 0.0) for k, n in enumerate(full[:-2])]
    rows += [("s", 20 + k, "A", 2, "SER", n, n[:1], "", 0.0, 0.0, 0.0) for k, n in enumerate([*full, "OXT"])] + [("s", 40, "A", 3, "UNX", "Q", "Q", "", 0.0, 0.0, 0.0)]
    got = {r.res_id: (r.missing, r.observed) for r in A.observed_fraction(atom_rows(spark, rows)).collect()}
    assert got[1] == ("CB,OG", pytest.approx(4 / 6)) and got[2] == ("", 1.0) and got[3][1] is None


def test_covalent_mark_and_bonds(spark):
    rows = [("s", 0, "A", 1, "ALA", "C", "C", "", 0.0, 0.0, 0.0), ("s", 1, "A", 2, "UNK", "N", "N", "", 1.33, 0.0, 0.0), ("s", 2, "A", 3, "UNK", "N", "N", "", 9.0, 0.0, 0.0), ("s", 3, "A", 4, "HOH", "O", "O", "", 5.0, 5.0, 5.0)]
    got = {r.atom_idx: r.mark for r in A.mark_atoms(atom_rows(spark, rows)).collect()}
    assert got == {0: 8, 1: 4 | 64, 2: 4, 3: 2}
    alt = [(*r[:7], a, *r[8:]) for r, a in zip(rows[:2], "AB")]
    assert A.covalent_bonds(atom_rows(spark, rows)).count() == 1 and A.covalent_bonds(atom_rows(spark, alt)).count() == 0


def test_component_marks(spark):
    def chain(ch, first, k, names, y, hetero=False):
        return [("s", first + i, ch, k + i // 3, names[i // 3], f"C{i % 3}", "C", "", 1.5 * i, y, 0.0, hetero) for i in range(3 * len(names))]

    rows = chain("A", 0, 1, ["ALA"] * 6, 0.0) + chain("B", 20, 1, ["NAG", "NAG"], 4.0) + chain("C", 30, 1, ["DA", "DC"], -4.0)
    rows += chain("D", 40, 1, ["UNX"], 80.0) + chain("E", 50, 1, ["QQQ"] * 2, 90.0) + [("s", 60, "F", 1, "HOH", "O", "O", "", 0.0, 50.0, 0.0, True)]
    rows += [("s", 70 + i, "G", 1, "QQQ", f"C{i}", "C", "", 1.5 * i, 0.0, 4.0, True) for i in range(6)]
    plain = atom_rows(spark, [r[:11] for r in rows])
    flags = spark.createDataFrame([(r[1], r[11]) for r in rows], "atom_idx int, h boolean")
    got = {r.atom_idx: r.mark for r in A.mark_components(plain.join(flags, "atom_idx").withColumn("hetero", F.col("h"))).collect()}
    assert [got[i] for i in (0, 17, 20, 25, 30, 35, 50, 60, 70)] == [8, 8, 4 | 32, 4 | 32, 4 | 16, 4 | 16, 1, 2, 4]


def test_observed_query_has_every_residue(spark):
    import __spark_entry__ as e

    got = e.queries()["op_2_5_15_observed_fractions"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 8 * 64 and any(r.observed is None for r in got) and any(r.missing for r in got)


def test_families(spark):
    dat = "".join(f"# STOCKHOLM 1.0\n#=GF ID   n{k}\n#=GF AC   PF{k}.2\n#=GF DE   two words\n#=GF GA   1; 1;\n#=GF TP   {t}\n//\n" for k, t in ((1, "Family"), (7000, "Domain"), (8000, "Family")))
    hmm = "".join(f"HMMER3/f\nNAME  m{k}\nACC   PF{k}.5\nLENG  {k}\n//\n" for k in (1, 7000, 9000))
    texts = spark.createDataFrame([("f", dat, hmm)], "f string, dat string, hmm string")
    sides = records.parse_families(texts, "f", "dat"), records.parse_models(texts, "f", "hmm")
    got = sorted(tuple(r) for r in records.read_families(*sides).collect())
    assert got == [("PF1", "n1", "two words", "Family", "m1", 1), ("PF7000", "n7000", "two words", "Domain", "m7000", 7000)]
    assert [r.acc for r in records.read_families(*sides, categories=["Domain"]).collect()] == ["PF7000"]
    assert [r.acc for r in records.read_families(*sides, accessions=["PF1"]).collect()] == ["PF1"]


def test_every_version_is_parsed(spark, tmp_path):
    import __spark_entry__ as e

    text = CIF.rstrip("#\n") + "\n#\n"
    rows = [("x/AB.cif", text), ("y/AB.cif", text.replace("1.0 2.0 3.0", "8.0 2.0 3.0")), ("z/AB.cif", text), ("z/CD.cif", None)]
    spark.createDataFrame([("structure_files", *r) for r in rows], "area string, file_path string, content string").write.parquet(str(tmp_path / "collection_files.parquet"))
    got = e.queries()["op_2_1_6_structure_versions"](spark, str(tmp_path)).collect()
    assert {r.structure_id for r in got} == {"AB"} and len({r.digest for r in got}) == 2 and {r.x for r in got} >= {1.0, 8.0}
    seen = e.queries()["op_2_1_25_component_versions"](spark, str(tmp_path)).collect()
    assert len({r.digest for r in seen}) == len(seen) == 2


def test_pocket_language(spark):
    df = spark.createDataFrame([(1, "CA", True, 3.0), (1, "CB", True, 4.0), (2, "CA", False, 9.0), (3, "CA", True, 5.5)], "res_id int, atom_name string, is_contact boolean, dist double")
    cases = {
        "c:1,2:any >= 2": True, "c:1:CA > 1": False, "cs:1,2,3:any = 2": True, "da:2,3:any <= 5.5": True, "daa:2,3:any <= 5.5": False,
        "daa:99:any < 1": True, "da:99:any < 1": False, "c:1:any > 5 | c:1:any >= 2 & cs:3:any >= 1": True, "(c:1:any > 5 | c:1:any >= 2) & cs:3:any != 1": False,
    }
    for text, want in cases.items():
        assert df.agg(pocket(text).alias("p")).first().p is want, text
    assert df.agg(pocket("c:10:any >= 2", {10: 1}).alias("p")).first().p is True
    for bad in ("c:1:any", "x:1:any > 1", "c:1:any > 1 &", "(c:1:any > 1", "__import__('os')"):
        with pytest.raises(FormatError):
            pocket(bad)


def test_partners_and_scores(spark):
    assert I.parse_partners("AB_C") == (["A", "B"], ["C"])
    with pytest.raises(I.MissingData):
        I.parse_partners("A_")
    with pytest.raises(I.AmbiguousData):
        I.parse_partners("AB_BC")
    row = spark.range(1).select(I.dockq(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("a"), I.dockq(F.lit(0.5), F.lit(2.0), F.lit(3.0)).alias("b"), I.dockq(F.lit(0.5), F.lit(2.0), F.lit(3.0), strict=True).alias("c")).first()
    assert row.a == 1 and row.b != row.c


def test_interface_states(spark):
    a = [(0, 0, 0), (4, 0, 0), (0, 4, 0), (0, 0, 4)]
    b = [(2, 0, 0), (0, 2, 0), (0, 0, 2), (30, 0, 0)]
    place = lambda s, ch, k, p: (s, k, ch, k, "ALA", f"X{k}", "C", "", *map(float, p))
    state = lambda s, pa, pb: [place(s, "A", k, p) for k, p in enumerate(pa)] + [place(s, "B", 4 + k, p) for k, p in enumerate(pb)]
    turn = lambda ps: [(3 - y, x - 5, z + 1) for x, y, z in ps]
    far = [*b[:3], (30, 0, 8)]
    ref = atom_rows(spark, state("rigid", a, b) + state("bent", a, b) + state("short", a, b) + state("few", a[:1] + [(90, 0, 0)] * 3, [(2, 0, 0)] + [(50, 0, 0)] * 3))
    mob = atom_rows(spark, state("rigid", turn(a), turn(b)) + state("bent", turn(a), turn(far)) + state("short", a, b)[:-1] + state("few", a[:1] + [(90, 0, 0)] * 3, [(2, 0, 0)] + [(50, 0, 0)] * 3))
    got = {r.structure_id: r for r in I.compare_states(ref, mob, "A_B", 5.0).collect()}
    assert got["rigid"].n_superposed == 7
    assert [getattr(got["rigid"], c) for c in ("superposed_rmsd", "irmsd", "lrmsd")] == pytest.approx([0] * 3, abs=1e-9) and got["rigid"].dockq == pytest.approx(1)
    # the atom that moved by 8 is no contact atom, but one of four of the ligand
    assert (got["bent"].irmsd, got["bent"].lrmsd, got["bent"].fnat) == (pytest.approx(0, abs=1e-9), pytest.approx(4), 1)
    assert got["bent"].dockq == pytest.approx((2 + 1 / (1 + (4 / 1.5) ** 2)) / 3)
    assert got["short"].error == "states are not comparable" and got["few"].error == "2 atoms to superpose" and got["few"].dockq is None


def test_record_formats(spark):
    lines = spark.createDataFrame([("f", 0, ">Cluster 0"), ("f", 1, "0\t9aa, >a... *"), ("f", 2, "1\t9aa, >b... at 99%"), ("f", 3, ">Cluster 1"), ("f", 4, "0\t9aa, >c... *")], "f string, k int, l string")
    assert {(r.cluster, r.member) for r in records.parse_clusters(lines, "f", "k", "l").collect()} == {(0, "a"), (0, "b"), (1, "c")}
    line = "    1    5 A M  H  >            0   0  120".ljust(136)
    row = records.parse_dssp(spark.createDataFrame([(line,), (" " * 136,)], "value string")).first()
    assert (row.num, row.res_id, row.chain_id, row.aa, row.ss3) == (1, 5, "A", "M", "H")
    comp = spark.createDataFrame([("ALA", "_chem_comp.id ALA\n_chem_comp.name 'ALANINE'\nloop_\n_a.x\n_a.y\n1 2\n3 4\n#\n"), ("E", None)], "id string, t string")
    got = {(r.grp, r.field, r.pos): r.value for r in records.parse_components(comp, "id", "t").collect()}
    assert got[("a", "y", 1)] == "4" and got[("chem_comp", "name", 0)] == "ALANINE"
