"""Operators on whole objects: the same rows as by positions, and no position is broadcast or shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandworks.functions.kernels import _scores, align_pair, align_pairs
from strandworks.operators import residues as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("packed"))
    rng = random.Random(3)
    rows = [(k, f"c{k % 7}" if k % 5 else None, 3, 90, "".join(rng.choice("ACDWX") for _ in range(k)) if k % 11 else None, None) for k in range(60)]
    rows += [(100, "c1", 5, 6, "wxXW", None), (101, "c1", 5, 6, "-x*\nA", None)]
    spark.createDataFrame(rows, "seq_id long, chain_id string, seq_start int, seq_end int, seq1 string, added_at timestamp").write.parquet(f"{d}/chain_sequences.parquet")
    return d


def _by_sql(folder, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view chain_sequences as select * from '{folder}/chain_sequences.parquet/*.parquet'")
    return sorted(c.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def _check(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    assert "Broadcast" not in _plan(df) and "Join" not in _plan(df)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == _by_sql(folder, name)


def test_numbering_relate_broadcasts_nothing(spark, folder):
    _check(spark, folder, "op_2_4_1_numbering_relate")


def test_packed_relation_is_that_of_positions(spark):
    rng = random.Random(1)
    pick = lambda: rng.choice([None, 1, 2, 3, 5, 2**31 - 1, -(2**31)])
    sizes = [0, 1, 2, 7, 40]
    objects = [(o, [pick() for _ in range(n)], [pick() if o % 2 else rng.choice([1, 2]) for _ in range(n)], [rng.choice([None, "A", "C", "é"]) for _ in range(n)]) for o, n in enumerate(sizes * 3)]
    df = spark.createDataFrame(objects, "o int, l array<int>, k array<int>, v array<string>")
    flat = spark.createDataFrame([(o, i + 1, a, b, c) for o, l, k, v in objects for i, (a, b, c) in enumerate(zip(l, k, v))], "o int, i int, l int, k int, v string")
    want = sorted(((r.o, r.i, r.w) for r in R.relate(flat, flat, "o", "l", "k", "v", "w").collect()), key=repr)
    out = R.relate_packed(df, ["o"], F.col("l"), F.col("k"), F.col("v"), "w").collect()
    assert sorted(((r.o, i + 1, w) for r in out for i, w in enumerate(r.w)), key=repr) == want
    assert len(out) == len(objects)


def test_relations_and_patches_of_positions_broadcast_nothing(spark):
    df = spark.createDataFrame([("x", 1, 10, "a")], "o string, i int, k int, v string")
    assert "Broadcast" not in _plan(R.relate(df, df, "o", "k", "k", "v", "w"))
    assert "Broadcast" not in _plan(R.patch(df, df.select("o", "i", "v"), "o", "k", "k", "v"))


def test_map_transfer_broadcasts_nothing(spark, folder):
    _check(spark, folder, "op_2_4_5_map_transfer")


def test_patch_broadcasts_nothing(spark, folder):
    _check(spark, folder, "op_2_4_3_patch")


def test_packed_patch_is_that_of_positions(spark):
    rng = random.Random(2)
    objects = []
    for o in range(40):
        n = rng.randrange(0, 9)
        at, number = sorted(rng.sample(range(-2, 25), n)), sorted(rng.sample(range(50), n))
        hole = lambda xs: [None if rng.random() < 0.15 else x for x in xs]
        objects.append((o, hole(number), hole(at if o % 4 else at[::-1]), list("abcdefghi"[:n]), list("ABCDEFGHIJKLMNOPQRSTUVW"[: rng.randrange(0, 23)])))
    df = spark.createDataFrame(objects, "o int, n array<int>, l array<int>, c array<string>, t array<string>")
    flat = spark.createDataFrame([(x[0], i + 1, *y) for x in objects for i, y in enumerate(zip(*x[1:4]))], "o int, i int, n int, l int, c string")
    template = spark.createDataFrame([(x[0], i + 1, c) for x in objects for i, c in enumerate(x[4])], "o int, i int, c string")
    want = sorted((r.o, r.i, r.c, r.patched) for r in R.patch(flat, template, "o", "n", "l", "c").collect())
    out = R.patch_packed(df, ["o"], F.col("n"), F.col("l"), F.col("c"), F.col("t")).collect()
    assert any(p for *_, p in want)
    assert sorted((r.o, i + 1, c, p) for r in out for i, (c, p) in enumerate(zip(r.letters, r.patched))) == want


def test_patched_sequences_broadcast_nothing(spark, folder):
    _check(spark, folder, "op_2_4_4_patched_sequences")


@pytest.fixture(scope="module")
def segments(spark, tmp_path_factory):
    """Segments that overlap, nest, touch, leave holes and have a longer or shorter other side."""
    d = str(tmp_path_factory.mktemp("segments"))
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        s, p, n, m = rng.randrange(-1, 30), rng.randrange(-1, 40), rng.randrange(-1, 12), rng.randrange(-1, 12)
        pdb, chain, u = rng.choice(["1abc", " 1ABC ", "2abc", "3abc", None]), rng.choice(["A", "B", "C"]), rng.choice(["p1", "P1", "P2", " P3", None])
        rows.append((f"{pdb}:{chain}".upper() if pdb else None, pdb, chain, u, p, p + m, s, s + n))
    spark.createDataFrame(rows, "pdb_chain string, pdb string, chain string, uniprot_id string, pdb_start int, pdb_end int, uniprot_start int, uniprot_end int").write.parquet(f"{d}/sifts.parquet")
    return d


def _check_segments(spark, d, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view sifts as select * from '{d}/sifts.parquet/*.parquet'")
    df = entry.queries()[name](spark, d)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(c.execute(entry.oracle_sql()[name]).fetchall(), key=repr)
    return _plan(df)


def test_sifts_numbering_counts_stretches_not_positions(spark, segments):
    plan = _check_segments(spark, segments, "op_2_4_8_sifts_numbering")
    assert "Generate" not in plan and "Join" not in plan


def test_segment_numbering_shuffles_no_positions(spark, segments):
    plan = _check_segments(spark, segments, "op_2_4_7_segment_numbering")
    assert "Join" not in plan and "Exchange" not in plan.split("Generate explode")[0]


def test_segments_are_shuffled_once_for_their_numbering(spark, segments, tmp_path):
    plan = _check_segments(spark, segments, "op_2_4_7_segment_numbering").split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    # a segment that is there again and again is one
    rows = spark.read.parquet(f"{segments}/sifts.parquet")
    rows.unionByName(rows).unionByName(rows.limit(30)).repartition(5).write.parquet(f"{tmp_path}/sifts.parquet")
    _check_segments(spark, str(tmp_path), "op_2_4_7_segment_numbering")


def test_a_long_item_is_read_once(spark):
    from strandworks.operators import collection as C

    item = "X=>" + ";".join(f"{k}ABC:A,B" for k in range(3000))
    df = C.parse_items(spark.createDataFrame([(item,)], "item string"), "item").select("seq_id", "str_id", "chain_id")
    assert {tuple(r) for r in df.collect()} == {("X", f"{k}ABC", c) for k in range(3000) for c in "AB"}
    rows = spark.createDataFrame([(item,)], "item string").repartition(2)
    above = C.parse_items(rows, "item").select("seq_id", "str_id", "chain_id")._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(ss")[0]
    assert "=>" not in above


def test_profile_build_joins_no_cells(spark, folder):
    from strandworks.operators import profiles as P
    from strandworks.queries.msa_and_variables import msa

    df = entry.queries()["op_2_6_7_profile_build"](spark, folder)
    assert "Join" not in _plan(df) and "Generate" not in _plan(df)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == _by_sql(folder, "op_2_6_7_profile_build")
    packed, table = P.build_packed(msa(spark, folder)), P.build(msa(spark, folder))
    assert sorted(map(tuple, P.pack(table).collect())) == sorted(map(tuple, packed.collect()))
    # ragged rows: a column counts the rows that reach it; half gaps stay, more go
    ragged = spark.createDataFrame([("x", "A-C"), ("x", "A-CD"), ("x", "AG-"), ("y", ""), ("z", "--"), (None, "A"), ("v", None)], "msa_id string, aligned string")
    (row,) = P.build_packed(ragged).collect()
    assert (row.msa_id, row.m, len(row.scores)) == ("x", 3, 60)
    assert row.scores[0] == pytest.approx(math.log(3.05 / 4 * 20)) and row.scores[42] == pytest.approx(math.log(1.05 / 2 * 20))


def test_profile_search_broadcasts_nothing(spark, folder):
    plan = _plan(entry.queries()["op_2_6_8_profile_search"](spark, folder))
    assert "Broadcast" not in plan and "Generate" not in plan


def test_profile_search_takes_profiles_in_blocks(spark, folder, monkeypatch):
    import numpy as np

    from strandworks.functions.kernels import GAP_OPEN, LETTERS, best_ungapped, profile_bounds, profile_codes, profile_columns, profile_matches, profile_score, profile_scores
    from strandworks.operators import profiles as P

    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(LETTERS + "X") for _ in range(n))
    cores = [text(n) for n in (1, 3, 30, 80, 200)]
    seqs = ["A", "X" * 9, *cores, *[text(9) + c[: len(c) // 2] + text(4) + c[len(c) // 2 + 3 :] for c in cores], cores[3] + cores[4] + cores[3]]
    grids = [np.where(np.array(list(c))[:, None] == np.array(list(LETTERS)), 2.35, -0.7) for c in cores]
    codes, begins = profile_codes(seqs)
    for s, b in zip(seqs, begins.tolist()):
        own = codes[b : b + len(s)]
        assert profile_scores(own, grids) == pytest.approx([profile_score(own, g) for g in grids])
        free = [best_ungapped(*profile_codes([s]), g)[0] for g in grids]
        near = set(profile_bounds(own, profile_columns(grids), -GAP_OPEN - 1e-3).tolist())
        assert {k for k, x in enumerate(free) if x > -GAP_OPEN - 1e-3} <= near <= {k for k, x in enumerate(free) if x > -GAP_OPEN - 0.5}
    # blocks smaller than any profile, and one block of all, give the matches of each pair alone
    table = spark.createDataFrame([(f"p{k}", len(g), g.ravel().tolist()) for k, g in enumerate(grids)], "msa_id string, m int, scores array<double>")
    rows = spark.createDataFrame(list(enumerate(seqs)), "k long, s string")
    want = sorted((i, f"p{k}", n, *m, len(g)) for i, s in enumerate(seqs) for k, g in enumerate(grids) for n, m in enumerate(profile_matches(s, g, 20.0), 1))
    assert len(want) > 8
    met = []
    for size in (1, 1 << 15):
        monkeypatch.setattr(P, "COLUMNS", size)
        met.append(P._pack_profiles(table.coalesce(1)).count())
        assert sorted(map(tuple, P.search(rows, "k", "s", table).collect())) == want
    assert met == [len(grids), 1]


def test_profile_annotate_broadcasts_nothing(spark, folder):
    assert "Broadcast" not in _plan(entry.queries()["op_2_6_9_profile_annotate"](spark, folder))


def test_pairs_aligned_at_once_are_those_aligned_alone():
    rng = random.Random(0)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", ""), ("", "AX"), ("WX", ""), ("XXXX", "XXXX"), ("aé-x", "A-ÿb"), (text("ACDEFGX", 700), text("ACDEFGX", 1500))]
    for n in [1, 2, 5, 20, 60] * 12:
        a = text(rng.choice(["ACDEFGHIKLMNPQRSTVWYX", "AX", "AC"]), n)
        k = rng.randrange(n)
        pairs += [(a, a), (a, a[:k] + a[k + 3 :]), (a[:k] + "WW" + a[k:], a), (a, text("ACWX", rng.randrange(80)))]
    assert align_pairs(pairs) == [align_pair(a, b) for a, b in pairs]
    assert align_pairs(pairs[:200], gap=-1) == [align_pair(a, b, gap=-1) for a, b in pairs[:200]]


def test_a_text_and_itself_need_no_table():
    matrix, _ = _scores()
    own = matrix.diagonal()
    assert (2 * matrix <= own[:, None] + own[None, :]).all()
    long = "ACDX" * 50_000  # a table of 40 billion cells
    assert align_pairs([(long, long)]) == [(long, long, 50_000 * (4 + 9 + 6 - 1))]


def test_star_alignment_aligns_once_and_shuffles_rows_once(spark, monkeypatch):
    import pyarrow as pa

    from strandworks.operators import msa as M

    rows = [("a", 1, "ACDEFG"), ("a", 2, "ACWWDEFG"), ("a", 3, "DEFG"), ("a", 4, None), ("a", 5, "ACDEFGKK"), ("b", 6, "AC"), ("c", 7, ""), ("c", 8, None), (None, 9, "AC")]
    rows += [("d", k, "ACDEFGHIKL"[: 3 + k % 8] + "W" * (k % 3)) for k in range(20, 60)]
    df = M.star_align(spark.createDataFrame(rows, "msa_id string, seq_id long, s string"))
    plan = _plan(df)
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
    out = {r.seq_id: (r.msa_id, r.aligned) for r in df.collect()}
    assert {k: v[1].replace("-", "") for k, v in out.items()} == {k: s or "" for m, k, s in rows if m}
    assert all(len({len(v[1]) for v in out.values() if v[0] == m}) == 1 for m in "abcd")
    # rows that wait in a file come out as those that wait in memory
    ordered = sorted((r for r in rows if r[0]), key=lambda r: (r[0], -len(r[2] or ""), r[1]))
    centre = {}
    for m, _, s in ordered:
        centre.setdefault(m, s or "")
    batch = pa.RecordBatch.from_pylist([{"msa_id": m, "seq_id": k, "s": s or "", "centre": centre[m]} for m, k, s in ordered])
    monkeypatch.setattr(M, "HELD", 15)
    filed = [r for b in M._star(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]
    assert {r["seq_id"]: (r["msa_id"], r["aligned"]) for r in filed} == out and len(filed) == len(out)
