import hashlib
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandworks.operators.compaction import _checksums, compact, consolidate_files
from strandworks.plans.scratch import finish_swap, swap_files
from strandworks.operators.orphans import beyond_runs, key_runs, orphan_references
from strandworks.operators.periods import BLOCK, periods_and_gaps


def brute_periods(rows):
    covered = {}
    for k, s, e in rows:
        if None not in (k, s, e) and 1 <= s <= e:
            covered.setdefault(k, set()).update(range(s, e + 1))
    out = set()
    for k, cells in covered.items():
        cells = sorted(cells)
        first = last = cells[0]
        for c in cells[1:] + [None]:
            if c != last + 1 if c is not None else True:
                out.add((k, "period", first, last))
                if c is not None:
                    out.add((k, "gap", last + 1, c - 1))
                    first = c
            last = c
    return out


@pytest.mark.parametrize("seed", range(3))
def test_periods(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), s := rng.choice([rng.randrange(-2, 90), None]), None if s is None else s + rng.randrange(-2, 9)) for _ in range(120)]
    rows += [("edge", BLOCK - 3, BLOCK + 2), ("edge", BLOCK, BLOCK), ("edge", BLOCK + 3, BLOCK + 3), ("edge", BLOCK - 9, BLOCK - 4), ("edge", BLOCK + 9, BLOCK + 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "key string, lo int, hi int, k string, s int")
    got = [tuple(r) for r in periods_and_gaps(df, "key", "lo", "hi").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(rows)


def test_periods_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], "key string, lo int, hi int"), "key", "lo", "hi").count() == 0


def test_compaction_parses_and_keeps_each_record_once(spark):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    rows = [
        ("a/x.fasta", "sequence_files", "junk\n>id1 desc\nAC d\n\nEF\r\n>id2\n>id3 q\r\ngg\rhh"),
        ("b/x.fasta", "sequence_files", ">id1\nACDEF"),
        ("b/x.fasta", "sequence_files", ">id1\nACDEG"),
        ("c.fasta", "sequence_files", ""),
        ("c.fasta", "sequence_files", None),
        ("c.fasta", "sequence_files", ">only\n \n"),
        ("s/P1.cif.gz", "structure_files", "  a \t b\n\nc "),
        ("t/P1.cif", "structure_files", "a b c"),
        ("t/P2", "structure_files", " \n"),
        (None, "structure_files", "z"),
        ("q", "elsewhere", "z"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_path string, area string, content string, body string")
    got = [(r.area, r.record_id, r.content_md5) for r in consolidate_files(df, target_bytes=16).collect()]
    want = {("sequence_files", i, md5(s)) for i, s in [("id1", "ACDEF"), ("id1", "ACDEG"), ("id3", "GGHH")]}
    want |= {("structure_files", "P1", md5("a b c")), ("structure_files", None, md5("z"))}
    assert len(got) == len(want) and set(got) == want
    assert consolidate_files(df.limit(0)).count() == 0


def test_compact_sizes_order_and_swap(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    df = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    assert compact(df, path, ["id"], target_bytes=200_000) > 1
    files = [p for p in (tmp_path / "table").iterdir() if p.suffix == ".parquet"]
    assert 1 < len(files) <= 6
    compact(spark.read.parquet(path).where("id < 100"), path, ["id"])
    assert spark.read.parquet(path).count() == 100
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_checksums_pass_the_range_of_a_long(spark):
    """Digests of one sign add up past 2**63 within a few rows."""
    ids = [r.id for r in spark.range(400).where(F.xxhash64("id") > (1 << 62)).collect()]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    sums = df.agg(*[c.alias(k) for k, c in _checksums(["id"]).items()]).first()
    assert sums.n == len(ids) and sums.added > 1 << 63
    assert sums.folded != df.where(F.col("id") != ids[0]).agg(_checksums(["id"])["folded"]).first()[0]


def test_a_swap_that_broke_off_is_carried_to_its_end(spark, tmp_path, monkeypatch):
    import strandworks.plans.scratch as S

    path = f"file://{tmp_path}/table"
    spark.range(10).coalesce(1).write.parquet(path)
    spark.range(20, 25).coalesce(1).write.parquet(f"{path}/.staging-x")
    with monkeypatch.context() as m:
        m.setattr(S, "finish_swap", lambda *_: None)
        swap_files(spark, f"{path}/.staging-x", path)
    assert spark.read.parquet(path).count() == 10
    finish_swap(spark, path)
    finish_swap(spark, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [20, 21, 22, 23, 24]
    assert not [p.name for p in (tmp_path / "table").iterdir() if "staging" in p.name or p.name == "_swap"]


def test_runs_and_as_of(spark):
    have = sorted({1, 2, 3, 7, 65535, 65536, 65537, 200000})
    codes = spark.createDataFrame([(c,) for c in have], "code long")
    wanted = spark.createDataFrame([(c,) for c in [0, 1, 3, 4, 7, 8, 65536, 65538, 199999, 200000]], "code long")
    assert sorted(r.code for r in beyond_runs(wanted, key_runs(codes)).collect()) == [0, 4, 8, 65538, 199999]


def test_orphans(spark):
    t = lambda m, d=1: datetime(2024, m, d)
    refs = [("f", " a", t(1)), ("f", "a", t(3)), ("f", "gone", t(2)), ("f", "no", t(2)), ("f", "no", None), ("g", "no", t(2)), ("f", None, t(1)), ("f", "A", t(1)), ("f", "when", t(1)), ("f", "no", t(2, 9))]
    targets = [("a ", t(2), None), ("a", t(4), t(5)), ("gone", t(1), t(2)), ("gone", None, t(2)), ("when", None, None), (None, t(1), None)]
    got = orphan_references(
        spark.createDataFrame([(*r, "x") for r in refs], "ref_field string, key string, at timestamp, code string"),
        spark.createDataFrame([(*r, "x") for r in targets], "key string, added timestamp, removed timestamp, month string"),
    )
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(
        [
            ("f", "a", "late", "2024-01"),
            ("f", "gone", "deleted", "2024-02"),
            ("f", "no", "missing", "2024-02"),
            ("f", "no", "missing", "unknown"),
            ("g", "no", "missing", "2024-02"),
            ("f", "A", "missing", "2024-01"),
        ]
    )
    empty = spark.createDataFrame([], "ref_field string, key string, at timestamp")
    none = spark.createDataFrame([], "key string, added timestamp, removed timestamp")
    assert orphan_references(empty, none).count() == 0
    assert re.fullmatch("missing", orphan_references(spark.createDataFrame([("f", "a", None)], empty.schema), none).first().kind)
