import logging
import random

import pytest
from pyspark.sql import functions as F

from strandworks.config import ConstructorConfig, quiet
from strandworks.errors import ConfigError
from strandworks.functions.extension import chain_kind
from strandworks.operators import msa as M
from strandworks.operators.collection import Catalog, Constructor
from strandworks.operators.interface import parse_partners, partner_columns
from strandworks.plans.rank import ranked
from strandworks.sources import services

MSA = "msa_id string, ord int, seq_id long, aligned string"


def test_star_alignment_keeps_letters_and_columns(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(40))
    cut = lambda s: "".join(c for c in s if rng.random() > 0.1)
    rows = [("m", k, s) for k, s in enumerate([base, cut(base), cut(base), base[:20] + "WWW" + base[20:], "", None])] + [("one", 9, "ACD"), ("none", 10, None)]
    got = {r.seq_id: r.aligned for r in M.star_align(spark.createDataFrame(rows, "msa_id string, seq_id long, s string")).collect()}
    assert {k: v.replace("-", "") for k, v in got.items()} == {k: s or "" for _, k, s in rows}
    assert len({len(got[k]) for k in range(6)}) == 1 and got[9] == "ACD" and got[10] == ""
    # equal stretches of the longest and another row stand in the same columns
    assert sum(x == y for x, y in zip(got[0], got[3])) == 40


def test_added_rows_keep_the_columns(spark):
    rows = [("m", 1, 1, "AC-DEFGHIK"), ("m", 2, 2, "ACWDEF-HIK"), ("m", 3, 3, "AC-DEFGHIK")]
    new = [("m", 7, "ACDEFGHIK"), ("m", 8, "ACDEFWWWGHIK"), ("x", 9, "AC"), ("m", 10, None)]
    got = {r.seq_id: r for r in M.add_rows(spark.createDataFrame(rows, MSA), spark.createDataFrame(new, "msa_id string, seq_id long, s string")).collect()}
    assert sorted(got) == [7, 8] and all(len(r.aligned) == 10 for r in got.values())
    assert got[7].aligned == "AC-DEFGHIK" and got[7].n_dropped == 0 and got[8].n_dropped == 2 or got[8].n_dropped == 3


def test_gap_columns_with_inner_gaps(spark):
    rows = [("m", 1, 1, "A--C-"), ("m", 2, 2, "AB-C-"), ("n", 1, 3, "AC")]
    df = spark.createDataFrame(rows, MSA)
    cut = lambda f: {r.seq_id: r.aligned for r in M.remove_gap_columns(df, f).collect()}
    assert cut(1.0) == {1: "A-C", 2: "ABC", 3: "AC"} and cut(0.5) == {1: "AC", 2: "AC", 3: "AC"} and cut(0.0) == {1: "", 2: "", 3: ""}


def test_columns_and_numbers_of_rows(spark):
    df = spark.createDataFrame([("m", 1, 1, "-C-DE"), ("m", 2, 2, "ACWD-")], MSA)
    whole = spark.createDataFrame([(1, "AACDEF"), (2, "XX")], "seq_id long, s string")
    assert sorted((r.i, r.col) for r in M.annotate_columns(df, whole).collect()) == [(3, 2), (4, 4), (5, 5)]
    pair = spark.createDataFrame([(1, "-C-DE", "ACWD-")], "k long, a string, b string")
    assert [(r.n1, r.n2) for r in sorted(M.pair_numbering(pair, "k", "a", "b").collect(), key=lambda r: r.col)] == [(None, 1), (1, 2), (None, 3), (2, 4), (3, None)]


def test_ranks(spark):
    values = [5, 3, 3, None, 9, 1]
    got = ranked(spark.createDataFrame([(v,) for v in values], "v int").repartition(4), F.asc_nulls_last("v")).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.ord)] == [1, 3, 3, 5, 9, None] and sorted(r.ord for r in got) == [1, 2, 3, 4, 5, 6]
    assert ranked(spark.createDataFrame([], "v int"), "v").count() == 0


def test_programs(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "k long, t string")
    run = lambda *c, **k: {r.k: r for r in services.run_command(df, "k", "t", list(c), **k).collect()}
    assert run("cat")[1].output == "abc" and not run("cat")[2].ok
    assert "ended with 3" in run("sh", "-c", "echo no >&2; exit 3")[1].error
    assert "longer" in run("sleep", "5", timeout=0.2)[1].error and "not installed" in run("no-such-program")[1].error


def test_stored_responses(spark):
    texts = ['{"search": {"mapping": {"mapped": [{"gene": "H|UniProtKB=P1", "target_gene": "MOUSE|UniProtKB=Q1", "ortholog": "LDO"}]}}}', "{}", "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [tuple(r) for r in services.orthologs(df, "text").collect()] == [("P1", "Q1", "LDO", "MOUSE")]
    info = services.info_fields(spark.createDataFrame([("a", '{"x": {"y": 1}}'), ("b", None)], "id string, t string"), "id", "t", {"y": "$.x.y"})
    assert sorted(tuple(r) for r in info.collect()) == [("a", "1"), ("b", None)]
    with pytest.raises(KeyError):
        services.PDB.address("sequence", F.lit("a"))


def test_constructor_finds_the_batch_that_fails(spark, tmp_path):
    batches = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "id string, batch int")

    def build(items):
        chains = items.select("id", F.lit(1).alias("chain_type"), F.when(F.col("id") == "c", F.raise_error(F.lit("no c")).cast("int")).otherwise(F.lit(0)).alias("level"))
        return chains, spark.createDataFrame([], "parent_id string, child_id string")

    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    ledger = {r.batch: r for r in Constructor(catalog, build, "id").run(batches, stop_on_failure=False).collect()}
    assert sorted(ledger) == [0, 1, 2] and ledger[1].failed and ledger[0].items_out == 2 and not ledger[2].failed
    assert {r.id for r in catalog.table("chains").collect()} == {"a", "b", "d"}
    healed = lambda items: (items.select("id", F.lit(1).alias("chain_type"), F.lit(0).alias("level")), build(items)[1])
    Constructor(catalog, healed, "id").resume(batches)
    assert {r.id for r in catalog.table("chains").collect()} == {"a", "b", "c", "d"}


def test_settings_guards_and_partners(spark, caplog):
    with pytest.raises(ConfigError):
        ConstructorConfig().paths()
    with pytest.raises(ConfigError):
        ConstructorConfig(output="x", batch_size=0).validate()
    assert ConstructorConfig(output="/a/").paths()["sequence_files"] == "/a/sequences"
    with quiet():
        logging.getLogger("x").error("unheard")
    logging.getLogger("x").error("heard")
    assert [r.message for r in caplog.records if r.name == "x"] == ["heard"]
    assert chain_kind(spark.createDataFrame([], "seq_id long, s string")) == "sequence" and chain_kind(spark.range(1)) is None
    texts = ["A_BC", "AB_", "_A", "AB", "AB_BC", "", "ABC_D"]
    got = {r.t: r for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", *partner_columns(F.col("t"))).collect()}
    for t in texts:
        try:
            sides, error = parse_partners(t), None
            assert (got[t].side_a, got[t].side_b) == tuple("".join(s) for s in sides)
        except ValueError as e:
            error = {"MissingData": "missing", "AmbiguousData": "shared"}[type(e).__name__]
        assert got[t].error == error
