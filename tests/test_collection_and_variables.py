import pytest
from pyspark.sql import functions as F

from strandworks.config import Config
from strandworks.errors import ConfigError
from strandworks.operators import collection as C
from strandworks.operators import msa as M
from strandworks.operators import tree as T
from strandworks.operators import variables as V
from strandworks.streaming.ledger import ingest


def test_catalog_keeps_first_and_cascades(spark, tmp_path):
    cat = C.Catalog(spark, f"file://{tmp_path}/cat")
    cat.add(spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("b", 9, 9)], C.SCHEMAS["chains"]).limit(2), spark.createDataFrame([("a", "b")], C.SCHEMAS["parents"]))
    cat.add(spark.createDataFrame([("a", 7, 7), ("c", 3, 1)], C.SCHEMAS["chains"]))
    assert {tuple(r) for r in cat.table("chains").collect()} == {("a", 1, 0), ("b", 1, 1), ("c", 3, 1)}
    vs = spark.createDataFrame([("a", "v", "1", True), ("b", "v", None, False), ("zz", "v", "2", True)], C.SCHEMAS["variables"])
    cat.add_variables(vs)
    assert [r.chain_id for r in cat.table("variables").collect()] == ["a"]
    cat.update_variables(spark.createDataFrame([("a", "v", "5"), ("q", "v", "6")], "chain_id string, variable_id string, value string"))
    assert [(r.chain_id, r.value) for r in cat.table("variables").collect()] == [("a", "5")]
    assert {r.id for r in cat.ids(chain_type=3).collect()} == {"c"} and {r.id for r in cat.ids(level=1, chain_type=1).collect()} == {"b"}
    cat.remove(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))
    assert all(cat.table(n).count() == 0 for n in ("chains", "parents", "variables"))


def test_constructor_records_failures_and_resumes(spark, tmp_path):
    cat = C.Catalog(spark, f"file://{tmp_path}/cat")
    batches = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, batch int")
    state = {"fail": True}

    def build(items):
        if state["fail"] and items.where("id = 'b'").count():
            raise RuntimeError("boom")
        return items.select("id", F.lit(1).alias("chain_type"), F.lit(0).alias("level")), spark.createDataFrame([], C.SCHEMAS["parents"])

    job = C.Constructor(cat, build, "id")
    with pytest.raises(RuntimeError):
        job.run(batches)
    assert {r.id for r in cat.table("chains").collect()} == {"a"}
    job.run(batches, stop_on_failure=False)
    state["fail"] = False
    job.resume(batches)
    assert {r.id for r in cat.table("chains").collect()} == {"a", "b", "c"}
    assert cat.table("batches").where("failed").count() == 2


def test_stream_ingest_is_resumable(spark, tmp_path):
    src = f"{tmp_path}/in"
    cat = C.Catalog(spark, f"file://{tmp_path}/cat")
    build = lambda b: (b.select("id", F.lit(1).alias("chain_type"), F.lit(0).alias("level")), spark.createDataFrame([], C.SCHEMAS["parents"]))
    for ids in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(i,) for i in ids], "id string").write.mode("append").parquet(src)
        ingest(spark.readStream.schema("id string").parquet(src), cat, build, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.id for r in cat.table("chains").collect()) == ["a", "b", "c"]
    assert cat.table("batches").count() == 2


def test_item_grammar_round_trip(spark):
    df = spark.createDataFrame([("X=>1ABC:A;2ABC:A,B",), ("S1",), ("1ABC:A,B",), ("Y=>1ABC",)], "item string")
    rows = C.parse_items(df, "item")
    assert rows.where("item = 'X=>1ABC:A;2ABC:A,B'").count() == 3
    assert {r.item for r in C.format_items(rows.where("seq_id is not null")).collect()} == {"X=>1ABC:A;2ABC:A,B", "Y=>1ABC"}


def test_variables_are_parsed_not_evaluated(spark):
    df = spark.createDataFrame([("o", "ACDEG"), ("p", None), ("q", "XX")], "obj string, seq string")
    ids = ["SeqEl(1)", "SeqEl(6)", "PFP(1, 1)", "Count(AC,2)"]
    got = {(r.object_id, r.variable_id): (r.ok, r.value) for r in V.calculate(df, "obj", "seq", ids).collect()}
    assert got[("o", "SeqEl(1)")] == (True, "A") and got[("o", "SeqEl(6)")] == (False, None)
    assert got[("o", "PFP(1,1)")] == (True, "-0.1") and got[("q", "PFP(1,1)")][0] is False and got[("p", "SeqEl(1)")] == (False, None)
    assert got[("o", "Count(AC,2)")] == (True, "1")
    for bad in ("__import__('os')", "Nope(1)", "SeqEl"):
        with pytest.raises(ValueError):
            V.parse(bad)
    wide = V.wide(V.calculate(df, "obj", "seq", ["SeqEl(1)", "SeqEl(6)"]), ["SeqEl(1)", "SeqEl(6)"])
    assert wide.count() == 3 and len(wide.columns) == 3
    twice = V.calculate(df, "obj", "seq", ["SeqEl(1)"])
    with pytest.raises(Exception, match="two results"):
        V.wide(twice.unionByName(twice), ["SeqEl(1)"]).collect()


def test_ancestors_and_levels(spark):
    df = spark.createDataFrame([("A|1-2<-(B|1-5<-(C|1-9))",), ("B|1-5",)], "id string")
    assert df.select(T.ancestors_of(F.col("id")).alias("a")).first().a == ["B|1-5", "C|1-9"]
    gone = T.missing_ancestors(df, "id").collect()
    assert [(r.own, r.filled) for r in gone] == [("C|1-9", "*" * 9)]
    edges = spark.createDataFrame([("r", "a"), ("a", "b")], "parent string, child string")
    tree = T.levels(edges, spark.createDataFrame([("r",)], "id string"))
    assert {(r.id, r.level, r.path) for r in tree.collect()} == {("r", 0, "r"), ("a", 1, "r/a"), ("b", 2, "r/a/b")}


def test_gap_columns_and_slices(spark):
    df = spark.createDataFrame([("m", 1, "s", "A--C"), ("m", 2, "t", "AB-C")], "msa_id string, ord int, seq_id string, aligned string")
    assert {r.aligned for r in M.remove_gap_columns(df).collect()} == {"A-C", "ABC"}
    assert {r.seq_id for r in M.filter_gap_rows(df, 0.5).collect()} == {"t"}
    assert df.select(M.column_slice(F.col("aligned"), 2, -1).alias("p")).first().p == "--C"
    nulls = spark.createDataFrame([("ACD", "AD"), (None, "A")], "a string, b string")
    assert [r.aln.numbers for r in M.align(nulls, "a", "b").collect()] == [[1, None, 2], None]


def test_config():
    c = Config().update_with({"contact_cutoff": 7.0, "nonsense": 1})
    assert c.contact_cutoff == 7.0 and Config().contact_cutoff == 5.0 and Config.layered('{"unknown_chain": "Q"}').unknown_chain == "Q"
    with pytest.raises(ConfigError):
        Config(structure_format=None).validate(("structure_format",))
