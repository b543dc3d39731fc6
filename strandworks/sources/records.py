"""Line formats: cluster files, secondary structure, components, models, tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.functions.tables import AMINO
from strandworks.plans.ship import ship
from strandworks.sources.structure_text import star_loops


def parse_clusters(lines: DataFrame, file: str, at: str, line: str) -> DataFrame:
    """``file, cluster, member`` of cluster files: a running count of the headers."""
    w = Window.partitionBy(file).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    header = F.startswith(F.col(line), F.lit(">Cluster"))
    rows = lines.withColumn("cluster", F.sum(header.cast("int")).over(w) - 1).where(~header)
    member = F.regexp_extract(line, r">(.+?)\.\.\.", 1)
    return rows.select(file, "cluster", member.alias("member")).where(F.col("member") != "")


#: First column (from 1) and width of the secondary-structure fields.
DSSP_FIELDS = {"num": (1, 5), "res_id": (6, 5), "ins_code": (11, 1), "chain_id": (12, 1), "aa": (14, 1), "ss8": (17, 1), "bp1": (26, 4), "bp2": (30, 4), "acc": (35, 4), "kappa": (92, 6), "alpha": (98, 6), "phi": (104, 6), "psi": (110, 6), "x": (116, 7), "y": (123, 7), "z": (130, 7)}


def parse_dssp(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fixed-width residue records as columns; rows with a blank chain are dropped.
    ``ss3`` folds helices to H, strands to E and the rest to C."""
    cut = lambda a, n: F.trim(F.substring(F.col(line), a, n))
    typed = {"num": "int", "res_id": "int", "bp1": "int", "bp2": "int", "acc": "int", **{k: "double" for k in ("kappa", "alpha", "phi", "psi", "x", "y", "z")}}
    cols = []
    for name, (a, n) in DSSP_FIELDS.items():
        c = cut(a, n)
        cols.append((F.when(c != "", c).try_cast(typed[name]) if name in typed else c).alias(name))
    rows = lines.select(*[c for c in lines.columns if c != line], *cols).where(F.col("chain_id") != "")
    return rows.withColumn("ss3", F.when(F.col("ss8").isin("H", "G", "I"), "H").when(F.col("ss8").isin("E", "B"), "E").otherwise("C"))


def annotate_structure(atoms: DataFrame, dssp: DataFrame) -> DataFrame:
    """Atoms with ``ss8, ss3`` by chain and residue; ``-`` and ``C`` where there is none."""
    ss = dssp.select("structure_id", "chain_id", "res_id", "ss8", "ss3")
    out = atoms.join(ss, ["structure_id", "chain_id", "res_id"], "left")
    return out.withColumns({"ss8": F.coalesce("ss8", F.lit("-")), "ss3": F.coalesce("ss3", F.lit("C"))})


def parse_components(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``comp_id, grp, field, pos, value`` of STAR blocks, single values at position 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                if not isinstance(text, str):
                    continue
                for tags, values in star_loops(text):
                    for pos, row in enumerate(values):
                        rows += [(key, *t[1:].split(".", 1), pos, v) for t, v in zip(tags, row)]
                in_loop = False
                for line in text.splitlines():
                    in_loop = (in_loop or line.strip() == "loop_") and not line.startswith("#")
                    parts = line.split(None, 1)
                    if not in_loop and len(parts) == 2 and parts[0].startswith("_") and "." in parts[0]:
                        rows.append((key, *parts[0][1:].split(".", 1), 0, parts[1].strip().strip("'\"")))
            yield pd.DataFrame(rows, columns=["comp_id", "grp", "field", "pos", "value"])

    ship(texts.sparkSession)
    return texts.select(id_col, text_col).mapInPandas(run, "comp_id string, grp string, field string, pos int, value string")


def component_letters(components: DataFrame) -> DataFrame:
    """``res_name, letter`` of parsed components: their one-letter code, or that of the
    standard residue that they are modified from; ``X`` for those with neither."""
    field = lambda name: F.max(F.when(F.col("field") == name, F.when(~F.col("value").isin("?", "."), F.col("value"))))
    known = F.create_map(*[F.lit(x) for pair in AMINO.items() for x in pair])
    rows = components.where("grp = 'chem_comp'").groupBy(F.col("comp_id").alias("res_name")).agg(field("one_letter_code").alias("code"), field("mon_nstd_parent_comp_id").alias("parent"))
    code = F.when(F.length("code") == 1, F.col("code"))
    return rows.select("res_name", F.coalesce(code, F.try_element_at(known, F.col("parent")), F.lit("X")).alias("letter"))


def parse_models(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Profile models of text files split at ``//``: ``source, name, acc, length``."""
    one = F.explode(F.split(F.col(text_col), r"(?m)^//\s*$")).alias("m")
    rows = texts.select(F.col(id_col).alias("source"), one).where(F.col("m").rlike(r"(?m)^NAME\s"))
    field = lambda n: F.regexp_extract("m", rf"(?m)^{n}\s+(\S+)", 1)
    return rows.select("source", field("NAME").alias("name"), field("ACC").alias("acc"), field("LENG").try_cast("int").alias("length"))


def parse_families(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Family metadata of ``dat`` texts, blocks split at comment lines: ``source, id,
    acc, description, category``; accessions without their versions."""
    one = F.explode(F.split(F.col(text_col), r"(?m)^# .*$")).alias("m")
    rows = texts.select(F.col(id_col).alias("source"), one).where(F.col("m").rlike(r"(?m)^#=GF AC\s"))
    field = lambda n: F.regexp_extract("m", rf"(?m)^#=GF {n}\s+(.*?)\s*$", 1)
    acc = F.split_part(field("AC"), F.lit("."), F.lit(1))
    return rows.select("source", field("ID").alias("id"), acc.alias("acc"), field("DE").alias("description"), field("TP").alias("category"))


def read_families(families: DataFrame, models: DataFrame, accessions: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Metadata joined to the models of the same accession, optionally only some
    accessions or categories: ``acc, id, description, category, name, length``."""
    for column, wanted in (("acc", accessions), ("category", categories)):
        families = families.where(F.col(column).isin(wanted)) if wanted else families
    models = models.select(F.split_part("acc", F.lit("."), F.lit(1)).alias("acc"), "name", "length")
    return families.drop("source").join(models, "acc").select("acc", "id", "description", "category", "name", "length")


def parse_sifts(spark: SparkSession, path: str) -> DataFrame:
    """Segment table of a CSV file with one comment line above its header: names made
    uniform, digits-only bounds, upper-case structures, distinct, null chains dropped."""
    raw = spark.read.option("header", "false").option("comment", "#").csv(path).where("_c0 <> 'PDB'")
    digits = lambda c: F.regexp_extract(c, r"(-?\d+)", 1).try_cast("int")
    rows = raw.select(
        F.upper(F.trim("_c0")).alias("pdb"), F.trim("_c1").alias("chain"), F.trim("_c2").alias("uniprot_id"),
        digits("_c5").alias("pdb_start"), digits("_c6").alias("pdb_end"), digits("_c7").alias("uniprot_start"), digits("_c8").alias("uniprot_end"),
    )
    return rows.where("chain is not null").distinct()


def read_columns(spark: SparkSession, path: str, n: int, sep: str = "\t") -> DataFrame:
    """A table of exactly ``n`` text columns; a row of another width raises."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    return spark.read.schema(schema).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", "true").csv(path)


def molecular_graph_json(edges: DataFrame, group: str, a: str, b: str, n_nodes: Column) -> DataFrame:
    """``group, graph``: ``{"num_nodes": n, "edges": [[a, b], ...]}`` in edge order."""
    pairs = F.array_sort(F.collect_list(F.array(F.col(a), F.col(b))))
    return edges.groupBy(group).agg(F.to_json(F.struct(n_nodes.alias("num_nodes"), pairs.alias("edges"))).alias("graph"))


def edges_of_json(graphs: DataFrame, group: str, text: str = "graph") -> DataFrame:
    parsed = F.from_json(text, "num_nodes int, edges array<array<int>>")
    rows = graphs.select(group, F.explode(parsed["edges"]).alias("e"))
    return rows.select(group, F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
