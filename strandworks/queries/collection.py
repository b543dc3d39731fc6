"""Queries on object trees, the catalog, and batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.operators import collection as C
from strandworks.operators import residues as R
from strandworks.operators import tree as T
from strandworks.operators.segments import segment_id
from strandworks.plans.scratch import Scratch
from strandworks.plans.rank import ranked
from strandworks.plans.tables import table
from strandworks.queries._base import SEQUENCES_SQL, Registry, sequences

reg = Registry()
QUERIES, SQL = reg.queries, reg.sql
SEQ = f"WITH {SEQUENCES_SQL}"

EDGES_SQL = """edges AS (
  SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
tree AS (
  SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS root, 0 AS level, 'r' || r_regionkey AS path FROM region
  UNION ALL SELECT child, parent, 1, parent || '/' || child FROM edges WHERE parent LIKE 'r%'
  UNION ALL SELECT b.child, a.parent, 2, a.parent || '/' || a.child || '/' || b.child FROM edges a JOIN edges b ON a.child = b.parent WHERE a.parent LIKE 'r%')"""
TREE = f"WITH {EDGES_SQL}"


def edges(spark, d):
    """Regions, nations, and their customers and suppliers as parents and children."""
    key = lambda p, c: F.concat(F.lit(p), c)
    n = table(spark, d, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"))
    c = table(spark, d, "customer").select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("child"))
    s = table(spark, d, "supplier").select(key("n", "s_nationkey").alias("parent"), key("s", "s_suppkey").alias("child"))
    return n.unionByName(c).unionByName(s)


def tree(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return T.levels(edges(spark, d), roots)


@reg.add("op_2_7_2_level_access", f"{TREE} SELECT id, root FROM tree WHERE level = 2")
def _(spark, d):
    return tree(spark, d).where("level = 2").select("id", "root")


@reg.add("op_2_7_4_topological_iteration", f"{TREE} SELECT id, level, row_number() OVER (PARTITION BY root ORDER BY level, path) AS ord FROM tree")
def _(spark, d):
    ord_ = F.row_number().over(Window.partitionBy("root").orderBy("level", "path"))
    return tree(spark, d).select("id", "level", ord_.cast("long").alias("ord"))


@reg.add("op_2_9_5_child_iteration", f"{TREE} SELECT root, string_agg(id, ',' ORDER BY level, path) AS ids FROM tree WHERE level BETWEEN 1 AND 1 GROUP BY 1")
def _(spark, d):
    rows = tree(spark, d).where("level between 1 and 1")
    pairs = F.array_sort(F.collect_list(F.struct("level", "path", "id")))
    return rows.groupBy("root").agg(F.array_join(F.transform(pairs, lambda x: x["id"]), ",").alias("ids"))


@reg.add("op_2_9_6_sequence_child_iteration", f"{TREE} SELECT root, level, count(*) AS n FROM tree WHERE id LIKE 'c%' OR level < 2 GROUP BY 1, 2")
def _(spark, d):
    return tree(spark, d).where("id like 'c%' or level < 2").groupBy("root", "level").agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_9_7_structure_child_iteration", f"{TREE} SELECT root, level, count(*) AS n FROM tree WHERE id LIKE 's%' OR level < 2 GROUP BY 1, 2")
def _(spark, d):
    return tree(spark, d).where("id like 's%' or level < 2").groupBy("root", "level").agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_4_11_resolve_up_lineage", f"{TREE} SELECT id, CASE WHEN level >= 1 AND CAST(substr(split_part(path, '/', 2), 2) AS INTEGER) % 2 = 0 THEN split_part(path, '/', 2) WHEN root <> 'r1' THEN root END AS found FROM tree")
def _(spark, d):
    """The nearest ancestor with a structure: nations of even key, else the region, but for one."""
    rows = tree(spark, d)
    n = F.substring("id", 2, 99).cast("long")
    flagged = rows.where((F.startswith("id", F.lit("n")) & (n % 2 == 0)) | (F.startswith("id", F.lit("r")) & (F.col("id") != "r1"))).select("id")
    return T.nearest_with(rows, flagged)


_LINEAGE = "lin AS (SELECT seq_id, chain_id, chain_id || '/' || seq_id || '|' || seq_start || '-' || seq_end || '<-(' || chain_id || '<-(top|1-2000))' AS id FROM chain_sequences WHERE chain_id IS NOT NULL)"


def _lineage(spark, d):
    t = table(spark, d, "chain_sequences").where("chain_id is not null")
    parent = F.concat("chain_id", F.lit("<-(top|1-2000)"))
    return t.select("seq_id", "chain_id", segment_id(F.concat("chain_id", F.lit("/"), F.col("seq_id")), F.col("seq_start"), F.col("seq_end"), parent).alias("id"))


@reg.add("op_2_9_8_ancestor_parsing", f"WITH {_LINEAGE} SELECT seq_id, chain_id || ',top|1-2000' AS ancestors FROM lin")
def _(spark, d):
    return _lineage(spark, d).select("seq_id", F.array_join(T.ancestors_of(F.col("id")), ",").alias("ancestors"))


@reg.add("op_2_9_9_fill_missing_ancestors", f"""WITH {_LINEAGE}, a AS (SELECT DISTINCT chain_id AS own FROM lin UNION SELECT 'top|1-2000' WHERE EXISTS (SELECT 1 FROM lin))
SELECT own, CAST(regexp_extract(own, '\\|(\\d+)-(\\d+)$', 1) AS INTEGER) AS "start", CAST(regexp_extract(own, '\\|(\\d+)-(\\d+)$', 2) AS INTEGER) AS "end",
repeat('*', CAST(regexp_extract(own, '\\|(\\d+)-(\\d+)$', 2) AS INTEGER) - CAST(regexp_extract(own, '\\|(\\d+)-(\\d+)$', 1) AS INTEGER) + 1) AS filled FROM a""")
def _(spark, d):
    return T.missing_ancestors(_lineage(spark, d), "id")


@reg.add("op_2_9_3_spawn_chain_child", f"{SEQ} SELECT seq_id, seq_id || '|5-30' AS child, substr(s, 5, 26) AS seq1 FROM sequences WHERE length(s) >= 30")
def _(spark, d):
    rows = sequences(spark, d).where(F.length("s") >= 30)
    return rows.select("seq_id", segment_id(F.col("seq_id").cast("string"), F.lit(5), F.lit(30)).alias("child"), F.substring("s", 5, 26).alias("seq1"))


@reg.add("op_2_2_20_apply_to_children", f"{TREE} SELECT id, upper(id) AS tag FROM tree WHERE level > 0")
def _(spark, d):
    return tree(spark, d).where("level > 0").select("id", F.upper("id").alias("tag"))


@reg.add("op_2_3_7_child_filter", f"{TREE} SELECT id FROM tree WHERE level = 1 AND root = 'r2'")
def _(spark, d):
    return tree(spark, d).where("level = 1 and root = 'r2'").select("id")


@reg.add("op_2_2_23_list_summary", "SELECT 'c' || c_custkey AS object_id, c_mktsegment AS segment, NULL AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, NULL, 'supplier' FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("object_id"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("object_id"), F.lit("supplier").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@reg.add("op_2_2_24_chain_summary", f"{SEQ} SELECT chain_id AS object_id, NULL AS parent_chain, false AS structure, CAST(count(*) AS BIGINT) AS n FROM sequences WHERE chain_id IS NOT NULL GROUP BY 1 UNION ALL SELECT CAST(seq_id AS VARCHAR), chain_id, true, CAST(length(s) AS BIGINT) FROM sequences WHERE chain_id IS NOT NULL")
def _(spark, d):
    rows = sequences(spark, d).where("chain_id is not null")
    top = rows.groupBy(F.col("chain_id").alias("object_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("structure", F.lit(False))
    own = rows.select(F.col("seq_id").cast("string").alias("object_id"), F.col("chain_id").alias("parent_chain"), F.lit(True).alias("structure"), F.length("s").cast("long").alias("n"))
    return top.unionByName(own, allowMissingColumns=True)


@reg.add("op_2_7_3_iterators", "SELECT DISTINCT trim(id, ' ') AS id, chain_type FROM chains WHERE id IS NOT NULL AND chain_type IN (1, 2)")
def _(spark, d):
    return table(spark, d, "chains").where("id is not null and chain_type in (1, 2)").select(F.trim("id").alias("id"), "chain_type").distinct()


@reg.add("op_2_7_6_list_mutation", "WITH r AS (SELECT n_nationkey * 2 AS ord, n_name AS name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 9, 'inserted') SELECT row_number() OVER (ORDER BY ord) AS ord, name FROM r")
def _(spark, d):
    """Delete one place, insert at another, number anew."""
    t = table(spark, d, "nation").where("n_nationkey <> 3").select((F.col("n_nationkey") * 2).alias("o"), F.col("n_name").alias("name"))
    both = t.unionByName(spark.createDataFrame([(9, "inserted")], "o int, name string"))
    return ranked(both, "o").select("ord", "name")


@reg.add("op_2_7_9_batches", f"{SEQ}, n AS (SELECT chain_id, seq_id, count(*) OVER (PARTITION BY chain_id) AS c, row_number() OVER (PARTITION BY chain_id ORDER BY seq_id) - 1 AS p FROM sequences WHERE chain_id IS NOT NULL) SELECT chain_id, seq_id, CAST(floor(p * ceil(c / 3.0) / c) AS INTEGER) AS chunk FROM n")
def _(spark, d):
    return C.chunk_evenly(sequences(spark, d).where("chain_id is not null"), "seq_id", "chain_id", 3)


@reg.add("op_2_8_7_batch_accounting", "WITH i AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click'), o AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view') SELECT CASE WHEN i.k IS NOT NULL AND o.k IS NOT NULL THEN 'done' WHEN i.k IS NOT NULL THEN 'missed' ELSE 'extra' END AS status, count(*) AS n FROM i FULL JOIN o ON i.k = o.k GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_type")
    return C.batch_status(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "k")


_ITEMS = "items AS (SELECT upper(trim(uniprot_id, ' ')) AS u, upper(trim(pdb, ' ')) AS p, trim(chain, ' ') AS c FROM sifts WHERE uniprot_id IS NOT NULL AND pdb IS NOT NULL AND chain IS NOT NULL GROUP BY ALL)"


def _items(spark, d):
    t = table(spark, d, "sifts").where("uniprot_id is not null and pdb is not null and chain is not null")
    return t.select(F.upper(F.trim("uniprot_id")).alias("seq_id"), F.upper(F.trim("pdb")).alias("str_id"), F.trim("chain").alias("chain_id")).distinct()


@reg.add("op_2_10_9_batch_items", f"WITH {_ITEMS} SELECT u AS seq_id, p AS str_id, c AS chain_id FROM items")
def _(spark, d):
    """Items written in their grammar and parsed back."""
    return C.parse_items(C.format_items(_items(spark, d)), "item").select("seq_id", "str_id", "chain_id")


@reg.add("op_2_10_8_item_kinds", "SELECT * FROM (VALUES ('S1', 'S1', NULL, NULL), ('1ABC:A,B', NULL, '1ABC', 'A'), ('1ABC:A,B', NULL, '1ABC', 'B'), ('X=>1ABC:A;2ABC:A,B', 'X', '1ABC', 'A'), ('X=>1ABC:A;2ABC:A,B', 'X', '2ABC', 'A'), ('X=>1ABC:A;2ABC:A,B', 'X', '2ABC', 'B')) t(item, seq_id, str_id, chain_id)")
def _(spark, d):
    return C.parse_items(spark.createDataFrame([("S1",), ("1ABC:A,B",), ("X=>1ABC:A;2ABC:A,B",)], "item string"), "item")


_CHAINS = "known AS (SELECT trim(id, ' ') AS id, min(chain_type) AS chain_type, min(level) AS level FROM chains WHERE id IS NOT NULL GROUP BY 1), links AS (SELECT DISTINCT trim(chain_id_parent, ' ') AS parent_id, trim(chain_id_child, ' ') AS child_id FROM parents WHERE chain_id_parent IS NOT NULL AND chain_id_child IS NOT NULL)"


def _catalog(spark, d, name):
    cat = C.Catalog(spark, Scratch(spark, "catalog").path(name))
    chains = table(spark, d, "chains").where("id is not null").groupBy(F.trim("id").alias("id")).agg(F.min("chain_type").alias("chain_type"), F.min("level").alias("level"))
    links = table(spark, d, "parents").where("chain_id_parent is not null and chain_id_child is not null").select(F.trim("chain_id_parent").alias("parent_id"), F.trim("chain_id_child").alias("child_id"))
    cat.add(chains, links)
    return cat


@reg.add("op_2_10_1_insert_chains", f"WITH {_CHAINS} SELECT * FROM known")
def _(spark, d):
    """The same chains twice: the second insert changes nothing."""
    cat = _catalog(spark, d, "insert")
    cat.add(cat.table("chains").withColumn("level", F.lit(99)))
    return cat.table("chains")


@reg.add("op_2_10_2_remove_cascade", f"WITH {_CHAINS} SELECT 'chains' AS name, count(*) AS n FROM known WHERE chain_type <> 2 UNION ALL SELECT 'parents', count(*) FROM links WHERE parent_id NOT IN (SELECT id FROM known WHERE chain_type = 2) AND child_id NOT IN (SELECT id FROM known WHERE chain_type = 2)")
def _(spark, d):
    cat = _catalog(spark, d, "remove")
    cat.remove(Scratch(spark, "gone").save(cat.ids(chain_type=2), "ids"))
    count = lambda n: cat.table(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return count("chains").unionByName(count("parents"))


@reg.add("op_2_10_3_add_variables", f"WITH {_CHAINS}, v AS (SELECT DISTINCT chain_id FROM chain_sequences WHERE chain_id IN (SELECT id FROM known)) SELECT chain_id, 'len' AS variable_id, CAST(max(length(seq1)) AS VARCHAR) AS value FROM chain_sequences WHERE chain_id IN (SELECT chain_id FROM v) GROUP BY 1 HAVING max(length(seq1)) > 50")
def _(spark, d):
    cat = _catalog(spark, d, "variables")
    rows = table(spark, d, "chain_sequences").where("chain_id is not null").groupBy("chain_id").agg(F.max(F.length("seq1")).alias("n"))
    cat.add_variables(rows.select("chain_id", F.lit("len").alias("variable_id"), F.col("n").cast("string").alias("value"), F.coalesce(F.col("n") > 50, F.lit(False)).alias("ok")))
    return cat.table("variables").select("chain_id", "variable_id", "value")


@reg.add("op_2_10_4_link_paths", f"WITH {_CHAINS} SELECT id AS chain_id, '/data/' || id AS path FROM known")
def _(spark, d):
    cat = _catalog(spark, d, "paths")
    names = cat.table("chains").select(F.concat(F.lit("/old/"), "id").alias("path"))
    cat.link(names.unionByName(spark.createDataFrame([("/data/unknown",)], "path string")))
    cat.link(cat.table("chains").select(F.concat(F.lit("/data/"), "id").alias("path")))
    return cat.table("paths")


@reg.add("op_2_10_5_update", f"WITH {_CHAINS} SELECT DISTINCT CASE WHEN child_id LIKE 'kin%' THEN 'moved' ELSE parent_id END AS parent_id, child_id, count(*) AS n FROM links GROUP BY ALL")
def _(spark, d):
    cat = _catalog(spark, d, "update")
    kin = cat.table("parents").where("child_id like 'kin%'").select("child_id", F.lit("moved").alias("parent_id"))
    cat.update_parents(Scratch(spark, "values").save(kin.unionByName(spark.createDataFrame([("absent", "moved")], "child_id string, parent_id string")), "kin"))
    return cat.table("parents").groupBy("parent_id", "child_id").agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_3_25_collection_where", f"WITH {_CHAINS} SELECT id FROM known WHERE chain_type = 3 AND level = 1")
def _(spark, d):
    return _catalog(spark, d, "where").ids(level=1, chain_type=3)


@reg.add("op_2_4_18_parent_child_lookup", f"WITH {_CHAINS} SELECT id, child_id FROM known LEFT JOIN links ON parent_id = id WHERE level = 0")
def _(spark, d):
    cat = _catalog(spark, d, "lookup")
    return cat.children_of(cat.ids(level=0))


@reg.add("op_2_4_19_load_with_recovery", f"WITH {_CHAINS} SELECT id, chain_type, level, p AS parent_id FROM known LEFT JOIN (SELECT child_id, max(parent_id) AS p FROM links GROUP BY 1) ON child_id = id WHERE chain_type = 1")
def _(spark, d):
    return _catalog(spark, d, "load").load(chain_type=1, structures=False)


@reg.add("op_2_4_20_structure_link", f"WITH {_CHAINS}, s AS (SELECT DISTINCT chain_id, CAST(seq_id AS VARCHAR) AS structure_id FROM chain_sequences WHERE chain_id IS NOT NULL) SELECT id, string_agg(structure_id, ',' ORDER BY structure_id) AS structures FROM known LEFT JOIN s ON chain_id = id GROUP BY 1")
def _(spark, d):
    cat = _catalog(spark, d, "structures")
    cat.add(cat.table("chains"), None, table(spark, d, "chain_sequences").where("chain_id is not null").select("chain_id", F.col("seq_id").cast("string").alias("structure_id")))
    return cat.load().select("id", "structures")


@reg.add("op_2_1_43_collection_store", f"WITH {_CHAINS} SELECT chain_type, count(*) AS n FROM known GROUP BY 1")
def _(spark, d):
    cat = _catalog(spark, d, "store")
    assert cat.tables() == ["chains", "parents"]
    return cat.table("chains").groupBy("chain_type").agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_10_6_constructor", f"WITH {_CHAINS} SELECT id, chain_type, level FROM known")
def _(spark, d):
    """Three batches into a catalog; the second run finds all done."""
    src = table(spark, d, "chains").where("id is not null").groupBy(F.trim("id").alias("id")).agg(F.min("chain_type").alias("chain_type"), F.min("level").alias("level"))
    src = Scratch(spark, "items").save(src, "items")
    batches = C.make_batches(src, "id", max(1, src.count() // 3))
    cat = C.Catalog(spark, Scratch(spark, "constructor").path("catalog"))
    build = lambda items: (src.join(items.select("id"), "id", "left_semi"), spark.createDataFrame([], C.SCHEMAS["parents"]))
    job = C.Constructor(cat, build, "id")
    job.run(batches)
    n = cat.table("batches").count()
    assert job.resume(batches).count() == n
    return cat.table("chains")


@reg.add("op_2_10_11_structure_callback", f"{SEQ} SELECT chain_id, count(*) AS n, count(*) FILTER (length(s) > 100 AND s LIKE '%W%') AS kept FROM sequences WHERE chain_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Callbacks that each drop structures of a chain; chains stay without any."""
    from strandworks.functions.extension import fold

    rows = sequences(spark, d).where("chain_id is not null")
    kept = fold(rows, [lambda t: t.where(F.length("s") > 100), lambda t: t.where(F.contains("s", F.lit("W")))])
    n = rows.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(kept.groupBy("chain_id").agg(F.count(F.lit(1)).alias("kept")), "chain_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


@reg.add("op_2_11_12_partner_parsing", """WITH p AS (SELECT DISTINCT 'p' || doc_id AS k, upper(coalesce(lang, '')) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_' END || upper(left(coalesce(source, ''), CAST(doc_id % 4 AS INTEGER))) AS t FROM documents)
SELECT k, split_part(t, '_', 1) AS side_a, split_part(t, '_', 2) AS side_b,
  CASE WHEN split_part(t, '_', 1) = '' OR split_part(t, '_', 2) = '' THEN 'missing' WHEN list_has_any(string_split(split_part(t, '_', 1), ''), string_split(split_part(t, '_', 2), '')) THEN 'shared' END AS error FROM p""")
def _(spark, d):
    """Texts of chain letters for two sides, with what is wrong with them."""
    from strandworks.operators.interface import partner_columns

    joint = F.when(F.col("doc_id") % 3 == 0, "").otherwise("_")
    text = F.concat(F.upper(F.coalesce("lang", F.lit(""))), joint, F.upper(F.substring(F.coalesce("source", F.lit("")), F.lit(1), (F.col("doc_id") % 4).cast("int"))))
    rows = table(spark, d, "documents").select(F.concat(F.lit("p"), "doc_id").alias("k"), text.alias("t")).distinct()
    return rows.select("k", *partner_columns(F.col("t")))


@reg.add("op_2_4_4_patched_sequences", f"{SEQ} SELECT seq_id, s AS seq1 FROM sequences WHERE regexp_matches(s, '[^WX]')")
def _(spark, d):
    """Sequences that lost W and X between other letters, patched and made text again."""
    letters, lost = F.split("s", ""), F.lit("WX")
    low, high = F.length("s") - F.length(F.ltrim("s", lost)) + 1, F.length(F.rtrim("s", lost))
    places = F.transform(letters, lambda x, k: F.struct(x.alias("aa"), (k + 1).alias("at")))
    rows = sequences(spark, d).where(F.rlike("s", F.lit("[^WX]"))).withColumns({"lo": low, "hi": high})
    rows = rows.select("seq_id", "s", F.filter(places, lambda p: ~p["aa"].isin("W", "X") | (p["at"] < F.col("lo")) | (p["at"] > F.col("hi"))).alias("lossy"))
    out = R.patch_packed(rows, ["seq_id"], F.col("lossy.at"), F.col("lossy.at"), F.col("lossy.aa"), letters)
    return out.select("seq_id", F.array_join("letters", "").alias("seq1"))


@reg.add("op_2_10_10_constructor_support", "WITH r AS (SELECT DISTINCT area FROM collection_files WHERE area IS NOT NULL) SELECT area, '/data/' || CASE area WHEN 'sequence_files' THEN 'sequences' ELSE 'structures' END AS folder FROM r")
def _(spark, d):
    """The folders of a collection for the areas its files name."""
    from strandworks.config import ConstructorConfig

    paths = ConstructorConfig(output="/data/").paths()
    folders = F.create_map(*[F.lit(x) for pair in paths.items() for x in pair])
    areas = table(spark, d, "collection_files").where("area is not null").select("area").distinct()
    return areas.select("area", F.try_element_at(folders, F.col("area")).alias("folder"))
