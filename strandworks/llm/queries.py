"""Named queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.leakage import leaked_items, leaked_spans
from strandworks.llm.oddsketch import clean, duplicate_classes, similar_pairs
from strandworks.llm.sentences import split_sentences
from strandworks.llm.splits import assign_groups, assign_loose, tied_keys
from strandworks.llm.tokenization import decode_corpus, encode_corpus
from strandworks.plans.scratch import Scratch
from strandworks.plans.tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chain_sequences").select(F.col("seq_id").alias("id"), clean(F.col("seq1")).alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_records(spark, sf_dir)).select(F.col("a").alias("seq_id_a"), F.col("b").alias("seq_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(_records(spark, sf_dir)).select(F.col("id").alias("seq_id"), "class_id", "n_links")


def _key(name: str):
    return F.upper(F.trim(name))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied_keys(table(spark, sf_dir, "sifts"), _key("uniprot_id"), _key("pdb"), "uniprot", "pdb")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group with its rows and its split; rows without keys go one by one
    and are summed per split under a null group."""
    sifts = table(spark, sf_dir, "sifts")
    scratch = Scratch(spark, "splits")
    groups = scratch.save(tied_keys(sifts, _key("uniprot_id"), _key("pdb"), "uniprot", "pdb"), "groups")
    keyed = sifts.select(
        F.when(F.col("uniprot_id").isNotNull(), "uniprot").when(F.col("pdb").isNotNull(), "pdb").alias("key_kind"),
        F.coalesce(_key("uniprot_id"), _key("pdb")).alias("record_key"),
    )
    weights = keyed.groupBy("key_kind", "record_key").agg(F.count(F.lit(1)).alias("n_rows"))
    weights = weights.join(groups, ["key_kind", "record_key"]).groupBy("group_key").agg(F.sum("n_rows").alias("n_rows"))
    plan = table(spark, sf_dir, "split_plan")
    loose = assign_loose(sifts.where("uniprot_id is null and pdb is null"), plan)
    tied = assign_groups(scratch.save(weights, "weights"), plan)
    return tied.unionByName(loose.select(F.lit(None).cast("string").alias("group_key"), "n_rows", "split_name"))


def p5_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's rows and the number of splits that hold it."""
    rows = p5_splits(spark, sf_dir).where("group_key is not null")
    return rows.groupBy("group_key").agg(F.sum("n_rows").alias("n_rows"), F.count_distinct("split_name").alias("n_splits"))


def p5_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each split has its share of rows within a point; a group that alone is
    larger than a point and the shares it upsets are left to the driver's own check."""
    rows = p5_splits(spark, sf_dir)
    total = rows.agg(F.sum("n_rows").alias("total"))
    held = rows.groupBy("split_name").agg(F.sum("n_rows").alias("n")).crossJoin(total)
    plan = table(spark, sf_dir, "split_plan")
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("share")) <= 0.01
    return plan.join(held, "split_name", "left").select("split_name", near.alias("near"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids decoded again."""
    return decode_corpus(p7_ids(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p5_found, p5_splits, p5_split_groups, p5_split_shares, p7_ids, p7_texts, p8_found, p8_spans, p9_found)}

_GRAMS = """
grams AS (
  SELECT DISTINCT seq_id, substr(s, i, 5) AS g FROM (
    SELECT seq_id, s, unnest(range(1, length(s) - 3)) AS i FROM (
      SELECT seq_id, regexp_replace(upper(seq1), '[^A-Z]', '', 'g') AS s FROM chain_sequences))),
sizes AS (SELECT seq_id, count(*) AS n FROM grams GROUP BY 1)
"""

_GROUPS = """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT '0' || upper(trim(uniprot_id, ' ')) AS a, '1' || upper(trim(pdb, ' ')) AS b FROM sifts),
edges AS (
  SELECT a AS v, b AS w FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL
  UNION SELECT b, a FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
vertices AS (SELECT a AS v FROM pairs WHERE a IS NOT NULL UNION SELECT b FROM pairs WHERE b IS NOT NULL),
labels(v, least) USING KEY (v) AS (
  SELECT v, v FROM vertices
  UNION
  SELECT e.w, min(l.least) FROM labels l JOIN edges e ON e.v = l.v JOIN recurring.labels r ON r.v = e.w
  WHERE l.least < r.least GROUP BY e.w)
"""

SQL = {
    "p5_split_groups": f"""{_GROUPS}
SELECT substr(least, 2) AS group_key, CAST(sum(n) AS BIGINT) AS n_rows, 1 AS n_splits FROM labels
JOIN (SELECT coalesce('0' || upper(trim(uniprot_id, ' ')), '1' || upper(trim(pdb, ' '))) AS v, count(*) AS n FROM sifts GROUP BY 1) USING (v) GROUP BY 1
""",
    "p5_split_shares": "SELECT split_name, true AS near FROM split_plan",
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_spans": r"""
WITH chars AS (
  SELECT doc_id, i, lower(substr(text, i, 1)) AS c FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)),
kept AS (
  SELECT doc_id, i - 1 AS pos, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM chars WHERE regexp_matches(c, '^[\p{L}\p{N}]')),
norm AS (SELECT doc_id, string_agg(c, '' ORDER BY n) AS s FROM kept GROUP BY 1),
items AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS s FROM eval_items),
windows AS (SELECT DISTINCT item_id, substr(s, i, 32) AS w FROM (SELECT item_id, s, unnest(range(1, length(s) - 30)) AS i FROM items)),
grams AS (SELECT doc_id, i, substr(s, i, 32) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 30)) AS i FROM norm)),
hits AS (SELECT doc_id, item_id, i, lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS before FROM grams JOIN windows USING (w)),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 32 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS run FROM hits),
spans AS (SELECT doc_id, item_id, min(i) AS a, max(i) + 31 AS b FROM runs GROUP BY doc_id, item_id, run)
SELECT s.doc_id, item_id, CAST(p.pos AS INTEGER) AS span_start, CAST(q.pos + 1 AS INTEGER) AS span_end
FROM spans s JOIN kept p ON p.doc_id = s.doc_id AND p.n = s.a JOIN kept q ON q.doc_id = s.doc_id AND q.n = s.b
""",
    "p2_found": f"""
WITH {_GRAMS},
common AS (
  SELECT a.seq_id AS x, b.seq_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.seq_id < b.seq_id GROUP BY 1, 2)
SELECT x AS seq_id_a, y AS seq_id_b FROM common JOIN sizes p ON p.seq_id = x JOIN sizes q ON q.seq_id = y
WHERE c >= 0.5 * (p.n + q.n - c)
""",
    "p2_classes": f"""
WITH {_GRAMS},
texts AS (SELECT seq_id, regexp_replace(upper(seq1), '[^A-Z]', '', 'g') AS s FROM chain_sequences),
members AS (SELECT seq_id, min(seq_id) OVER (PARTITION BY s) AS rep FROM texts WHERE length(s) >= 5),
common AS (
  SELECT a.seq_id AS x, b.seq_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.seq_id <> b.seq_id
  WHERE a.seq_id IN (SELECT rep FROM members) AND b.seq_id IN (SELECT rep FROM members) GROUP BY 1, 2),
links AS (
  SELECT x, count(*) AS n FROM common JOIN sizes p ON p.seq_id = x JOIN sizes q ON q.seq_id = y
  WHERE c >= 0.5 * (p.n + q.n - c) GROUP BY 1)
SELECT seq_id, rep AS class_id, coalesce(n, 0) AS n_links FROM members LEFT JOIN links ON x = rep
""",
    "p5_found": f"""{_GROUPS}
SELECT CASE WHEN v LIKE '0%' THEN 'uniprot' ELSE 'pdb' END AS key_kind, substr(v, 2) AS record_key, substr(least, 2) AS group_key
FROM labels
""",
    "p8_found": r"""
WITH items AS (
  SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS s FROM eval_items),
windows AS (
  SELECT DISTINCT item_id, substr(s, i, 32) AS w FROM (SELECT item_id, s, unnest(range(1, length(s) - 30)) AS i FROM items)),
docs AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS s FROM documents),
grams AS (
  SELECT DISTINCT doc_id, substr(s, i, 32) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 30)) AS i FROM docs))
SELECT DISTINCT doc_id, item_id FROM grams JOIN windows USING (w)
""",
}
