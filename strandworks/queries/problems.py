"""Training-data problems of the core: hierarchies, periods, compaction, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.operators.compaction import consolidate_files
from strandworks.operators.hierarchy import chain_descendants, chain_hierarchy
from strandworks.operators.orphans import orphan_references
from strandworks.operators.periods import periods_and_gaps
from strandworks.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_hierarchy(table(spark, sf_dir, "chains"), table(spark, sf_dir, "parents"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chain_descendants(table(spark, sf_dir, "chains"), table(spark, sf_dir, "parents"))
    return found.select(F.col("ancestor").alias("ancestor_id"), F.col("id").alias("chain_id"), "distance")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods_and_gaps(table(spark, sf_dir, "sifts"), F.upper(F.trim("uniprot_id")), "uniprot_start", "uniprot_end")
    return found.select(
        F.col("k").alias("uniprot_id"), "kind", F.col("s").cast("int").alias("seg_from"), F.col("e").cast("int").alias("seg_to")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate_files(table(spark, sf_dir, "collection_files")).select("area", "record_id", "content_md5")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "parents")
    ends = F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("key")) for c in ("chain_id_parent", "chain_id_child")])
    refs = parents.select(F.explode(ends).alias("x"), F.col("added_at").alias("at")).select("x.ref_field", "x.key", "at")
    chains = table(spark, sf_dir, "chains").select(F.col("id").alias("key"), F.col("added_at").alias("added"), F.col("removed_at").alias("removed"))
    found = orphan_references(refs, chains)
    return found.select("ref_field", F.col("key").alias("chain_id"), "kind", F.col("month").alias("ref_month"))


QUERIES = {f.__name__: f for f in (p1_found, p1_descendants, p3_found, p4_found, p6_found)}

SQL = {
    "p1_found": """
WITH RECURSIVE links AS (
  SELECT DISTINCT trim(chain_id_parent, ' ') AS p, trim(chain_id_child, ' ') AS c FROM parents
  WHERE chain_id_parent IS NOT NULL AND chain_id_child IS NOT NULL),
nodes AS (
  SELECT trim(id, ' ') AS n FROM chains WHERE id IS NOT NULL
  UNION SELECT trim(chain_id_parent, ' ') FROM parents WHERE chain_id_parent IS NOT NULL
  UNION SELECT trim(chain_id_child, ' ') FROM parents WHERE chain_id_child IS NOT NULL),
reach(a, d) AS (
  SELECT p, c FROM links UNION SELECT r.a, l.c FROM reach r JOIN links l ON l.p = r.d),
circle AS (SELECT DISTINCT a AS n FROM reach WHERE a = d),
ring AS (
  SELECT x.a AS n, min(x.d) AS root FROM reach x JOIN reach y ON x.a = y.d AND x.d = y.a GROUP BY 1),
under AS (
  SELECT DISTINCT d AS n FROM reach WHERE a IN (SELECT n FROM circle) AND d NOT IN (SELECT n FROM circle)),
walk(n, root, depth, path) AS (
  SELECT n, n, 0, n FROM nodes
  WHERE n NOT IN (SELECT c FROM links)
  UNION ALL
  SELECT l.c, w.root, w.depth + 1, w.path || ' > ' || l.c FROM walk w JOIN links l ON l.p = w.n
  WHERE l.c NOT IN (SELECT n FROM circle) AND l.c NOT IN (SELECT n FROM under))
SELECT n AS chain_id, 'tree' AS kind, root AS root_id, CAST(depth AS INTEGER) AS depth, path AS chain_path FROM walk
UNION ALL
SELECT n, 'level', root, CAST(depth AS INTEGER), path FROM walk
WHERE EXISTS (SELECT 1 FROM chains WHERE trim(id, ' ') = n AND level <> depth)
UNION ALL SELECT n, 'cycle', root, -1, '' FROM ring
UNION ALL SELECT n, 'below', '', -1, '' FROM under
""",
    "p1_descendants": """
WITH RECURSIVE links AS (
  SELECT DISTINCT trim(chain_id_parent, ' ') AS p, trim(chain_id_child, ' ') AS c FROM parents
  WHERE chain_id_parent IS NOT NULL AND chain_id_child IS NOT NULL),
reach(a, d) AS (
  SELECT p, c FROM links UNION SELECT r.a, l.c FROM reach r JOIN links l ON l.p = r.d),
circle AS (SELECT DISTINCT a AS n FROM reach WHERE a = d),
off AS (SELECT n FROM circle UNION SELECT d FROM reach WHERE a IN (SELECT n FROM circle)),
free AS (SELECT p, c FROM links WHERE c NOT IN (SELECT n FROM off)),
found(a, n, far) AS (
  SELECT p, c, 1 FROM free UNION SELECT f.a, l.c, f.far + 1 FROM found f JOIN free l ON l.p = f.n)
SELECT a AS ancestor_id, n AS chain_id, CAST(far AS INTEGER) AS distance FROM found
""",
    "p3_found": """
WITH segs AS (
  SELECT DISTINCT upper(trim(uniprot_id, ' ')) AS k, uniprot_start AS s, uniprot_end AS e FROM sifts
  WHERE uniprot_id IS NOT NULL AND uniprot_start >= 1 AND uniprot_start <= uniprot_end),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM segs),
runs AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked),
periods AS (SELECT k, min(s) AS s, max(e) AS e FROM runs GROUP BY k, run),
gaps AS (SELECT k, e + 1 AS s, lead(s) OVER (PARTITION BY k ORDER BY s) - 1 AS e FROM periods)
SELECT k AS uniprot_id, 'period' AS kind, CAST(s AS INTEGER) AS seg_from, CAST(e AS INTEGER) AS seg_to FROM periods
UNION ALL SELECT k, 'gap', CAST(s AS INTEGER), CAST(e AS INTEGER) FROM gaps WHERE e IS NOT NULL
""",
    "p4_found": """
WITH entries AS (
  SELECT area, unnest(string_split(chr(10) || regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10) || '>')[2:]) AS p
  FROM collection_files WHERE area = 'sequence_files'),
records AS (
  SELECT area, regexp_extract(p, '^([^\\s]*)', 1) AS record_id,
    CASE WHEN strpos(p, chr(10)) > 0 THEN upper(regexp_replace(substr(p, strpos(p, chr(10))), '\\s+', '', 'g')) ELSE '' END AS body
  FROM entries
  UNION ALL
  SELECT area, split_part(regexp_extract(file_path, '([^/]*)$', 1), '.', 1), trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ')
  FROM collection_files WHERE area = 'structure_files')
SELECT DISTINCT area, record_id, md5(body) AS content_md5 FROM records WHERE body <> ''
""",
    "p6_found": """
WITH refs AS (
  SELECT 'chain_id_parent' AS ref_field, trim(chain_id_parent, ' ') AS k, added_at AS linked FROM parents WHERE chain_id_parent IS NOT NULL
  UNION ALL SELECT 'chain_id_child', trim(chain_id_child, ' '), added_at FROM parents WHERE chain_id_child IS NOT NULL),
targets AS (
  SELECT trim(id, ' ') AS k, min(added_at) AS added, bool_or(removed_at IS NULL) AS alive FROM chains WHERE id IS NOT NULL GROUP BY 1),
found AS (
  SELECT ref_field, r.k AS chain_id,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN NOT alive THEN 'deleted' WHEN added > linked THEN 'late' END AS kind,
    coalesce(strftime(linked, '%Y-%m'), 'unknown') AS ref_month
  FROM refs r LEFT JOIN targets t ON r.k = t.k)
SELECT DISTINCT ref_field, chain_id, kind, ref_month FROM found WHERE kind IS NOT NULL
""",
}
