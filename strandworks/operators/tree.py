"""Lineage of segment ids and of shallow object trees.

Ids carry their ancestry as ``name|start-end<-(parent<-(...))``.  For links of
unknown depth see :mod:`strandworks.operators.hierarchy`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors_of(segment: Column) -> Column:
    """Ids of the ancestors, nearest first; an empty array for a root."""
    parts = F.split(segment, r"<-\(")
    return F.transform(F.slice(parts, 2, 1 << 20), lambda p: F.regexp_replace(p, r"\)+$", ""))


def node_name(segment: Column) -> Column:
    return F.split_part(segment, F.lit("<-"), F.lit(1))


def missing_ancestors(df: DataFrame, segment: str) -> DataFrame:
    """Ancestors that ids name but no row has: ``own, start, end, filled``, with a
    sequence of ``*`` as long as the ancestor."""
    have = df.select(node_name(F.col(segment)).alias("own")).distinct()
    named = df.select(F.explode(ancestors_of(F.col(segment))).alias("own")).distinct()
    gone = named.join(have, "own", "left_anti")
    s, e = (F.regexp_extract("own", r"\|(\d+)-(\d+)$", k).cast("int") for k in (1, 2))
    rows = gone.select("own", s.alias("start"), e.alias("end"))
    return rows.withColumn("filled", F.repeat(F.lit("*"), F.col("end") - F.col("start") + 1))


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, root, level, path`` below given roots by a recursive query; for trees as
    shallow as collections of objects are.  A circle raises by Spark's own limit."""
    spark = edges.sparkSession
    e, r = (f"t_{uuid.uuid4().hex}" for _ in "er")
    edges.select(F.col("parent"), F.col("child")).createOrReplaceTempView(e)
    roots.select(F.col("id")).createOrReplaceTempView(r)
    return spark.sql(f"""
WITH RECURSIVE walk(id, root, level, path) AS (
  SELECT id, id, 0, CAST(id AS STRING) FROM {r}
  UNION ALL
  SELECT e.child, w.root, w.level + 1, w.path || '/' || e.child FROM walk w JOIN {e} e ON e.parent = w.id)
SELECT id, root, level, path FROM walk""")


def nearest_with(tree: DataFrame, flagged: DataFrame) -> DataFrame:
    """For each node the nearest of itself and its ancestors that is flagged: ``id,
    found``, null if none; ``tree`` has ``(id, path)`` of ids joined by ``/``."""
    chain = tree.select("id", F.posexplode(F.split("path", "/")).alias("depth", "anc"))
    hit = chain.join(flagged.select(F.col("id").alias("anc")).distinct(), "anc")
    best = hit.groupBy("id").agg(F.max_by("anc", "depth").alias("found"))
    return tree.select("id").join(best, "id", "left")
