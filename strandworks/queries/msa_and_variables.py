"""Queries on alignments, alignment kernels and the variable engine."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.functions.tables import PFP
from strandworks.operators import msa as M
from strandworks.operators import variables as V
from strandworks.queries._base import SEQUENCES_SQL, Registry, sequences

reg = Registry()
QUERIES, SQL = reg.queries, reg.sql
MSA_SQL = (
    SEQUENCES_SQL
    + """,
msa AS (
  SELECT chain_id AS msa_id, row_number() OVER (PARTITION BY chain_id ORDER BY seq_id) AS ord, seq_id,
    substr(s, 1, seq_id % 7 + 1) || repeat('-', max(length(s)) OVER (PARTITION BY chain_id) - length(s)) || substr(s, seq_id % 7 + 2) AS aligned
  FROM sequences WHERE chain_id IS NOT NULL)"""
)
W_MSA = f"WITH {MSA_SQL}"


def msa(spark, d):
    """The sequences of each chain, brought to one length by gaps after some letters."""
    rows = sequences(spark, d).where("chain_id is not null")
    w = Window.partitionBy("chain_id")
    k = (F.col("seq_id") % 7 + 1).cast("int")
    gaps = F.repeat(F.lit("-"), F.max(F.length("s")).over(w) - F.length("s"))
    aligned = F.concat(F.substring("s", F.lit(1), k), gaps, F.substring("s", k + 1, F.length("s")))
    return rows.select(F.col("chain_id").alias("msa_id"), F.row_number().over(w.orderBy("seq_id")).alias("ord"), "seq_id", aligned.alias("aligned"))


@reg.add("op_2_1_5_msa_constructor", f"{W_MSA} SELECT msa_id, ord, seq_id, aligned FROM msa")
def _(spark, d):
    return msa(spark, d).withColumn("ord", F.col("ord").cast("long"))


@reg.add("op_2_1_4_msa_verify", f"{W_MSA} SELECT msa_id, count(DISTINCT length(aligned)) <= 1 AS ok FROM msa GROUP BY 1")
def _(spark, d):
    return M.verify(msa(spark, d))


@reg.add("op_2_2_15_alignment_accessors", f"{W_MSA} SELECT msa_id, count(*) AS n_rows, CAST(max(length(aligned)) AS INTEGER) AS n_cols FROM msa GROUP BY 1")
def _(spark, d):
    return msa(spark, d).groupBy("msa_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.length("aligned")).alias("n_cols"))


@reg.add(
    "op_2_2_16_msa_columns",
    f"{W_MSA} SELECT msa_id, CAST(pos AS INTEGER) AS pos, string_agg(substr(aligned, pos, 1), '' ORDER BY ord) AS \"column\" FROM (SELECT *, unnest(range(1, length(aligned) + 1)) AS pos FROM msa) GROUP BY 1, 2",
)
def _(spark, d):
    return M.columns(msa(spark, d))


@reg.add(
    "op_2_2_17_msa_slice",
    f"{W_MSA} SELECT seq_id, substr(aligned, 3, length(aligned) - 4) AS part, regexp_replace(substr(aligned, 2, 11), '(.).?', '\\1', 'g') AS odd FROM msa WHERE length(aligned) >= 12",
)
def _(spark, d):
    rows = msa(spark, d).where("length(aligned) >= 12")
    return rows.select("seq_id", M.column_slice(F.col("aligned"), 3, -3).alias("part"), M.column_slice(F.col("aligned"), 2, 12, 2).alias("odd"))


@reg.add("op_2_2_21_map_over_msa", f"{W_MSA} SELECT seq_id, lower(aligned) AS aligned FROM msa")
def _(spark, d):
    return msa(spark, d).select("seq_id", F.lower("aligned").alias("aligned"))


@reg.add("op_2_3_10_msa_row_filter", f"{W_MSA} SELECT msa_id, seq_id FROM msa WHERE ord > 1")
def _(spark, d):
    rows = msa(spark, d)
    return M.remove_rows(rows, rows.where("ord = 1")).select("msa_id", "seq_id")


@reg.add("op_2_3_11_msa_gap_filter", f"{W_MSA} SELECT seq_id FROM msa WHERE (length(aligned) - length(replace(aligned, '-', ''))) / length(aligned) < 0.3")
def _(spark, d):
    return M.filter_gap_rows(msa(spark, d), 0.3).select("seq_id")


@reg.add(
    "op_2_3_12_gap_columns",
    f"""{W_MSA}, cells AS (SELECT msa_id, ord, seq_id, pos, substr(aligned, pos, 1) AS c FROM (SELECT *, unnest(range(1, length(aligned) + 1)) AS pos FROM msa)),
bad AS (SELECT msa_id, pos FROM cells GROUP BY 1, 2 HAVING count(*) FILTER (c = '-') / count(*) >= 0.5)
SELECT seq_id, coalesce(string_agg(c, '' ORDER BY pos) FILTER ((msa_id, pos) NOT IN (SELECT (msa_id, pos) FROM bad)), '') AS aligned FROM cells GROUP BY 1""",
)
def _(spark, d):
    return M.remove_gap_columns(msa(spark, d), 0.5).select("seq_id", "aligned")


@reg.add("op_2_3_13_gap_sequences", f"{W_MSA} SELECT seq_id, (length(aligned) - length(replace(aligned, '-', ''))) / length(aligned) <= 0.25 AS kept FROM msa")
def _(spark, d):
    return M.partition_gap_rows(msa(spark, d), 0.25).select("seq_id", "kept")


@reg.add(
    "op_2_4_6_numbering_through_alignment",
    f"""{W_MSA}, p AS (SELECT a.seq_id, a.aligned AS x, b.aligned AS y FROM msa a JOIN msa b ON a.msa_id = b.msa_id AND b.ord = a.ord + 1),
q AS (SELECT *, unnest(range(1, length(x) + 1)) AS col FROM p)
SELECT seq_id, CAST(col AS INTEGER) AS col,
  CASE WHEN substr(x, col, 1) <> '-' THEN CAST(length(replace(substr(x, 1, col), '-', '')) AS INTEGER) END AS n1,
  CASE WHEN substr(y, col, 1) <> '-' THEN CAST(length(replace(substr(y, 1, col), '-', '')) AS INTEGER) END AS n2 FROM q""",
)
def _(spark, d):
    w = Window.partitionBy("msa_id").orderBy("ord")
    pairs = msa(spark, d).select("seq_id", F.col("aligned").alias("x"), F.lead("aligned").over(w).alias("y")).where("y is not null")
    return M.pair_numbering(pairs, "seq_id", "x", "y")


def _neighbours(spark, d):
    w = Window.partitionBy("chain_id").orderBy("seq_id")
    rows = sequences(spark, d).where("chain_id is not null")
    return rows.select("seq_id", "s", F.lead("s").over(w).alias("s2")).where("s2 is not null")


@reg.add("op_2_6_1_numbering_mapping")
def _(spark, d):
    """Optimal global alignment of neighbouring sequences and the numbers it maps."""
    out = M.align(_neighbours(spark, d), "s", "s2")
    return out.select("seq_id", F.posexplode("aln.numbers").alias("k", "n")).select("seq_id", (F.col("k") + 1).alias("i"), F.col("n").alias("mapped"))


@reg.add("op_2_6_3_pairwise_aligner")
def _(spark, d):
    return M.align(_neighbours(spark, d), "s", "s2").select("seq_id", "aln.a", "aln.b", "aln.score")


@reg.add(
    "op_2_6_5_msa_annotate",
    f"{W_MSA} SELECT seq_id, CAST(1 AS INTEGER) AS \"start\", CAST(length(replace(aligned, '-', '')) AS INTEGER) AS \"end\" FROM msa",
)
def _(spark, d):
    return M.annotate(msa(spark, d), sequences(spark, d).select("seq_id", "s"))


@reg.add(
    "op_2_6_5_msa_annotate_columns",
    f"""{W_MSA}, c AS (SELECT seq_id, aligned, unnest(range(1, length(aligned) + 1)) AS col FROM (SELECT seq_id, substr(aligned, 3) AS aligned FROM msa))
SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY col) + least(length(s), CASE WHEN seq_id % 7 + 1 < 2 AND length(s) < w THEN seq_id % 7 + 1 ELSE 2 END) AS i, CAST(col AS INTEGER) AS col
FROM c JOIN (SELECT seq_id, s, length(m.aligned) AS w FROM msa m JOIN sequences USING (seq_id)) USING (seq_id) WHERE substr(c.aligned, col, 1) <> '-'""",
)
def _(spark, d):
    """Rows without their first two columns: each letter's place in the whole sequence."""
    part = msa(spark, d).withColumn("aligned", F.substring("aligned", 3, 1 << 30))
    out = M.annotate_columns(part, sequences(spark, d).select("seq_id", "s"))
    return out.withColumn("i", F.col("i").cast("long"))


@reg.add("op_2_6_4_star_alignment")
def _(spark, d):
    """The sequences of each chain aligned to the longest one (no SQL: alignment)."""
    return M.star_align(sequences(spark, d).where("chain_id is not null").select(F.col("chain_id").alias("msa_id"), "seq_id", "s"))


@reg.add("op_2_6_4_star_alignment_keeps_letters", f"{W_MSA} SELECT msa_id, seq_id, s, true AS square FROM msa JOIN sequences USING (seq_id)")
def _(spark, d):
    """What an alignment must keep: the letters of each row, and one width for all."""
    w = Window.partitionBy("msa_id")
    out = M.star_align(sequences(spark, d).where("chain_id is not null").select(F.col("chain_id").alias("msa_id"), "seq_id", "s"))
    width = F.length("aligned")
    return out.select("msa_id", "seq_id", F.replace("aligned", F.lit("-"), F.lit("")).alias("s"), (F.min(width).over(w) == F.max(width).over(w)).alias("square"))


@reg.add(
    "op_2_8_1_msa_set_operations",
    f"{W_MSA} SELECT msa_id, seq_id, 'first' AS part FROM msa WHERE ord = 1 UNION ALL SELECT msa_id, seq_id, 'rest' FROM msa WHERE ord > 1",
)
def _(spark, d):
    rows = msa(spark, d)
    first = rows.where("ord = 1")
    rest = M.remove_rows(rows, first)
    return first.select("msa_id", "seq_id", F.lit("first").alias("part")).unionByName(rest.select("msa_id", "seq_id", F.lit("rest").alias("part")))


IDS = ["SeqEl(1)", "SeqEl(10)", "SeqEl(700)", "PFP(10,1)", "PFP(3,4)", "Count(AILV)"]
_PFP_SQL = "pfp(aa, c1, c2, c3, c4, c5) AS (VALUES " + ", ".join(f"('{a}', {', '.join(repr(str(x)) for x in row)})" for a, row in PFP.items()) + ")"
_VARS_SQL = f"""WITH {SEQUENCES_SQL}, {_PFP_SQL},
results AS (
  SELECT seq_id AS object_id, 'SeqEl(1)' AS variable_id, true AS ok, substr(s, 1, 1) AS value, NULL AS error, 'str' AS rtype FROM sequences
  UNION ALL SELECT seq_id, 'SeqEl(10)', length(s) >= 10, CASE WHEN length(s) >= 10 THEN substr(s, 10, 1) END, CASE WHEN length(s) < 10 THEN 'no position 10' END, 'str' FROM sequences
  UNION ALL SELECT seq_id, 'SeqEl(700)', length(s) >= 700, CASE WHEN length(s) >= 700 THEN substr(s, 700, 1) END, CASE WHEN length(s) < 700 THEN 'no position 700' END, 'str' FROM sequences
  UNION ALL SELECT seq_id, 'PFP(10,1)', c1 IS NOT NULL, c1, CASE WHEN c1 IS NULL THEN 'no residue of the table at 10' END, 'float' FROM sequences LEFT JOIN pfp ON aa = substr(s, 10, 1)
  UNION ALL SELECT seq_id, 'PFP(3,4)', c4 IS NOT NULL, c4, CASE WHEN c4 IS NULL THEN 'no residue of the table at 3' END, 'float' FROM sequences LEFT JOIN pfp ON aa = substr(s, 3, 1)
  UNION ALL SELECT seq_id, 'Count(AILV)', true, CAST(length(s) - length(regexp_replace(s, '[AILV]', '', 'g')) AS VARCHAR), NULL, 'int' FROM sequences)"""


def _results(spark, d):
    return V.calculate(sequences(spark, d), "seq_id", "s", IDS)


@reg.add("op_2_11_4_generic_calculator", f"{_VARS_SQL} SELECT * FROM results")
def _(spark, d):
    return _results(spark, d)


@reg.add("op_2_6_16_protfp", f"{_VARS_SQL} SELECT object_id, variable_id, CAST(value AS DOUBLE) AS as_float FROM results WHERE rtype = 'float' AND ok")
def _(spark, d):
    return V.typed(_results(spark, d)).where("rtype = 'float' and ok").select("object_id", "variable_id", "as_float")


@reg.add("op_2_6_17_protfp_table", f"WITH {_PFP_SQL} SELECT aa, CAST(c1 AS DOUBLE) AS c1, CAST(c5 AS DOUBLE) AS c5 FROM pfp")
def _(spark, d):
    return spark.createDataFrame([(a, row[0], row[4]) for a, row in PFP.items()], "aa string, c1 double, c5 double")


@reg.add("op_2_5_19_aggregate_stored", f'{_VARS_SQL} SELECT object_id AS "ObjectID", variable_id AS "VariableID", value AS "VariableResult" FROM results')
def _(spark, d):
    return V.long(_results(spark, d))


@reg.add(
    "op_2_5_20_aggregate_wide",
    f"""{_VARS_SQL} SELECT object_id, {", ".join(f"max(value) FILTER (variable_id = '{v}') AS v{k}" for k, v in enumerate(IDS))} FROM results GROUP BY 1""",
)
def _(spark, d):
    out = V.wide(_results(spark, d), IDS)
    return out.select("object_id", *[F.col(f"`{v}`").alias(f"v{k}") for k, v in enumerate(IDS)])


@reg.add("op_2_11_3_broadcast_map", f"{_VARS_SQL} SELECT variable_id, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM results GROUP BY 1")
def _(spark, d):
    return _results(spark, d).groupBy("variable_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))


@reg.add("op_2_11_2_variable_container", f"{_VARS_SQL} SELECT rtype, count(DISTINCT variable_id) AS n FROM results GROUP BY 1")
def _(spark, d):
    return _results(spark, d).groupBy("rtype").agg(F.count_distinct("variable_id").alias("n"))


@reg.add("op_2_11_5_staging", f"WITH {SEQUENCES_SQL} SELECT seq_id AS object_id, unnest(['SeqEl(1)', 'PFP(3,4)']) AS variable_id FROM sequences WHERE length(s) >= 100")
def _(spark, d):
    """Which variables apply: sequence variables on objects long enough."""
    return V.assign(sequences(spark, d).where(F.length("s") >= 100), "seq_id", ["SeqEl(1)", "PFP(3,4)"]).select("object_id", "variable_id")


@reg.add(
    "op_2_11_6_assign_remove_reset",
    f"{_VARS_SQL} SELECT object_id, variable_id, CASE WHEN rtype <> 'str' THEN value END AS value FROM results WHERE variable_id <> 'SeqEl(700)'",
)
def _(spark, d):
    rows = _results(spark, d)
    kept = V.remove(rows.select("object_id", "variable_id", "value", "rtype"), rows.where("variable_id = 'SeqEl(700)'"))
    return V.reset(kept, rows.where("rtype = 'str'")).select("object_id", "variable_id", "value")


@reg.add("op_2_11_7_calculate", f"{_VARS_SQL} SELECT object_id, variable_id, ok FROM results WHERE NOT ok")
def _(spark, d):
    return _results(spark, d).where("not ok").select("object_id", "variable_id", "ok")


@reg.add("op_2_5_5_aggregators", f"{_VARS_SQL} SELECT variable_id, min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean, round(median(x), 6) AS med FROM (SELECT variable_id, CAST(value AS DOUBLE) AS x FROM results WHERE rtype <> 'str') GROUP BY 1")
def _(spark, d):
    rows = V.typed(_results(spark, d)).where("rtype <> 'str'").select("variable_id", F.coalesce("as_float", "as_int").alias("x"))
    return rows.groupBy("variable_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("med"))
