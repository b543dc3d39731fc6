"""Queries on segments and residues: projections, filters, lookups, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.operators import residues as R
from strandworks.operators import segments as S
from strandworks.plans.rank import ranked
from strandworks.plans.tables import table
from strandworks.queries._base import RESIDUES_SQL, SEGMENTS_SQL, SEQUENCES_SQL, Registry, residues, segment_rows, segments, sequences

reg = Registry()
QUERIES, SQL = reg.queries, reg.sql
RES, SEG, SEQ = f"WITH {RESIDUES_SQL}", f"WITH {SEGMENTS_SQL}", f"WITH {SEQUENCES_SQL}"


@reg.add("op_2_1_15_sequence_from_string", f"{RES} SELECT seq_id, i, aa FROM residues")
def _(spark, d):
    return residues(spark, d).select("seq_id", "i", "aa")


@reg.add("op_2_1_16_sequence_as_table", f"{SEQ} SELECT seq_id, s AS seq1 FROM sequences")
def _(spark, d):
    return R.collapse_sequence(residues(spark, d), "seq_id", "aa")


@reg.add("op_2_2_1_random_access", f"{RES} SELECT seq_id, i, aa FROM residues WHERE i BETWEEN 3 AND 12")
def _(spark, d):
    return R.take(residues(spark, d), 3, 12).select("seq_id", "i", "aa")


@reg.add("op_2_2_2_add_column", f"{RES} SELECT seq_id, i, aa, CASE WHEN aa IN ('D', 'E', 'K', 'R') THEN aa END AS charged FROM residues")
def _(spark, d):
    rows = residues(spark, d)
    values = rows.where(F.col("aa").isin("D", "E", "K", "R")).select("seq_id", "i", F.col("aa").alias("value"))
    return R.add_column(rows.drop("num"), "seq_id", values, "charged")


@reg.add(
    "op_2_2_3_column_predicates",
    f"{SEQ} SELECT seq_id, CAST(length(s) AS BIGINT) AS n, length(s) = 1 AS singleton, 100 BETWEEN seq_start AND seq_end AS has_100 FROM sequences",
)
def _(spark, d):
    return sequences(spark, d).select(
        "seq_id", F.length("s").cast("long").alias("n"), (F.length("s") == 1).alias("singleton"), F.lit(100).between(F.col("seq_start"), F.col("seq_end")).alias("has_100")
    )


@reg.add(
    "op_2_2_4_identity_strings",
    "SELECT seq_id, chain_id || '/' || seq_id || '|' || seq_start || '-' || seq_end || CASE WHEN chain_id IS NULL THEN '' ELSE '<-(' || chain_id || ')' END AS id, "
    "chain_id || '/' || seq_id || '|' || seq_start || '-' || seq_end AS own FROM chain_sequences WHERE chain_id IS NOT NULL",
)
def _(spark, d):
    t = table(spark, d, "chain_sequences").where("chain_id is not null")
    name = F.concat("chain_id", F.lit("/"), F.col("seq_id").cast("string"))
    full = S.segment_id(name, F.col("seq_start"), F.col("seq_end"), F.col("chain_id"))
    return t.select("seq_id", full.alias("id")).withColumn("own", S.strip_parents(F.col("id")))


@reg.add("op_2_2_5_shift", f"{SEG} SELECT g, name, s + 7 AS s, e + 7 AS e FROM segments")
def _(spark, d):
    s, e = S.shift(F.col("s"), F.col("e"), 7)
    return segments(spark, d).select("g", "name", s.alias("s"), e.alias("e"))


@reg.add("op_2_2_6_sequence_accessors", f"{RES} SELECT seq_id, i, coalesce(num, i) AS numbering, aa FROM residues")
def _(spark, d):
    return residues(spark, d).select("seq_id", "i", F.coalesce("num", "i").alias("numbering"), "aa")


@reg.add("op_2_2_7_item_lookup", f"{RES} SELECT seq_id, aa, min(i) AS value FROM residues GROUP BY ALL")
def _(spark, d):
    return R.first_of(residues(spark, d), "seq_id", "aa", F.col("i"))


@reg.add(
    "op_2_2_8_closest_lookup",
    f"{RES}, up AS (SELECT seq_id, min(i) FILTER (num >= 60) AS up FROM residues GROUP BY 1), "
    "down AS (SELECT seq_id, max(i) FILTER (num <= 60) AS down FROM residues GROUP BY 1) SELECT * FROM up JOIN down USING (seq_id)",
)
def _(spark, d):
    rows = residues(spark, d)
    up = R.closest(rows, "seq_id", "num", 60).withColumnRenamed("at", "up")
    return up.join(R.closest(rows, "seq_id", "num", 60, reverse=True).withColumnRenamed("at", "down"), "seq_id")


@reg.add(
    "op_2_2_9_boundary_mapping",
    f"""{RES}, x AS (SELECT seq_id, max(num) AS hi, min(num) AS lo, min(i) FILTER (num >= 50) AS su, max(i) FILTER (num <= 50) AS sd,
    min(i) FILTER (num >= 90) AS eu, max(i) FILTER (num <= 90) AS ed FROM residues GROUP BY 1)
SELECT seq_id, CASE WHEN 50 > hi THEN sd ELSE su END AS from_i, CASE WHEN 90 < lo THEN eu ELSE ed END AS to_i FROM x""",
)
def _(spark, d):
    return R.map_boundaries(residues(spark, d), "seq_id", "num", F.lit(50), F.lit(90), nearest=True)


@reg.add("op_2_2_18_apply_to_map", f"{RES} SELECT seq_id, i, num * 2 + 1 AS num FROM residues")
def _(spark, d):
    return residues(spark, d).select("seq_id", "i", (F.col("num") * 2 + 1).alias("num"))


@reg.add("op_2_2_19_apply_to_objects", f"{SEQ} SELECT seq_id, reverse(s) AS s FROM sequences")
def _(spark, d):
    return sequences(spark, d).select("seq_id", F.reverse("s").alias("s"))


@reg.add(
    "op_2_2_22_sequence_summary",
    f"{SEQ} SELECT chain_id AS parent_id, CAST(seq_id AS VARCHAR) AS object_id, seq_start AS start_pos, seq_end AS end_pos, 'len' AS meta_key, CAST(length(s) AS VARCHAR) AS meta_value FROM sequences",
)
def _(spark, d):
    meta = F.create_map(F.lit("len"), F.length("s").cast("string"))
    rows = sequences(spark, d).select(F.col("chain_id").alias("parent_id"), F.col("seq_id").cast("string").alias("object_id"), F.col("seq_start").alias("start_pos"), F.col("seq_end").alias("end_pos"), meta.alias("m"))
    return rows.select("parent_id", "object_id", "start_pos", "end_pos", F.explode("m").alias("meta_key", "meta_value"))


@reg.add(
    "op_2_2_30_category_tag",
    "SELECT seq_id, CASE WHEN seq1 IS NULL THEN 'all' ELSE 'all,has_seq' END AS category FROM chain_sequences",
)
def _(spark, d):
    t = table(spark, d, "chain_sequences")
    tags = F.array_union(F.array(F.lit("all")), F.when(F.col("seq1").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("has_seq"))))
    return t.select("seq_id", F.array_join(tags, ",").alias("category"))


@reg.add(
    "op_2_2_31_field_helpers",
    "SELECT u, string_agg(p, ',' ORDER BY p) AS ps FROM (SELECT DISTINCT upper(trim(uniprot_id, ' ')) AS u, upper(trim(pdb, ' ')) AS p FROM sifts WHERE uniprot_id IS NOT NULL AND pdb IS NOT NULL) GROUP BY u",
)
def _(spark, d):
    """Column to column: sorted distinct partners of each key."""
    pairs = table(spark, d, "sifts").select(F.upper(F.trim("uniprot_id")).alias("u"), F.upper(F.trim("pdb")).alias("p")).where("u is not null and p is not null")
    return pairs.groupBy("u").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("ps"))


@reg.add("op_2_3_1_generic_filter", f"{SEQ} SELECT seq_id FROM sequences WHERE length(s) > 200 AND s LIKE 'M%'")
def _(spark, d):
    return sequences(spark, d).where((F.length("s") > 200) & F.startswith("s", F.lit("M"))).select("seq_id")


@reg.add("op_2_3_2_category_filter", "SELECT seq_id FROM chain_sequences WHERE seq1 IS NOT NULL")
def _(spark, d):
    t = table(spark, d, "chain_sequences").withColumn("category", F.when(F.col("seq1").isNull(), "all").otherwise("all,has_seq"))
    return t.where(F.array_contains(F.split("category", ","), "has_seq")).select("seq_id")


@reg.add("op_2_3_3_substring_access", "SELECT seq_id, chain_id FROM chain_sequences WHERE contains(chain_id, 'kin_')")
def _(spark, d):
    return table(spark, d, "chain_sequences").where(F.contains("chain_id", F.lit("kin_"))).select("seq_id", "chain_id")


@reg.add(
    "op_2_3_4_position_filter",
    f"""{RES}, a AS (SELECT seq_id FROM residues WHERE num IN (40, 41, 55) GROUP BY 1 HAVING count(DISTINCT num) = 3),
b AS (SELECT seq_id, arg_min(num, i) FILTER (num >= 40) AS f, arg_max(num, i) FILTER (num <= 90) AS t FROM residues GROUP BY 1)
SELECT seq_id, f AS from_key, t AS to_key, seq_id IN (SELECT seq_id FROM a) AS has_all FROM b WHERE f <= t""",
)
def _(spark, d):
    rows = residues(spark, d)
    every = R.holds_all(rows, "seq_id", "num", [40, 41, 55]).withColumn("has_all", F.lit(True))
    return R.mapped_span(rows, "seq_id", "num", 40, 90).join(every, "seq_id", "left").withColumn("has_all", F.coalesce("has_all", F.lit(False)))


@reg.add(
    "op_2_3_5_interval_predicates",
    f"{SEG} SELECT g, name, s, e, ps, pe, s <= pe AND ps <= e AS overlaps, s <= ps AND pe <= e AS bounds, ps <= s AND e <= pe AS bounded FROM segments",
)
def _(spark, d):
    c = [F.col(x) for x in ("s", "e", "ps", "pe")]
    return segments(spark, d).withColumns({"overlaps": S.overlaps(*c), "bounds": S.bounds(*c), "bounded": S.bounded_by(*c)})


@reg.add(
    "op_2_3_6_any_overlap",
    f"""{SEG}, x AS (SELECT g, s, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT DISTINCT g, s, e FROM segments))
SELECT g, bool_or(coalesce(s <= b, false)) AS has_overlap FROM x GROUP BY g""",
)
def _(spark, d):
    return S.any_overlap(segments(spark, d).select("g", "s", "e").distinct(), ["g"], "s", "e")


@reg.add(
    "op_2_4_1_numbering_relate",
    f"""{RES}, other AS (SELECT seq_id, num, min_by(aa, i) AS via FROM residues GROUP BY 1, 2)
SELECT r.seq_id, r.i, o.via FROM residues r LEFT JOIN other o ON r.seq_id = o.seq_id AND r.num IS NOT DISTINCT FROM o.num""",
)
def _(spark, d):
    letters = F.split("s", "")
    num = F.transform(letters, lambda x, k: F.when(x != "X", F.col("seq_start") + k))
    out = R.relate_packed(sequences(spark, d), ["seq_id"], num, num, letters, "via")
    return out.select("seq_id", F.posexplode("via").alias("k", "via")).select("seq_id", (F.col("k") + 1).alias("i"), "via")


@reg.add("op_2_4_2_fill", f"{RES} SELECT seq_id, i, coalesce(num, -i) AS patched FROM residues")
def _(spark, d):
    rows = residues(spark, d).withColumn("template", -F.col("i"))
    return R.fill(rows, "num", "template", "patched").select("seq_id", "i", "patched")


@reg.add(
    "op_2_4_3_patch",
    f"{RES} SELECT seq_id, i, aa, aa IN ('W', 'X') AND i > lo AND i < hi AS patched FROM (SELECT *, min(i) FILTER (aa NOT IN ('W', 'X')) OVER (PARTITION BY seq_id) AS lo, "
    "max(i) FILTER (aa NOT IN ('W', 'X')) OVER (PARTITION BY seq_id) AS hi FROM residues) WHERE i BETWEEN lo AND hi",
)
def _(spark, d):
    """Sequences that lost W and X get them back from the template."""
    places = F.transform(F.split("s", ""), lambda x, k: F.struct(x.alias("aa"), (k + 1).alias("at")))
    rows = sequences(spark, d).where(F.rlike("s", F.lit("[^WX]"))).withColumn("lossy", F.filter(places, lambda p: ~p["aa"].isin("W", "X")))
    rows = rows.select("seq_id", "s", "lossy", (F.col("lossy")[0]["at"] - 1).alias("before"))
    out = R.patch_packed(rows, ["seq_id", "before"], F.col("lossy.at"), F.col("lossy.at"), F.col("lossy.aa"), F.split("s", ""))
    out = out.select("seq_id", "before", "patched", F.posexplode("letters").alias("k", "aa"))
    return out.select("seq_id", (F.col("before") + F.col("k") + 1).alias("i"), "aa", F.col("patched")[F.col("k")].alias("patched"))


@reg.add("op_2_4_5_map_transfer", f"{RES} SELECT a.seq_id, a.i, b.aa AS moved FROM residues a LEFT JOIN residues b ON a.seq_id = b.seq_id AND b.i = a.i + 2")
def _(spark, d):
    n = F.length("s")
    out = R.relate_packed(sequences(spark, d), ["seq_id"], F.sequence(F.lit(3), n + 2), F.sequence(F.lit(1), n), F.split("s", ""), "moved")
    return out.select("seq_id", F.posexplode("moved").alias("k", "moved")).select("seq_id", (F.col("k") + 1).alias("i"), "moved")


@reg.add(
    "op_2_4_7_segment_numbering",
    """WITH base AS (SELECT DISTINCT upper(trim(uniprot_id, ' ')) AS g, pdb_chain AS c, uniprot_start AS s, uniprot_end AS e, pdb_start AS ps, pdb_end AS pe FROM sifts
  WHERE uniprot_id IS NOT NULL AND pdb_chain IS NOT NULL AND uniprot_start >= 1 AND uniprot_end >= uniprot_start AND pdb_start >= 1 AND pdb_end >= pdb_start),
f AS (SELECT g, c, unnest(range(min(s), max(e) + 1)) AS from_pos, min(s) AS s0 FROM base GROUP BY g, c),
cov AS (SELECT DISTINCT g, c, unnest(range(ps, pe + 1)) AS p FROM base),
sp AS (SELECT g, c, unnest(range(min(ps), max(pe) + 1)) AS p, min(ps) AS p0 FROM base GROUP BY g, c)
SELECT f.g, f.c, CAST(f.from_pos - f.s0 + 1 AS INTEGER) AS at, CAST(f.from_pos AS INTEGER) AS from_pos, CAST(cov.p AS INTEGER) AS to_pos
FROM f JOIN sp ON f.g = sp.g AND f.c = sp.c AND f.from_pos - f.s0 = sp.p - sp.p0 LEFT JOIN cov ON cov.g = sp.g AND cov.c = sp.c AND cov.p = sp.p""",
)
def _(spark, d):
    rows = segment_rows(spark, d).withColumnRenamed("name", "c")
    return S.segment_numbering(rows, ["g", "c"], ("s", "e"), ("ps", "pe"))


@reg.add("op_2_4_12_map_for_staging", f"{RES} SELECT seq_id, aa, max(i) AS value FROM residues GROUP BY ALL")
def _(spark, d):
    return R.last_of(residues(spark, d), "seq_id", "aa", F.col("i"))


@reg.add("op_2_5_1_coverage", f"{RES} SELECT seq_id, round(count(num) / count(*), 6) AS cov_num FROM residues GROUP BY 1")
def _(spark, d):
    return R.coverage(residues(spark, d), "seq_id", ["num"]).withColumn("cov_num", F.round("cov_num", 6))


@reg.add("op_2_5_2_match_fraction", f"{RES} SELECT seq_id, round(count(*) FILTER (num IS NOT DISTINCT FROM i) / count(*), 6) AS matched FROM residues GROUP BY 1")
def _(spark, d):
    return R.match(residues(spark, d), "seq_id", "num", "i").withColumn("matched", F.round("matched", 6))


@reg.add(
    "op_2_5_3_run_groups",
    f"""{RES}, t AS (SELECT *, CASE WHEN lag(aa) OVER w = aa THEN 0 ELSE 1 END AS turn FROM residues WINDOW w AS (PARTITION BY seq_id ORDER BY i)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY seq_id ORDER BY i) AS run FROM t)
SELECT seq_id, CAST(run AS BIGINT) AS run, min(aa) AS aa, count(*) AS n FROM r GROUP BY seq_id, run""",
)
def _(spark, d):
    runs = R.consecutive_runs(residues(spark, d), ["i"], "aa", ["seq_id"])
    return runs.groupBy("seq_id", "run").agg(F.min("aa").alias("aa"), F.count(F.lit(1)).alias("n"))


@reg.add(
    "op_2_5_10_slice_transform_reduce",
    f"{RES} SELECT seq_id, count(*) FILTER (aa IN ('A', 'I', 'L', 'V')) AS n FROM residues WHERE i BETWEEN 5 AND 60 GROUP BY 1",
)
def _(spark, d):
    """The letters of an inclusive slice, tested and summed, with array functions."""
    letters = F.slice(F.split("s", ""), 5, 56)
    hits = F.transform(letters, lambda x: F.when(x.isin("A", "I", "L", "V"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = sequences(spark, d).where(F.length("s") >= 5)
    return rows.select("seq_id", F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@reg.add("op_2_7_1_sort", "SELECT seq_id, row_number() OVER (ORDER BY chain_id NULLS FIRST, seq_id) AS ord FROM chain_sequences")
def _(spark, d):
    """Global order by id with an explicit rank, from range partitions."""
    return ranked(table(spark, d, "chain_sequences").select("chain_id", "seq_id"), F.asc_nulls_first("chain_id"), "seq_id").select("seq_id", "ord")


@reg.add(
    "op_2_7_5_drop_duplicates",
    f"{SEQ} SELECT min(seq_id) AS seq_id, s FROM sequences GROUP BY s",
)
def _(spark, d):
    return sequences(spark, d).groupBy("s").agg(F.min("seq_id").alias("seq_id"))


@reg.add(
    "op_2_8_2_list_concatenation",
    f"{SEQ} SELECT seq_id, 1 AS part FROM sequences UNION ALL SELECT seq_id, 2 FROM sequences WHERE length(s) < 50",
)
def _(spark, d):
    s = sequences(spark, d)
    return s.select("seq_id", F.lit(1).alias("part")).unionByName(s.where(F.length("s") < 50).select("seq_id", F.lit(2).alias("part")))


@reg.add(
    "op_2_8_3_segment_intersection",
    f"{SEG} SELECT g || '&' || name AS ov_name, greatest(s, ps) AS ov_start, least(e, pe) AS ov_end FROM segments WHERE s <= pe AND ps <= e",
)
def _(spark, d):
    return S.intersect(segments(spark, d), ("g", "s", "e"), ("name", "ps", "pe")).select("ov_name", "ov_start", "ov_end")


@reg.add(
    "op_2_8_4_segment_append",
    f"""{SEQ}, n AS (SELECT *, lead(s) OVER w AS s2 FROM sequences WHERE chain_id IS NOT NULL WINDOW w AS (PARTITION BY chain_id ORDER BY seq_id))
SELECT seq_id, seq_start AS start_pos, CAST(seq_start + length(s) + length(s2) - 1 AS INTEGER) AS end_pos, s || s2 AS seq1 FROM n WHERE s2 IS NOT NULL""",
)
def _(spark, d):
    w = Window.partitionBy("chain_id").orderBy("seq_id")
    rows = sequences(spark, d).where("chain_id is not null").withColumn("s2", F.lead("s").over(w)).where("s2 is not null")
    return rows.select("seq_id", F.col("seq_start").alias("start_pos"), (F.col("seq_start") + F.length("s") + F.length("s2") - 1).alias("end_pos"), F.concat("s", "s2").alias("seq1"))


@reg.add("op_2_8_5_segment_insert", f"{SEQ} SELECT seq_id, substr(s, 1, 4) || 'GG' || substr(s, 5) AS seq1 FROM sequences WHERE length(s) >= 4")
def _(spark, d):
    """Insert two letters after position 4: split, append, append the rest."""
    rows = sequences(spark, d).where(F.length("s") >= 4)
    return rows.select("seq_id", F.concat(F.substring("s", 1, 4), F.lit("GG"), F.substring("s", 5, 1 << 30)).alias("seq1"))


@reg.add(
    "op_2_8_6_resolve_overlaps",
    f"""WITH RECURSIVE {SEGMENTS_SQL.replace("segments AS", "segs AS")},
u AS (SELECT DISTINCT g, s, e FROM segs),
o AS (SELECT g, s, e, row_number() OVER (PARTITION BY g ORDER BY e, s) AS k FROM u),
p AS (SELECT a.g, a.s, a.e, a.k, (SELECT count(*) FROM o b WHERE b.g = a.g AND b.e < a.s) AS j FROM o a),
dp(g, k, best) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] FROM u
  UNION ALL
  SELECT p.g, p.k, dp.best || [greatest(dp.best[p.k], dp.best[p.j + 1] + p.e - p.s + 1)] FROM dp JOIN p ON p.g = dp.g AND p.k = dp.k + 1)
SELECT g, CAST(max(best[-1]) AS BIGINT) AS covered FROM dp GROUP BY g""",
)
def _(spark, d):
    """Total length of the best non-overlapping segments of each protein."""
    rows = segments(spark, d).select("g", "s", "e").withColumn("v", (F.col("e") - F.col("s") + 1).cast("double"))
    return S.resolve_overlaps(rows, "g", "s", "e", "v").groupBy("g").agg(F.sum("v").cast("long").alias("covered"))


@reg.add("op_2_6_15_sequence_element", f"{SEQ} SELECT seq_id, length(s) >= 10 AS ok, CASE WHEN length(s) >= 10 THEN substr(s, 10, 1) END AS value FROM sequences")
def _(spark, d):
    value = F.get(F.split("s", ""), F.lit(9))
    return sequences(spark, d).select("seq_id", value.isNotNull().alias("ok"), value.alias("value"))


@reg.add(
    "op_2_9_1_spawn_child",
    f"{RES} SELECT seq_id, CAST(seq_id AS VARCHAR) || '|3-9' AS child, i, aa FROM residues WHERE i BETWEEN 3 AND 9",
)
def _(spark, d):
    rows = residues(spark, d)
    ranges = rows.select("seq_id").distinct().select("seq_id", F.lit(3).alias("from_i"), F.lit(9).alias("to_i"))
    name = S.segment_id(F.col("seq_id").cast("string"), F.col("from_i"), F.col("to_i"))
    return R.spawn_child(rows, "seq_id", ranges, name).select("seq_id", "child", "i", "aa")
