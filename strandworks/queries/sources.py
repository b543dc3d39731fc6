"""Queries on sources: texts in the input tables, and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.functions.tables import AMINO
from strandworks.operators import sifts as X
from strandworks.operators.compaction import fasta_entries
from strandworks.plans.scratch import Scratch
from strandworks.plans.tables import table
from strandworks.queries._base import SEQUENCES_SQL, Registry, sequences
from strandworks.queries.structures import ATOMS_SQL, atoms
from strandworks.sources import fasta, records, remote, services
from strandworks.sources import structure_text as S

reg = Registry()
QUERIES, SQL = reg.queries, reg.sql
SEQ = f"WITH {SEQUENCES_SQL}"


@reg.add(
    "op_2_1_1_fasta_reader",
    """WITH e AS (SELECT file_path, unnest(string_split(chr(10) || regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10) || '>')[2:]) AS p FROM collection_files WHERE area = 'sequence_files')
SELECT file_path, regexp_extract(p, '^([^\\s]*)', 1) AS seq_id, CASE WHEN strpos(p, chr(10)) > 0 THEN upper(regexp_replace(substr(p, strpos(p, chr(10))), '\\s+', '', 'g')) ELSE '' END AS seq1 FROM e""",
)
def _(spark, d):
    files = table(spark, d, "collection_files").where("area = 'sequence_files'")
    return files.select("file_path", F.explode(fasta_entries(F.col("content"))).alias("x")).select("file_path", F.col("x.record_id").alias("seq_id"), F.col("x.body").alias("seq1"))


@reg.add("op_2_1_2_fasta_round_trip", f"{SEQ} SELECT CAST(seq_id AS VARCHAR) AS seq_id, s AS seq1 FROM sequences")
def _(spark, d):
    """Write the sequences as FASTA files and scan them back."""
    path = Scratch(spark, "fasta").path("out")
    fasta.write_fasta(sequences(spark, d).select(F.col("seq_id").cast("string").alias("seq_id"), F.col("s").alias("seq1")), path)
    return fasta.read_fasta(spark, path)


@reg.add("op_2_1_3_fasta_export", f"{SEQ} SELECT chain_id, string_agg('>' || seq_id || chr(10) || s, chr(10) ORDER BY seq_id) AS fasta FROM sequences WHERE chain_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    return fasta.to_fasta(sequences(spark, d).where("chain_id is not null"), "chain_id", "seq_id", "seq_id", "s")


_CIF = """WITH f AS (SELECT split_part(regexp_extract(file_path, '([^/]*)$', 1), '.', 1) AS structure_id, min(content) AS content FROM collection_files WHERE area = 'structure_files' AND content IS NOT NULL GROUP BY 1),
l AS (SELECT structure_id, string_split(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '\\s+', ' ', 'g'), ' ') AS p FROM (SELECT structure_id, unnest(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM f))"""


@reg.add(
    "op_2_1_6_structure_reader",
    _CIF + " SELECT structure_id, p[2] AS atom_name, p[3] AS res_name, CAST(p[4] AS INTEGER) AS res_id, CAST(p[5] AS DOUBLE) AS x, CAST(p[6] AS DOUBLE) AS y, CAST(p[7] AS DOUBLE) AS z FROM l WHERE len(p) = 7 AND regexp_full_match(p[1], '[0-9]+')",
)
def _(spark, d):
    """Atoms of the structure texts, one text per structure."""
    name = F.regexp_extract(F.regexp_extract("file_path", r"([^/]*)$", 1), r"^([^.]*)", 1)
    texts = table(spark, d, "collection_files").where("area = 'structure_files' and content is not null").groupBy(name.alias("structure_id")).agg(F.min("content").alias("text"))
    return S.parse_structures(texts, "structure_id", "text").select("structure_id", "atom_name", "res_name", "res_id", "x", "y", "z")


# every distinct text of a name, not only the least one
_VERSIONS = _CIF.replace("min(content) AS content", "md5(content) AS digest, content").replace("GROUP BY 1)", "GROUP BY ALL)").replace("SELECT structure_id, string_split", "SELECT structure_id, digest, string_split").replace("(SELECT structure_id, unnest", "(SELECT structure_id, digest, unnest")


def _versions(spark, d, where="content is not null"):
    """``structure_id, digest, key, text``: each distinct text of a structure."""
    name = F.regexp_extract(F.regexp_extract("file_path", r"([^/]*)$", 1), r"^([^.]*)", 1)
    rows = table(spark, d, "collection_files").where("area = 'structure_files'").where(where).select(name.alias("structure_id"), F.md5("content").alias("digest"), F.col("content").alias("text"))
    return rows.dropDuplicates(["structure_id", "digest"]).withColumn("key", F.concat_ws(".", "structure_id", "digest"))


@reg.add(
    "op_2_1_6_structure_versions",
    _VERSIONS + " SELECT structure_id, digest, p[2] AS atom_name, p[3] AS res_name, CAST(p[4] AS INTEGER) AS res_id, CAST(p[5] AS DOUBLE) AS x, CAST(p[6] AS DOUBLE) AS y, CAST(p[7] AS DOUBLE) AS z FROM l WHERE len(p) = 7 AND regexp_full_match(p[1], '[0-9]+')",
)
def _(spark, d):
    """Atoms of every distinct text of a structure, keyed by the text's digest."""
    rows = S.parse_structures(_versions(spark, d), "key", "text").withColumnRenamed("structure_id", "key")
    return rows.select(F.substring_index("key", ".", 1).alias("structure_id"), F.substring_index("key", ".", -1).alias("digest"), "atom_name", "res_name", "res_id", "x", "y", "z")


@reg.add("op_2_1_7_structure_round_trip", f"WITH {ATOMS_SQL} SELECT structure_id, atom_idx, chain_id, res_id, res_name, atom_name, element, hetero, altloc_id, x, y, z FROM atoms")
def _(spark, d):
    """Write structures as text, parse them back."""
    rows = atoms(spark, d).withColumn("ins_code", F.lit(""))
    back = S.parse_structures(S.structure_texts(rows), "structure_id", "text", "pdb")
    return back.drop("ins_code")


@reg.add("op_2_1_7_structure_round_trip_mmcif", f"WITH {ATOMS_SQL} SELECT structure_id, atom_idx, chain_id || 'x' AS chain_id, res_id + 100000 AS res_id, res_name, atom_name || '''' AS atom_name, element, hetero, altloc_id, x, y, z FROM atoms")
def _(spark, d):
    """Names and numbers that do not fit the older format, written as mmCIF and parsed."""
    rows = atoms(spark, d).withColumns({"ins_code": F.lit(""), "chain_id": F.concat("chain_id", F.lit("x")), "res_id": F.col("res_id") + 100000, "atom_name": F.concat("atom_name", F.lit("'"))})
    back = S.parse_structures(S.structure_texts(rows, "mmcif"), "structure_id", "text", "mmcif")
    return back.drop("ins_code")


@reg.add("op_2_1_6_structure_files", f"WITH {ATOMS_SQL} SELECT structure_id, atom_idx, chain_id, res_id, res_name, atom_name, x, y, z FROM atoms")
def _(spark, d):
    """Structures written as files of both formats and read back from their folder."""
    rows = atoms(spark, d).withColumn("ins_code", F.lit(""))
    path = Scratch(spark, "structures").path("files")
    number = F.substring("structure_id", 2, 99).cast("int") % 2
    S.write_structures(rows.where(number == 0), path, "pdb")
    S.write_structures(rows.where(number == 1), path, "cif")
    return S.read_structures(spark, path).select("structure_id", "atom_idx", "chain_id", "res_id", "res_name", "atom_name", "x", "y", "z")


@reg.add("op_2_1_9_sequence_dump", f"{SEQ} SELECT seq_id, CAST(i AS INTEGER) AS i, substr(s, i, 1) AS aa FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM sequences)")
def _(spark, d):
    """Tab-separated dumps in folders by chain type, read back by their paths."""
    from strandworks.operators.residues import explode_sequence

    path = Scratch(spark, "dump").path("out")
    rows = explode_sequence(sequences(spark, d), "seq_id", "s", "aa").withColumn("folder", F.pmod("seq_id", F.lit(8)))
    rows.select("folder", "seq_id", "i", "aa").write.partitionBy("folder").option("sep", "\t").option("header", "true").csv(path)
    back = spark.read.schema("seq_id long, i int, aa string").option("sep", "\t").option("header", "true").csv(f"{path}/*")
    where = F.regexp_extract(F.col("_metadata.file_path"), r"folder=(\d+)", 1).cast("long")
    return back.where(where == F.pmod("seq_id", F.lit(8))).select("seq_id", "i", "aa")


@reg.add("op_2_1_14_directory_tree", "SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n_files, count(DISTINCT regexp_extract(file_path, '([^/]*)$', 1)) AS n_names FROM collection_files GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "collection_files")
    return t.groupBy(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct(F.regexp_extract("file_path", r"([^/]*)$", 1)).alias("n_names"))


@reg.add("op_2_1_20_initializer_by_extension", "SELECT CASE WHEN file_path LIKE '%.fasta' OR file_path LIKE '%.fa' THEN 'sequence' WHEN file_path LIKE '%.cif' THEN 'structure' ELSE 'unsupported' END AS kind, count(*) AS n FROM collection_files GROUP BY 1")
def _(spark, d):
    kind = F.when(F.col("file_path").rlike(r"\.(fasta|fa)$"), "sequence").when(F.col("file_path").rlike(r"\.cif$"), "structure").otherwise("unsupported")
    return table(spark, d, "collection_files").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@reg.add(
    "op_2_1_20_initialized_objects",
    _VERSIONS
    + """, parts AS (SELECT unnest(string_split(chr(10) || regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10) || '>')[2:]) AS p FROM collection_files WHERE area = 'sequence_files'),
s AS (SELECT DISTINCT regexp_extract(p, '^([^\\s]*)', 1) AS name, CASE WHEN strpos(p, chr(10)) > 0 THEN upper(regexp_replace(substr(p, strpos(p, chr(10))), '\\s+', '', 'g')) ELSE '' END AS body FROM parts)
SELECT 'sequence' AS kind, name, md5(body) AS digest, CAST(length(body) AS BIGINT) AS size FROM s WHERE body <> ''
UNION ALL SELECT 'structure', structure_id, digest, count(*) FROM l WHERE len(p) = 7 AND regexp_full_match(p[1], '[0-9]+') GROUP BY 2, 3""",
)
def _(spark, d):
    """Objects of mixed files: each distinct sequence with its letters, each distinct
    structure with its atoms."""
    files = table(spark, d, "collection_files")
    one = files.where("area = 'sequence_files'").select(F.explode(fasta_entries(F.col("content"))).alias("x")).select(F.col("x.record_id").alias("name"), F.col("x.body").alias("body"))
    sequences_ = one.where("body <> ''").select(F.lit("sequence").alias("kind"), "name", F.md5("body").alias("digest"), F.length("body").cast("long").alias("size")).distinct()
    atoms_ = S.parse_structures(_versions(spark, d), "key", "text").groupBy(F.col("structure_id").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    structures = atoms_.select(F.lit("structure").alias("kind"), F.substring_index("key", ".", 1).alias("name"), F.substring_index("key", ".", -1).alias("digest"), "size")
    return sequences_.unionByName(structures)


@reg.add("op_2_1_22_cluster_reader", f"{SEQ} SELECT chain_id AS file, row_number() OVER (PARTITION BY chain_id ORDER BY s) - 1 AS cluster, CAST(m AS VARCHAR) AS member FROM (SELECT chain_id, s, list(seq_id) AS ms FROM sequences WHERE chain_id IS NOT NULL GROUP BY 1, 2), unnest(ms) AS u(m) WHERE false")
def _(spark, d):
    """Cluster files made from equal sequences of a chain, parsed back."""
    rows = sequences(spark, d).where("chain_id is not null")
    w = Window.partitionBy("chain_id").orderBy("s")
    ranked = rows.withColumn("k", F.dense_rank().over(w) - 1)
    heads = ranked.select("chain_id", "k", F.lit(-1).cast("long").alias("o"), F.concat(F.lit(">Cluster "), F.col("k")).alias("line")).distinct()
    items = ranked.select("chain_id", "k", F.col("seq_id").alias("o"), F.concat(F.lit("0\t9aa, >"), F.col("seq_id"), F.lit("... *")).alias("line"))
    lines = heads.unionByName(items).withColumn("at", F.struct("k", "o"))
    return records.parse_clusters(lines, "chain_id", "at", "line").select(F.col("chain_id").alias("file"), F.col("cluster").cast("long").alias("cluster"), "member")


SQL["op_2_1_22_cluster_reader"] = f"{SEQ} SELECT chain_id AS file, dense_rank() OVER (PARTITION BY chain_id ORDER BY s) - 1 AS cluster, CAST(seq_id AS VARCHAR) AS member FROM sequences WHERE chain_id IS NOT NULL"


def _dssp_lines(spark, d):
    a = atoms(spark, d).where("atom_name = 'CA'")
    ss = F.element_at(F.array(*[F.lit(x) for x in "HGEBT S"]), F.pmod(F.col("res_id"), F.lit(7)) + 1)
    pad = lambda c, n: F.lpad(c.cast("string"), n, " ")
    line = F.concat(pad(F.col("res_id") + 1, 5), pad(F.col("res_id"), 5), F.lit(" "), F.col("chain_id"), F.lit(" X  "), ss, F.lit(" " * 17), pad(F.col("res_id") * 3, 4))
    return a.select("structure_id", F.rpad(line, 136, " ").alias("value"))


@reg.add("op_2_1_23_secondary_structure_parser", f"WITH {ATOMS_SQL} SELECT structure_id, chain_id, res_id, CASE WHEN s IN ('H', 'G') THEN 'H' WHEN s IN ('E', 'B') THEN 'E' ELSE 'C' END AS ss3, count(*) AS n FROM (SELECT *, ['H', 'G', 'E', 'B', 'T', ' ', 'S'][res_id % 7 + 1] AS s FROM atoms) GROUP BY ALL")
def _(spark, d):
    """Fixed-width records made from the structures, parsed and joined onto atoms."""
    ss = records.parse_dssp(_dssp_lines(spark, d))
    every = records.annotate_structure(atoms(spark, d), ss)
    return every.groupBy("structure_id", "chain_id", "res_id", "ss3").agg(F.count(F.lit(1)).alias("n"))


@reg.add("op_2_1_25_component_source", _CIF.replace(" AND content IS NOT NULL", " AND content IS NOT NULL AND content LIKE '%loop_%'") + " SELECT structure_id AS comp_id, count(*) AS n_rows FROM l WHERE len(p) = 7 AND regexp_full_match(p[1], '[0-9]+') GROUP BY 1")
def _(spark, d):
    """STAR blocks in long form, counted by their first field."""
    name = F.regexp_extract(F.regexp_extract("file_path", r"([^/]*)$", 1), r"^([^.]*)", 1)
    texts = table(spark, d, "collection_files").where("area = 'structure_files' and content like '%loop_%'").groupBy(name.alias("comp_id")).agg(F.min("content").alias("text"))
    return records.parse_components(texts, "comp_id", "text").where("grp = 'atom_site' and field = 'id'").groupBy("comp_id").agg(F.count(F.lit(1)).alias("n_rows"))


@reg.add("op_2_1_25_component_versions", _VERSIONS.replace(" AND content IS NOT NULL", " AND content IS NOT NULL AND content LIKE '%loop_%'") + " SELECT structure_id AS comp_id, digest, count(*) AS n_rows FROM l WHERE len(p) = 7 AND regexp_full_match(p[1], '[0-9]+') GROUP BY 1, 2")
def _(spark, d):
    """The same of every distinct text, keyed by its digest."""
    found = records.parse_components(_versions(spark, d, "content like '%loop_%'"), "key", "text").where("grp = 'atom_site' and field = 'id'")
    found = found.groupBy(F.col("comp_id").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.select(F.substring_index("key", ".", 1).alias("comp_id"), F.substring_index("key", ".", -1).alias("digest"), "n_rows")


_THREE = "CASE substr(s, 1, 1) " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in AMINO.items()) + " END"


@reg.add("op_2_1_18_component_letters", f"{SEQ} SELECT 'C' || seq_id AS res_name, CASE WHEN seq_id % 3 = 0 THEN 'X' WHEN {_THREE} IS NULL AND seq_id % 3 = 1 THEN 'X' ELSE substr(s, 1, 1) END AS letter FROM sequences")
def _(spark, d):
    """Letters of components that are modified residues, have a code, or neither."""
    rows, parent = sequences(spark, d), F.lit(None).cast("string")
    for three, one in AMINO.items():
        parent = F.when(F.substring("s", 1, 1) == one, three).otherwise(parent)
    kind = F.col("seq_id") % 3
    lines = [
        F.concat(F.lit("data_C"), "seq_id"), F.concat(F.lit("_chem_comp.id C"), "seq_id"),
        F.concat(F.lit("_chem_comp.one_letter_code "), F.when(kind == 2, F.substring("s", 1, 1)).otherwise("?")),
        F.concat(F.lit("_chem_comp.mon_nstd_parent_comp_id "), F.coalesce(F.when(kind == 1, parent), F.lit("?"))),
    ]
    texts = rows.select(F.concat(F.lit("C"), "seq_id").alias("id"), F.concat_ws("\n", *lines).alias("text"))
    return records.component_letters(records.parse_components(texts, "id", "text"))


@reg.add("op_2_1_27_model_iterator", f"{SEQ} SELECT chain_id AS source, 'm' || seq_id AS name, 'PF' || seq_id AS acc, CAST(length(s) AS INTEGER) AS length FROM sequences WHERE chain_id IS NOT NULL")
def _(spark, d):
    one = F.concat(F.lit("HMMER3/f\nNAME  m"), F.col("seq_id"), F.lit("\nACC   PF"), F.col("seq_id"), F.lit("\nLENG  "), F.length("s"), F.lit("\n//\n"))
    texts = sequences(spark, d).where("chain_id is not null").groupBy("chain_id").agg(F.array_join(F.collect_list(one), "").alias("text"))
    return records.parse_models(texts, "chain_id", "text")


@reg.add("op_2_1_26_family_source", f"{SEQ}, dat AS (SELECT DISTINCT 'PF' || (seq_id % 500) AS acc, ['Domain', 'Family'][seq_id % 2 + 1] AS category FROM sequences), m AS (SELECT 'PF' || seq_id AS acc, length(s) AS n FROM sequences) SELECT m.acc, category, CAST(n AS INTEGER) AS n FROM m JOIN dat USING (acc) WHERE category = 'Family'")
def _(spark, d):
    """Metadata inner-joined to models on the accession, read by category."""
    s = sequences(spark, d)
    dat = s.select(F.concat(F.lit("PF"), F.col("seq_id") % 500).alias("acc"), F.when(F.col("seq_id") % 2 == 0, "Domain").otherwise("Family").alias("category")).distinct()
    return s.select(F.concat(F.lit("PF"), F.col("seq_id")).alias("acc"), F.length("s").alias("n")).join(dat.where("category = 'Family'"), "acc")


@reg.add("op_2_1_26_family_models", f"{SEQ} SELECT 'PF' || seq_id AS acc, 'f' || seq_id AS id, 'chain ' || coalesce(chain_id, '-') AS description, CASE WHEN length(s) < 200 THEN 'Domain' ELSE 'Family' END AS category, 'm' || seq_id AS name, CAST(length(s) AS INTEGER) AS length FROM sequences")
def _(spark, d):
    """Metadata and models of every sequence, written as texts, parsed and joined."""
    kind = F.when(F.length("s") < 200, "Domain").otherwise("Family")
    dat = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID   f"), F.col("seq_id"), F.lit("\n#=GF AC   PF"), F.col("seq_id"), F.lit(".3\n#=GF DE   chain "), F.coalesce("chain_id", F.lit("-")), F.lit("\n#=GF GA   20.0; 20.0;\n#=GF TP   "), kind, F.lit("\n//\n"))
    hmm = F.concat(F.lit("HMMER3/f\nNAME  m"), F.col("seq_id"), F.lit("\nACC   PF"), F.col("seq_id"), F.lit(".3\nLENG  "), F.length("s"), F.lit("\n//\n"))
    texts = sequences(spark, d).select("seq_id", dat.alias("dat"), hmm.alias("hmm"))
    return records.read_families(records.parse_families(texts, "seq_id", "dat"), records.parse_models(texts, "seq_id", "hmm"))


_SIFTS = """rows AS (SELECT DISTINCT upper(trim(pdb, ' ')) AS pdb, trim(chain, ' ') AS chain, upper(trim(uniprot_id, ' ')) AS uniprot_id, pdb_start, pdb_end, uniprot_start, uniprot_end
  FROM sifts WHERE pdb IS NOT NULL AND chain IS NOT NULL AND uniprot_id IS NOT NULL)"""


@reg.add("op_2_1_28_sifts_source", f"WITH {_SIFTS} SELECT * FROM rows")
def _(spark, d):
    return X.clean(table(spark, d, "sifts"))


@reg.add("op_2_4_9_sifts_id_map", f"""WITH {_SIFTS}, p AS (SELECT 'uniprot' AS kind, uniprot_id AS id_from, pdb || ':' || chain AS t FROM rows UNION SELECT 'chain', pdb || ':' || chain, uniprot_id FROM rows UNION SELECT 'pdb', pdb, chain FROM rows)
SELECT kind, id_from, string_agg(t, ',' ORDER BY t) AS id_to FROM p GROUP BY 1, 2""")
def _(spark, d):
    return X.id_map(X.clean(table(spark, d, "sifts")))


@reg.add("op_2_4_10_sifts_mapping_plan", f"""WITH {_SIFTS}, k AS (SELECT uniprot_id FROM rows GROUP BY 1 HAVING count(DISTINCT pdb) >= 2), p AS (SELECT uniprot_id, pdb, string_agg(DISTINCT chain, ',' ORDER BY chain) AS cs FROM rows WHERE uniprot_id IN (SELECT uniprot_id FROM k) GROUP BY 1, 2)
SELECT uniprot_id, string_agg(pdb || ':' || cs, ';' ORDER BY pdb || ':' || cs) AS plan FROM p GROUP BY 1""")
def _(spark, d):
    rows = X.clean(table(spark, d, "sifts"))
    many = rows.groupBy("uniprot_id").agg(F.count_distinct("pdb").alias("n")).where("n >= 2")
    return X.mapping_plan(rows, many)


@reg.add("op_2_4_8_sifts_numbering", "")
def _(spark, d):
    from strandworks.operators.segments import numbered_spans

    rows = X.clean(table(spark, d, "sifts")).where("uniprot_start >= 1 and uniprot_end >= uniprot_start and pdb_start >= 1 and pdb_end >= pdb_start")
    out = numbered_spans(rows.withColumn("c", F.concat_ws(":", "pdb", "chain")), ["uniprot_id", "c"], ("uniprot_start", "uniprot_end"), ("pdb_start", "pdb_end"))
    return out.groupBy("uniprot_id", "c").agg(F.sum("n").alias("n"), F.sum("n_mapped").alias("n_mapped"))


SQL["op_2_4_8_sifts_numbering"] = f"""WITH {_SIFTS}, base AS (SELECT *, pdb || ':' || chain AS c FROM rows WHERE uniprot_start >= 1 AND uniprot_end >= uniprot_start AND pdb_start >= 1 AND pdb_end >= pdb_start),
ext AS (SELECT uniprot_id, c, min(pdb_start) AS p0, least(max(uniprot_end) - min(uniprot_start), max(pdb_end) - min(pdb_start)) + 1 AS n FROM base GROUP BY 1, 2),
cov AS (SELECT DISTINCT uniprot_id, c, unnest(range(pdb_start, pdb_end + 1)) AS p FROM base)
SELECT ext.uniprot_id, ext.c, CAST(n AS BIGINT) AS n, count(p) AS n_mapped FROM ext LEFT JOIN cov ON ext.uniprot_id = cov.uniprot_id AND ext.c = cov.c AND p < p0 + n GROUP BY ALL"""


@reg.add("op_2_1_34_url_builders", "SELECT DISTINCT 'https://files.rcsb.org/download/' || upper(trim(pdb, ' ')) || '.cif' AS url FROM sifts WHERE pdb IS NOT NULL")
def _(spark, d):
    return table(spark, d, "sifts").where("pdb is not null").select(remote.url("pdb_file", F.upper(F.trim("pdb")), "cif").alias("url")).distinct()


@reg.add("op_2_1_35_protein_urls", "SELECT DISTINCT 'https://rest.uniprot.org/uniprotkb/stream?format=fasta&query=accession:' || upper(trim(uniprot_id, ' ')) AS url FROM sifts WHERE uniprot_id IS NOT NULL")
def _(spark, d):
    return table(spark, d, "sifts").where("uniprot_id is not null").select(remote.url("uniprot", F.upper(F.trim("uniprot_id")), "fasta").alias("url")).distinct()


@reg.add("op_2_1_36_predicted_urls", "SELECT DISTINCT 'https://alphafold.ebi.ac.uk/files/AF-' || upper(trim(uniprot_id, ' ')) || '-F1-model_v4.cif' AS url FROM sifts WHERE uniprot_id IS NOT NULL")
def _(spark, d):
    return table(spark, d, "sifts").where("uniprot_id is not null").select(remote.url("predicted", F.upper(F.trim("uniprot_id")), "cif").alias("url")).distinct()


@reg.add("op_2_1_37_fetch_plan", "SELECT DISTINCT upper(trim(pdb, ' ')) AS k, false AS ok, 'offline: no network access' AS error FROM sifts WHERE pdb IS NOT NULL AND upper(trim(pdb, ' ')) NOT IN (SELECT split_part(regexp_extract(file_path, '([^/]*)$', 1), '.', 1) FROM collection_files)")
def _(spark, d):
    wanted = table(spark, d, "sifts").where("pdb is not null").select(F.upper(F.trim("pdb")).alias("k"))
    have = table(spark, d, "collection_files").select(F.regexp_extract(F.regexp_extract("file_path", r"([^/]*)$", 1), r"^([^.]*)", 1).alias("k"))
    return remote.fetch(remote.fetch_plan(wanted, have, "k"), "k")


@reg.add("op_2_3_20_method_filter", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 3")
def _(spark, d):
    return remote.method_filter(table(spark, d, "events"), "event_id", "props", "$.k", "3")


@reg.add("op_2_1_40_graph_json", "SELECT n_regionkey AS g, n_nationkey AS a, n_nationkey + 1 AS b FROM nation")
def _(spark, d):
    edges = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    return records.edges_of_json(records.molecular_graph_json(edges, "g", "a", "b", F.max("b")), "g")


@reg.add("op_2_1_42_column_table_reader", f"{SEQ} SELECT CAST(seq_id AS VARCHAR) AS c0, s AS c1 FROM sequences")
def _(spark, d):
    path = Scratch(spark, "table").path("out")
    sequences(spark, d).select("seq_id", "s").write.option("sep", "\t").csv(path)
    return records.read_columns(spark, path, 2)


@reg.add("op_2_1_41_variables_file", f"{SEQ} SELECT CAST(seq_id AS VARCHAR) AS object_id, 'SeqEl(1)' AS variable_id, substr(s, 1, 1) AS value FROM sequences")
def _(spark, d):
    """Variable files written and read back; ids go through the parser."""
    from strandworks.operators import variables as V

    path = Scratch(spark, "variables").path("out")
    V.calculate(sequences(spark, d), "seq_id", "s", ["SeqEl(1)"]).select("object_id", "variable_id", "value").write.option("sep", "\t").csv(path)
    back = records.read_columns(spark, path, 3)
    return back.where(F.col("c1") == V.parse("SeqEl(1)").id).toDF("object_id", "variable_id", "value")


@reg.add("op_2_1_39_interface_dump", f"WITH {ATOMS_SQL} SELECT structure_id, a, b, round(dist, 6) AS dist FROM pairs WHERE a_chain = 'A' AND b_chain IN ('B', 'C') AND a_name <> 'HOH' AND b_name <> 'HOH' AND dist <= 10.0")
def _(spark, d):
    """Contacts stored as a table and read back."""
    from strandworks.operators import interface as I

    rows = I.contacts(atoms(spark, d), "A_BC", 10.0).select("structure_id", "a", "b", F.round("dist", 6).alias("dist"))
    return Scratch(spark, "interface").save(rows, "contacts")


@reg.add("op_2_1_38_subprocess", f"{SEQ} SELECT seq_id, true AS ok, lower(s) AS output, NULL AS error FROM sequences WHERE seq_id % 2 = 1 UNION ALL SELECT seq_id, false, NULL, 'no-such-program is not installed' FROM sequences WHERE seq_id % 2 = 0")
def _(spark, d):
    """An external program over texts, and one that is not there."""
    rows = sequences(spark, d)
    run = lambda part, command: services.run_command(rows.where(F.col("seq_id") % 2 == part), "seq_id", "s", command)
    return run(1, ["tr", "A-Z", "a-z"]).unionByName(run(0, ["no-such-program"]))


@reg.add("op_2_1_24_secondary_structure_run", f"WITH {ATOMS_SQL} SELECT DISTINCT structure_id, false AS ok, 'no-such-program is not installed' AS error FROM atoms")
def _(spark, d):
    """The runner's answer where its program is missing, as it is in this box."""
    texts = atoms(spark, d).groupBy("structure_id").agg(F.count(F.lit(1)).cast("string").alias("text"))
    return services.secondary_structure(texts, "structure_id", "text", "no-such-program").select("structure_id", "ok", "error")


@reg.add("op_2_6_4_external_alignment", f"{SEQ} SELECT DISTINCT chain_id, false AS ok, 'no-such-program is not installed' AS error FROM sequences WHERE chain_id IS NOT NULL")
def _(spark, d):
    rows = sequences(spark, d).where("chain_id is not null").groupBy("chain_id").agg(F.array_join(F.collect_list(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "s")), "\n").alias("text"))
    return services.external_alignment(rows, "chain_id", "text", "no-such-program").select("chain_id", "ok", "error")


_WANTED = "wanted AS (SELECT DISTINCT upper(trim(uniprot_id, ' ')) AS id FROM sifts WHERE uniprot_id IS NOT NULL), have AS (SELECT id FROM wanted WHERE length(id) % 2 = 0 AND id < 'P')"


def _wanted(spark, d):
    rows = table(spark, d, "sifts").where("uniprot_id is not null").select(F.upper(F.trim("uniprot_id")).alias("id")).distinct()
    return rows, rows.where("length(id) % 2 = 0 and id < 'P'")


def _requests(spark, d, service, what, fmt):
    """What a service is asked for: every missing key once, its address, and whether
    its request has at most the keys that the service takes."""
    plan = service.plan(*_wanted(spark, d), "id")
    sizes = plan.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(sizes, "chunk").select("id", service.address(what, F.col("id"), fmt).alias("url"), (F.col("n") <= service.chunk).alias("fits"))


for _name, _service, _what, _fmt, _url in (
    ("op_2_1_29_uniprot_requests", services.UNIPROT, "fasta", "fasta", "'https://rest.uniprot.org/uniprotkb/stream?format=fasta&query=accession:' || id"),
    ("op_2_1_30_pdb_requests", services.PDB, "structure", "cif", "'https://files.rcsb.org/download/' || id || '.cif'"),
    ("op_2_1_31_alphafold_requests", services.ALPHAFOLD, "structure", "cif", "'https://alphafold.ebi.ac.uk/files/AF-' || id || '-F1-model_v4.cif'"),
):
    reg.add(_name, f"WITH {_WANTED} SELECT id, {_url} AS url, true AS fits FROM wanted WHERE id NOT IN (SELECT id FROM have)")(
        lambda spark, d, a=_service, b=_what, c=_fmt: _requests(spark, d, a, b, c)
    )


@reg.add("op_2_1_33_api_base", f"WITH {_WANTED} SELECT id, false AS ok, 'offline: no network access' AS error FROM wanted WHERE id NOT IN (SELECT id FROM have)")
def _(spark, d):
    """Nothing is fetched without a network; what remains says why."""
    fetched, remaining = services.UNIPROT.fetch(*_wanted(spark, d), "id")
    return fetched.unionByName(remaining)


@reg.add(
    "op_2_1_32_orthologs",
    "WITH r AS (SELECT DISTINCT upper(trim(uniprot_id, ' ')) AS u, upper(trim(pdb, ' ')) AS p, length(pdb_chain) % 2 AS odd FROM sifts WHERE uniprot_id IS NOT NULL AND pdb IS NOT NULL AND pdb_chain IS NOT NULL) SELECT DISTINCT u AS gene, p AS target, 'LDO' AS kind, 'MOUSE' AS organism FROM r WHERE odd = 0",
)
def _(spark, d):
    """Stored responses, one per protein, read into a table of one kind of orthologs."""
    rows = table(spark, d, "sifts").where("uniprot_id is not null and pdb is not null and pdb_chain is not null")
    rows = rows.select(F.upper(F.trim("uniprot_id")).alias("u"), F.upper(F.trim("pdb")).alias("p"), (F.length("pdb_chain") % 2).alias("odd")).distinct()
    one = F.struct(F.concat(F.lit("HUMAN|HGNC=1|UniProtKB="), "u").alias("gene"), F.concat(F.lit("MOUSE|MGI=1|UniProtKB="), "p").alias("target_gene"), F.when(F.col("odd") == 0, "LDO").otherwise("O").alias("ortholog"))
    # a response is as long as a protein has partners; blocks keep those of hot proteins apart
    stored = rows.groupBy("u", F.pmod(F.xxhash64("p"), F.lit(16)).alias("block")).agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(one).alias("mapped")).alias("mapping")).alias("search"))).alias("text"))
    return services.orthologs(stored, "text").distinct()


@reg.add(
    "op_2_10_7_constructor_hooks",
    f"""{SEQ}, k AS (SELECT *, seq_id % 3 = 0 AS have FROM sequences) SELECT CAST(seq_id AS VARCHAR) AS id, 'built' AS state, CAST(length(s) AS INTEGER) AS size FROM k WHERE have
UNION ALL SELECT CAST(seq_id AS VARCHAR), 'offline: no network access', NULL FROM k WHERE NOT have""",
)
def _(spark, d):
    """Items that are staged become objects, the others are asked for in vain."""

    class Sequences(services.Hooks):
        def init_inputs(self, staged):
            one = staged.select(F.explode(fasta_entries(F.col("content"))).alias("x"))
            return one.select(F.col("x.record_id").alias("id"), F.lit("built").alias("state"), F.length("x.body").alias("size"))

    rows = sequences(spark, d).select(F.col("seq_id").cast("string").alias("id"), (F.col("seq_id") % 3 == 0).alias("have"), F.concat(F.lit(">"), "seq_id", F.lit("\n"), "s").alias("content"))
    hooks = Sequences()
    fetched, remaining = hooks.fetch_missing(rows.select("id"), rows.where("have").select("id"))
    built = hooks.init_inputs(rows.where("have").select("id", "content"))
    return built.unionByName(remaining.select("id", F.col("error").alias("state"), F.lit(None).cast("int").alias("size")))
