"""Turning very many tiny files into few well-sized ones, each record once."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.plans.scratch import Scratch, delete_path, rows, swap_files

#: The white space of Unicode, as a character class.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TARGET_BYTES = 128 << 20


def _no_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + "+", "")


def fasta_entries(content: Column) -> Column:
    """Array of ``(record_id, body)`` of the entries of one FASTA text.

    An entry is a line that begins with ``>`` and all up to the next such line;
    ``\\n``, ``\\r\\n`` and ``\\r`` end lines.  Text before the first header belongs
    to no entry.  ``body`` is the residues without white space, in upper case.
    """
    text = F.regexp_replace(content, r"\r\n?", "\n")
    parts = F.split(F.concat(F.lit("\n"), text), "\n>")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^((?:(?!" + SPACE + r").)*)", 1).alias("record_id"),
            F.upper(_no_space(F.when(F.instr(p, "\n") > 0, F.substring(p, F.instr(p, "\n"), F.length(p))).otherwise(""))).alias("body"),
        ),
    )


def split_records(files: DataFrame) -> DataFrame:
    """``(area, record_id, body)`` of every record in rows of small files.

    ``sequence_files`` hold FASTA entries.  In ``structure_files`` a row is one
    record, named by its file name up to the first dot, its body with white space
    runs made one space.  Records with an empty body are none; null contents and
    other areas give no records; a null path gives a null ``record_id``.
    """
    entries = F.when(F.col("area") == "sequence_files", fasta_entries(F.col("content"))).when(
        F.col("area") == "structure_files",
        F.array(
            F.struct(
                F.regexp_extract(F.regexp_extract("file_path", r"([^/]*)$", 1), r"^([^.]*)", 1).alias("record_id"),
                F.regexp_replace(F.regexp_replace("content", SPACE + "+", " "), "^ | $", "").alias("body"),
            )
        ),
    )
    rows = files.select("area", F.explode(entries).alias("x"))
    return rows.select("area", "x.record_id", "x.body").where(F.col("body") != "")


def distinct_records(files: DataFrame) -> DataFrame:
    """One row per distinct ``(area, record_id, content_md5)``, with the body.

    Copies meet in a map-side combine before the shuffle, and the digest is part
    of the key, so neither a file listed very often nor an id with very many
    contents ends up in one task.
    """
    rows = split_records(files).withColumn("content_md5", F.md5("body"))
    return rows.groupBy("area", "record_id", "content_md5").agg(F.first("body").alias("body"))


def _checksums(keys: list[str]) -> dict[str, Column]:
    """Row count and two checksums of whole rows: one adds up digests as decimals of 38
    places, which 10^19 rows do not fill, the other folds another digest by XOR."""
    return {"n": rows(), "added": F.sum(F.xxhash64(*keys).cast("decimal(38,0)")), "folded": F.bit_xor(F.xxhash64(F.lit("folded"), *keys))}


def compact(df: DataFrame, path: str, keys: list[str], target_bytes: int = TARGET_BYTES, size: Column | None = None) -> int:
    """Rewrite ``df`` as few sorted files at ``path``; returns how many ranges.

    Rows are range-partitioned by ``keys`` at boundaries that Spark samples; the
    number of ranges follows from the total of ``size`` (bytes of a row; by
    default the length of its text columns) and ``target_bytes``.  The files go to
    a hidden folder inside ``path``.  Only if count and checksums of what was written
    equal those of the source do its files take the place of those in ``path``, which
    exists and can be read at every moment; otherwise they are removed and an error
    raised.  Give keys that are close to unique: rows equal in
    all keys cannot be split over files.
    """
    spark = df.sparkSession
    if size is None:
        texts = [c for c, t in df.dtypes if t in ("string", "binary")]
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(df.columns)))
    before = df.agg(F.sum(size).alias("bytes"), *[c.alias(k) for k, c in _checksums(df.columns).items()]).first().asDict()
    ranges = max(1, math.ceil((before.pop("bytes") or 0) / target_bytes))
    staging = f"{path}/.staging-{uuid.uuid4().hex}"
    df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).write.parquet(staging)
    after = spark.read.schema(df.schema).parquet(staging).agg(*[c.alias(k) for k, c in _checksums(df.columns).items()]).first().asDict()
    if after != before:
        delete_path(spark, staging)
        raise RuntimeError(f"compaction does not reconcile: {before} became {after}")
    swap_files(spark, staging, path)
    return ranges


def _source_sums(files: DataFrame) -> dict:
    """Count and checksums of the distinct record keys, straight from the source rows
    and without their bodies."""
    keys = ["area", "record_id", "content_md5"]
    found = split_records(files).select("area", "record_id", F.md5("body").alias("content_md5")).distinct()
    return found.agg(*[c.alias(k) for k, c in _checksums(keys).items()]).first().asDict()


def consolidate_files(files: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Compact all records of small-file rows; the table of them, read back.

    Columns ``area, record_id, content_md5, body``.  ``path`` defaults to a folder
    in the shared checkpoint directory.  The keys of what is read back are reconciled
    with those of the source rows, which are split once more for that, so a record
    lost on the way to the sorted files shows as well.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "compaction")
    records = scratch.save(distinct_records(files), "records")
    path = path or scratch.path("compacted")
    compact(records, path, ["area", "record_id", "content_md5"], target_bytes)
    scratch.drop(records)
    out = spark.read.schema(records.schema).parquet(path)
    wrote = out.agg(*[c.alias(k) for k, c in _checksums(["area", "record_id", "content_md5"]).items()]).first().asDict()
    if wrote != (source := _source_sums(files)):
        raise RuntimeError(f"compaction does not reconcile with its source: {source} became {wrote}")
    return out
