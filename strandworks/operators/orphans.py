"""References to keys that are missing, deleted, or arrived later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.plans.scratch import Scratch

#: Codes per block of the as-of match; bounds the rows one task sorts.
BLOCK_BITS = 16


def encode_keys(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Dense integer codes ``(key, code)`` of distinct keys, in key order.

    The keys are range-sorted into partitions; a row's code is its place in its
    partition plus the sizes of the partitions before it.  Only those sizes, one
    number per partition, are summed in one place.
    """
    place = F.monotonically_increasing_id()
    ordered = keys.orderBy("key").select("key", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at"))
    ordered = scratch.save(ordered, "ordered")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("base"))
    return ordered.join(F.broadcast(offsets), "part").select("key", (F.col("base") + F.col("at")).alias("code"))


def key_runs(codes: DataFrame) -> DataFrame:
    """Contiguous runs ``(block, first, last)`` of distinct integer ``code``s.

    Runs end at block bounds, so every run lies in one block and the blocks can
    be worked on apart.
    """
    block = F.shiftright("code", BLOCK_BITS)
    inside = Window.partitionBy("block").orderBy("code")
    rows = codes.select("code", block.alias("block")).withColumn("island", F.col("code") - F.row_number().over(inside))
    return rows.groupBy("block", "island").agg(F.min("code").alias("first"), F.max("code").alias("last")).drop("island")


def outside_runs(codes: DataFrame, **runs: DataFrame) -> DataFrame:
    """``code`` with a flag for each named table of runs: whether the code lies in none of
    them.  An as-of match to the preceding run start of each table, all in one pass:
    a code is outside if that run ended before it, or there is none."""
    nulls = [F.lit(None).cast("long").alias(name) for name in runs]
    rows = codes.select(F.shiftright("code", BLOCK_BITS).alias("block"), "code", F.lit(1).alias("_kind"), *nulls)
    for name, table in runs.items():
        ends = [F.col("last").alias(n) if n == name else F.lit(None).cast("long").alias(n) for n in runs]
        rows = rows.unionByName(table.select("block", F.col("first").alias("code"), F.lit(0).alias("_kind"), *ends))
    w = Window.partitionBy("block").orderBy("code", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({f"_{n}": F.last(n, ignorenulls=True).over(w) for n in runs}).where("_kind = 1")
    return found.select("code", *[(F.col(f"_{n}").isNull() | (F.col(f"_{n}") < F.col("code"))).alias(n) for n in runs])


def beyond_runs(codes: DataFrame, runs: DataFrame) -> DataFrame:
    """The ``code``s that lie in no run."""
    return outside_runs(codes, out=runs).where("out").select("code")


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Faulty references ``(ref_field, key, kind, month)``, distinct.

    ``refs`` has ``(ref_field, key, at)``, ``targets`` ``(key, added, removed)``.
    Keys are compared trimmed of spaces.  The first that fits: ``missing`` no
    target has the key; ``deleted`` every such target was removed; ``late`` the
    earliest target came after the reference (not if either time is null).
    ``month`` is ``yyyy-MM`` of the reference, ``unknown`` without a time.  Null
    keys refer to nothing and give no rows.

    References shrink to one row per field, key and month before any join, and
    keys to one each, so a key with a third of all references is one row per month.
    """
    scratch = Scratch(refs.sparkSession, "orphans")
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    refs = (
        refs.select("ref_field", F.trim("key").alias("key"), month.alias("month"), "at")
        .where(F.col("key").isNotNull())
        .groupBy("ref_field", "key", "month")
        .agg(F.min("at").alias("at"))
    )
    targets = (
        targets.select(F.trim("key").alias("key"), "added", "removed")
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("added").alias("added"), F.bool_or(F.col("removed").isNull()).alias("alive"))
    )
    refs, targets = scratch.save(refs, "refs"), scratch.save(targets, "targets")
    codes = encode_keys(refs.select("key").union(targets.select("key")).distinct(), scratch)
    targets = scratch.save(targets.join(codes, "key"), "coded_targets")
    refs = scratch.save(refs.join(codes, "key"), "coded_refs")
    wanted = refs.select("code").distinct()
    runs = {"missing": key_runs(targets.select("code")), "dead": key_runs(targets.where("alive").select("code"))}
    status = outside_runs(wanted, **runs).join(targets.select("code", "added"), "code", "left")
    kind = F.when(F.col("missing"), "missing").when(F.col("dead"), "deleted").when(F.col("added") > F.col("at"), "late")
    found = refs.join(status, "code").select("ref_field", "key", kind.alias("kind"), "month")
    return found.where(F.col("kind").isNotNull())
