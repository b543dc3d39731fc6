"""A catalog of objects as Parquet tables, and batches that fill it.

Tables: ``chains (id, chain_type, level)``, ``parents (parent_id, child_id)``,
``variables (chain_id, variable_id, value, ok)``, ``paths (chain_id, path)`` and
``structures (chain_id, structure_id)``.  Inserts append what is new; everything
else writes the table anew and swaps its files; a table is there at every moment, and
a swap that broke off is carried to its end before the table is read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.plans.scratch import Scratch, delete_path, finish_swap, path_exists, swap_files

SCHEMAS = {
    "chains": "id string, chain_type int, level int",
    "parents": "parent_id string, child_id string",
    "variables": "chain_id string, variable_id string, value string, ok boolean",
    "paths": "chain_id string, path string",
    "structures": "chain_id string, structure_id string",
    "batches": "batch int, items_in int, items_out int, failed boolean, error string",
}
#: table -> columns that refer to a chain
REFERENCES = {"chains": ["id"], "parents": ["parent_id", "child_id"], "variables": ["chain_id"], "paths": ["chain_id"], "structures": ["chain_id", "structure_id"]}


class Catalog:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, root: str, overwrite: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        if overwrite:
            delete_path(spark, self.root)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def tables(self) -> list[str]:
        return [n for n in SCHEMAS if path_exists(self.spark, self._path(n))]

    def table(self, name: str, where: str | Column | None = None) -> DataFrame:
        """A table, empty if nothing was stored; ``where`` reaches the scan."""
        if path_exists(self.spark, f"{self._path(name)}/_swap"):
            finish_swap(self.spark, self._path(name))
        if not path_exists(self.spark, self._path(name)):
            df = self.spark.createDataFrame([], SCHEMAS[name])
        else:
            df = self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name))
        return df if where is None else df.where(where)

    def ids(self, level: int | None = None, chain_type: int | None = None) -> DataFrame:
        """Ids by either, both or neither."""
        df = self.table("chains")
        if level is not None:
            df = df.where(F.col("level") == level)
        if chain_type is not None:
            df = df.where(F.col("chain_type") == chain_type)
        return df.select("id")

    def _append(self, name: str, df: DataFrame) -> None:
        names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        df.select(*names).write.mode("append").parquet(self._path(name))

    def _swap(self, name: str, df: DataFrame) -> None:
        names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        staging = f"{self._path(name)}/.staging-{uuid.uuid4().hex}"
        df.select(*names).write.parquet(staging)
        swap_files(self.spark, staging, self._path(name))

    def _insert(self, name: str, df: DataFrame, key: list[str]) -> None:
        fresh = df.dropDuplicates(key).join(self.table(name).select(*key), key, "left_anti")
        self._append(name, fresh)

    def add(self, chains: DataFrame, parents: DataFrame | None = None, structures: DataFrame | None = None) -> None:
        """Insert what is not there yet; ids that are stay as they are."""
        self._insert("chains", chains, ["id"])
        if parents is not None:
            self._insert("parents", parents, ["parent_id", "child_id"])
        if structures is not None:
            self._insert("structures", structures, ["chain_id", "structure_id"])

    def remove(self, ids: DataFrame) -> None:
        """Delete chains and all rows of other tables that refer to them."""
        gone = ids.select(F.col("id").alias("_gone")).distinct()
        for name, columns in REFERENCES.items():
            if name not in self.tables():
                continue
            df = self.table(name)
            for c in columns:
                df = df.join(gone, F.col(c) == F.col("_gone"), "left_anti")
            self._swap(name, df)

    def add_variables(self, variables: DataFrame, keep_failed: bool = False) -> None:
        """Append variables of known chains; failed ones only on request."""
        known = variables.join(self.table("chains").select(F.col("id").alias("chain_id")), "chain_id", "left_semi")
        self._insert("variables", known if keep_failed else known.where("ok"), ["chain_id", "variable_id"])

    def link(self, paths: DataFrame) -> None:
        """Upsert the folder of each known chain, named by its last part."""
        named = paths.select(F.regexp_extract("path", r"([^/]+)/*$", 1).alias("chain_id"), "path")
        named = named.join(self.table("chains").select(F.col("id").alias("chain_id")), "chain_id", "left_semi").groupBy("chain_id").agg(F.max("path").alias("path"))
        kept = self.table("paths").join(named, "chain_id", "left_anti")
        self._swap("paths", kept.unionByName(named))

    def update_parents(self, values: DataFrame) -> None:
        """Set the parent of children that have one; others are not inserted."""
        new = values.groupBy("child_id").agg(F.max("parent_id").alias("_new"))
        df = self.table("parents").join(new, "child_id", "left")
        self._swap("parents", df.select(F.coalesce("_new", "parent_id").alias("parent_id"), "child_id"))

    def update_variables(self, values: DataFrame, set_ok: bool = True) -> None:
        """Set the values of variables that are there."""
        new = values.select("chain_id", "variable_id", F.col("value").alias("_new")).dropDuplicates(["chain_id", "variable_id"]).withColumn("_hit", F.lit(True))
        df = self.table("variables").join(new, ["chain_id", "variable_id"], "left")
        ok = F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("ok")) if set_ok else F.col("ok")
        self._swap("variables", df.select("chain_id", "variable_id", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value")).alias("value"), ok.alias("ok")))

    def children_of(self, ids: DataFrame) -> DataFrame:
        """``id, child_id`` of the asked ids; null where there is none."""
        return ids.join(self.table("parents"), ids["id"] == F.col("parent_id"), "left").select("id", "child_id")

    def parents_of(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.table("parents"), ids["id"] == F.col("child_id"), "left").select("id", "parent_id")

    def load(self, chain_type: int | None = None, level: int | None = None, ids: DataFrame | None = None, structures: bool = True) -> DataFrame:
        """``id, chain_type, level, parent_id, structures`` of the chosen chains."""
        df = self.table("chains").join(self.ids(level, chain_type), "id", "left_semi")
        if ids is not None:
            df = df.join(ids.select("id").distinct(), "id", "left_semi")
        up = self.table("parents").groupBy(F.col("child_id").alias("id")).agg(F.max("parent_id").alias("parent_id"))
        df = df.join(up, "id", "left")
        if not structures:
            return df
        own = self.table("structures").groupBy(F.col("chain_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("structure_id")), ",").alias("structures"))
        return df.join(own, "id", "left")


def parse_items(df: DataFrame, item: str) -> DataFrame:
    """Batch items of ``S``, ``ID:A,B`` and ``S=>ID1:A;ID2:A,B``: one row
    ``item, seq_id, str_id, chain_id`` per sequence, structure and chain."""
    has_map = F.instr(item, "=>") > 0
    seq = F.when(has_map, F.split_part(item, F.lit("=>"), F.lit(1))).when(F.instr(item, ":") == 0, F.col(item))
    rest = F.when(has_map, F.split_part(item, F.lit("=>"), F.lit(2))).when(F.instr(item, ":") > 0, F.col(item)).otherwise("")
    # an item may hold a million structures, so it is read before it is exploded, not for each row
    rows = df.select(F.col(item).alias("item"), F.trim(seq).alias("seq_id"), F.split(rest, ";").alias("ss")).select("item", "seq_id", F.explode("ss").alias("s"))
    chains = F.when(F.instr("s", ":") > 0, F.split(F.split_part("s", F.lit(":"), F.lit(2)), ",")).otherwise(F.array(F.lit(None).cast("string")))
    name = F.when(F.col("s") != "", F.trim(F.split_part("s", F.lit(":"), F.lit(1))))
    return rows.select("item", "seq_id", name.alias("str_id"), F.explode(chains).alias("chain_id"))


def format_items(rows: DataFrame) -> DataFrame:
    """Back to text: ``seq_id, item``, structures and chains in order."""
    per = rows.where("str_id is not null").groupBy("seq_id", "str_id").agg(F.array_join(F.array_sort(F.collect_set("chain_id")), ",").alias("cs"))
    text = F.when(F.col("cs") == "", F.col("str_id")).otherwise(F.concat_ws(":", "str_id", "cs"))
    return per.groupBy("seq_id").agg(F.concat(F.first("seq_id"), F.lit("=>"), F.array_join(F.array_sort(F.collect_list(text)), ";")).alias("item"))


def make_batches(items: DataFrame, key: str, size: int, start: int = 0) -> DataFrame:
    """Unique items in evenly filled batches of about ``size``, numbered from ``start``.

    The number of batches follows from the count; an item's batch from its hash, so
    no global order is needed."""
    unique = items.select(key).distinct()
    n = max(1, -(-unique.count() // size))
    return unique.select(key, (F.pmod(F.xxhash64(F.lit("batch"), key), F.lit(n)) + start).cast("int").alias("batch"))


def chunk_evenly(items: DataFrame, key: str, group: str, size: int) -> DataFrame:
    """Exact chunks of at most ``size`` within each group, sizes differing by one."""
    w = Window.partitionBy(group)
    n = F.ceil(F.count(F.lit(1)).over(w) / size)
    place = F.row_number().over(w.orderBy(key)) - 1
    return items.select(group, key, F.floor(place * n / F.count(F.lit(1)).over(w)).cast("int").alias("chunk"))


def batch_status(items_in: DataFrame, items_out: DataFrame, key: str) -> DataFrame:
    """``status, n``: items done, missed, and made without having been asked."""
    a = items_in.select(key).distinct().withColumn("i", F.lit(True))
    b = items_out.select(key).distinct().withColumn("o", F.lit(True))
    status = F.when(F.col("i") & F.col("o"), "done").when(F.col("i"), "missed").otherwise("extra")
    return a.join(b, key, "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


class Constructor:
    """Runs batches into a catalog and keeps a ledger, so that it can resume.

    ``build`` turns items, which have the columns of the batches, into ``(chains,
    parents)``; chains that keep the column ``batch`` are counted by it, others by the
    item whose key is their id.  All open batches are one plan: one anti-join with the
    catalog, one write, and ledger rows from one aggregation.  Only if that plan fails
    are the batches run one by one, to find those that do.
    """

    def __init__(self, catalog: Catalog, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], key: str):
        self.catalog, self.build, self.key = catalog, build, key

    def _run(self, items: DataFrame) -> None:
        chains, parents = self.build(items)
        self.catalog.add(chains.drop("batch"), parents)
        if "batch" not in chains.columns:
            chains = chains.join(items.select(F.col(self.key).alias("id"), "batch"), "id")
        made = chains.groupBy("batch").agg(F.count_distinct("id").alias("items_out"))
        rows = items.groupBy("batch").agg(F.count(F.lit(1)).alias("items_in")).join(made, "batch", "left")
        self.catalog._append("batches", rows.select("batch", F.col("items_in").cast("int"), F.coalesce("items_out", F.lit(0)).cast("int").alias("items_out"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("error")))

    def run(self, batches: DataFrame, stop_on_failure: bool = True) -> DataFrame:
        done = self.catalog.table("batches").where("not failed").select("batch").distinct()
        left = Scratch(self.catalog.spark, "batches").save(batches.join(done, "batch", "left_anti"), "open")
        if left.isEmpty():
            return self.catalog.table("batches")
        try:
            self._run(left)
        except Exception:
            self._one_by_one(left, stop_on_failure)
        return self.catalog.table("batches")

    def _one_by_one(self, left: DataFrame, stop_on_failure: bool) -> None:
        for number in sorted(r.batch for r in left.select("batch").distinct().collect()):
            items = left.where(F.col("batch") == number)
            try:
                self._run(items)
            except Exception as e:
                row = (number, items.count(), 0, True, f"{type(e).__name__}: {str(e)[:200]}")
                self.catalog._append("batches", self.catalog.spark.createDataFrame([row], SCHEMAS["batches"]))
                if stop_on_failure:
                    raise

    resume = run
