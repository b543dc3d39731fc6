"""Staged tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back.
The table lies below ``spark.checkpoint.dir``, so a lost executor costs only the
tasks it was running.  Where the setting is missing, a temporary folder is used,
and only if the master is local.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandworks.plans.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandworks-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder if it exists."""
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


def swap_files(spark: SparkSession, staging: str, path: str) -> None:
    """Put the Parquet files of ``staging``, a hidden folder below ``path``, in the place
    of those in ``path``.

    What is to come and to go is written down first.  New files are then renamed into
    ``path`` before old ones are deleted, so at no moment is there no table; a reader
    in between may see rows twice, none is missing.  A swap that broke off is carried
    to its end by :func:`finish_swap`.
    """
    fs, root = _fs(spark, path)
    old = [f.getPath().getName() for f in fs.listStatus(root) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    plan = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_swap.tmp")
    out = fs.create(plan, True)
    out.write("\n".join([staging.rsplit("/", 1)[-1], *old]).encode())
    out.close()
    fs.rename(plan, _fs(spark, f"{path}/_swap")[1])
    finish_swap(spark, path)


def finish_swap(spark: SparkSession, path: str) -> None:
    """Carry out the swap that is written down in ``path``, if one is."""
    fs, plan = _fs(spark, f"{path}/_swap")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(plan):
        return
    source = fs.open(plan)
    staging, *old = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").split("\n")
    source.close()
    folder = jpath(f"{path}/{staging}")
    if fs.exists(folder):
        for f in fs.listStatus(folder):
            if not f.getPath().getName().startswith(("_", ".")) and not fs.rename(f.getPath(), jpath(f"{path}/{f.getPath().getName()}")):
                raise OSError(f"cannot move {f.getPath()} to {path}")
    for name in filter(None, old):
        fs.delete(jpath(f"{path}/{name}"), False)
    fs.delete(folder, True)
    fs.delete(plan, False)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, root)
    except Exception:  # the session or its JVM is gone; nothing is left to clean with
        pass


_roots: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete every staged table this process made and has not deleted yet.  Results
    of operators that were not stored elsewhere cannot be read any more."""
    while _roots:
        _forget(spark, _roots.pop())


class Scratch:
    """One operator run's staged tables; :meth:`drop` frees those no longer read.

    What is left lies there until the interpreter ends, :func:`clear` or
    :meth:`close` is called, because the DataFrame an operator returns may still
    read it.  Call :func:`clear` before stopping a session.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _roots.append(self.root)
        atexit.register(_forget, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, **counts) -> DataFrame | tuple[DataFrame, dict]:
        """Write and read back.  With ``counts`` (name=aggregate column), returns
        the values observed during the write as well, without a second job."""
        path = self.path(name)
        seen = None
        if counts:
            seen = Observation()
            df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return (back, seen.get) if counts else back

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and (path := getattr(t, "_scratch_path", None)):
                delete_path(self.spark, path)

    def close(self) -> None:
        _forget(self.spark, self.root)


def rows() -> Column:
    """The row count, for :meth:`Scratch.save`."""
    return F.count(F.lit(1))
