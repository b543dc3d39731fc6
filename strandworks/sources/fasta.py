"""FASTA: a text scan split at headers, a writer, and a registered data source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_fasta(spark: SparkSession, path: str, strip_id: bool = True) -> DataFrame:
    """``seq_id, seq1`` of the entries of FASTA files.

    The scan splits files at ``\\n>``, so large files are read by many tasks.  Lines
    of an entry are joined, blank ones dropped; with ``strip_id`` a header ends at
    its first white space.  Text before the first header is no entry.
    """
    lines = spark.read.option("lineSep", "\n>").text(path)
    entry = F.regexp_replace("value", r"\r", "")
    rows = lines.select(F.regexp_replace(entry, r"^\s*>", "").alias("e"), F.startswith(F.ltrim(entry), F.lit(">")).alias("marked"), F.monotonically_increasing_id().alias("k"))
    head = F.split_part("e", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.when(F.instr(F.col("e"), "\n") > 0, F.substring("e", F.instr(F.col("e"), "\n"), F.length("e"))).otherwise(""), r"\s", "")
    name = F.regexp_extract(head, r"^(\S*)", 1) if strip_id else F.trim(head)
    return rows.select(name.alias("seq_id"), body.alias("seq1")).where(F.length("seq_id") > 0)


def fasta_text(seq_id: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), seq_id, F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq1") -> None:
    """One entry per row, no line left empty between them."""
    df.select(fasta_text(F.col(seq_id), F.col(seq)).alias("value")).write.text(path)


def to_fasta(df: DataFrame, group: str, order: str, seq_id: str, seq: str) -> DataFrame:
    """``group, fasta``: all sequences of a group as one text, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), fasta_text(F.col(seq_id).cast("string"), F.col(seq)).alias("t"))))
    return df.groupBy(group).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), "\n").alias("fasta"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, part):
        name, lines = None, []
        strip = self.options.get("strip_id", "true").lower() == "true"
        with open(part.path, encoding="utf-8") as f:
            for line in f:
                line = line.strip()
                if line.startswith(">"):
                    if name is not None:
                        yield name, "".join(lines), part.path
                    name, lines = (line[1:].split() or [""])[0] if strip else line[1:], []
                elif line and name is not None:
                    lines.append(line)
        if name is not None:
            yield name, "".join(lines), part.path


class FastaDataSource(DataSource):
    """``spark.read.format("fasta").option("path", glob)``: one task per file."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "seq_id string, seq1 string, path string"

    def reader(self, schema):
        return _FastaReader(self.options)
