"""What the reference gets from remote services and external programs.

There is no network and most programs are missing here.  Requests become plans and
rows that say why they failed; stored responses are parsed; a program that is
installed on the executors is run over Arrow batches.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.plans.ship import ship
from strandworks.sources import remote


@dataclass(frozen=True)
class Service:
    """A remote service: its addresses by what is wanted, keys in a request, trials."""

    name: str
    urls: dict[str, str] = field(default_factory=dict)
    chunk: int = 100
    trials: int = 1

    def address(self, what: str, key: Column, fmt: Column | str = "") -> Column:
        """The address for ``what`` of a key; unknown kinds raise."""
        if what not in self.urls:
            raise KeyError(f"{self.name} has no {what!r}")
        return remote.url(self.urls[what], key, fmt)

    def plan(self, wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
        """Keys that are not there yet, in requests of at most ``chunk`` keys."""
        return remote.fetch_plan(wanted, have, key, self.chunk)

    def fetch(self, wanted: DataFrame, have: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """``(fetched, remaining)``: without a network nothing is fetched, and what
        remains has its error."""
        rows = remote.fetch(self.plan(wanted, have, key), key)
        return rows.where("ok"), rows.where("not ok")


UNIPROT = Service("uniprot", {"fasta": "uniprot", "info": "uniprot"})
PDB = Service("pdb", {"structure": "pdb_file", "info": "pdb_info"}, chunk=1)
ALPHAFOLD = Service("alphafold", {"structure": "predicted"}, chunk=1)
PANTHER = Service("panther", {"orthologs": "orthologs"}, chunk=10)


def info_fields(responses: DataFrame, key: str, text: str, fields: dict[str, str]) -> DataFrame:
    """Columns from stored JSON responses by their paths; null where one is missing."""
    return responses.select(key, *[F.get_json_object(text, path).alias(name) for name, path in fields.items()])


def orthologs(responses: DataFrame, text: str, kind: str | None = "LDO") -> DataFrame:
    """``gene, target, kind, organism`` from stored ortholog responses, one row per
    mapped gene, of one kind or of all.  A response without the list, or with text that
    is no JSON, has no rows."""
    shape = "struct<search: struct<mapping: struct<mapped: array<struct<gene: string, target_gene: string, ortholog: string, target_gene_symbol: string>>>>>"
    mapped = F.from_json(text, shape)["search"]["mapping"]["mapped"]
    gene = lambda c: F.element_at(F.split(c, "UniProtKB="), -1)
    rows = responses.select(F.explode(mapped).alias("m"))
    rows = rows.select(gene("m.gene").alias("gene"), gene("m.target_gene").alias("target"), F.col("m.ortholog").alias("kind"), F.split("m.target_gene", r"\|")[0].alias("organism"))
    return rows if kind is None else rows.where(F.col("kind") == kind)


def run_command(rows: DataFrame, key: str, text: str, command: list[str], timeout: float = 600.0) -> DataFrame:
    """``key, ok, output, error``: a program run on every row's text, which it gets as
    its input.  A program that is missing, fails or takes too long makes a row with an
    error, never an exception; a null text is an error."""
    kind = rows.schema[key].dataType.simpleString()

    def one(body: str | None) -> tuple[bool, str | None, str | None]:
        if not isinstance(body, str):
            return False, None, "no input"
        try:
            done = subprocess.run(command, input=body, capture_output=True, text=True, timeout=timeout)
        except FileNotFoundError:
            return False, None, f"{command[0]} is not installed"
        except subprocess.TimeoutExpired:
            return False, None, f"{command[0]} took longer than {timeout} s"
        if done.returncode:
            return False, done.stdout, f"{command[0]} ended with {done.returncode}: {done.stderr[-500:]}"
        return True, done.stdout, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, *one(b)) for k, b in zip(batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist())]
            yield pd.DataFrame(found, columns=[key, "ok", "output", "error"])

    ship(rows.sparkSession)
    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, ok boolean, output string, error string")


def secondary_structure(rows: DataFrame, key: str, text: str, program: str = "mkdssp") -> DataFrame:
    """Secondary structure files of structure texts, by the external program."""
    return run_command(rows, key, text, [program, "--output-format", "dssp", "/dev/stdin", "/dev/stdout"])


def external_alignment(groups: DataFrame, key: str, fasta: str, program: str = "mafft-linsi") -> DataFrame:
    """Alignments of FASTA texts by the external program; without it use
    :func:`strandworks.operators.msa.star_align`."""
    return run_command(groups, key, fasta, [program, "--quiet", "-"])


class Hooks:
    """What a constructor asks of a kind of items: what is missing and how to get it,
    and how staged texts become objects.  Subclasses set ``service`` and override
    :meth:`init_inputs`."""

    service = UNIPROT
    key = "id"

    def fetch_missing(self, items: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(fetched, remaining)`` of the items that are not there yet."""
        return self.service.fetch(items, have, self.key)

    def init_inputs(self, staged: DataFrame) -> DataFrame:
        """Objects of staged texts; as they are unless overridden."""
        return staged
