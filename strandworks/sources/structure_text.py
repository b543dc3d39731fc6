"""Atoms from mmCIF and PDB text, and back."""

from __future__ import annotations

import gzip
import shlex
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.plans.scratch import _fs
from strandworks.plans.ship import ship
from strandworks.sources.binary_structures import parse_mmtf

SCHEMA = (
    "structure_id string, atom_idx int, chain_id string, res_id int, ins_code string, res_name string, atom_name string, element string, "
    "hetero boolean, altloc_id string, x double, y double, z double"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def star_loops(text: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """The loops of a STAR text as ``(tags, rows)``; tags may share lines."""
    tags: list[str] | None = None
    values: list[str] = []
    for line in [*text.splitlines(), "#"]:
        bare = line.strip()
        if bare == "loop_" or bare.startswith(("#", "data_")) or not bare:
            if tags and bare:
                yield tags, [values[i : i + len(tags)] for i in range(0, len(values) - len(tags) + 1, len(tags))]
                tags, values = None, []
            if bare == "loop_":
                tags, values = [], []
        elif tags is not None and bare.startswith("_"):
            tags += bare.split()
        elif tags is not None:
            try:
                values += shlex.split(bare) if "'" in bare or '"' in bare else bare.split()
            except ValueError:
                values += bare.split()


def _number(x: str | None, kind=float):
    try:
        return kind(x)
    except (TypeError, ValueError):
        return None


def parse_mmcif(text: str, structure_id: str) -> list[tuple]:
    """Atom rows of the first ``_atom_site`` loop of the first model; author numbers
    are preferred, ``.`` and ``?`` are empty."""
    out: list[tuple] = []
    for tags, rows in star_loops(text):
        if not tags or not tags[0].startswith("_atom_site."):
            continue
        at = {t.split(".", 1)[1]: i for i, t in enumerate(tags)}

        def get(row: list[str], *names: str, at=at) -> str:
            for n in names:
                if n in at and row[at[n]] not in (".", "?"):
                    return row[at[n]]
            return ""

        model = None
        for row in rows:
            m = get(row, "pdbx_PDB_model_num")
            model = m if model is None else model
            if m != model:
                break
            name = get(row, "auth_atom_id", "label_atom_id")
            out.append(
                (
                    structure_id, len(out), get(row, "auth_asym_id", "label_asym_id"), _number(get(row, "auth_seq_id", "label_seq_id"), int),
                    get(row, "pdbx_PDB_ins_code"), get(row, "auth_comp_id", "label_comp_id"), name, get(row, "type_symbol") or name[:1],
                    get(row, "group_PDB") == "HETATM", get(row, "label_alt_id"), _number(get(row, "Cartn_x")), _number(get(row, "Cartn_y")), _number(get(row, "Cartn_z")),
                )
            )
        break
    return out


def parse_pdb(text: str, structure_id: str) -> list[tuple]:
    """Atom rows of the fixed columns of the first model."""
    out: list[tuple] = []
    for line in text.splitlines():
        if line.startswith("ENDMDL"):
            break
        if line.startswith(("ATOM  ", "HETATM")):
            name = line[12:16].strip()
            out.append(
                (
                    structure_id, len(out), line[21:22].strip(), _number(line[22:26], int), line[26:27].strip(), line[17:20].strip(), name,
                    line[76:78].strip() or name[:1], line.startswith("HETATM"), line[16:17].strip(), _number(line[30:38]), _number(line[38:46]), _number(line[46:54]),
                )
            )
    return out


def format_pdb(rows: list[tuple]) -> str:
    """PDB text of atom rows.  Serial numbers have five places and begin anew after
    99,999; chains of more than one letter do not fit, write those as mmCIF."""
    lines = []
    for r in rows:
        _, i, chain, res, ins, res_name, name, element, het, alt, x, y, z = r
        padded = f" {name:<3}" if len(name) < 4 and len(element) < 2 else f"{name:<4}"
        lines.append(f"{'HETATM' if het else 'ATOM  '}{(i + 1) % 100_000:>5} {padded}{alt:1}{res_name:>3} {chain:1}{res:>4}{ins:1}   {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{0:6.2f}          {element:>2}")
    return "\n".join([*lines, "END"])


#: The columns of a written ``_atom_site`` loop.
_SITE = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z auth_seq_id auth_comp_id auth_asym_id auth_atom_id pdbx_PDB_model_num".split()


def _quoted(value) -> str:
    """A value as one word of a STAR text."""
    text = "" if value is None else str(value)
    if not text:
        return "."
    if "'" in text or text[0] in "_#$[]\"":
        return f'"{text}"'
    return f"'{text}'" if any(c.isspace() for c in text) or text in (".", "?") else text


def format_mmcif(rows: list[tuple], structure_id: str) -> str:
    """mmCIF text of atom rows, with as many letters and numbers as they have."""
    lines = [f"data_{structure_id}", "#", "loop_", *(f"_atom_site.{c}" for c in _SITE)]
    for r in rows:
        _, i, chain, res, ins, res_name, name, element, het, alt, x, y, z = r
        words = ["HETATM" if het else "ATOM", i + 1, element, name, alt, res_name, chain, res, ins or "?", f"{x:.3f}", f"{y:.3f}", f"{z:.3f}", res, res_name, chain, name, 1]
        lines.append(" ".join(w if w == "?" else _quoted(w) for w in words))
    return "\n".join([*lines, "#", ""])


def parse_structures(texts: DataFrame, id_col: str, text_col: str, fmt: str = "mmcif") -> DataFrame:
    """Atoms of structure texts held in a column; null and other texts give none."""
    parser = parse_mmcif if fmt in ("cif", "mmcif") else parse_pdb

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]) if isinstance(text, str) for r in parser(text, key)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    ship(texts.sparkSession)
    return texts.select(id_col, text_col).mapInPandas(run, SCHEMA)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of ``.cif``, ``.pdb``, ``.mmtf`` and their ``.gz`` files; the id is the file
    name up to its first dot.  A file is one record: structures are small, files are
    many.  A binary file that cannot be read gives no atoms."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for name, content in zip(batch["path"], batch["content"]):
                base = name.rsplit("/", 1)[-1]
                raw = gzip.decompress(content) if base.endswith(".gz") else bytes(content)
                if ".mmtf" in base:
                    try:
                        rows += parse_mmtf(raw, base.split(".", 1)[0])
                    except (ValueError, KeyError, IndexError, TypeError, struct.error):
                        pass
                    continue
                parse = parse_pdb if ".pdb" in base else parse_mmcif
                rows += parse(raw.decode("utf-8", "replace"), base.split(".", 1)[0])
            yield pd.DataFrame(rows, columns=_COLUMNS)

    ship(spark)
    return files.mapInPandas(run, SCHEMA)


def structure_texts(atoms: DataFrame, fmt: str = "pdb") -> DataFrame:
    """``structure_id, text``: each structure as PDB or mmCIF text."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf.sort_values("atom_idx")[_COLUMNS].itertuples(index=False)]
        name = pdf["structure_id"].iloc[0]
        return pd.DataFrame([(name, format_mmcif(rows, name) if fmt in ("cif", "mmcif") else format_pdb(rows))], columns=["structure_id", "text"])

    ship(atoms.sparkSession)
    return atoms.select(*_COLUMNS).groupBy("structure_id").applyInPandas(run, "structure_id string, text string")


def write_structures(atoms: DataFrame, path: str, fmt: str = "cif") -> None:
    """One file per structure below ``path``, named by its id and the format; written by
    the executors, through a file system that all of them and the driver see."""
    texts = structure_texts(atoms, fmt)
    spark = atoms.sparkSession
    staging = f"{path}/.writing-{uuid.uuid4().hex}"
    texts.select("text", F.concat("structure_id", F.lit(f".{fmt}")).alias("file")).write.option("compression", "none").partitionBy("file").text(staging)
    fs, folder = _fs(spark, staging)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for part in fs.listStatus(folder):
        if part.isDirectory() and part.getPath().getName().startswith("file="):
            name = part.getPath().getName()[5:]
            for f in fs.listStatus(part.getPath()):
                if f.getPath().getName().startswith("part-") and not fs.rename(f.getPath(), jpath(f"{path}/{name}")):
                    raise OSError(f"cannot write {name}")
    fs.delete(folder, True)


def mark_flags(mark, names: dict[str, int]) -> dict:
    """Boolean columns of an integer mark, by bit."""
    return {n.lower(): mark.bitwiseAND(F.lit(b)) > 0 for n, b in names.items()}
