"""Remote services: address builders and fetch plans.  There is no network here, so
fetching yields rows that say so; nothing is invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Addresses by service; ``{id}`` and ``{fmt}`` are filled in.
URLS = {
    "pdb_file": "https://files.rcsb.org/download/{id}.{fmt}",
    "pdb_info": "https://data.rcsb.org/rest/v1/core/entry/{id}",
    "uniprot": "https://rest.uniprot.org/uniprotkb/stream?format={fmt}&query=accession:{id}",
    "orthologs": "https://pantherdb.org/services/oai/pantherdb/ortholog/matchortho?geneInputList={id}",
    "predicted": "https://alphafold.ebi.ac.uk/files/AF-{id}-F1-model_v4.{fmt}",
}
OFFLINE = "offline: no network access"


def url(service: str, key: Column, fmt: Column | str = "") -> Column:
    """The address of a key as a column."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    template = URLS[service]
    before, _, rest = template.partition("{id}")
    fill = lambda part: F.replace(F.lit(part), F.lit("{fmt}"), fmt)
    return F.concat(fill(before), key, fill(rest))


def fetch_plan(wanted: DataFrame, have: DataFrame, key: str, chunk: int = 100) -> DataFrame:
    """What is left to fetch, in chunks: ``key, chunk``."""
    from pyspark.sql.window import Window

    left = wanted.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")
    bucket = F.pmod(F.xxhash64(key), F.lit(64))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return left.withColumn("_b", bucket).withColumn("chunk", F.concat_ws("-", "_b", F.floor((place - 1) / chunk))).select(key, "chunk")


def fetch(plan: DataFrame, key: str) -> DataFrame:
    """``key, ok, error``: every request fails for want of a network."""
    return plan.select(key, F.lit(False).alias("ok"), F.lit(OFFLINE).alias("error"))


def method_filter(info: DataFrame, key: str, text: str, path: str, wanted: str) -> DataFrame:
    """Keys whose stored JSON has a value at a path; a missing one rejects."""
    return info.where(F.get_json_object(text, path) == wanted).select(key)
