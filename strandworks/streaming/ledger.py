"""Filling a catalog from a stream, batch by batch.

The checkpoint of the query is the ledger's twin: a restarted query goes on with the
first micro-batch that was not committed, and since inserts skip what is there, a
batch that ran half is made whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandworks.operators.collection import SCHEMAS, Catalog


def ingest(stream: DataFrame, catalog: Catalog, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Start a query that runs ``build`` on each micro-batch and stores the result;
    it takes what is available and ends."""

    def store(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            chains, parents = build(kept)
            catalog.add(chains, parents)
            row = (number, kept.count(), chains.select("id").distinct().count(), False, None)
            catalog._append("batches", catalog.spark.createDataFrame([row], SCHEMAS["batches"]))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
