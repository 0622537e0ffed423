"""Continuous ingest: each micro-batch of new documents is redacted, chunked, embedded and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspark.plans import retrieval
from veilspark.sources import metadata


def ingest_stream(docs: DataFrame, index_path: str, metadata_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that takes in all documents there are and stops; start it again for later ones.

    A batch that is tried again after a failure is taken in once: documents whose id is in the metadata are left out, and
    the metadata is what completes a batch of vectors.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = None
        if metadata.batches(spark, metadata_path):
            known = metadata.read(spark, metadata_path).select("document_id").distinct()
        fresh = batch if known is None else batch.join(known, "document_id", "left_anti")
        retrieval.ingest(fresh, index_path, metadata_path, **options)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
