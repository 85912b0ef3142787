"""Incremental ingestion: new documents of a stream become postings of the search index (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from incipit.operators.retrieval import postings


def ingest(docs: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of a stream of (doc, text) to a Parquet index, partitioned by batch; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
