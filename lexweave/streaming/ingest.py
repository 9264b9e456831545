"""Incremental ingest: dictionary lines arrive as files and are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..sources.dictionary import edge_rows, parse_lines, words_of
from ..sources.specs import SourceSpec


def ingest_stream(spark: SparkSession, folder: str, store: Store, spec: SourceSpec, checkpoint: str) -> StreamingQuery:
    """Merge every file that appears in ``folder`` into the store; a batch that is run again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        lines = batch.select(F.monotonically_increasing_id().alias("ordinal"), "value")
        parsed = parse_lines(lines, spec).persist()
        try:
            store.insert_words(words_of(parsed), seq="ordinal")
            edges = edge_rows(parsed)
            if not edges.isEmpty():
                store.insert_edges(edges, seq="ordinal")
        finally:
            parsed.unpersist()

    source = spark.readStream.format("text").option("maxFilesPerTrigger", 64).load(folder)
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
