"""Indexing a stream of record files: each micro-batch is signed and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.index import Index
from kinfold.operators.lineage import cut
from kinfold.operators.signature import sign
from kinfold.operators.vocabulary import Vocabulary


def index_stream(records: DataFrame, vocabulary: Vocabulary, index: Index, checkpoint: str, **trigger) -> StreamingQuery:
    """Sign and index the records of a stream. A replayed batch writes the same version and the
    same postings, so in a 'set' index it counts once. ``trigger`` as for a writer's trigger;
    all that is there, once, by default."""

    def append(batch: DataFrame, number: int) -> None:
        index.write(batch, cut(sign(batch, vocabulary)), number)

    return records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
