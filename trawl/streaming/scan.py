"""Scans of arriving text: stateless matching, and a sink that keeps each blob and finding once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trawl.operators import suppress
from trawl.operators.detect import with_ids, with_python
from trawl.plans.store import Store, scan


def matches(stream: DataFrame, rules) -> DataFrame:
    """Matches of a stream of blobs (blob_id, text), without state; also right for a batch."""
    return with_ids(with_python(stream.select("blob_id", "text"), rules))


def unsuppressed(stream: DataFrame, rules, context: int = 2) -> DataFrame:
    """The same with context, without matches that their rule's predicate drops."""
    return with_ids(suppress.unsuppressed(with_python(stream.select("blob_id", "text"), rules, context=context)))


def start(stream: DataFrame, rules, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scans a stream of blobs (blob_id, path, text) into a store, micro-batch by micro-batch.

    A batch that runs again finds its blobs and matches in the store and adds nothing.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, _: scan(store, batch, rules) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
