"""The newest change of each key over a stream of changes.

State is one row for each key. Late changes do no harm: a change that is older
than what is known loses the comparison, whenever it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.sources.store import Store


def latest(changes: DataFrame) -> DataFrame:
    """A streaming (key, layer, ord, op, value); for update or complete mode."""
    newest = F.max(F.struct("layer", "ord", "op", "value")).alias("n")
    return changes.groupBy("key").agg(newest).select("key", "n.layer", "n.ord", "n.op", "n.value")


def into_store(changes: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of changes(ord, key, op, value) to a store's log as one commit.

    ``ord`` is the version of the source, so a change that comes late loses to
    a newer one of its key. The manifest keeps the number of the last batch of
    each checkpoint, so a batch that is tried again changes nothing.
    """

    def append(batch: DataFrame, number: int) -> None:
        store.apply(batch, versions=True, batch=(checkpoint, number))

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
