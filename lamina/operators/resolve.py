"""Newest-wins resolution and the reads on top of it.

One hash exchange on ``key``, with partial aggregation before it, whatever the
number of layers; predicates on the key pass through the aggregate to the scan.
Deletions are dropped strictly above the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.errors import invalid


def merged(*layers: DataFrame) -> DataFrame:
    """The changes of several layers as one table."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def resolved(changes: DataFrame, *by: str) -> DataFrame:
    """The newest change of each key (within each group ``by``), deletions kept."""
    newest = F.max(F.struct("layer", "ord", "seq", "op", "value")).alias("n")
    return changes.groupBy(*by, "key").agg(newest).select(*by, "key", "n.layer", "n.ord", "n.seq", "n.op", "n.value")


def newest(changes: DataFrame) -> DataFrame:
    """The newest change of each key where ``ord`` orders all layers: late changes may lie in newer ones."""
    best = F.max(F.struct("ord", "layer", "seq", "op", "value")).alias("n")
    return changes.groupBy("key").agg(best).select("key", "n.layer", "n.ord", "n.seq", "n.op", "n.value")


#: How the newest changes are found: ``resolved`` or ``newest``.
Newest = Callable[[DataFrame], DataFrame]


def visible(changes: DataFrame, newest: Newest = resolved) -> DataFrame:
    """(key, value) of the live keys."""
    return newest(changes).where("value is not null").select("key", "value")


def numbered(ranged: DataFrame) -> DataFrame:
    """(layer, ord, key, value) of rows(layer, key, value, file, i) in files that are ranges of keys, in the order of their names.

    ``ord`` is the rows in the files before, and those before in its own, and 1.
    """
    sizes = ranged.groupBy("file").agg(F.count("*").alias("n"))  # a row for each file
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(before, "file").select("layer", (F.col("before") + F.col("i") + 1).alias("ord"), "key", "value")


def _range(start: str | None, end: str | None) -> Column:
    ok = F.lit(True)
    if start is not None:
        ok = ok & (F.col("key") >= start)
    if end is not None:
        ok = ok & (F.col("key") < end)
    return ok


def check_range(start: str | None, end: str | None, limit: int | None) -> None:
    if limit is not None and limit <= 0:
        raise invalid("limit must be positive", value=limit)
    if start and end and end < start:
        raise invalid("range end lies before its start", start=start, end=end)


def scan(changes: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, newest: Newest = resolved) -> DataFrame:
    """Live (key, value) in key order, from ``start`` up to but without ``end``."""
    check_range(start, end, limit)
    rows = visible(changes.where(_range(start, end)), newest).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def prefix_scan(changes: DataFrame, prefix: str) -> DataFrame:
    """Live (key, value) of the keys that begin with ``prefix``, in key order."""
    return visible(changes.where(F.col("key").startswith(prefix))).orderBy("key")


def states(changes: DataFrame, keys: DataFrame, small: int | None = None, newest: Newest = resolved) -> DataFrame:
    """(key, state, value, layer) of each requested key: hit, tombstone or miss.

    ``small``: the number of requested keys if known; up to 100,000 they are
    sent to the changes, which are then filtered before the exchange.
    """
    wanted = keys.select("key").distinct()
    if small is not None and small <= 100_000:
        changes = changes.join(F.broadcast(wanted), "key", "left_semi")
    known = newest(changes).select("key", "value", "layer", F.lit(True).alias("found"))
    state = F.when(F.col("found").isNull(), "miss").when(F.col("value").isNull(), "tombstone").otherwise("hit")
    return wanted.join(known, "key", "left").select("key", state.alias("state"), "value", "layer")


def lookup(changes: DataFrame, key: str) -> tuple[bool, str | None]:
    """(found, value) of one key; a deleted key is found with no value."""
    row = changes.where(F.col("key") == key).agg(F.count("*").alias("n"), F.max(F.struct("layer", "ord", "value")).alias("v")).first()
    return row.n > 0, row.v["value"] if row.n else None


def as_of(changes: DataFrame, layer: int | Column, ord: int | Column) -> DataFrame:
    """Live (key, value) as they were when (layer, ord) was the newest change."""
    return visible(changes.where((F.col("layer") < layer) | ((F.col("layer") == layer) & (F.col("ord") <= ord))))


def duplicate_versions(changes: DataFrame) -> DataFrame:
    """(key, layer, ord, n) that occur more than once: no newest exists there."""
    return changes.groupBy("key", "layer", "ord").agg(F.count("*").alias("n")).where("n > 1")


def sealed_order(layer: DataFrame) -> DataFrame:
    """(key, n) that a sealed layer holds more than once."""
    return layer.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def flush_points(changes: DataFrame, limit: int, *by: str) -> DataFrame:
    """(by, ord) of the changes that fill the memtable of a write session.

    A key costs its length and that of its newest value since the last flush.
    The fold needs only each change's cost and that of the key's change before.
    A session is inherently sequential: one task reads it in order of ``ord``
    and carries two numbers from batch to batch, so a session may have any
    number of changes and boundaries. Sessions (``by``) run side by side.
    """
    cost = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    last = Window.partitionBy(*by, "key").orderBy("ord")
    rows = changes.withColumn("cost", cost.cast("long"))
    rows = rows.withColumn("old_ord", F.lag("ord").over(last)).withColumn("old_cost", F.lag("cost").over(last))
    rows = rows.select(*by, F.col("ord").cast("long").alias("ord"), "cost", "old_ord", "old_cost")
    rows = (rows.repartition(*by) if by else rows.coalesce(1)).sortWithinPartitions(*by, "ord", "cost", "old_ord", "old_cost")
    width = len(by)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, start, size = None, -1, 0
        for batch in batches:
            full = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True) if by else repeat(())
            changed = (batch.column(width + i).to_pylist() for i in range(4))
            for i, (key, (at, new, old_at, old)) in enumerate(zip(keys, zip(*changed, strict=True))):
                if key != session:
                    session, start, size = key, -1, 0
                size += new - (old if old_at is not None and old_at > start else 0)
                if size >= limit:
                    full.append(i)
                    start, size = at, 0
            if full:
                yield batch.select(range(width + 1)).take(pa.array(full))

    return rows.mapInArrow(fold, rows.select(*by, "ord").schema)
