"""Operator 9: mixing sources to target weights.

Every source's words, in an order that the rows' contents fix, are packed into
blocks of a fixed number of words. Output shards have a fixed number of slots.
For each shard the number of slots of each source is a multinomial draw. Over
all shards the draws of a source stray from its number of slots; an exact last
step takes that up: a source's drawn slots beyond its number go, in order, to
the sources that were drawn too seldom, so the sums are right and all else stays
as drawn. The n-th slot of a source takes block ``permutation(n mod blocks)`` of
that source, where the permutation is a keyed Feistel network, so any slot's
block is computed alone and each pass over a source uses every block once.
Slots are then joined with the blocks by (source, block index).

Targets: a source's target is ``share`` times all words split by weight, but at
most ``most`` times the source's size; what exceeds that is split again by
weight among the others until none is above. A source's number of slots is its
target in blocks, rounded so that the sum is right.

At scale: the order inside a source is made by a two-level prefix sum over
buckets of about ``BUCKET`` documents, so a source with a third of all rows is
never one task's work; the join key (source, block) has as many values as there
are blocks. The driver holds one row for each source (a name and two numbers).
Draws depend on the seed and the shard's number alone, and the order on the
rows' contents, so reruns, lost tasks and another split of the files give the
same mix.

Defined results: null or empty text has size 0 and is taken 0 times; a null
source is a source of its own and comes last; rows with the same doc_id are
separate rows (of rows that are alike in all three columns any may be the one
that is taken more often); an empty table gives no rows; other columns are
ignored. A text of any length is counted whole and may span many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.storage import cut, rows_of, scratch, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Words in a block, slots in a shard, documents in a bucket of a source.
BLOCK, SLOTS, BUCKET = 64, 4096, 500
#: Shards whose counts one task draws.
SHARDS = 100
SEED = 20240601
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], share: float = SHARE, most: float = MOST) -> list[float]:
    """The words that each source is to give; sizes in the order of sources."""
    cap = [most * s for s in sizes]
    total, out, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if total * weights[i] / weight > cap[i]]
        if not above:
            for i in free:
                out[i] = total * weights[i] / weight
            break
        for i in above:
            out[i] = cap[i]
        total -= sum(cap[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(n) at ``index`` (arrays of one length)."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2)))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):  # outside of range(n), walk on along the cycle
            x, h, m = out[todo], half[todo], mask[todo]
            left, right = x >> h, x & m
            for turn in range(4):
                f = (right + key[todo] + np.uint64(turn * 0x9E3779B9)) * np.uint64(0xFF51AFD7ED558CCD)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xC4CEB9FE1A85EC53)
                left, right = right, left ^ ((f >> np.uint64(31)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def sized(docs: DataFrame, word: str = WORD) -> DataFrame:
    """(doc_id, source, size, h): the words of each row, and a hash that orders rows of one doc_id."""
    text = F.col("text").cast("string")
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(word)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("string"), text).alias("h"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def placed(rows: DataFrame) -> DataFrame:
    """rows(doc_id, source, size, h) with ``at``: the words of the source before the row."""
    rows = cut(rows, "sized")
    buckets = max(1, rows_of(rows) // BUCKET)
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inner = Window.partitionBy("source", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    chunk = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    # buckets of a source are themselves summed in chunks of 1000
    chunk = chunk.withColumn("group", F.floor(F.col("bucket") / 1000))
    over = Window.partitionBy("source", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = chunk.groupBy("source", "group").agg(F.sum("bucket_size").alias("group_size"))
    top = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    group = group.select(F.col("source").alias("gs"), F.col("group").alias("gg"), F.coalesce(F.sum("group_size").over(top), F.lit(0)).alias("above"))
    chunk = chunk.withColumn("before", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)))
    chunk = chunk.join(group, _same(F.col("source"), F.col("gs")) & (F.col("group") == F.col("gg"))).select(
        F.col("source").alias("cs"), F.col("bucket").alias("cb"), (F.col("before") + F.col("above")).alias("base")
    )
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(chunk.hint("merge"), _same(F.col("source"), F.col("cs")) & (F.col("bucket") == F.col("cb")))
    return rows.withColumn("at", F.col("at") + F.col("base")).select("doc_id", "source", "size", "at")


def slots_of(blocks: np.ndarray, sizes: list[int], aims: list[float]) -> np.ndarray:
    """Each source's number of slots: its target in blocks, the largest remainders rounded up."""
    wanted = np.array([b * t / s if s else 0.0 for b, t, s in zip(blocks.tolist(), aims, sizes, strict=True)])
    out = np.floor(wanted + 1e-9).astype(np.int64)
    order = np.argsort(-(wanted - out), kind="stable")
    out[order[: int(round(wanted.sum())) - int(out.sum())]] += 1
    return out


class Draw:
    """The slots of every shard: how many of each source, and which of a source's blocks.

    All of it is a function of the seed and of the numbers of the sources.
    """

    def __init__(self, blocks: np.ndarray, wanted: np.ndarray, slots: int, seed: int) -> None:
        self.blocks, self.wanted, self.slots, self.seed = blocks, wanted, slots, seed
        self.total = int(wanted.sum())
        self.shards = -(-self.total // slots)
        self.drawn = wanted  # once known: how many slots of each source all shards have drawn

    def counts(self, shard: int) -> np.ndarray:
        n = min(self.slots, self.total - shard * self.slots)
        return np.random.default_rng([self.seed, shard]).multinomial(n, self.wanted / self.total)

    def corrected(self, source: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(source, turn) of drawn slots: those beyond a source's number go to the sources drawn too seldom."""
        over, short = np.maximum(self.drawn - self.wanted, 0), np.maximum(self.wanted - self.drawn, 0)
        of = np.full(len(turn), source, dtype=np.int64)
        much = np.flatnonzero(turn >= self.wanted[source])
        if len(much):
            rank = turn[much] - self.wanted[source] + over[:source].sum()
            ends = np.cumsum(short)
            to = np.searchsorted(ends, rank, side="right")
            of[much], turn = to, turn.copy()
            turn[much] = self.drawn[to] + rank - (ends - short)[to]
        return of, turn

    def block(self, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
        lap, index = np.divmod(turn, self.blocks[source])
        with np.errstate(over="ignore"):
            key = (np.uint64(self.seed) * np.uint64(31) + source.astype(np.uint64)) * np.uint64(1_000_003) + lap.astype(np.uint64)
        return permuted(index, self.blocks[source], key)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    block: int = BLOCK, slots: int = SLOTS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, slots) of the mix.

    documents: doc_id, size, source_size, target, taken. slots: shard, slot,
    source, block, which lists the mix block by block.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = keep(cut(placed(sized(docs)), "placed"))
        found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r["size"] for r in found]
        aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
        blocks = np.array([-(-s // block) for s in sizes], dtype=np.int64)
        draw = Draw(blocks, slots_of(blocks, sizes, aims), slots, seed)

        # documents with what their source has
        about = spark.createDataFrame(
            [(i, r.source, int(s), float(t)) for i, (r, s, t) in enumerate(zip(found, sizes, aims, strict=True))],
            "sid int, name string, source_size long, target double",
        )
        rows = rows.join(F.broadcast(about) if len(found) < 100_000 else about, _same(F.col("source"), F.col("name")))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shard in pdf["id"]:
                    c = draw.counts(int(shard))
                    sid = np.flatnonzero(c)
                    yield pd.DataFrame({"shard": int(shard), "sid": sid.astype(np.int32), "n": c[sid]})

        drawn = spark.range(0, draw.shards, 1, 1 + draw.shards // SHARDS).mapInPandas(count, "shard long, sid int, n long")
        drawn = cut(drawn.withColumn("part", F.floor(F.col("shard") / 1000)), "drawn")
        before = Window.partitionBy("sid", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        parts = drawn.groupBy("sid", "part").agg(F.sum("n").alias("pn"))
        above = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("sid", "part", F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("above"))
        sums = {r.sid: r.n for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect()}  # a row for each source
        draw.drawn = np.array([sums.get(i, 0) for i in range(len(found))], dtype=np.int64)
        drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(parts, ["sid", "part"])
        drawn = drawn.select("shard", "sid", "n", (F.col("first") + F.col("above")).alias("first"))
        drawn = keep(cut(drawn.repartition(1 + draw.total // 100_000, "shard", "sid"), "turns"))  # few rows, but of many slots each

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, s, n, first in pdf.itertuples(index=False):
                of, turn = draw.corrected(s, np.arange(first, first + n))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(n), "sid": of.astype(np.int32), "block": draw.block(of, turn)})

    chosen = drawn.mapInPandas(choose, "shard long, slot long, sid int, block long")
    times = chosen.groupBy("sid", "block").agg(F.count("*").alias("times"))

    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    of = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    joined = of.withColumn("words", words).join(times.hint("merge"), ["sid", "block"], "left")  # as many as there are blocks
    # a row with words is told from others of its source by where it begins
    taken = joined.groupBy("sid", "at", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
    none = rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.drop("sid", "at").unionAll(none), chosen.join(F.broadcast(about.select("sid", F.col("name").alias("source"))), "sid")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]
