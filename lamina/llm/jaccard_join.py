"""Operator 10: n-gram Jaccard self-join with PartEnum signatures.

A document's set holds its distinct 5-word shingles. Two sets link if
``100 * |A and B| >= 80 * |A or B|``, that is if at most ``(a + b) / 9``
shingles are in one set alone.

Signatures. Sizes are cut into bands whose tops grow by 5/4, so the sets that a
set can link with lie in its own band or the next. For each band the domain of
shingles is partitioned (by hash) on two levels, as in PartEnum: into more
parts than half of the shingles that may differ, so linked sets have parts with
at most one of them, and each part into ``CELLS`` cells, of which all subsets
that leave one cell out are enumerated, so such a part agrees on a subset. A
signature is a hash of the band, the part, the cell that is left out and the
shingles in the rest; empty ones are left out. A set enumerates its signatures
once for its own band and once for the next. A set that has too few parts to be
sure of an agreeing one (its shingles leave too many empty) also emits its least
shingles as prefix-filter signatures, so the join is exact for it too.

Buckets of sets with one signature give candidates: every pair in a bucket of
up to ``SMALL`` sets; in larger ones each set with the first (linear, not
quadratic). A set that has more agreeing parts for sure than it has large
buckets needs none of them. For the others (members of large groups of near
copies, mostly) the rarest of their large buckets are compared component by
component, and what is then still apart by a prefix filter over those sets
alone, so nothing is lost and nothing is capped.

Candidates are verified on the whole sets. Pairs already in one component are
not verified: the result (classes and components) does not need them.

Movement: equal sets are one class before anything is compared; a task emits
the signatures of equal sets once; signatures travel as packed blocks of 12
bytes each, dealt by signature; whole sets are made again from the text of
candidate documents alone. A signature that more than one document in
``1 / HOT`` has is found while sets are described (there are fewer than
``HOT`` times a set's signatures of them), and its members are dealt by
their own keys: its bucket is large, so it needs no task that sees it whole.
Joins by bucket, class and component send what hot values need to their rows
(``joins.spread_join``).

Hashes. Shingles are told apart by 64-bit hashes of five words, sets by 64-bit
hashes of their shingles. No rows become one class by a hash alone: a second,
cryptographic digest of the words is compared within each class, and where it
differs the sets themselves are; should two sets share a key, all is done again
with another seed (expected once in 2^65 / rows^2 runs), and after ``SEEDS``
such runs the operator fails rather than link them.

Defined results: null texts and texts without words have 0 shingles and are
components of their own; fewer than five words are one shingle; equal sets are
linked; rows with the same doc_id are separate rows of one id; a row with null
doc_id has the least id of its component, null if there is none; an empty table
gives no rows; other columns are ignored (or kept, by ``deduplicate``). Texts
of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.errors import corrupt
from lamina.llm.components import components
from lamina.llm.joins import hot_values, spread_join
from lamina.llm.storage import cut, rows_of, scratch, table
from lamina.llm.vectors import LOWER, PIECE, SPACE, Words, mix, pieces, text_bytes

WIDTH = 5
#: Cells of a part.
CELLS = 3
#: Sets in a bucket of which all pairs are compared at once.
SMALL = 12
#: MB of signatures that one task reads.
RANGE_MB = 16
#: A signature is hot if more than HOT_FLOOR sets and one in HOT have it.
HOT, HOT_FLOOR = 1000, 500
#: Distinct signatures that a task counts, and keys of sets that it remembers.
COUNTED, SEEN = 1 << 20, 1 << 20
#: Runs with another hash before a collision is an error.
SEEDS = 3
#: Candidate documents whose ids are broadcast (16 bytes each); beyond it they are joined.
BROADCAST_ROWS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT, _U48 = np.uint64(17), (1 << 48) - 1


def _tops() -> np.ndarray:
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * 5 // 4))
    return np.array(tops, dtype=np.int64)


TOPS = _tops()
#: Parts of a band: more than half of the (a + b) / 9 <= 2 / 9 * top that may
#: differ, with room for parts that are empty or whose signature is very common.
PARTS = np.ceil(1.15 * (TOPS * 2 // 9 // 2 + 1)).astype(np.int64)


def sets_of(text: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, size of each row): the distinct shingles, sorted by row and value."""
    w = Words(*text_bytes(text), seed=seed)
    h, rows = w.hash, len(w.count)
    with np.errstate(over="ignore"):
        value = np.zeros(max(0, len(h) - WIDTH + 1), dtype=np.uint64)
        for k in range(WIDTH):
            value = value * _ODD + h[k : k + len(value)]
        whole = w.doc[: len(value)] == w.doc[WIDTH - 1 :]
        row, value = w.doc[: len(value)][whole], mix(value[whole])
        few = np.flatnonzero((w.count > 0) & (w.count < WIDTH))
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(WIDTH - 1):
            there = w.count[few] > k
            short[there] = short[there] * _ODD + h[w.first[few][there] + k]
        short = mix(short + w.count[few].astype(np.uint64))
    row, value = np.concatenate((row, few)), np.concatenate((value, short))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=rows)


def _keys(row: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's set; 0 for an empty one."""
    out = np.zeros(len(size), dtype=np.uint64)
    some = size > 0
    if some.any():
        first = np.concatenate(([0], np.cumsum(size)))[:-1][some]
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(value ^ _ODD), first) + size[some].astype(np.uint64) * _ODD)
    return out


def _words(text: pa.Array) -> list[bytes]:
    """The words of each row as they are compared, a blank between."""
    raw, offsets = text_bytes(text)
    blank = SPACE[raw]
    kept = ~blank
    kept[1:] |= ~blank[:-1]  # a blank behind a word stays
    plain = np.where(blank, np.uint8(32), LOWER[raw])[kept].tobytes()
    at = np.concatenate(([0], np.cumsum(kept)))[offsets]
    return [plain[a:b].strip(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _digests(text: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in _words(text)], dtype=np.int64)


def _signatures(row: np.ndarray, value: np.ndarray, size: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) in the own (role 0) or the next band (role 1), and each row's slack.

    The slack is the number of signatures, less one, that a row shares for sure
    with any set it links with; below 0 (given as 0) none is sure.
    """
    band = np.searchsorted(TOPS, size) + role
    top, parts = TOPS[band], PARTS[band]
    most = (size + np.minimum(top, size * 5 // 4)) // 9  # shingles that the largest partner in this band may differ by
    slack = np.zeros(len(size), dtype=np.int64)
    if not len(row):
        return row, value, slack
    with np.errstate(over="ignore"):
        salt = mix((band.astype(np.uint64) + np.uint64(1)) * _ODD)
        where = (mix(value ^ salt[row]) >> np.uint64(20)).astype(np.int64)
        n = parts[row]
        cell = where % n * CELLS + where // n % CELLS
        order = np.lexsort((cell, row))
        r, c, v = row[order], cell[order], value[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        r, c, total = r[at], c[at], np.add.reduceat(mix(v + _ODD), at)
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] // CELLS != c[:-1] // CELLS)
        part, at = np.cumsum(new) - 1, np.flatnonzero(new)
        held, full = np.zeros((len(at), CELLS), dtype=np.uint64), np.zeros((len(at), CELLS), dtype=bool)
        held[part, c % CELLS], full[part, c % CELLS] = total, True
        r, number = r[at], (c[at] // CELLS * CELLS).astype(np.uint64)
        # each subset of a part's cells that leaves one out
        rest = held.sum(axis=1)[:, None] - held
        signature = mix(mix(rest) + (salt[r] + number)[:, None] + np.arange(CELLS, dtype=np.uint64))
        cells = full.sum(axis=1)
        some = cells[:, None] > full
        # one difference spoils a part of one cell, two spoil any other
        single, solid = (np.bincount(r[x], minlength=len(size)) for x in (cells == 1, cells > 1))
        sure = single + solid - np.minimum(single, most) - np.maximum(most - single, 0) // 2
        slack = np.maximum(sure - 1, 0)
        r, signature = np.repeat(r, some.sum(axis=1)), signature[some]
        thin = np.flatnonzero((sure < 1) & (size > 0))
        if len(thin):
            first = np.concatenate(([0], np.cumsum(size)))
            take = [np.arange(first[i], first[i] + size[i] + (-4 * size[i] // 5) + 1) for i in thin]
            least = np.concatenate(take)
            r = np.concatenate((r, row[least]))
            signature = np.concatenate((signature, mix(value[least] + salt[row[least]] * np.uint64(3))))
    return r, signature, slack


class _Fresh:
    """Which sets a task has not met before, as far as it remembers."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def only(self, row: np.ndarray, value: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sets without those met before, and which rows are left."""
        new = np.zeros(len(key), dtype=bool)
        for i, k in enumerate(key.tolist()):
            if k not in self.seen:
                new[i] = True
                self.seen.add(k)
        if len(self.seen) > SEEN:
            self.seen.clear()
        kept = new[row]
        return row[kept], value[kept], np.where(new, size, 0), new


class _Counts:
    """How often signatures occur in a task, as far as they are frequent."""

    def __init__(self) -> None:
        self.value, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, signatures: np.ndarray) -> None:
        self.waiting.append(signatures)
        if sum(map(len, self.waiting)) > COUNTED:
            self.settle()
            if len(self.value) > COUNTED:
                often = self.times > 1
                self.value, self.times = self.value[often], self.times[often]

    def settle(self) -> None:
        value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting = []
        both = np.concatenate((self.value, value))
        self.value, at = np.unique(both, return_inverse=True)
        self.times = np.bincount(at, weights=np.concatenate((self.times, times)), minlength=len(self.value)).astype(np.int64)


_DESCRIBED = "doc_id long, n long, k long, d long, slack0 long, slack1 long, often array<long>, times array<long>"


def described(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, n, k, d, slack0, slack1) of each row: size, key and digest of its set, slacks by role.

    Slacks are null in a row whose set the task has met before. A row for each
    task, with n below 0, has the signatures that are frequent in it.
    """
    least, share = max(2, min(4, HOT_FLOOR)), 2 * HOT

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, fresh, sets = _Counts(), _Fresh(), 0
        none = lambda n: pa.nulls(n, pa.list_(pa.int64()))
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                text = batch.column(1).slice(a, b - a)
                row, value, size = sets_of(text, seed)
                key = _keys(row, value, size)
                row, value, few, new = fresh.only(row, value, size, key)
                slacks = []
                for role in (0, 1):
                    _, signature, slack = _signatures(row, value, few, role)
                    counts.add(signature)
                    slacks.append(pa.array(slack, mask=~new))
                sets += int(new.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size), pa.array(key.view(np.int64)), pa.array(_digests(text)), *slacks, none(b - a), none(b - a)],
                    names=["doc_id", "n", "k", "d", "slack0", "slack1", "often", "times"],
                )
        counts.settle()
        often = counts.times >= max(least, sets // share)
        if often.any():
            lists = [pa.array([x[often].tolist()], pa.list_(pa.int64())) for x in (counts.value.view(np.int64), counts.times)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([0]), pa.array([0]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *lists],
                names=["doc_id", "n", "k", "d", "slack0", "slack1", "often", "times"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(describe, _DESCRIBED)


def _hot_signatures(told: DataFrame, rows: int) -> np.ndarray:
    """The signatures that more than HOT_FLOOR sets and one row in HOT have, sorted."""
    each = told.where("n < 0").select(F.explode(F.arrays_zip("often", "times")).alias("x")).select("x.often", "x.times")
    summed = each.groupBy("often").agg(F.sum("times").alias("times")).where(F.col("times") > max(HOT_FLOOR, rows // HOT))
    return np.sort(np.array([r[0] for r in summed.select("often").collect()], dtype=np.int64).view(np.uint64))


def _packed(docs: DataFrame, ranges: int, hot: np.ndarray, seed: int = 0) -> DataFrame:
    """(range, block): 6 bytes of signature and 6 bytes of key and role, many to a block.

    Hot signatures go to ranges of their own, behind the others, by key.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            text = batch.column(0)
            for a, b in pieces(text, 4 * PIECE):
                row, value, size = sets_of(text.slice(a, b - a), seed)
                key = _keys(row, value, size)
                row, value, size, _ = fresh.only(row, value, size, key)
                key >>= _SHIFT
                parts = []
                for role in (0, 1):
                    r, s, _ = _signatures(row, value, size, role)
                    parts.append((s, key[r] << np.uint64(1) | np.uint64(role)))
                s, k = (np.concatenate(x) for x in zip(*parts, strict=True))
                if not len(s):
                    continue
                where = (s % np.uint64(ranges)).astype(np.int64)
                if len(hot):
                    apart = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    where[apart] = ranges + (mix(k[apart]) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                data = np.empty((len(s), 12), dtype=np.uint8)
                data[:, :6] = (s[order] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                data[:, 6:] = k[order].view(np.uint8).reshape(-1, 8)[:, :6]
                number, at = np.unique(where[order], return_index=True)
                ends = np.append(at[1:], len(s))
                blocks = [data[x:y].tobytes() for x, y in zip(at, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(blocks, pa.binary())], names=["range", "block"])

    return docs.select(F.col("text").cast("string")).mapInArrow(emit, "range long, block binary")


def candidates_in(signature: np.ndarray, key: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, a, b, times): kind 0 are pairs of keys that meet in so many buckets, kind 1 members b (key and role) of large bucket a."""
    order = np.lexsort((key, signature))
    s, k = signature[order], key[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    s, k = s[new], k[new]
    own = (k & np.uint64(1)) == 0
    bare = k >> np.uint64(1)
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(s)))
    owners = np.add.reduceat(own.astype(np.int64), at) if len(at) else count
    bucket = np.repeat(np.arange(len(at)), count)
    useful = (count > 1) & (owners > 0)
    a, b = [], []
    few = (useful & (count <= small))[bucket]
    for d in range(1, small):
        i = np.flatnonzero(few[: len(s) - d] & (bucket[: len(s) - d] == bucket[d:]) & (own[: len(s) - d] | own[d:])) if len(s) > d else []
        if len(i):
            a.append(bare[i])
            b.append(bare[i + d])
    many = np.flatnonzero((useful & (count > small))[bucket])
    if len(many):
        lead = np.full(len(at), len(s), dtype=np.int64)  # the first owner of each bucket
        mine = np.flatnonzero(own)
        np.minimum.at(lead, bucket[mine], mine)
        head = lead[bucket[many]]
        a.append(bare[head])
        b.append(bare[many])
    pa_, pb = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    low, high = np.minimum(pa_, pb), np.maximum(pa_, pb)
    keep = low != high
    low, high = low[keep], high[keep]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(low) else np.zeros(0, np.int64)
    times = np.concatenate((np.diff(np.append(first, len(low))), np.ones(len(many), np.int64)))
    kind = np.concatenate((np.zeros(len(first), np.int32), np.ones(len(many), np.int32)))
    return kind, np.concatenate((low[first], s[many])), np.concatenate((high[first], k[many])), times


def _candidates(packed: DataFrame, ranges: int) -> DataFrame:
    """(kind, a, b, times) of every range, see candidates_in; members of hot signatures are of kind 1."""

    def met(number: int, blocks: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 12)
        wide = np.zeros((len(data), 8), dtype=np.uint8)
        wide[:, :6] = data[:, :6]
        signature = wide.view("<u8").ravel().copy()
        wide[:, :6] = data[:, 6:]
        key = wide.view("<u8").ravel()
        with np.errstate(over="ignore"):
            if number < ranges:  # a bucket's name holds its range
                kind, a, b, times = candidates_in(signature, key)
                a = np.where(kind == 1, mix(a * np.uint64(ranges) + np.uint64(number)), a)
            else:
                order = np.lexsort((key, signature))
                a, b = mix(~signature[order]), key[order].copy()
                new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                a, b = a[new], b[new]
                kind, times = np.ones(len(a), np.int32), np.ones(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(times)], names=["kind", "a", "b", "times"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = -1, []
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != now and blocks:
                    yield met(now, blocks)
                    blocks = []
                now = number
                blocks.append(block)
        if blocks:
            yield met(now, blocks)

    dealt = packed.repartitionById(ranges, (F.col("range") % ranges).cast("int")).sortWithinPartitions("range")
    return dealt.mapInArrow(meet, "kind int, a long, b long, times long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of docs that share a doc_id with a row of wanted."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    if rows_of(wanted) <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    return texts.join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("text")


def _whole_sets(docs: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """(k, n, shingles) of wanted(k, doc_id), from the texts of those documents alone."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for a, b in pieces(text):
                row, value, size = sets_of(text.slice(a, b - a), seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_keys(row, value, size).view(np.int64)), pa.array(size),
                     pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(value.view(np.int64)))],
                    names=["k", "n", "shingles"],
                )

    found = _texts(docs, wanted).mapInArrow(build, "k long, n long, shingles array<long>")
    keys = wanted.select("k")
    if rows_of(wanted) <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    # rows that share a doc_id with a wanted one, and copies of it, go
    return found.join(keys, "k", "left_semi").groupBy("k", "n").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) that link.

    Only sets of the pairs move: the ids of the pairs are sent to the sets
    where there are few enough of them. Of a set in very many pairs (the head
    of a large bucket) the shingles are sent to the others.
    """
    few = rows_of(pairs) <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    left, right = (sets.withColumnsRenamed({"k": x, "n": f"n{x}", "shingles": f"s{x}"}) for x in "ab")
    hot = sorted({*hot_values(pairs, "a"), *hot_values(pairs, "b")})
    parts = []
    if hot:
        a, b = F.col("a"), F.col("b")
        mine = pairs.where(a.isin(hot) | b.isin(hot)).select(F.when(a.isin(hot), b).otherwise(a).alias("a"), F.when(a.isin(hot), a).otherwise(b).alias("b"))
        parts.append(left.join(sent(mine), "a").join(F.broadcast(right.where(b.isin(hot))), "b"))
        pairs = pairs.where(~a.isin(hot) & ~b.isin(hot))
    right = right.join(sent(pairs.select("b").distinct()), "b", "left_semi")
    parts.append(left.join(sent(pairs), "a").join(right, "b"))
    linked = [
        both.withColumn("o", F.size(F.array_intersect("sa", "sb")))
        .where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * 80).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        for both in parts
    ]
    return linked[0] if len(linked) == 1 else linked[0].unionAll(linked[1])


def _band(n: Column) -> Column:
    """The number of a size's band."""
    return F.size(F.filter(F.array(*(F.lit(int(t)) for t in TOPS)), lambda t: t < n))


def _cross(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs(a, b) whose ends are not in one component yet."""
    a, b = (roots.withColumnsRenamed({"node": c, "root": f"r{c}"}) for c in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _prefix_pairs(some: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) out of some(k, root, n) in different components that may link.

    A prefix filter over these sets alone: sets that link share one of the
    ``n - 0.8 n + 1`` shingles of each that fewest of the sets hold, so near
    copies with too many shingles of their own pair with none.
    """
    sent = F.broadcast if rows_of(some) <= BROADCAST_ROWS else lambda df: df
    tokens = sets.select("k", F.explode("shingles").alias("t")).join(sent(some), "k")
    rare = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ordered = tokens.join(rare, "t").groupBy("k", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("by"))  # one set's shingles
    few = (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1).cast("int")
    prefix = ordered.select("k", "root", "n", F.posexplode(F.slice("by", F.lit(1), few)).alias("i", "x")).where("x.df > 1").select("k", "root", "n", "x.t", "i")
    prefix = cut(prefix, "prefix")
    other = prefix.toDF("k2", "root2", "n2", "t2", "i2")
    # the first shingle that two sets share leaves room for all they must share
    least = F.ceil(4 * (F.col("n") + F.col("n2")) / 9)
    fits = (F.col("k") < F.col("k2")) & (F.col("root") != F.col("root2")) & (F.col("n") - F.col("i") >= least) & (F.col("n2") - F.col("i2") >= least)
    return prefix.join(other, (F.col("t") == F.col("t2")) & fits).select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct()


def _collide(docs: DataFrame, rows: DataFrame, mixed: DataFrame, seed: int) -> bool:
    """Whether two different sets share one of the keys mixed(k), by the sets themselves."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for a, b in pieces(text):
                part, spelt = text.slice(a, b - a), []
                for x in _words(part):
                    w = x.split(b" ")
                    shingles = {b" ".join(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))}
                    spelt.append(hashlib.sha256(b"\n".join(sorted(shingles))).digest())
                yield pa.RecordBatch.from_arrays([pa.array(_keys(*sets_of(part, seed)).view(np.int64)), pa.array(spelt, pa.binary())], names=["k", "spelt"])

    wanted = cut(spread_join(rows.where("n > 0").select("k", "doc_id"), mixed, "k"), "mixed")
    found = _texts(docs, wanted).mapInArrow(spell, "k long, spelt binary").distinct().join(mixed, "k", "left_semi")
    return not found.groupBy("k").agg(F.count("*").alias("sets")).where("sets > 1").isEmpty()


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """(rows, classes, hot signatures, seed): every row described, and the distinct sets."""
    for seed in range(SEEDS):
        told = cut(described(docs, seed), "described")
        rows = told.where("n >= 0")
        classes = cut(
            rows.where("n > 0").groupBy("k").agg(
                F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.max("slack0").alias("slack0"), F.max("slack1").alias("slack1"),
                (F.min("d") != F.max("d")).alias("mixed"),
            ), "classes"
        )
        mixed = classes.where("mixed").select("k")
        if mixed.isEmpty() or not _collide(docs, rows, mixed, seed):
            rows.cut_path, rows.cut_rows = told.cut_path, rows_of(told)  # or less
            return rows, classes, _hot_signatures(told, rows_of(told)), seed
    raise corrupt("different sets share a key", seeds=SEEDS)


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, classes, roots, seed): every row with its set, the distinct sets, the component of those that link with others."""
    spark = docs.sparkSession
    rows, classes, hot, seed = classified(docs)
    total = classes.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 12 / (RANGE_MB << 20)) + 1)
    found = cut(_candidates(_packed(docs, ranges, hot, seed), ranges), "candidates")

    # How many large buckets each set is in, by role.
    bare = F.shiftrightunsigned("k", 17)
    large = found.where("kind = 1").select(F.col("a").alias("bucket"), F.shiftrightunsigned("b", 1).alias("bare"), F.col("b").bitwiseAND(1).alias("role"))
    held = large.groupBy("bare").agg(F.count_if(F.col("role") == 0).alias("large0"), F.count_if(F.col("role") == 1).alias("large1"))
    classes = classes.withColumn("bare", bare).join(held, "bare", "left")
    classes = cut(classes.fillna(0, ["large0", "large1"]).withColumn("band", _band(F.col("n"))), "classes")

    # Sets that link agree on more parts than the slack of either, so a pair
    # must meet in as many buckets, counting all the large ones it may share.
    named = classes.select("bare", "k", "n", "band", F.array("slack0", "slack1").alias("slack"), F.array("large0", "large1").alias("large"))
    pool = found.where("kind = 0").groupBy("a", "b").agg(F.sum("times").alias("times"))
    one, two = (named.toDF(*(f"{c}{x}" for c in named.columns)).withColumnRenamed(f"bare{x}", y) for x, y in ((1, "a"), (2, "b")))
    pool = pool.join(one, "a").join(two, "b")
    fits = (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * 80) & (F.col("k1") != F.col("k2"))
    # the set in the lower band of two met the other in its next band
    role1, role2 = (F.when(F.col(f"band{x}") < F.col(f"band{y}"), 1).otherwise(0) for x, y in ((1, 2), (2, 1)))
    need = F.greatest(F.get("slack1", role1), F.get("slack2", role2)) + 1
    may = F.col("times") + F.least(F.get("large1", role1), F.get("large2", role2))
    pool = cut(pool.where(fits & (may >= need)).select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct(), "pool")

    # Large buckets: only sets that have more of them than slack need any, and
    # of those the rarest that exceed the slack (the order is the same for all).
    slack = classes.select("bare", "k", F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("role"), F.col(f"slack{r}").alias("slack")) for r in (0, 1)))).alias("x")).select("bare", "k", "x.*")
    large = large.join(slack, ["bare", "role"])
    large = cut(large, "large")
    members = large.groupBy("bucket").agg(F.count("*").alias("members"))
    per = spread_join(large, members, "bucket").groupBy("k", "role", "slack").agg(F.sort_array(F.collect_list(F.struct("members", "bucket"))).alias("held"))
    per = per.where(F.size("held") > F.col("slack"))  # a set's own buckets: no more than its parts
    rarest = F.slice("held", F.lit(1), (F.size("held") - F.col("slack")).cast("int"))
    large = cut(per.select("k", "role", F.explode(rarest).alias("x")).select("k", "role", "x.bucket"), "large")

    wanted = pool.select(F.col("a").alias("k")).unionAll(pool.select("b")).unionAll(large.select("k")).distinct()
    wanted = cut(classes.join(wanted, "k", "left_semi").select("k", "doc_id"), "wanted")
    sets = cut(_whole_sets(docs, wanted, seed), "sets")
    sizes = sets.select("k", "n")

    # first each set with the least that it shares a bucket with, then what that leaves apart
    tested = cut(pool.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tested")
    links = cut(_verified(tested, sets), "verified")
    roots = components(links)
    rest = cut(_cross(pool.join(tested, ["a", "b"], "left_anti"), roots), "rest")
    if rows_of(rest):
        tested = tested.unionAll(rest)
        more = cut(_verified(rest, sets), "verified")
        if rows_of(more):
            links = links.unionAll(more)
            roots = components(links)

    everyone = False  # at first each with the head of its bucket, at last with all
    while rows_of(large):
        held = large.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
        held = cut(held.join(sizes, "k"), "held")
        apart = held.groupBy("bucket").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("role") == 0, F.struct("root", "k", "n"))).alias("head")
        ).where("low <> high and head is not null")
        if everyone:
            unsettled = spread_join(held, apart.select("bucket"), "bucket").select("k", "root", "n").distinct()
            pairs = _prefix_pairs(cut(unsettled, "unsettled"), sets)
        else:
            first = apart.select("bucket", F.col("head.root").alias("hroot"), F.col("head.k").alias("hk"), F.col("head.n").alias("hn"))
            meets = (F.col("root") != F.col("hroot")) & (F.least("n", "hn") * 100 >= F.greatest("n", "hn") * 80)
            pairs = spread_join(held, first, "bucket").where(meets)
            pairs = pairs.select(F.least("k", "hk").alias("a"), F.greatest("k", "hk").alias("b")).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = cut(_verified(pairs, sets), "verified")
        tested = tested.unionAll(pairs)
        if not rows_of(more):
            if everyone:
                break
            everyone = True
            continue
        links = links.unionAll(more)
        roots = components(links)
        if everyone:
            break  # all pairs of these buckets are tested
    return rows, classes, roots, seed


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, doc_id, root) of every class."""
    joined = classes.select("k", "doc_id").join(roots.withColumnRenamed("node", "k"), "k", "left")
    return cut(joined.withColumn("root", F.coalesce("root", "k")), "rooted")


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs."""
    with scratch(docs.sparkSession) as keep:
        rows, classes, roots, _ = linked_classes(docs)
        rooted = _rooted(classes, roots)
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = cut(spread_join(rooted, least, "root").select("k", "component_id"), "named")
        some = rows.where("n > 0").select("doc_id", "n", "k")
        some.cut_rows = rows_of(rows)  # or less
        out = spread_join(some, named, "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        keep(named)
        keep(rows)
    return out.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id")))


def _keyed(docs: DataFrame, names: list[str], seed: int = 0) -> DataFrame:
    """docs under the given names with the key of each row's set as last column."""
    out = docs.toDF(*names)
    at = names.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            keys = [_keys(*sets_of(text.slice(a, b - a), seed)).view(np.int64) for a, b in pieces(text)]
            k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], names=[*batch.schema.names, "k"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(add, f"{kept}, k long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id (null comes last).

    Of several such rows one stays. Rows without words all stay.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows, classes, roots, seed = linked_classes(docs)
        ids = cut(rows.where("n > 0").groupBy("doc_id", "k").agg(F.count("*").alias("times")), "ids")
        held = cut(spread_join(ids, _rooted(classes, roots).select("k", "root"), "k"), "held")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
        stays = held.groupBy("root").agg(F.min(order).alias("s")).select(F.col("s.doc_id").alias("sid"), F.col("s.k").alias("sk"), F.lit(True).alias("stays"))
        marked = held.join(stays, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("k") == F.col("sk")), "left").fillna(False, ["stays"])
        gone = keep(cut(marked.where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "stays"), "gone"))
        single = rows.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").isEmpty()
    bound = F.broadcast(gone) if rows_of(gone) <= BROADCAST_ROWS else gone
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    if single:  # a doc_id names its row, so texts need not be looked at again
        return docs.join(bound, mine, "left_anti")
    names = [{"text": "text", "doc_id": "doc_id"}.get(c, f"_{i}") for i, c in enumerate(docs.columns)]
    found = _keyed(docs, names, seed).join(bound, mine & (F.col("k") == F.col("_k")), "left")
    once = found.where("stays is null").select(*names)
    repeated = found.where("stays").dropDuplicates(["doc_id", "k"]).select(*names)
    return once.unionAll(repeated).toDF(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
