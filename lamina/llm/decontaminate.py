"""Operator 7: benchmark decontamination by CGK embedding and bit sampling.

A document is contaminated by an item if some run of its words is within
``RATIO`` times the item's length of it in edit distance over words (ASCII
punctuation and case do not count). Steps, all inside one map-only pass:

1. Windows as long as each item size, at every word. A count filter drops those
   that cannot match: ``k`` edits leave at least ``n - 1 - 2k`` of an item's
   word pairs, so a window with fewer pairs of the benchmark holds no match.
   This loses nothing.
2. The CGK random walk embeds window and item: at each step it copies the word
   under a pointer, and a random bit of (step, word) says whether the pointer
   moves. Edit distance becomes Hamming distance of the walks.
3. Bit sampling: the words at a few random steps are a bucket key. Window and
   item with equal keys in any of many repeats are candidates. The number of
   repeats is set for each item size so that items with the most edits allowed
   are found with probability ``RECALL`` (measured on edited copies of items of
   that size). Where ``MOST_REPEATS`` do not reach that, all windows that pass
   the count filter are verified against all items of the size.
4. Candidates are verified by exact edit distance (bit-parallel, approximate
   string search of the item in the words around the window).

The benchmark travels to the tasks in slices of at most ``SLICE_MB`` of text;
each slice is one pass over the documents, so nothing that is broadcast grows
beyond that bound. Texts never move between tasks.

Defined results: null and empty texts match nothing, and neither do items of
fewer than ``MIN_WORDS`` words (too short to be a passage; a parameter of this
module); of several matches of one item in a document
the least distance and then the first place counts; a null doc_id or item_id
is carried; repeated rows are matched each; an empty table or benchmark gives
no matches; other columns are ignored (or kept, by ``clean``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.storage import cut, scratch, table
from lamina.llm.vectors import NOT_ALNUM, Words, mix, pieces, text_bytes

RATIO, MIN_WORDS = 0.2, 5
RECALL, SAMPLES, MOST_REPEATS, SEED = 0.99, 3, 256, 7
SLICE_MB = 16
#: Edited items of a size, and repeats, by which the rate of collisions is measured.
TRIALS = 64
#: Windows embedded at a time.
WINDOWS = 1 << 13


@dataclass
class Index:
    """The items of one slice and the tables that the tasks search."""

    ids: list  # item_id of each item
    words: list[np.ndarray]  # word hashes of each item
    sizes: np.ndarray  # distinct item sizes
    vocabulary: np.ndarray
    pairs: np.ndarray  # sorted codes of the items' word pairs
    pair_first: np.ndarray  # pair i occurs in items of the sizes
    pair_sizes: np.ndarray  # sizes[pair_sizes[pair_first[i] : pair_first[i + 1]]]
    repeats: dict[int, int]  # of each size; 0 where windows are compared with all items of the size
    buckets: dict[int, tuple[np.ndarray, np.ndarray]]  # size -> sorted keys, items


def edits(n: int | np.ndarray, ratio: float = RATIO):
    return np.floor(np.asarray(n) * ratio + 1e-9).astype(np.int64)


def words_of(text: pa.Array) -> Words:
    return Words(*text_bytes(text), parts=NOT_ALNUM)


def keys(windows: np.ndarray, repeats: int, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """(windows, repeats) bucket keys of (windows, n) word hashes."""
    count, n = windows.shape
    rng = np.random.default_rng(seed)
    steps = (rng.random((repeats, samples)) * 2 * n).astype(np.int64)
    salt = mix(np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    padded = np.concatenate((windows, np.zeros((count, 1), np.uint64)), axis=1)
    at = np.zeros((count, repeats), dtype=np.int64)
    out = np.zeros((count, repeats), dtype=np.uint64)
    rows = np.arange(count)[:, None]
    with np.errstate(over="ignore"):
        for step in range(int(steps.max(initial=-1)) + 1):
            word = padded[rows, at]
            for s in range(samples):
                here = steps[:, s] == step
                if here.any():
                    out[:, here] += mix(word[:, here] + np.uint64(s + 1))
            bit = (word ^ salt) * np.uint64(0xFF51AFD7ED558CCD) * np.uint64(2 * step + 1)
            at = np.minimum(at + ((bit >> np.uint64(47)) & np.uint64(1)).astype(np.int64), n)
        return mix(out + salt)


def _edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``words`` after k random edits, cut or filled to the same length."""
    out = list(words)
    for _ in range(k):
        i, what = int(rng.integers(len(out))), int(rng.integers(3))
        new = np.uint64(rng.integers(1 << 63))
        if what == 0:
            out[i] = new
        elif what == 1 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, new)
    out += [np.uint64(rng.integers(1 << 63)) for _ in range(len(words) - len(out))]
    return np.array(out[: len(words)], dtype=np.uint64)


def repeats_for(items: list[np.ndarray], recall: float, ratio: float) -> int:
    """Repeats that find items (of one size) with the most edits with probability ``recall``; 0 if ``MOST_REPEATS`` do not."""
    rng = np.random.default_rng(SEED)
    some = np.stack((items * -(-TRIALS // len(items)))[: max(TRIALS, min(len(items), 4 * TRIALS))])
    worst = np.stack([_edited(words, int(edits(len(words), ratio)), rng) for words in some])
    rates = (keys(some, TRIALS) == keys(worst, TRIALS)).mean(axis=1)
    for r in range(1, MOST_REPEATS + 1):
        if 1 - np.mean((1 - rates) ** r) >= recall:
            return r
    return 0


def build(rows: list, ratio: float = RATIO, recall: float = RECALL) -> Index:
    """rows: (item_id, text) of a slice."""
    w = words_of(pa.array([r[1] for r in rows], pa.string()))
    found = [(r[0], w.hash[w.first[i] : w.first[i + 1]]) for i, r in enumerate(rows) if w.count[i] >= MIN_WORDS]
    items = [x[1] for x in found]
    vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
    codes = [np.searchsorted(vocabulary, x) for x in items]
    sizes = np.unique([len(x) for x in items]).astype(np.int64)
    both = [(c[:-1] * (len(vocabulary) + 1) + c[1:]) * (len(sizes) + 1) + np.searchsorted(sizes, len(c)) for c in codes]
    pair, pair_sizes = np.divmod(np.unique(np.concatenate(both)) if items else np.zeros(0, np.int64), len(sizes) + 1)
    pairs, pair_first = np.unique(pair, return_index=True)
    pair_first = np.append(pair_first, len(pair))
    buckets, repeats = {}, {}
    for n in sorted({len(x) for x in items}):
        own = [i for i, x in enumerate(items) if len(x) == n]
        repeats[n] = repeats_for([items[i] for i in own], recall, ratio)
        if not repeats[n]:
            buckets[n] = np.zeros(0, np.uint64), np.array(own)
            continue
        k = keys(np.stack([items[i] for i in own]), repeats[n])
        flat, item = k.ravel(), np.repeat(own, repeats[n])
        order = np.argsort(flat, kind="stable")
        buckets[n] = flat[order], item[order]
    return Index([x[0] for x in found], items, sizes, vocabulary, pairs, pair_first, pair_sizes, repeats, buckets)


def search(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of ``text`` closest to ``item``; the first of equals."""

    def ends(pattern: np.ndarray, words: np.ndarray, free: bool) -> list[int]:
        # Myers' bit-parallel dynamic programme, one bit for each pattern word
        m = len(pattern)
        masks: dict[int, int] = {}
        for i, x in enumerate(pattern.tolist()):
            masks[x] = masks.get(x, 0) | 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, out = full, 0, m, []
        for x in words.tolist():
            eq = masks.get(x, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(xh | plus) & full, plus & xh
            score += bool(up & top) - bool(down & top)
            up, down = (up << 1 | (not free)) & full, down << 1 & full
            plus, minus = down | ~(xv | up) & full, up & xv
            out.append(score)
        return out

    forth = ends(item, text, True)
    distance = min(forth)
    end = forth.index(distance) + 1
    back = ends(item[::-1], text[:end][::-1], False)
    start = end - 1 - back.index(distance) if distance in back else end
    return distance, start, end


def matches(text: pa.Array, index: Index, ratio: float = RATIO) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, word behind) of a batch, best of each row and item."""
    if not index.ids:
        return []
    sizes, most = index.sizes, edits(index.sizes, ratio)
    need, reach = np.maximum(sizes - 1 - 2 * most, 1), sizes + most
    base = len(index.vocabulary) + 1
    held: dict[int, list] = {int(n): [] for n in sizes}  # size -> (row, word number, window)
    rows: dict[int, np.ndarray] = {}
    found: dict[tuple[int, int], list[int]] = {}

    def flush(n: int) -> None:
        part, held[n] = held[n], []
        if not part:
            return
        bucket, item = index.buckets[n]
        if not index.repeats[n]:  # exact: every window that passed the count filter with every item
            for row, at, _ in part:
                for i in item.tolist():
                    found.setdefault((row, i), []).append(at)
            return
        for a in range(0, len(part), WINDOWS):
            some = part[a : a + WINDOWS]
            got = keys(np.stack([x[2] for x in some]), index.repeats[n])
            lo, hi = np.searchsorted(bucket, got.ravel(), "left"), np.searchsorted(bucket, got.ravel(), "right")
            for hit in np.flatnonzero(hi > lo):
                row, at, _ = some[hit // index.repeats[n]]
                for i in set(item[lo[hit] : hi[hit]].tolist()):
                    found.setdefault((row, i), []).append(at)

    for a, b in pieces(text):
        w = words_of(text.slice(a, b - a))
        h = w.hash
        if not len(h):
            continue
        code = np.searchsorted(index.vocabulary, h)
        code = np.where(index.vocabulary[np.minimum(code, base - 2)] == h, code, base - 1)
        pair = code[:-1] * base + code[1:]
        at = np.minimum(np.searchsorted(index.pairs, pair), len(index.pairs) - 1)
        hit = np.flatnonzero((index.pairs[at] == pair) & (w.doc[:-1] == w.doc[1:]))
        # one entry for each hit and each size of an item that has the pair
        lo, many = index.pair_first[at[hit]], np.diff(index.pair_first)[at[hit]]
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        size, place = index.pair_sizes[entry], np.repeat(hit, many)
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], np.arange(len(sizes) + 1))
        for c, (n, k, few, far) in enumerate(zip(sizes.tolist(), most.tolist(), need.tolist(), reach.tolist(), strict=True)):
            x = place[order[bounds[c] : bounds[c + 1]]]
            y, x = x[few - 1 :], x[: max(0, len(x) - few + 1)]
            near = (y - x <= far - 2) & (w.doc[x] == w.doc[y])
            x, y = x[near], y[near]
            # a window that holds the pairs x to y begins from y + 2 - far to x
            first = np.maximum(y + 2 - far, w.first[w.doc[x]])
            first[1:] = np.maximum(first[1:], x[:-1] + 1)
            wide = np.maximum(x - first + 1, 0)
            p = np.repeat(first - np.concatenate(([0], np.cumsum(wide)[:-1])), wide) + np.arange(wide.sum())
            stop = w.first[w.doc[p] + 1]
            ok = p + n - k <= stop
            for x, last in zip(p[ok].tolist(), stop[ok].tolist(), strict=True):
                row, window = int(w.doc[x]), h[x : min(x + n, last)]
                if len(window) < n:
                    window = np.concatenate((window, np.zeros(n - len(window), np.uint64)))
                row += a
                if row not in rows:
                    rows[row] = h[w.first[row - a] : w.first[row - a + 1]].copy()
                held[n].append((row, x - int(w.first[row - a]), window))
        for n in held:
            if len(held[n]) >= WINDOWS:
                flush(n)
    for n in held:
        flush(n)
    out = []
    for (row, i), at in sorted(found.items()):
        item, words, best = index.words[i], rows[row], None
        n, k = len(item), int(edits(len(item), ratio))
        spans: list[list[int]] = []
        for p in sorted(set(at)):  # windows close together are searched as one
            lo, hi = max(0, p - k), min(len(words), p + n + 2 * k)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            d, s, e = search(item, words[lo:hi])
            if d <= k and (best is None or d < best[0]):
                best = (d, lo + s, lo + e)
        if best:
            out.append((row, i, *best))
    return out


def slices(benchmark: DataFrame, mb: int = SLICE_MB) -> Iterator[list]:
    """(item_id, text) of the benchmark in lists of about ``mb`` MB of text at most."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * size // (mb << 20)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, distance, similarity, start_word, end_word), a row for each document row and item."""
    item_type = "long" if benchmark.schema["item_id"].dataType.simpleString() in ("bigint", "int") else "string"
    benchmark = benchmark.withColumn("item_id", F.col("item_id").cast(item_type))
    parts = None
    for rows in slices(benchmark):
        index = build(rows, ratio, recall)

        def find(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = matches(batch.column(1), index, ratio)
                if got:
                    row, item, distance, start, end = (np.array(x) for x in zip(*got, strict=True))
                    size = np.array([len(index.words[i]) for i in item])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item], schema.field(1).type),
                         pa.array(distance.astype(np.int64)), pa.array(1 - distance / size), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))],
                        names=schema.names,
                    )

        schema = pa.schema([
            ("doc_id", pa.int64()), ("item_id", pa.int64() if item_type == "long" else pa.string()), ("distance", pa.int64()),
            ("similarity", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64()),
        ])
        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            find, f"doc_id long, item_id {item_type}, distance long, similarity double, start_word long, end_word long"
        )
        parts = part if parts is None else parts.unionAll(part)
    return parts


def clean(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, recall: float = RECALL) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    inner = [f"_{i}" if c != "text" else c for i, c in enumerate(docs.columns)]
    out = docs.toDF(*inner)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for rows in slices(benchmark):
        index = build(rows, ratio, recall)
        at = inner.index("text")

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {m[0] for m in matches(batch.column(at), index, ratio)}
                yield batch.filter(pa.array([i not in bad for i in range(len(batch))], pa.bool_()))

        out = out.mapInArrow(keep, kept)
    return out.toDF(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(cut(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "matches"))
