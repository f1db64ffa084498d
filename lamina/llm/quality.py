"""Operator 3: quality rules with an isolation forest on rule statistics.

One map-only pass computes counts and shares for every whole text (words,
symbols, repeated lines, repeated word windows, cases, marks, lengths). The
base rules reject short and repetitive texts. The method's verdict comes from
an isolation forest on the statistics: random splits isolate odd documents in
few steps, so a short mean path is a high anomaly score. The threshold on that
score is calibrated from labelled rows: among thresholds that reject at most
``FALSE_REJECTS`` of the good ones it is the one that rejects most bad ones
(rows that the base rules fail take no part).

The forest is grown from a bounded sample, ``TREES * SUBSAMPLE`` documents at
most (those with the least hashes), each tree in a task of its own. Labels are
joined with the statistics, not with texts, and are summed into ``BINS`` score
bins before the driver sees them; every labelled row counts.

Defined results: null and empty texts have no words, so the base rules fail
them; without documents to grow trees, or without labels of both kinds, the
method rejects nothing; null labels are ignored; a doc_id with several labels
counts with each; a null doc_id keeps its row; repeated rows stay; an empty
table gives no rows; other columns are ignored. A text of any length is counted
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.storage import cut, scratch, table
from lamina.llm.vectors import SPACE, Words, pieces, row_sums, span_hash, text_bytes, windows

TREES, SUBSAMPLE, SEED = 100, 256, 11
FALSE_REJECTS, BINS = 0.002, 2000
MIN_WORDS, WINDOW = 50, 3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "line_words", "distinct_share"]


def statistics(text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the (rows, features) matrix of a piece of texts."""
    raw, offsets = text_bytes(text)
    rows = len(offsets) - 1
    byte_row = np.repeat(np.arange(rows), np.diff(offsets))
    per = lambda mask: np.bincount(byte_row[mask], minlength=rows).astype(np.int64)
    w = Words(raw, offsets, lower=False)
    n = w.count.astype(np.int64)
    chars = per(~SPACE[raw] & ((raw & 0xC0) != 0x80))
    symbols = per(_SYMBOL[raw])

    # lines: between row starts and \n; those with a word that repeat an earlier one
    feeds = np.flatnonzero(raw == 10)
    start = np.union1d(offsets[:-1][np.diff(offsets) > 0], feeds[feeds + 1 < len(raw)] + 1).astype(np.int64)
    end = np.minimum(np.searchsorted(feeds, start, side="left"), max(len(feeds) - 1, 0))
    line_row = np.searchsorted(offsets, start, side="right") - 1
    stop = offsets[line_row + 1] if len(start) else start
    if len(feeds):
        at = feeds[end]
        stop = np.where((at >= start) & (at < stop), at, stop)
    wordy = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop, line_row = start[wordy], stop[wordy], line_row[wordy]
    h = span_hash(raw, start, stop)
    order = np.lexsort((h, line_row))
    same = (line_row[order][1:] == line_row[order][:-1]) & (h[order][1:] == h[order][:-1])
    dup = np.bincount(line_row[order][1:][same], minlength=rows).astype(np.int64)
    lines = np.bincount(line_row, minlength=rows)

    # words in a window that occurs twice or more in its text
    repeat = np.zeros(rows, dtype=np.int64)
    row, value = windows(w, WINDOW)
    if len(row):
        order = np.lexsort((value, row))
        r, v = row[order], value[order]
        eq = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
        twice = np.zeros(len(r), dtype=bool)
        twice[1:] |= eq
        twice[:-1] |= eq
        whole = np.flatnonzero(w.doc[: len(w.doc) - WINDOW + 1] == w.doc[WINDOW - 1 :])  # the window's first word
        first = whole[order[twice]]
        covered = np.zeros(len(w.doc) + 1, dtype=bool)
        for k in range(WINDOW):
            covered[first + k] = True
        repeat = row_sums(covered[:-1], w.doc, rows)
    pairs = np.lexsort((w.hash, w.doc))
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = (w.doc[pairs][1:] != w.doc[pairs][:-1]) | (w.hash[pairs][1:] != w.hash[pairs][:-1])
    distinct = row_sums(new, w.doc[pairs], rows)

    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    features = np.stack([
        chars / words, symbols / letters, dup / np.maximum(lines, 1), repeat / words, per(_UPPER[raw]) / letters,
        per(_MARK[raw]) / letters, np.log1p(n / np.maximum(lines, 1)), distinct / words / np.sqrt(1 / words + 0.02),
    ], axis=1) if rows else np.zeros((0, len(FEATURES)))
    return dict(zip(COUNTS, (n, chars, symbols, dup, repeat), strict=True)), features


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, features array) of each row of docs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for a, b in pieces(text):
                counts, features = statistics(text.slice(a, b - a))
                ends = np.arange(0, features.size + 1, features.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(counts[c]) for c in COUNTS), pa.ListArray.from_arrays(pa.array(ends), pa.array(features.ravel()))],
                    names=["doc_id", *COUNTS, "features"],
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, schema)


def grow(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A tree as rows (feature, split, left, right, path length); feature -1 is a leaf."""
    deepest = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list[float]] = []

    def add(own: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + _unseen(len(own))])
        low, high = own.min(axis=0), own.max(axis=0)
        able = np.flatnonzero(high > low)
        if depth < deepest and len(own) > 1 and len(able):
            f = int(rng.choice(able))
            split = rng.uniform(low[f], high[f])
            left = own[:, f] < split
            if left.any() and not left.all():
                nodes[me][:4] = [f, split, add(own[left], depth + 1), add(own[~left], depth + 1)]
        return me

    add(points, 0)
    return np.array(nodes, dtype=float)


def _unseen(n: int) -> float:
    """The mean path in a random search tree of n points: what a leaf leaves out."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def forest(stats: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> list[np.ndarray]:
    """Trees over at most trees * subsample rows of stats(doc_id, features)."""
    hashed = stats.select(F.xxhash64("doc_id", "features", F.lit(seed)).alias("h"), "features")
    most = trees * subsample
    edge = hashed.select("h").orderBy("h").limit(most + 1).agg(F.max("h"), F.count("h")).first()
    if not edge[1]:
        return []
    sample = hashed.where(F.col("h") < edge[0]) if edge[1] > most else hashed
    if sample.isEmpty():  # all rows are alike
        return []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("h", kind="stable")
        points = np.stack(pdf["features"].to_numpy())[:subsample]
        nodes = grow(points, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "size": [len(points)], "nodes": [nodes.ravel().tolist()]})

    dealt = sample.withColumn("tree", F.pmod(F.xxhash64("h"), F.lit(trees)).cast("int"))
    rows = dealt.groupBy("tree").applyInPandas(one, "tree int, size int, nodes array<double>").collect()  # ``trees`` rows
    return [np.array([r.size, *r.nodes]) for r in sorted(rows, key=lambda r: r.tree)]


def anomaly(points: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    """0 to 1, near 1 if isolated in few splits."""
    if not trees or not len(points):
        return np.zeros(len(points))
    total, norm = np.zeros(len(points)), 0.0
    for tree in trees:
        size, nodes = int(tree[0]), tree[1:].reshape(-1, 5)
        feature, left, right = nodes[:, 0].astype(int), nodes[:, 2].astype(int), nodes[:, 3].astype(int)
        at = np.zeros(len(points), dtype=int)
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            node = at[live]
            low = points[live, feature[node]] < nodes[node, 1]
            at[live] = np.where(low, left[node], right[node])
            live = live[feature[at[live]] >= 0]
        total += nodes[at, 4]
        norm += max(_unseen(size), 1e-9)
    return 2.0 ** (-total / norm)


def calibrated(scored: DataFrame, labels: DataFrame, most: float = FALSE_REJECTS, bins: int = BINS) -> float:
    """The threshold above which a score means rejection; over 1 if nothing can be learned."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_good")).where(F.col("_good").isNotNull())
    both = scored.join(known, F.col("doc_id") == F.col("_id")).withColumn("bin", F.floor(F.col("anomaly") * bins).cast("int"))
    rows = both.groupBy("bin").agg(F.sum(F.when(F.col("_good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_good") == 0, 1).otherwise(0)).alias("bad")).collect()
    good, bad = np.zeros(bins + 2), np.zeros(bins + 2)
    for r in rows:
        good[r.bin], bad[r.bin] = r.good, r.bad
    if not good.sum() or not bad.sum():
        return 2.0
    # rejected when the threshold is the lower edge of bin i
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    able = np.flatnonzero((lost <= most * good.sum()) & (caught > 0))
    if not len(able):
        return 2.0
    best = able[caught[able] == caught[able].max()]
    return float(best[-1]) / bins


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, anomaly) of each row of docs."""
    stats = cut(measured(docs), "statistics")
    trees = forest(stats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False)
            points = flat.reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(anomaly(points, trees))], names=[*batch.schema.names[:-1], "anomaly"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double"
    scored = cut(stats.mapInArrow(score, schema), "scored")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    edge = calibrated(scored.where(~failed), labels)  # the verdict is asked for where the base rules pass
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("anomaly") < edge)).alias("kept"), "anomaly")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(cut(judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "judged"))
