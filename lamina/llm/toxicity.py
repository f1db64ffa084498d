"""Operator 5: toxicity by a linear classifier on character n-grams.

Features are the n-grams (3 to 5 code points of lower-cased text, all but
letters and digits as one blank) of a text, hashed to ``BITS`` bits; a value is
the n-gram's count over the text's length, so a long text is not toxic for one
chance hit. As in naive Bayes support vector machines each feature is scaled by
its log-count ratio between the classes; logistic regression is then trained on
the scaled features. A score is the logistic function of the sum.

Learning uses at most ``SAMPLE`` labelled rows (those with the least hashes of
doc_id; the bound is a parameter) out of those whose hash remainder is not 0.
Their n-grams are made and counted in Spark. Of those that ``LEAST_TEXTS`` or
more of the texts have, one task fits the weights of the ``FEATURES`` with the
greatest log-count ratios (both are parameters of the fit). Scoring is one map-only pass over whole
texts with a table of weights of a fixed size.

Defined results: null and empty texts get the score of a text without features;
without labels of both kinds every score is the share of toxic labels (0 without
any); null labels and null doc_ids are not learned from; a null doc_id keeps
its row and counts as not held out; repeated rows stay; an empty table gives no
rows; other columns are ignored. A text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.langid import _fold, held_out
from lamina.llm.storage import cut, scratch, table
from lamina.llm.vectors import code_points, mix, pieces

SHORTEST, LONGEST, BITS = 3, 5, 22
SAMPLE, FEATURES, LEAST_TEXTS = 20_000, 40_000, 3
#: Labelled texts that one task counts.
TEXTS = 1250
SCALE, SMOOTH, PENALTY, STEPS = 50.0, 0.2, 1e-3, 400


@dataclass
class Model:
    keys: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    bias: float


def features(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each n-gram of each row, repeats included."""
    lower, letter = _fold()
    rows = len(offsets) - 1
    # a blank before and after each row
    text = np.ones(len(points) + 2 * rows, dtype=np.uint64)
    doc = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    known = letter[points] | ((points >= 48) & (points < 58))
    text[np.arange(len(points)) + 2 * np.repeat(np.arange(rows), np.diff(offsets)) + 1] = np.where(known, lower[points] + 2, 1)
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != 1) | (text[:-1] != 1) | (doc[1:] != doc[:-1])
    text, doc = mix(text[keep]), doc[keep]
    out_row, out_key = [], []
    with np.errstate(over="ignore"):
        key = np.zeros(len(text), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            m = len(text) - n + 1
            if m <= 0:
                break
            key = key[:m] * np.uint64(0x9E3779B97F4A7C15) + text[n - 1 :]
            if n >= SHORTEST:
                ok = doc[:m] == doc[n - 1 :]
                out_row.append(doc[:m][ok])
                out_key.append((mix(key[ok] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_key)


def rates(points: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, rate): the distinct features of each row, or those wanted, by their share."""
    row, key = features(points, offsets)
    length = np.maximum(np.diff(offsets), 1)
    if wanted is not None:
        hit = wanted[key]
        row, key = row[hit], key[hit]
    both, count = np.unique(row << BITS | key, return_counts=True)
    row = both >> BITS
    return row, both & ((1 << BITS) - 1), count / length[row]


def _fit(keys: list[np.ndarray], values: list[np.ndarray], toxic: np.ndarray, usable: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of usable, bias) for texts given as features out of usable and their rates."""
    row = np.repeat(np.arange(len(keys)), [len(t) for t in keys])
    col, value = np.searchsorted(usable, np.concatenate(keys)), np.concatenate(values) * SCALE
    # full-batch Adam on the penalised logistic loss, classes weighted alike
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    scaled = value * ratio[col]
    # the same numbers by column, so that both sums of a step run over neighbours
    order = np.argsort(col, kind="stable")
    by_row, by_col = np.flatnonzero(np.diff(row, prepend=-1)), np.flatnonzero(np.diff(col[order], prepend=-1))
    rows, cols = row[by_row], col[order][by_col]
    row_of, scaled_of, part = row[order], scaled[order], np.empty(len(col))
    z_of, gw_of = np.zeros(len(keys)), np.zeros(len(usable))
    w, b = np.full(len(usable), 0.1), -1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        np.multiply(np.take(w, col, out=part, mode="clip"), scaled, out=part)
        z_of[rows] = np.add.reduceat(part, by_row)
        z = z_of + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        np.multiply(np.take(g, row_of, out=part, mode="clip"), scaled_of, out=part)
        gw_of[cols] = np.add.reduceat(part, by_col)
        gw = gw_of + PENALTY * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.01 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= 0.03 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w * ratio * SCALE, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.where(F.col("_toxic").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % 5 != 0))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # ``sample`` rows of two numbers; a doc_id with several texts counts with the least
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = cut(rows.groupBy("_id", "_toxic").agg(F.min("text").alias("text")).repartition(1 + sample // TEXTS, "_id"), "labelled")
    shares = rows.agg(F.count("*"), F.sum("_toxic")).first()
    bad, good = shares[1] or 0, shares[0] - (shares[1] or 0)
    if not bad or not good:
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if bad else -30.0)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, 1 << BITS), dtype=np.float32), np.zeros(1 << BITS, dtype=np.int32)
        for batch in batches:
            text, toxic = batch.column(2), batch.column(1).to_numpy()
            for a, b in pieces(text):
                row, key, value = rates(*code_points(text.slice(a, b - a)))
                of = toxic[a:b][row]
                for c in (0, 1):
                    np.add.at(total[c], key[of == c], value[of == c].astype(np.float32))
                np.add.at(seen, key, 1)
        key = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.astype(np.int32)), pa.array(total[0, key]), pa.array(total[1, key]), pa.array(seen[key])], names=["key", "good", "bad", "n"]
        )

    # the log-count ratio, over mean rates in the texts of a class
    sums = rows.mapInArrow(add_up, "key int, good float, bad float, n int").groupBy("key").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("n").alias("n")
    ).where(F.col("n") >= LEAST_TEXTS)
    ratio = F.log((SMOOTH + F.col("bad") * SCALE) / bad) - F.log((SMOOTH * good / bad + F.col("good") * SCALE) / good)
    best = sums.select("key", ratio.alias("ratio")).orderBy(F.desc(F.abs("ratio")), "key").limit(FEATURES).collect()
    best.sort(key=lambda r: r.key)
    usable, ratios = np.array([r.key for r in best], dtype=np.int64), np.array([r.ratio for r in best])
    if not len(usable):
        return Model(usable, ratios, float(np.log(bad / good)))
    wanted = np.zeros(1 << BITS, dtype=bool)
    wanted[usable] = True

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for a, b in pieces(text):
                row, key, value = rates(*code_points(text.slice(a, b - a)), wanted)
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(key.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))],
                    names=["id", "toxic", "keys", "rates"],
                )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        keys, values = ([np.asarray(x, dtype=kind) for x in pdf[c]] for c, kind in (("keys", np.int64), ("rates", float)))
        weights, bias = _fit(keys, values, pdf["toxic"].to_numpy(), usable, ratios)
        return pd.DataFrame({"weights": [weights], "bias": [bias]})

    # the bounded sample is one group
    made = rows.mapInArrow(make, "id long, toxic int, keys array<int>, rates array<float>").withColumn("all", F.lit(0))
    got = made.groupBy("all").applyInPandas(fit, "weights array<double>, bias double").first()
    return Model(usable, np.asarray(got["weights"]), float(got["bias"]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs."""
    weights, filter_ = model.weights, np.zeros(1 << BITS, dtype=bool)
    filter_[model.keys] = True

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for a, b in pieces(text):
                row, key, value = rates(*code_points(text.slice(a, b - a)), filter_)
                z = model.bias + np.bincount(row, weights=value * weights[np.searchsorted(model.keys, key)], minlength=b - a)
                value = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(value)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
        out = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
        return keep(cut(out, "scores"))
