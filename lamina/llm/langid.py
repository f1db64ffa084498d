"""Operator 2: language identification by rank-order profiles.

Every language has a profile: its ``TOP`` most frequent character n-grams
(1 to 3 code points of lower-cased words, with a blank at either word end) in
order of rank. A document's own most frequent n-grams are ranked alike, and the
out-of-place distance to a profile is the sum, over the document's n-grams, of
how far their ranks differ, with ``TOP`` for n-grams that the profile lacks.
The nearest profile wins; equal distances go to the first name.

Learning: at most ``SAMPLE`` documents of each language (those with the least
hash of doc_id) out of the rows with a language and a hash remainder that is
not 0; this bound is a parameter. Their n-grams are counted in Spark, and the
driver holds ``TOP`` n-grams of each language. Prediction is one map-only pass
over whole texts.

Defined results: a text that is null or has no letter gives ``und`` with score
0, and so does every text if nothing can be learned; a null doc_id keeps its
row, counts as not held out and is not learned from; repeated rows stay; an
empty table gives no rows; other columns are ignored. A text of any length is
ranked whole, in one task, with memory that follows its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.storage import cut, scratch, table
from lamina.llm.vectors import code_points, pieces

TOP, LONGEST, SAMPLE = 300, 3, 1000  # LONGEST is 3 at most
#: Below this score no profile fits; the pipeline rejects such documents.
MIN_SCORE = 0.2
#: Bits of a character in an n-gram's key, so 3 fit; letters are their code
#: point + 2 and a blank is 1, so keys of different lengths differ.
_BITS, _BLANK = 21, np.uint64(1)

_tables: dict = {}


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, and whether it is a letter."""
    if not _tables:
        letter = np.zeros(0x110000, dtype=bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for p in range(0x110000):
            c = chr(p)
            if c.isalpha():
                letter[p] = True
                if len(c.lower()) == 1:
                    lower[p] = ord(c.lower())
        _tables["fold"] = lower, letter
    return _tables["fold"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def grams(points: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the n-grams of each length; all else than letters is one blank."""
    lower, letter = _fold()
    rows = len(offsets) - 1
    # a blank before, between and after the rows
    doc = np.repeat(np.arange(rows), np.diff(offsets) + 1)
    text = np.ones(len(points) + rows, dtype=np.uint64)
    if len(points):
        safe = np.minimum(points, 0x10FFFF)
        text[np.arange(len(points)) + np.repeat(np.arange(rows), np.diff(offsets))] = np.where(letter[safe], lower[safe] + 2, 1)
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != _BLANK) | (text[:-1] != _BLANK)
    text, doc = text[keep], doc[keep]
    text, doc = np.concatenate(([_BLANK], text)), np.concatenate((doc[:1], doc))
    # a blank between rows ends the one before; it also opens the one behind
    key = np.zeros(len(text), dtype=np.uint64)
    for n in range(1, longest + 1):
        m = len(text) - n + 1
        if m <= 0:
            return
        key = (key[:m] << np.uint64(_BITS)) | text[n - 1 :]
        of = doc[n - 1 :]
        inner = np.ones(m, dtype=bool)
        for k in range(1, n - 1):  # blanks stand at the ends alone
            inner &= text[k : k + m] != _BLANK
        if n == 2:
            inner &= (text[:m] != _BLANK) | (text[1:] != _BLANK)
        ok = inner & ((of == doc[:m]) | (text[:m] == _BLANK)) if n > 1 else text != _BLANK
        yield of[ok], key[ok]


def counted(points: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count), sorted by row, then falling count, then key."""
    out = []
    for row, key in grams(points, offsets, longest):
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        out.append((row[at], key[at], np.diff(np.append(at, len(row)))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, key, count = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((key, -count, row))
    return row[order], key[order], count[order]


def _ranked(row: np.ndarray) -> np.ndarray:
    first = np.searchsorted(row, row, side="left")
    return np.arange(len(row)) - first


def profiles(docs: DataFrame, top: int = TOP, sample: int = SAMPLE, longest: int = LONGEST) -> dict[str, np.ndarray]:
    """language -> keys in order of rank, from rows that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    # hashes are spread evenly over the doc_ids, so those below twice the share
    # that is wanted hold the least ``sample``; only they are dealt by language
    total = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("total")).select(F.col("lang").alias("_lang"), "total")
    h, edge = F.xxhash64("doc_id"), 2.0**64 * (2.0 * sample + 100) / F.col("total") - 2.0**63
    # sent: a row for each language, of which the driver holds the profiles too;
    # a planned merge join would deal all rows by language before it is dropped
    near = usable.select("lang", "doc_id").join(F.broadcast(total), F.col("lang") == F.col("_lang")).where(h.cast("double") <= edge)
    pick = Window.partitionBy("lang").orderBy(h, "doc_id")
    ids = near.select("lang", "doc_id").distinct().withColumn("n", F.row_number().over(pick)).where(F.col("n") <= sample)
    ids = ids.select("doc_id").distinct()  # ``sample`` for each language at most
    learned = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, text = batch.column(0).to_pylist(), batch.column(1)
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs], dtype=np.int64)
            for a, b in pieces(text):
                row, key, n = counted(*code_points(text.slice(a, b - a)), longest)
                of = index[a:b][row]
                order = np.lexsort((key, of))
                of, key, n = of[order], key[order], n[order]
                new = np.ones(len(of), dtype=bool)
                new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(new)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in of[at]], pa.string()), pa.array(key[at].view(np.int64)), pa.array(np.add.reduceat(n, at))],
                        names=["lang", "key", "n"],
                    )

    counts = learned.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.key)
    return {k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in out.items()}


def distances(points: np.ndarray, offsets: np.ndarray, known: list[np.ndarray], top: int = TOP, longest: int = LONGEST) -> np.ndarray:
    """(rows, profiles) out-of-place distances over their greatest; nan without letters."""
    rows = len(offsets) - 1
    row, key, _ = counted(points, offsets, longest)
    rank = _ranked(row)
    row, key, rank = row[rank < top], key[rank < top], rank[rank < top]
    n = np.bincount(row, minlength=rows).astype(float)
    out = np.full((rows, len(known)), np.nan)
    for j, profile in enumerate(known):
        order = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile[order], key), len(profile) - 1)
        there = profile[order][at] == key
        away = np.where(there, np.abs(rank - order[at]), top)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, j] = np.bincount(row, weights=away, minlength=rows) / (n * top)
    return out


def identify(docs: DataFrame, known: dict[str, np.ndarray], top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """docs with lang_pred and score (1 less the distance) as last columns."""
    names = sorted(known)
    keys = [known[k] for k in names]
    schema = docs.schema
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    text_at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_at)
            lang, score = [], []
            for a, b in pieces(text):
                far = distances(*code_points(text.slice(a, b - a)), keys, top, longest) if keys else np.full((b - a, 1), np.nan)
                none = np.isnan(far[:, 0])
                best = np.argmin(np.where(none[:, None], 1.0, far), axis=1)
                lang += ["und" if x else names[i] for x, i in zip(none, best, strict=True)]
                score.append(np.where(none, 0.0, 1.0 - far[np.arange(len(far)), best]))
            values = np.clip(np.concatenate(score), 0, 1) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(values)], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(predict, f"{kept}, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose text fits some profile learned from docs (all, if none can be learned)."""
    known = profiles(docs)
    if not known:
        return docs
    inner = [f"_{i}" if c != "text" else c for i, c in enumerate(docs.columns)]  # names that clash with none
    found = identify(docs.toDF(*inner), known)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).drop("lang_pred", "score").toDF(*docs.columns)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        found = identify(docs.select("doc_id", "text"), profiles(docs))
        return keep(cut(found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"), "languages"))
