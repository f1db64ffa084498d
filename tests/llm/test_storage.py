"""Written tables, the folders that are left, and joins with hot values."""

import os

from lamina.llm import joins
from lamina.llm.storage import cut, rows_of, scratch, small_batches
from lamina.sources.shared import shared_dir


def folders(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("lamina-")}


def test_scratch_removes_what_is_not_kept(spark, make):
    before = folders(spark)
    with scratch(spark) as keep:
        first = cut(make([(1, "a"), (2, None)]), "first")
        with scratch(spark) as inner:
            kept = inner(cut(first.where("doc_id = 1"), "inner"))
            cut(first, "gone")
        assert rows_of(first) == 2 and rows_of(kept) == 1 and len(folders(spark) - before) == 2
        out = keep(cut(kept, "out"))
    assert [r.text for r in out.collect()] == ["a"] and len(folders(spark) - before) == 1
    assert rows_of(cut(make([]), "empty")) == 0 and rows_of(make([(1, "a")])) == 1


def test_the_callers_batch_size_comes_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark):
        assert spark.conf.get(key) == "1000"
    assert spark.conf.get(key) == before


def test_spread_joins_match_plain_ones(spark, monkeypatch):
    real = joins.hot_values
    monkeypatch.setattr(joins, "hot_values", lambda rows, on: real(rows, on, 10, 5))
    left = spark.createDataFrame([(i % 7 if i > 60 else 3, i) for i in range(100)] + [(None, 1), (99, 2)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "k long, name string")
    assert real(left, "k", 10, 5) == [3] and real(left, "k", 10, 500) == []
    for how in ("inner", "left"):
        got, want = joins.spread_join(left, right, "k", how), left.join(right, "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
