"""Shared folders for intermediate tables, and the reading of inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lamina.sources.shared import file_system, fresh_dir

#: Rows of text in an Arrow batch: few, since the JVM and Python each hold one whole.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The folders of the innermost ``scratch``.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_ROWS`` rows for what runs inside; then the caller's setting again."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def new_path(spark: SparkSession, label: str) -> str:
    path = fresh_dir(spark, label)
    if _held.get() is not None:
        _held.get().append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result depends on no shuffle file or executor any more, so a later
    loss of an executor recomputes nothing above this point. It knows the
    number of its rows, see ``rows_of``.
    """
    spark = df.sparkSession
    path, counted = new_path(spark, label), Observation()
    with small_batches(spark):
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path, out.cut_rows = path, counted.get.get("n")
    return out


def rows_of(df: DataFrame) -> int:
    """The number of rows, counted if it was not when ``df`` was written."""
    known = getattr(df, "cut_rows", None)
    return df.count() if known is None else known


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """The folders made inside are removed at the end, but for those of tables given to ``keep``.

    What is computed lazily behind the end may read kept tables alone.
    """
    outer, mine = _held.get(), []
    token = _held.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        mine.remove(df.cut_path)
        if outer is not None:
            outer.append(df.cut_path)
        return df

    try:
        yield keep
    finally:
        _held.reset(token)
        for path in mine:
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
