"""Joins that no hot key puts into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.storage import rows_of

#: A value is hot if more than one row in ``SHARE`` has it, so there are fewer
#: than ``SHARE`` hot values; up to ``FLOOR`` rows of one are no burden.
SHARE, FLOOR = 1000, 1000


def hot_values(rows: DataFrame, on: str, share: int = SHARE, floor: int = FLOOR) -> list:
    """The values of column ``on`` that more than ``floor`` rows and one row in ``share`` have; fewer than ``share``."""
    n = rows_of(rows)
    if n <= floor:
        return []
    most = max(floor, n // share)
    counted = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return [r[0] for r in counted.select(on).collect()]


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has at most one row for each value of ``on``.

    Rows of hot values stay where they are and the few rows of ``right`` that
    they need are sent to them; all other rows are dealt by ``on``. ``left``
    is read three times, so it should be a table.
    """
    hot = hot_values(left, on)
    if not hot:
        return left.join(right, on, how)
    here, there = F.col(on).isin(hot), ~F.col(on).isin(hot)
    sent = F.broadcast(right.where(here))  # fewer than SHARE rows
    rest = left.where(there) if how == "inner" else left.where(F.coalesce(there, F.lit(True)))
    return left.where(here).join(sent, on, how).unionByName(rest.join(right.where(there), on, how))
