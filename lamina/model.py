"""The change schema.

A store is an ordered stack of layers of changes. ``(layer, ord)`` orders all
changes of a key, newest last; the live log is the highest layer. ``value`` is
null in a deletion and only there: an empty string is a value. ``seq`` is
carried but orders nothing, since it starts anew with each log.
"""

from __future__ import annotations

from pyspark.sql import types as T

CHANGE = T.StructType([
    T.StructField("layer", T.LongType(), False),
    T.StructField("ord", T.LongType(), False),
    T.StructField("seq", T.LongType(), True),
    T.StructField("op", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])

PUT, DELETE = "put", "del"
MEMTABLE_LIMIT = 1 << 20
BITS_PER_KEY, HASHES, LEAST_BITS = 10, 4, 64
