"""Counters over layers and logs, each a single pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.codec import bloom_bits, bloom_positions
from lamina.model import HASHES
from lamina.operators.resolve import resolved


def memtable_bytes(log: DataFrame, *by: str) -> DataFrame:
    """(by, keys, bytes) of the live rows: code points of keys and newest values."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    return resolved(log, *by).groupBy(*by).agg(
        F.count("*").alias("memtable_entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("memtable_bytes"),
        F.count_if(F.col("value").isNull()).alias("tombstones"),
    )


def store_stats(sealed: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counters of sealed layers and the live log.

    Sealed entries count shadowed and deleted rows; tombstones only the log's.
    """
    tables = sealed.agg(
        F.count_distinct("layer").alias("tables"), F.count("*").alias("sealed_entries"),
        (F.coalesce(F.max("layer"), F.lit(0)) + 1).cast("long").alias("next_table_number"),
        F.count_if(F.col("value").isNull()).alias("sealed_tombstones"),
    )
    records = log.agg(F.count("*").alias("wal_records"))
    return tables.crossJoin(memtable_bytes(log)).crossJoin(records)  # three tables of one row


def log_counters(log: DataFrame, *by: str) -> DataFrame:
    """(by, records, last_sequence, put_keys, deleted_keys) of a log."""
    records = log.groupBy(*by).agg(F.count("*").alias("records"), F.max(F.struct("ord", "seq"))["seq"].alias("last_sequence"))
    keys = resolved(log, *by).groupBy(*by).agg(
        F.count_if(F.col("value").isNotNull()).alias("put_keys"), F.count_if(F.col("value").isNull()).alias("deleted_keys")
    )
    return records.join(keys, list(by)) if by else records.crossJoin(keys)  # two tables of one row


def table_documents(sealed: DataFrame) -> DataFrame:
    """(layer, keys, bits, hashes, bytes) of each sealed layer and its Bloom filter."""
    counted = sealed.groupBy("layer").agg(F.count("*").alias("keys"))
    bits = bloom_bits(F.col("keys"))
    return counted.select("layer", "keys", bits.alias("bits"), F.lit(HASHES).cast("long").alias("hashes"), F.ceil(bits / 8).cast("long").alias("bytes"))


def bloom(sealed: DataFrame) -> DataFrame:
    """(layer, position): the set bits of each layer's filter."""
    sized = sealed.groupBy("layer").agg(bloom_bits(F.count("*")).alias("bits"))
    placed = sealed.join(F.broadcast(sized), "layer")  # a row for each layer
    return placed.select("layer", F.explode(bloom_positions(F.col("key"), F.col("bits"))).alias("position")).distinct()


def bloom_probe(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """(layer, key, maybe): whether each layer's filter may hold each key."""
    sized = sealed.groupBy("layer").agg(bloom_bits(F.count("*")).alias("bits"))
    asked = keys.select("key").distinct().crossJoin(F.broadcast(sized))  # keys by layers, as asked
    asked = asked.select("layer", "key", F.explode(bloom_positions(F.col("key"), F.col("bits"))).alias("position"))
    there = bloom(sealed).withColumn("there", F.lit(True))
    return asked.join(there, ["layer", "position"], "left").groupBy("layer", "key").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("maybe"))
