"""All queries over the change-log operators, with their SQL.

The driver tables are read as change logs: ``events`` is a store of three
sealed layers and a live log, ``orders`` a longer log of one layer, and
``conversations`` a log for each conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import codec
from lamina.operators import recover, report, resolve
from lamina.sources.shared import fresh_dir
from lamina.sources.store import Store

LIVE = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    day, deleted = F.dayofmonth("ts"), F.col("event_type") == "error"
    layer = F.when(day <= 10, 1).when(day <= 20, 2).when(day <= 25, 3).otherwise(LIVE)
    return e.select(
        layer.cast("long").alias("layer"), (F.col("event_id") + 1).alias("ord"), (F.col("event_id") + 1).alias("seq"),
        F.when(deleted, "del").otherwise("put").alias("op"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.when(~deleted, F.concat("event_type", F.lit(":"), "props")).alias("value"), day.cast("long").alias("shard"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    deleted = F.col("o_orderstatus") == "F"
    return o.select(
        F.lit(1).cast("long").alias("layer"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("seq"),
        F.when(deleted, "del").otherwise("put").alias("op"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("key"),
        F.when(~deleted, F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("value"),
    )


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    deleted = F.col("role") == "system"
    return c.select(
        F.lit(1).cast("long").alias("layer"), F.col("turn").alias("ord"), F.col("turn").alias("seq"), F.when(deleted, "del").otherwise("put").alias("op"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("key"), F.when(~deleted, F.col("text")).alias("value"),
    )


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """The events as a store of its own: three sealed tables and a live log."""
    store = Store(spark, fresh_dir(spark, "store"), memtable_limit=1 << 62)
    changes = events_log(spark, sf_dir).drop("shard")
    store.load(changes.where(F.col("layer") < LIVE), changes.where(F.col("layer") == LIVE))
    return store


EVENTS = """
c AS (SELECT CAST(CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 WHEN day(ts) <= 25 THEN 3 ELSE 4 END AS BIGINT) AS layer,
             event_id + 1 AS ord, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op,
             'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key,
             CASE WHEN event_type <> 'error' THEN event_type || ':' || props END AS value, CAST(day(ts) AS BIGINT) AS shard
      FROM events)"""
ORDERS = """
c AS (SELECT CAST(1 AS BIGINT) AS layer, o_orderkey AS ord, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'del' ELSE 'put' END AS op,
             lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS key,
             CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus || '|' || o_orderpriority END AS value
      FROM orders)"""
TALKS = """
c AS (SELECT CAST(1 AS BIGINT) AS layer, turn AS ord, turn AS seq, CASE WHEN role = 'system' THEN 'del' ELSE 'put' END AS op,
             'c' || CAST(conv_id AS VARCHAR) AS key, CASE WHEN role <> 'system' THEN text END AS value
      FROM conversations)"""
NEWEST = """
r AS (SELECT layer, ord, seq, op, key, value
      FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC, ord DESC) AS n FROM c) WHERE n = 1)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {EVENTS}, {NEWEST} SELECT key, layer, ord, seq, op, value FROM r")
def resolve_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved(events_log(spark, sf_dir))


@query(f"WITH {ORDERS}, {NEWEST} SELECT key, layer, ord, seq, op, value FROM r")
def resolve_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved(orders_log(spark, sf_dir))


@query(f"WITH {TALKS}, {NEWEST} SELECT key, op, value FROM r")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved(conversations_log(spark, sf_dir)).select("key", "op", "value")


@query(f"WITH {EVENTS}, {NEWEST} SELECT key, value FROM r WHERE value IS NOT NULL AND key >= 'u000003' AND key < 'u000090' ORDER BY key LIMIT 40")
def scan_range_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir), "u000003", "u000090", 40)


@query(f"WITH {EVENTS}, {NEWEST} SELECT key, value FROM r WHERE value IS NOT NULL")
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir))


@query(f"WITH {ORDERS}, {NEWEST} SELECT key, value FROM r WHERE value IS NOT NULL AND key >= '000000050'")
def scan_start_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(orders_log(spark, sf_dir), start="000000050")


@query(f"WITH {ORDERS}, {NEWEST} SELECT key, value FROM r WHERE value IS NOT NULL AND key < '000000050'")
def scan_end_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(orders_log(spark, sf_dir), end="000000050")


@query(f"WITH {EVENTS}, {NEWEST} SELECT key, value FROM r WHERE value IS NOT NULL AND key LIKE 'u00001%'")
def scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.prefix_scan(events_log(spark, sf_dir), "u00001")


@query(f"""WITH {EVENTS}, {NEWEST}, k AS (SELECT DISTINCT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer)
SELECT k.key, CASE WHEN r.key IS NULL THEN 'miss' WHEN r.value IS NULL THEN 'tombstone' ELSE 'hit' END AS state, r.value, r.layer
FROM k LEFT JOIN r ON k.key = r.key""")
def multi_get_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return resolve.states(events_log(spark, sf_dir), keys)


@query(f"""WITH {EVENTS}, {NEWEST}, k AS (SELECT unnest(['u000001', 'u000007', 'nobody', '']) AS key)
SELECT k.key, CASE WHEN r.key IS NULL THEN 'miss' WHEN r.value IS NULL THEN 'tombstone' ELSE 'hit' END AS state, r.value, r.layer
FROM k LEFT JOIN r ON k.key = r.key""")
def point_gets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([("u000001",), ("u000007",), ("nobody",), ("",)], "key string")
    return resolve.states(events_log(spark, sf_dir), keys, small=4)


@query(f"WITH {EVENTS}, {NEWEST} SELECT layer, count(*) AS keys, count(value) AS live FROM r GROUP BY layer")
def resolve_source_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = resolve.resolved(events_log(spark, sf_dir))
    return newest.groupBy("layer").agg(F.count("*").alias("keys"), F.count("value").alias("live"))


@query(f"""WITH {EVENTS}, p AS (SELECT max(ord) // 2 AS bound FROM c), c2 AS (SELECT c.* FROM c, p WHERE ord <= bound),
r AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC, ord DESC) AS n FROM c2) WHERE n = 1)
SELECT key, value FROM r WHERE value IS NOT NULL""")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = events_log(spark, sf_dir)
    bound = changes.agg(F.floor(F.max("ord") / 2).alias("bound"))
    known = changes.join(F.broadcast(bound), F.col("ord") <= F.col("bound"))  # one row
    then = known.agg(F.max(F.struct("layer", "ord")).alias("then"))
    return resolve.as_of(changes.join(F.broadcast(then)), F.col("then.layer"), F.col("then.ord"))  # one row


@query(f"""WITH {EVENTS} SELECT layer, key, ord, op, value FROM
(SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY ord DESC) AS n FROM c) WHERE n = 1""")
def flush_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, live = _store(spark, sf_dir), F.lit(LIVE).cast("long")
    number = store.flush()
    return store.sealed().select(F.when(F.col("layer") == number, live).otherwise(F.col("layer")).alias("layer"), "key", "ord", "op", "value")


@query(f"""WITH RECURSIVE {EVENTS},
o AS (SELECT shard, ord, length(key) + coalesce(length(value), 0) AS cost, row_number() OVER (PARTITION BY shard ORDER BY ord) AS n,
             lag(ord) OVER (PARTITION BY shard, key ORDER BY ord) AS old_ord,
             lag(length(key) + coalesce(length(value), 0)) OVER (PARTITION BY shard, key ORDER BY ord) AS old_cost FROM c),
f AS (SELECT shard, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT shard FROM o)
      UNION ALL
      SELECT f.shard, o.n, CASE WHEN s.size >= 300 THEN o.ord ELSE f.start END, CASE WHEN s.size >= 300 THEN 0 ELSE s.size END,
             CASE WHEN s.size >= 300 THEN o.ord END AS hit
      FROM f JOIN o ON o.shard = f.shard AND o.n = f.n + 1,
      LATERAL (SELECT f.bytes + o.cost - CASE WHEN o.old_ord > f.start THEN o.old_cost ELSE 0 END AS size) s)
SELECT shard, hit AS ord FROM f WHERE hit IS NOT NULL""")
def auto_flush_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.flush_points(events_log(spark, sf_dir), 300, "shard")


@query(f"""WITH {EVENTS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY layer DESC, ord DESC) AS n FROM c) WHERE n = 1)
SELECT shard, count(*) AS memtable_entries, CAST(sum(length(key) + coalesce(length(value), 0)) AS BIGINT) AS memtable_bytes,
       count(*) - count(value) AS tombstones FROM r GROUP BY shard""")
def memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.memtable_bytes(events_log(spark, sf_dir), "shard")


@query(f"WITH {EVENTS}, {NEWEST} SELECT CAST(5 AS BIGINT) AS layer, row_number() OVER (ORDER BY key) AS ord, key, value FROM r WHERE value IS NOT NULL")
def compact_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.flush()
    return store.numbered(store.compact()["table"])


@query(f"""WITH {EVENTS}, {NEWEST} SELECT (SELECT max(layer) + 1 FROM c WHERE layer < 4) AS table_number, count(value) AS keys,
(SELECT count(DISTINCT layer) FROM c WHERE layer < 4) AS removed_tables FROM r""")
def compact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is compacted as it is, so the new table takes the number after the sealed ones."""
    done = _store(spark, sf_dir).compact()
    return spark.createDataFrame([(done["table"], done["keys"], done["removedTables"])], "table_number long, keys long, removed_tables long")


@query(f"""WITH {EVENTS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY ord DESC) AS n FROM c) WHERE n = 1),
t AS (SELECT count(DISTINCT layer) AS tables, count(*) AS sealed_entries, coalesce(max(layer), 0) + 1 AS next_table_number,
             count(*) - count(value) AS sealed_tombstones FROM s WHERE layer < 4),
m AS (SELECT count(*) AS memtable_entries, CAST(coalesce(sum(length(key) + coalesce(length(value), 0)), 0) AS BIGINT) AS memtable_bytes,
             count(*) - count(value) AS tombstones FROM s WHERE layer = 4),
w AS (SELECT count(*) AS wal_records FROM c WHERE layer = 4)
SELECT * FROM t, m, w""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = events_log(spark, sf_dir)
    sealed = resolve.resolved(changes.where(F.col("layer") < LIVE).withColumn("table", F.col("layer")), "table")
    return report.store_stats(sealed.select("layer", "key", "value"), changes.where(F.col("layer") == LIVE))


@query(f"""WITH {TALKS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS n FROM c)
SELECT count(*) AS records, (SELECT seq FROM c ORDER BY ord DESC, seq DESC LIMIT 1) AS last_sequence,
       count(*) FILTER (n = 1 AND value IS NOT NULL) AS put_keys, count(*) FILTER (n = 1 AND value IS NULL) AS deleted_keys FROM n""")
def verify_log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.log_counters(conversations_log(spark, sf_dir))


@query(f"""WITH {EVENTS}, s AS (SELECT shard, key, op, ord, seq, value, row_number() OVER (PARTITION BY shard, key ORDER BY ord DESC) AS n,
       first_value(seq) OVER (PARTITION BY shard ORDER BY ord DESC) AS last_seq FROM c)
SELECT shard, count(*) AS records, max(last_seq) AS last_sequence, count(*) FILTER (n = 1 AND value IS NOT NULL) AS put_keys,
       count(*) FILTER (n = 1 AND value IS NULL) AS deleted_keys FROM s GROUP BY shard""")
def verify_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.log_counters(events_log(spark, sf_dir), "shard")


SEALED = "s AS (SELECT layer, key, value FROM (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY ord DESC) AS n FROM c) WHERE n = 1 AND layer < 4)"
BITS = "b AS (SELECT layer, count(*) AS keys, greatest(64, 10 * greatest(1, count(*))) AS bits FROM s GROUP BY layer)"


def _word(i: int) -> str:
    return f"CAST(('0x' || substr(sha256(key), {1 + 8 * i}, 8)) AS BIGINT) % bits"


POSITIONS = "[" + ", ".join(_word(i) for i in range(4)) + "]"


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = events_log(spark, sf_dir).where(F.col("layer") < LIVE)
    return resolve.resolved(changes.withColumn("table", F.col("layer")), "table").select("layer", "key", "value")


@query(f"WITH {EVENTS}, {SEALED}, {BITS} SELECT layer, keys, bits, CAST(4 AS BIGINT) AS hashes, (bits + 7) // 8 AS bytes FROM b")
def table_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.table_documents(_sealed(spark, sf_dir))


@query(f"WITH {EVENTS}, {SEALED}, {BITS} SELECT DISTINCT layer, unnest({POSITIONS}) AS position FROM s JOIN b USING (layer)")
def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.bloom(_sealed(spark, sf_dir))


@query(f"""WITH {EVENTS}, {SEALED}, {BITS}, k AS (SELECT DISTINCT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer),
f AS (SELECT DISTINCT layer, unnest({POSITIONS}) AS position FROM s JOIN b USING (layer)),
q AS (SELECT layer, key, unnest({POSITIONS}) AS position FROM k, b)
SELECT q.layer, q.key, bool_and(f.position IS NOT NULL) AS maybe FROM q LEFT JOIN f USING (layer, position) GROUP BY q.layer, q.key""")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return report.bloom_probe(_sealed(spark, sf_dir), keys)


@query("""SELECT doc_id, sha256('{"key":' || to_json(source) || ',"op":"put","seq":' || CAST(doc_id + 1 AS VARCHAR) || ',"value":' || to_json(text) || '}') AS payload_sha256
FROM documents""")
def log_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    body = codec.record_json(F.col("source"), F.lit("put"), F.col("doc_id") + 1, F.col("text"))
    return d.select("doc_id", F.sha2(body.cast("binary"), 256).alias("payload_sha256"))


#: CRC-32 of the bytes of ``body``, bit by bit: DuckDB has no such function.
CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(body)) + 1),
         lambda i: CAST('0x' || substr(hex(encode(body)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))),
         lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
LINES = f"""
j AS (SELECT shard, ord, seq, '{{"key":' || to_json(key) || ',"op":"' || op || '","seq":' || CAST(seq AS VARCHAR) || CASE WHEN value IS NULL THEN '' ELSE ',"value":' || to_json(value) END || '}}' AS body FROM c),
l AS (SELECT shard, ord, seq, printf('%08x', xor({CRC}, 4294967295)) || ' ' || body AS line FROM j)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    body = codec.record_json(F.col("key"), F.col("op"), F.col("seq"), F.col("value"))
    return log.select("shard", "ord", "seq", codec.record_line(body).alias("line"))


@query(f"WITH {EVENTS}, {LINES} SELECT seq, line FROM l")
def log_record_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("seq", "line")


@query(f"""WITH {EVENTS}, {LINES}, d AS (SELECT shard, ord, seq, octet_length(encode(line)) + 1 AS size, seq % 29 = 7 OR seq % 31 = 5 OR seq % 37 = 9 OR seq % 41 = 11 AS bad FROM l),
b AS (SELECT shard, min(ord) AS bad FROM d WHERE bad GROUP BY shard)
SELECT d.shard, count(*) FILTER (b.bad IS NULL OR ord < b.bad) AS records, arg_max(seq, ord) FILTER (b.bad IS NULL OR ord < b.bad) AS last_sequence,
       CAST(coalesce(sum(size) FILTER (b.bad IS NULL OR ord < b.bad), 0) AS BIGINT) AS good_bytes, CAST(coalesce(sum(size) FILTER (ord >= b.bad), 0) AS BIGINT) AS truncated_bytes
FROM d LEFT JOIN b ON d.shard = b.shard GROUP BY d.shard""")
def recover_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery of a log for each day: a line's checksum, its payload, its layout or its end is damaged at places."""
    seq, line = F.col("seq"), F.col("line")
    damaged = F.when(seq % 29 == 7, F.translate(line, "0123456789", "1234567890")).when(seq % 31 == 5, F.concat(F.substring(line, 1, 9), F.reverse(F.substring(line, 10, 9999))))
    damaged = damaged.when(seq % 37 == 9, F.replace(line, F.lit(" "), F.lit("_"))).otherwise(line)
    lines = _lines(spark, sf_dir).select(
        F.col("shard").alias("file"), "ord", damaged.alias("line"), (F.octet_length("line") + 1).cast("long").alias("size"), (seq % 41 != 11).alias("ended")
    )
    _, reports = recover.recovered(lines)
    return reports.withColumnRenamed("file", "shard").select("shard", "records", "last_sequence", "good_bytes", "truncated_bytes")


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN contains(text, chr(9)) THEN 'tab' WHEN contains(text, chr(10)) THEN 'newline' END AS key_error
FROM documents""")
def key_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", codec.key_error(F.col("text")).alias("key_error"))


@query("SELECT doc_id, to_base64(encode(text)) AS encoded, true AS same FROM documents")
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumn("encoded", codec.base64(F.col("text")))
    return d.select("doc_id", "encoded", (codec.unbase64(F.col("encoded")) == F.col("text")).alias("same"))


@query("""WITH n AS (SELECT p_partkey, 'table-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') || CASE WHEN p_size % 5 = 0 THEN '.tmp' ELSE '.sst' END AS name FROM part),
x AS (SELECT *, CAST(nullif(regexp_extract(name, '^table-([0-9]+)\\.sst$', 1), '') AS BIGINT) AS number FROM n)
SELECT p_partkey, name, number, coalesce((SELECT max(number) FROM x), 0) + 1 AS next_number FROM x""")
def table_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 5 == 0, F.regexp_replace(codec.table_name(F.col("p_partkey")), r"\.sst$", ".tmp")).otherwise(codec.table_name(F.col("p_partkey")))
    named = p.select("p_partkey", name.alias("name")).withColumn("number", codec.table_number(F.col("name")))
    top = named.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next_number"))
    return named.join(F.broadcast(top))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("layer"), F.col("l_partkey").alias("ord"))
    return resolve.duplicate_versions(line).select(F.col("key").alias("l_orderkey"), F.col("layer").alias("l_linenumber"), F.col("ord").alias("l_partkey"), "n")

