import base64
import json
import os
import threading
import zlib
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lamina import cli
from lamina.errors import Kind, LaminaError
from lamina.functions import codec
from lamina.model import CHANGE
from lamina.operators import recover, resolve
from lamina.sources import shared, tables
from lamina.sources.store import Store
from lamina.streaming.latest import into_store, latest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


@contextmanager
def fails(kind, match=None):
    with pytest.raises(LaminaError, match=match) as caught:
        yield
    assert caught.value.kind is kind


def rows(df):
    return [tuple(r) for r in df.collect()]


def batch(spark, *changes):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(changes)], "ord long, key string, op string, value string")


def test_reads_across_layers(spark, store):
    store.apply(batch(spark, ("c", "put", "C"), ("a", "put", "1"), ("b", "put", ""), ("d", "put", "x")))
    assert store.flush() == 1 and store.flush() is None
    store.apply(batch(spark, ("a", "put", "2"), ("d", "del", None), ("ghost", "del", None), ("a", "put", "3")))
    assert [store.get(k) for k in ("a", "b", "d", "ghost", "no")] == [(True, "3"), (True, ""), (True, None), (True, None), (False, None)]
    assert rows(store.scan()) == [("a", "3"), ("b", ""), ("c", "C")]
    assert rows(store.scan("b", "c")) == [("b", "")] and rows(store.scan(end="")) == [] and rows(store.scan(limit=1)) == [("a", "3")]
    assert {r.key: r.state for r in store.get_many(["a", "d", "no"]).collect()} == {"a": "hit", "d": "tombstone", "no": "miss"}
    stats = store.stats()
    assert (stats["tables"], stats["sealedEntries"], stats["memtableEntries"], stats["tombstones"], stats["walRecords"]) == (1, 4, 3, 2, 4)
    assert stats["memtableBytes"] == len("a3") + len("d") + len("ghost")
    snap = store.snapshot()
    assert store.compact() == {"table": 2, "keys": 3, "removedTables": 1}
    store.put("a", "later")
    assert snap.get("a") == "3" and snap.get("d", "none") == "none" and snap.document()["keys"] == 3
    assert store.get("d") == (False, None) and store.stats()["nextTableNumber"] == 3
    report = store.verify()
    assert report["tables"][0]["keys"] == 3 and report["wal"]["records"] == 1 and report["wal"]["lastSequence"] == 1
    assert store.vacuum() == 3 and rows(store.scan()) == [("a", "later"), ("b", ""), ("c", "C")]


def test_limits_and_validation(spark, store, tmp_path):
    for key in ("", "a\tb", "a\nb"):
        with fails(Kind.REQUEST):
            store.put(key, "v")
    for args in ({"start": "z", "end": "a"}, {"limit": 0}):
        with fails(Kind.REQUEST):
            store.scan(**args)
    with fails(Kind.REQUEST):
        store.apply(batch(spark, ("a", "merge", "1")))
    with fails(Kind.REQUEST):
        store.apply(batch(spark, ("a", "put", None)))
    with fails(Kind.REQUEST):
        Store(spark, "x", 0)
    assert store.compact()["keys"] == 0 and store.verify()["tables"][0]["bloom"] == {"bits": 64, "hashes": 4, "bytes": 8}
    small = Store(spark, f"file://{tmp_path}/small", memtable_limit=3)
    small.put("k", "😀")
    assert small.stats()["tables"] == 0
    small.put("k", "ab")
    assert small.stats()["tables"] == 1 and small.stats()["walRecords"] == 0
    one, two = store.manifest(), store.manifest()
    store._commit(one)
    with fails(Kind.REQUEST):
        store._commit(two)


def line(payload, crc=None):
    body = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return f"{crc or format(zlib.crc32(body.encode()), '08x')} {body}\n"


GOOD = [{"key": "a", "op": "put", "seq": 1, "value": "é\u001f\\u001F\n"}, {"key": "b", "op": "del", "seq": 2}, {"key": "a", "op": "put", "seq": 3, "value": "", "more": 1}]


def test_records_round_trip(spark):
    values = ["", "plain", 'q"\\', "\u001f\u000b\\u001F\\\u001a", "é😀\t\n\r", "\\\\u000B"]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "seq long, value string")
    body = codec.record_json(F.lit("k"), F.lit("put"), F.col("seq"), F.col("value"))
    got = df.select(codec.record_line(body).alias("line"), "seq", "value").collect()
    for r in got:
        assert r.line + "\n" == line({"key": "k", "op": "put", "seq": r.seq, "value": r.value})
    back = spark.createDataFrame(got).select(recover.decoded(F.col("line")).alias("r"), F.col("value").alias("v")).select("r.*", "v").collect()
    assert all(r.problem is None and r.value == r.v for r in back)


@pytest.mark.parametrize(("bad", "problem"), [
    ("", "empty"), ("short", "layout"), ("00000000" + line(GOOD[0])[8:-1], "checksum"), (line({"key": "a", "op": "merge", "seq": 1})[:-1], "op"),
    (line({"key": "a", "op": "put", "seq": 1})[:-1], "value"), (line({"key": "a", "op": "put", "seq": 1, "value": 5})[:-1], "value"),
    (line({"key": 5, "op": "del", "seq": 1})[:-1], "key"), (line({"key": "", "op": "del", "seq": 1})[:-1], "key"),
    (line({"key": "a", "op": "del", "seq": 0})[:-1], "seq"), (line({"key": "a", "op": "del", "seq": 1.0})[:-1], "seq"),
    (line({"key": "a", "op": "del", "seq": True})[:-1], "seq"), (line([1])[:-1], "object"),
])
def test_bad_records(spark, bad, problem):
    assert spark.createDataFrame([(bad,)], "line string").select(recover.decoded(F.col("line"))["problem"]).first()[0] == problem


def test_recovery_stops_at_the_first_bad_line(spark, tmp_path):
    good = "".join(map(line, GOOD))
    cases = {"clean": good, "torn": good + 'deadbeef {"op":"put","key":"b","seq":9,"va', "middle": line(GOOD[0]) + "junk\n" + line(GOOD[1]), "open": good[:-1], "none": ""}
    for name, text in cases.items():
        (tmp_path / name).write_bytes(text.encode())
    records, reports = tables.read_log(spark, f"file://{tmp_path}/*")
    got = {r.file.rsplit("/", 1)[1]: r for r in reports.collect()}
    assert (got["clean"].records, got["clean"].truncated_bytes, got["clean"].last_sequence) == (3, 0, 3)
    assert got["torn"].records == 3 and got["torn"].truncated_bytes == len(cases["torn"].encode()) - len(good.encode())
    assert got["middle"].records == 1 and got["open"].records == 2
    kept = records.where(F.col("file").endswith("clean")).withColumn("layer", F.lit(1))
    assert sorted(rows(resolve.resolved(kept).select("key", "value"))) == [("a", ""), ("b", None)]


def test_table_files_round_trip_and_seal(spark, store, tmp_path, monkeypatch):
    layer = spark.createDataFrame([("b", None), ("a", "é" * 90), ("c", "")], "key string, value string")
    text = tables.table_text(layer)
    head, *entries, foot = text.rstrip("\n").split("\n")
    assert json.loads(head) == {"bloomBits": 64, "bloomHashes": 4, "count": 3} and entries[1:] == ["b\t~", "c\t"]
    assert base64.b64decode(entries[0].split("\t")[1]).decode() == "é" * 90
    assert all(tables.bloom_image_holds(json.loads(foot)["bloom"], 64, k) for k in "abc")
    src = tmp_path / "old"
    src.mkdir()
    (src / "table-000002.sst").write_text(text)
    (src / "wal.log").write_text("".join(map(line, GOOD)) + "torn")
    assert store.import_files(f"file://{src}") == {"tables": 1, "truncatedBytes": 4}
    assert store.verify()["wal"]["truncatedBytes"] == 4 and store.stats()["walTruncatedBytes"] == 4
    assert store.get("c") == (True, "") and store.get("a") == (True, "") and store.stats()["nextTableNumber"] == 3
    (src / "table-000002.sst").write_text(text[:40] + "Z" + text[41:])
    with fails(Kind.DATA):
        tables.read_tables(spark, f"file://{src}")
    with fails(Kind.REQUEST):
        tables.table_text(layer.union(layer))
    monkeypatch.setattr(tables, "MOST_ENTRIES", 2)
    with fails(Kind.REQUEST, "too large"):
        tables.table_text(layer)


def test_versions_and_tombstones(spark):
    changes = spark.createDataFrame([(1, 1, None, "put", "k", "old"), (2, 1, None, "del", "k", None), (2, 2, None, "put", "￿", "x"), (1, 9, None, "put", "\U00010000", "y")], CHANGE)
    assert rows(resolve.scan(changes)) == [("￿", "x"), ("\U00010000", "y")]
    assert rows(resolve.as_of(changes, 1, 5)) == [("k", "old")]
    assert resolve.duplicate_versions(changes.union(changes)).count() == 4


def test_pushdown(spark, store):
    store.put("a", "1")
    plan = store.scan("a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,b)" in plan


def run(capsys, *argv):
    code = cli.main(list(argv))
    out, err = capsys.readouterr()
    return code, json.loads(out) if out else None, json.loads(err) if err else None


def test_command_line(spark, tmp_path, capsys):
    d = ("--dir", f"file://{tmp_path}/c")
    assert run(capsys, "describe")[1]["exitCodes"] == {"ok": 0, "error": 2, "negativeVerdict": 3}
    assert run(capsys, "put", *d, "--key", "k", "--value", "é")[:2] == (0, {"key": "k", "written": True, "bytes": 1, "writes": 1})
    assert run(capsys, "get", *d, "--key", "k")[:2] == (0, {"key": "k", "found": True, "value": "é"})
    assert run(capsys, "get", *d, "--key", "x")[0] == 3
    assert run(capsys, "delete", *d, "--key", "k")[1]["wasValue"] == "é"
    assert run(capsys, "delete", *d, "--key", "k")[1] == {"key": "k", "deleted": True, "wasPresent": True, "wasValue": None, "writes": 1}
    assert run(capsys, "get", *d, "--key", "k")[:2] == (0, {"key": "k", "found": True, "value": None})
    assert run(capsys, "scan", *d)[:2] == (3, {"rows": [], "count": 0})
    assert run(capsys, "flush", *d)[1]["flushed"] and run(capsys, "flush", *d)[0] == 3
    assert run(capsys, "compact", *d)[1] == {"table": 2, "keys": 0, "removedTables": 1}
    assert run(capsys, "get", *d, "--key", "k")[0] == 3 and run(capsys, "verify", *d)[0] == 0 and run(capsys, "stats", *d)[1]["tables"] == 1
    code, out, err = run(capsys, "put", *d, "--key", "", "--value", "v")
    assert (code, out, err["error"]) == (2, None, "validation_error")
    assert run(capsys, "scan", *d, "--limit", "x")[2]["error"] == "validation_error" and run(capsys)[0] == 2


def test_streams(spark, store, tmp_path):
    src = str(tmp_path / "in")
    schema = "layer long, ord long, key string, op string, value string"
    spark.createDataFrame([(1, 2, "a", "put", "new"), (1, 3, "b", "del", None)], schema).write.parquet(src)
    spark.createDataFrame([(1, 1, "a", "put", "late")], schema).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_rows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("latest_rows").select("key", "ord", "value"))) == [("a", 2, "new"), ("b", 3, None)]
    into_store(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), store, str(tmp_path / "ck")).awaitTermination()
    assert rows(store.scan()) == [("a", "new")] and store.manifest()["streams"] == {str(tmp_path / "ck"): max(int(f) for f in os.listdir(tmp_path / "ck/commits") if f.isdigit())}


def test_late_changes_lose_and_batches_count_once(spark, store):
    one = lambda ord_, op, key, value=None: spark.createDataFrame([(ord_, key, op, value)], "ord long, key string, op string, value string")
    assert store.apply(one(5, "put", "a", "new"), versions=True, batch=("s", 0)) == 1
    assert store.apply(one(4, "put", "a", "late-old"), versions=True, batch=("s", 1)) == 1
    assert store.get("a") == (True, "new")
    store.flush()
    assert store.apply(one(3, "put", "a", "later-old"), versions=True, batch=("s", 2)) == 1
    assert store.get("a") == (True, "new") and rows(store.scan()) == [("a", "new")] and store.get_many(["a"]).first().value == "new"
    assert store.apply(one(9, "put", "a", "again"), versions=True, batch=("s", 2)) == 0 and store.get("a") == (True, "new")
    store.put("a", "session")  # behind all that is stored
    assert store.get("a") == (True, "session")
    store.apply(one(20, "del", "a"), versions=True)
    store.compact()
    assert store.apply(one(19, "put", "a", "older than the compaction"), versions=True, batch=("s", 3)) == 0
    assert store.get("a") == (False, None) and store.apply(one(21, "put", "a", "x"), versions=True, batch=("t", 0)) == 1 and rows(store.scan()) == [("a", "x")]


def test_one_of_two_racing_writers_commits(spark, tmp_path):
    path, done = f"file://{tmp_path}/race", []

    def write(name, barrier):
        mine = Store(spark, path)
        m = mine.manifest()
        barrier.wait()
        try:
            mine._commit(m | {"cut": name})
            done.append(name)
        except LaminaError as error:
            assert error.kind is Kind.REQUEST

    for turn in range(20):
        barrier, before = threading.Barrier(4), len(done)
        threads = [threading.Thread(target=write, args=(4 * turn + i, barrier)) for i in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        m = Store(spark, path).manifest()
        assert len(done) == before + 1 and (m["version"], m["cut"]) == (turn + 1, done[-1])
    assert not [f for f in os.listdir(tmp_path / "race/manifest") if f.startswith("_")]


def test_damaged_and_missing_parts_are_found(spark, store, tmp_path):
    store.apply(batch(spark, *((f"k{i:04d}", "put", f"v{i}") for i in range(400))))
    store.flush()
    store.put("z", "1")
    assert [t["keys"] for t in store.verify()["tables"]] == [400]
    folder = tmp_path / "s/tables/000001"
    part = next(f for f in sorted(folder.iterdir()) if f.name.startswith("part-"))
    whole = part.read_bytes()
    (folder / f".{part.name}.crc").unlink(missing_ok=True)
    for at in (4, 40, len(whole) // 2, len(whole) - 20):
        part.write_bytes(whole[:at] + bytes([whole[at] ^ 90]) + whole[at + 1 :])
        with fails(Kind.DATA):
            store.verify()
    part.write_bytes(whole[:-1])
    with fails(Kind.DATA, "files are not"):
        store.get("k0001")
    part.unlink()
    for read in (store.verify, store.scan, store.stats):
        with fails(Kind.DATA, "files are not"):
            read()
    part.write_bytes(whole)
    assert store.verify()["wal"]["truncatedBytes"] == 0
    # what a writer leaves that stops before its commit
    lost = tmp_path / "s/log/000000000009-dead"
    lost.mkdir(parents=True)
    (lost / "part-0.parquet").write_bytes(b"x" * 70)
    assert store.verify()["wal"]["truncatedBytes"] == 70 and store.stats()["walTruncatedBytes"] == 70
    assert store.vacuum() == 2 and store.verify()["wal"]["truncatedBytes"] == 0 and store.get("z") == (True, "1")


def test_compaction_numbers_keys_of_many_files(spark, store):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = spark.range(400_000).select(F.col("id").alias("ord"), F.sha1(F.col("id").cast("string")).alias("key"), F.lit("put").alias("op"), F.lit("v").alias("value"))
        store.apply(keys)
        table = store.compact()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert table["keys"] == 400_000 and len(store.manifest()["tables"][0]["files"]) > 1
    placed = store.numbered(table["table"])
    span = placed.agg(F.count_distinct("ord").alias("d"), F.min("ord").alias("low"), F.max("ord").alias("high")).first()
    assert tuple(span) == (400_000, 1, 400_000)
    assert [r.key for r in placed.orderBy("ord").limit(500).collect()] == [r.key for r in keys.select("key").orderBy("key").limit(500).collect()]


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://head:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
