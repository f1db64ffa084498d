"""A store on a folder: immutable Parquet layers, log segments and a manifest.

    <dir>/tables/<number>/        a sealed layer, sorted by key, Bloom filter on key
    <dir>/log/<segment>/          appended changes of the live log
    <dir>/manifest/<version>.json what is in the store, in versions

A version is committed by making its file, whole and only if no other writer
has made it; readers take the highest. Files are only removed (``vacuum``) once
no manifest names them, so a crash leaves the version before, whole; what it
leaves of a segment that was never committed is reported as truncated bytes.

The manifest names every file of a layer or segment with its size, and each
layer's rows and the checksums of its files. Reads compare names and sizes, so
a part that is missing or cut is an error and no loss; ``verify`` reads all
bytes of all layers.

``ord`` orders the changes of the whole store. Changes of a write session get
the positions behind all that are stored. Changes that carry versions of their
own keep them, so one that comes late loses to what is newer, sealed or not.
Compaction forgets deletions, so what is older than a compaction is left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.errors import corrupt, invalid
from lamina.functions.codec import key_error
from lamina.model import CHANGE, MEMTABLE_LIMIT
from lamina.operators import report, resolve
from lamina.sources import shared

LIVE = (1 << 62) - 1  # the log's layer: above every table
#: Rows of a file of a layer, so that its bytes can be read at once.
FILE_ROWS = 5_000_000
EMPTY = {"version": 0, "tables": [], "log": [], "next": 1, "seq": 0, "ord": 0, "compacted": 0, "cut": 0, "streams": {}}
_WRONG = {"key": "keys must not be empty or hold tabs or line ends", "op": "unknown operation", "value": "a put needs a value"}


@dataclass
class Snapshot:
    """A fixed view: the live rows when it was taken."""

    sequence: int
    version: int
    rows: DataFrame

    def get(self, key: str, default: str | None = None) -> str | None:
        row = self.rows.where(F.col("key") == key).first()
        return row.value if row else default

    def items(self) -> DataFrame:
        return self.rows.orderBy("key")

    def document(self) -> dict[str, int]:
        return {"sequence": self.sequence, "keys": self.rows.count()}


@dataclass
class Store:
    spark: SparkSession
    directory: str
    memtable_limit: int = MEMTABLE_LIMIT
    writes: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        if self.memtable_limit <= 0:
            raise invalid("memtable limit must be positive", value=self.memtable_limit)
        self.directory = self.directory.rstrip("/")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        """Nothing is open between calls: every write is committed before it returns."""

    # the manifest

    def manifest(self) -> dict:
        newest = max((n for n in shared.sizes(self.spark, f"{self.directory}/manifest") if n.endswith(".json")), default=None)
        return EMPTY | (json.loads(shared.read_text(self.spark, f"{self.directory}/manifest/{newest}")) if newest else {})

    def _commit(self, m: dict) -> None:
        m = m | {"version": m["version"] + 1}
        if not shared.write_once(self.spark, f"{self.directory}/manifest/{m['version']:012d}.json", json.dumps(m)):
            raise invalid("another writer has changed the store", version=m["version"])

    def _table(self, number: int) -> str:
        return f"{self.directory}/tables/{number:06d}"

    def _segment(self, name: str) -> str:
        return f"{self.directory}/log/{name}"

    def _unnamed(self, m: dict) -> list[tuple[str, str]]:
        """(kind, folder) of the folders that a manifest does not name."""
        live = {"tables": {f"{t['number']:06d}" for t in m["tables"]}, "log": {s["name"] for s in m["log"]}}
        out = []
        for kind, names in live.items():
            fs, p = shared.file_system(self.spark, f"{self.directory}/{kind}")
            out += [(kind, str(f.getPath())) for f in (fs.listStatus(p) if fs.exists(p) else []) if f.getPath().getName() not in names]
        return out

    def vacuum(self) -> int:
        """Remove tables and segments that the newest manifest does not name."""
        gone = 0
        for _, folder in self._unnamed(self.manifest()):
            fs, p = shared.file_system(self.spark, folder)
            gone += bool(fs.delete(p, True))
        return gone

    # layers as DataFrames

    def _read(self, parts: list[tuple[str, dict]]) -> DataFrame:
        """The rows of folders with what the manifest says of each."""
        for path, said in parts:
            if shared.sizes(self.spark, path) != said["files"]:
                raise corrupt("files are not those that were written", path=path)
        if not parts:
            return self.spark.createDataFrame([], CHANGE)
        return self.spark.read.schema(CHANGE).parquet(*(path for path, _ in parts))

    def sealed(self, m: dict | None = None) -> DataFrame:
        return self._read([(self._table(t["number"]), t) for t in (m or self.manifest())["tables"]])

    def log(self, m: dict | None = None) -> DataFrame:
        return self._read([(self._segment(s["name"]), s) for s in (m or self.manifest())["log"]])

    def changes(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        return resolve.merged(self.sealed(m), self.log(m))

    # writes

    def apply(self, rows: DataFrame, versions: bool = False, batch: tuple[str, int] | None = None) -> int:
        """Append rows(ord, key, op, value) to the log in one commit; the number of rows.

        ``ord`` is the order inside the batch, behind all that is stored; with
        ``versions`` it orders the whole store, and rows not above the last
        compaction are left out. ``batch`` is (stream, number): one that is not
        above the last number of its stream is in the store already.
        """
        m = self.manifest()
        if batch and batch[1] <= m["streams"].get(batch[0], -1):
            return 0
        streams = m["streams"] | ({batch[0]: batch[1]} if batch else {})
        rows = rows.select(F.col("ord").cast("long").alias("ord"), "key", "op", F.when(F.col("op") == "put", F.col("value")).alias("value"))
        if versions:
            rows = rows.where(F.col("ord") > m["compacted"])
        wrong = F.when(key_error(F.col("key")).isNotNull(), "key").when(~F.coalesce(F.col("op").isin("put", "del"), F.lit(False)), "op")
        wrong = wrong.when((F.col("op") == "put") & F.col("value").isNull(), "value")
        size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
        span = rows.agg(
            F.count("*").alias("n"), F.count_distinct("ord").alias("d"), F.min("ord").alias("low"), F.max("ord").alias("high"), F.sum(size).alias("bytes"),
            F.min(F.when(wrong.isNotNull(), F.struct(wrong.alias("what"), "key"))).alias("bad"),
        ).first()
        if not span.n:
            if batch:
                self._commit(m | {"streams": streams})
            return 0
        if span.bad:
            raise invalid(_WRONG[span.bad.what], value=span.bad.key)
        if span.n != span.d and not versions:
            raise invalid("changes must have distinct positions")
        shift = 0 if versions else m["ord"] - span.low + 1
        name = f"{m['next']:012d}-{uuid.uuid4().hex[:8]}"
        seq = F.col("ord") - span.low + 1 + m["seq"]
        rows.select(F.lit(LIVE).alias("layer"), (F.col("ord") + shift).alias("ord"), seq.alias("seq"), "op", "key", "value").write.parquet(self._segment(name))
        segment = {"name": name, "rows": span.n, "bytes": span.bytes, "files": shared.sizes(self.spark, self._segment(name))}
        self._commit(m | {
            "log": [*m["log"], segment], "next": m["next"] + 1, "seq": m["seq"] + span.high - span.low + 1, "ord": max(m["ord"], span.high + shift), "streams": streams,
        })
        self.writes += span.n
        # the sum of all records bounds the memtable, which holds each key once
        if sum(s["bytes"] for s in m["log"]) + span.bytes >= self.memtable_limit and self.memtable().first().memtable_bytes >= self.memtable_limit:
            self.flush()
        return span.n

    def _one(self, op: str, key: str, value: str | None) -> None:
        self.apply(self.spark.createDataFrame([(1, key, op, value)], "ord long, key string, op string, value string"))

    def put(self, key: str, value: str) -> None:
        if not isinstance(value, str):
            raise invalid("a value must be a string", key=key)
        self._one("put", key, value)

    def delete(self, key: str) -> None:
        self._one("del", key, None)

    def _seal(self, rows: DataFrame, number: int) -> dict:
        """Write a table; what the manifest says of it."""
        rows = rows.select(F.lit(number).cast("long").alias("layer"), "ord", "seq", "op", "key", "value")
        rows = rows.repartitionByRange("key").sortWithinPartitions("key")
        made = rows.write.option("parquet.bloom.filter.enabled#key", "true").option("maxRecordsPerFile", FILE_ROWS)
        made.parquet(self._table(number), mode="overwrite")
        said = {"number": number, "files": shared.sizes(self.spark, self._table(number))}
        return said | {"rows": self._read([(self._table(number), said)]).count(), "crc": self._checksums(number)}

    def _checksums(self, number: int) -> dict[str, int]:
        """The CRC-32 of each file of a table; a row for each file."""
        files = self.spark.read.format("binaryFile").load(self._table(number)).select(F.element_at(F.split("path", "/"), -1), F.crc32("content"))
        return {name: crc for name, crc in files.collect()}

    def flush(self) -> int | None:
        """Seal the log as the newest table, deletions kept; its number, or None if it is empty."""
        m = self.manifest()
        if not m["log"]:
            return None
        table = self._seal(resolve.newest(self.log(m)), 1 + max((t["number"] for t in m["tables"]), default=0))
        self._commit(m | {"tables": [*m["tables"], table], "log": [], "seq": 0, "cut": 0})
        return table["number"]

    def compact(self) -> dict[str, int]:
        """One table of the live rows in place of all tables and the log."""
        m = self.manifest()
        table = self._seal(resolve.newest(self.changes(m)).where("value is not null"), 1 + max((t["number"] for t in m["tables"]), default=0))
        self._commit(m | {"tables": [table], "log": [], "seq": 0, "cut": 0, "compacted": m["ord"]})
        return {"table": table["number"], "keys": table["rows"], "removedTables": len(m["tables"])}

    # reads

    def get(self, key: str) -> tuple[bool, str | None]:
        row = resolve.newest(self.changes().where(F.col("key") == key)).first()
        return row is not None, row.value if row else None

    def get_many(self, keys: Iterable[str]) -> DataFrame:
        keys = list(keys)
        return resolve.states(self.changes(), self.spark.createDataFrame([(k,) for k in keys], "key string"), small=len(keys), newest=resolve.newest)

    def scan(self, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return resolve.scan(self.changes(), start, end, limit, newest=resolve.newest)

    def snapshot(self) -> Snapshot:
        """Files are immutable, so the rows stay as they are now until a vacuum."""
        m = self.manifest()
        return Snapshot(self.writes, m["version"], resolve.newest(self.changes(m)).where("value is not null").select("key", "value"))

    def numbered(self, number: int) -> DataFrame:
        """(layer, ord, key, value) of a sealed table, ``ord`` being the place in the order of keys.

        The table's files are ranges of keys in the order of their names, and
        Parquet knows a row's place in its file, so nothing is sorted again.
        """
        rows = self.spark.read.schema(CHANGE).parquet(self._table(number))
        rows = rows.select("layer", "key", "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"))
        return resolve.numbered(rows)

    # reports

    def memtable(self) -> DataFrame:
        return report.memtable_bytes(self.log())

    def _truncated(self, m: dict) -> int:
        """Bytes cut from an imported log, and of segments that were never committed."""
        left = (shared.sizes(self.spark, folder) for kind, folder in self._unnamed(m) if kind == "log" and int(folder.rsplit("/", 1)[1][:12]) >= m["next"])
        return m["cut"] + sum(sum(files.values()) for files in left)

    def stats(self) -> dict[str, object]:
        m = self.manifest()
        r = report.store_stats(self.sealed(m), self.log(m)).first()
        return {
            "directory": self.directory, "tables": len(m["tables"]), "sealedEntries": r.sealed_entries, "memtableEntries": r.memtable_entries,
            "memtableBytes": r.memtable_bytes, "tombstones": r.tombstones, "walRecords": r.wal_records, "walTruncatedBytes": self._truncated(m),
            "nextTableNumber": 1 + max((t["number"] for t in m["tables"]), default=0),
        }

    def verify(self) -> dict[str, object]:
        """Read everything; an error for a table that is not what was sealed."""
        m = self.manifest()
        sealed = self.sealed(m)
        for t in m["tables"]:
            path = self._table(t["number"])
            if self._checksums(t["number"]) != t["crc"]:
                raise corrupt("files are not those that were sealed", path=path)
        documents = {r.layer: r for r in report.table_documents(sealed).collect()}  # a row for each table
        empty, tables = {"keys": 0, "bits": 64, "hashes": 4, "bytes": 8}, []
        for t in m["tables"]:
            d = documents[t["number"]].asDict() if t["number"] in documents else empty
            tables.append({"path": self._table(t["number"]), "keys": d["keys"], "bloom": {k: d[k] for k in ("bits", "hashes", "bytes")}})
        w = report.log_counters(self.log(m)).first()
        wal = {"records": w.records, "truncatedBytes": self._truncated(m), "lastSequence": w.last_sequence or 0, "putKeys": w.put_keys, "deletedKeys": w.deleted_keys}
        return {"tables": tables, "wal": wal}

    # other formats

    def load(self, sealed: DataFrame, log: DataFrame) -> None:
        """Fill a new store from changes: ``sealed`` by layer, of each key the newest, and ``log`` behind them."""
        m = self.manifest()
        if m["version"]:
            raise invalid("only a new store can be filled", directory=self.directory)
        numbers = sorted(r.layer for r in sealed.select("layer").distinct().collect())  # a row for each layer
        tables = [self._seal(resolve.newest(sealed.where(F.col("layer") == n)), n) for n in numbers]
        top = sealed.agg(F.max("ord")).first()[0] or 0
        self._commit(m | {"tables": tables, "ord": top})
        self.apply(log.select("ord", "key", "op", "value"), versions=True)

    def import_files(self, path: str) -> dict[str, int]:
        """Take over a folder of text tables and a log; the log is cut at its first bad line."""
        from lamina.sources.tables import read_log, read_tables

        m = self.manifest()
        if m["version"]:
            raise invalid("files are imported into a new store only", directory=self.directory)
        names, tables = shared.sizes(self.spark, path), []
        if any(n.endswith(".sst") for n in names):
            rows = read_tables(self.spark, path)
            rows = rows.select("layer", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("long").alias("seq"), F.when(F.col("value").isNull(), "del").otherwise("put").alias("op"), "key", "value")
            numbers = sorted(r.layer for r in rows.select("layer").distinct().collect())  # a row for each table
            tables = [self._seal(rows.where(F.col("layer") == n), n) for n in numbers]
        cut = 0
        if "wal.log" in names:
            records, reports = read_log(self.spark, f"{path}/wal.log")
            cut = reports.agg(F.sum("truncated_bytes")).first()[0] or 0
        self._commit(m | {"tables": tables, "cut": cut})
        if "wal.log" in names:
            self.apply(records)
        return {"tables": len(tables), "truncatedBytes": cut}
