"""Operator 4: WARC archives, read by boundary-chain verification.

Writing: one record for each page. Of equal payloads (by SHA-1) the page with
the largest id holds the payload as a response; the others are revisits that
name it. Records are packed into chunks and written by Spark's text writer as
raw bytes, plain or with each record a gzip member of its own.

Reading: a record's start is looked for in every block of a file, so magic
inside payloads gives false starts. Each candidate is parsed as far as the
record that it claims to begin and yields the offset of its successor. Inside a
block the successors are followed to the first offset behind the block; pointer
jumping then doubles these steps from the start of the file, and only records
on that chain are kept. A file's tasks need no common state, and the number of
rounds is the logarithm of its blocks. A file whose chain does not end at the
file's end is an error.

Defined results: null html is an empty payload; equal payloads of at least
``least`` bytes (0 here) are stored once; rows that share both payload and the
largest page_id are all responses; a null page_id revisits the largest id of
its payload (it is a response if there is none); white space and control
characters in a url are percent-encoded, a null url is left out; an empty table
gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.errors import corrupt
from lamina.llm.joins import spread_join
from lamina.llm.storage import cut, new_path, rows_of, scratch, small_batches, table

#: Bytes of a chunk of records, and of a block that is searched for starts.
CHUNK, BLOCK = 4 << 20, 1 << 20
#: Groups of equal payloads that are sent to the pages; beyond it they are joined.
BROADCAST_GROUPS = 200_000
END = b"\r\n\r\n"
MAGIC, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
#: Bytes of header of a start that no record's end lies before, which is on no chain.
HEAD_LIMIT = 1 << 16


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: A gzip member without content closes each chunk of a compressed file.
EMPTY_MEMBER = _gzip(b"")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:lamina:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None, is_revisit: bool) -> bytes:
    """A record without the two line ends that close it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if is_revisit:
        lines += [f"WARC-Refers-To: {_urn(revisit_of)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def write_archives(pages: DataFrame, path: str, compressed: bool = True, least: int = 0) -> str:
    """Write pages(page_id, url, html) as WARC files under ``path``."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    groups = pages.where(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1 and top is not null").select("sha", "top"), "payloads")
    few = rows_of(groups) <= BROADCAST_GROUPS
    pages = (pages.join(F.broadcast(groups), "sha", "left") if few else spread_join(pages, groups, "sha", "left")).select(
        "page_id", "url", "payload", "top", (F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))).alias("again")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        chunk = lambda: pa.RecordBatch.from_arrays([pa.array([(b"" if compressed else END).join(held)], pa.binary())], names=["chunk"])
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, payload, top, again = (x.as_py() for x in row)
                data = record(page_id, url, payload, top, again)
                held.append(_gzip(data + END) if compressed else data)
                size += len(held[-1])
                if size >= CHUNK:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    closing = (EMPTY_MEMBER if compressed else END).decode("latin-1")
    chunks = pages.mapInArrow(pack, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    with small_batches(pages.sparkSession):
        chunks.write.option("encoding", "ISO-8859-1").option("lineSep", closing).option("compression", "none").text(path)
    return path


def _member(view: memoryview, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and the offset behind it."""
    packer, out, fed = zlib.decompressobj(31), [], at
    try:
        while fed < len(view) and not packer.eof:
            part = view[fed : fed + (1 << 14)]
            out.append(packer.decompress(part))
            fed += len(part)
    except zlib.error:
        return None
    return (b"".join(out), fed - len(packer.unused_data)) if packer.eof else None


def _parse(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(fields, start of the block, end of the block) of a record at ``at``.

    A start on a chain is the first one or follows an end, so the headers that
    are read without a limit do not overlap.
    """
    if not data.startswith(MAGIC, at):
        return None
    stop = data.find(END, at) if at == 0 or data.startswith(END, at - len(END)) else data.find(END, at, at + HEAD_LIMIT)
    if stop < 0:
        return None
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", length):
        return None
    start = stop + len(END)
    return fields, start, start + int(length)


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:lamina:page:(-?[0-9]+)>", urn or "")
    return int(m[1]) if m else None


def _described(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(END)
    kind = fields.get("warc-type")
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
        size, sha = int(m[1]) if m else 0, claimed
    else:
        size, sha = len(payload), digest(payload)
    return {
        "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": sha,
        "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "intact": sha == claimed,
    }


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def candidates(content: bytes, block: int = BLOCK) -> Iterator[dict]:
    """A row for each possible start of a record: block, offset, successor, exit and the record."""
    view = memoryview(content)
    compressed = content[:3] == GZIP
    magic = GZIP if compressed else MAGIC
    for number, begin in enumerate(range(0, len(content), block)):
        end, found = min(begin + block, len(content)), []
        at = content.find(magic, begin)
        while 0 <= at < end:
            row = None
            if compressed:
                got = _member(view, at)
                if got and not got[0]:
                    row = {"successor": got[1], "record": None}
                elif got and (p := _parse(got[0], 0)) and got[0][p[2] :] == END:
                    row = {"successor": got[1], "record": _described(p[0], got[0][p[1] : p[2]])}
            elif (p := _parse(content, at)) and p[2] + 4 <= len(view) and view[p[2] : p[2] + 4] == END:
                row = {"successor": p[2] + 4, "record": _described(p[0], bytes(view[p[1] : p[2]]))}
            if row:
                found.append(row | {"block": number, "offset": at})
            at = content.find(magic, at + 1)
        # follow successors to the first offset behind the block, from the back
        leaves: dict[int, int] = {}
        for row in reversed(found):
            leaves[row["offset"]] = row["exit"] = leaves.get(row["successor"], row["successor"])
        yield from found


def read_archives(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The records on the chain from each file's start, with the file's name and the offset."""
    # files go by a number, so that no table of offsets carries names
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").option("recursiveFileLookup", "true").load(path)
        .where("length > 0").select(F.xxhash64("path").alias("file"), "path", "length", "content")
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, name, content in zip(pdf["file"], pdf["path"], pdf["content"], strict=True):
                rows: list[dict] = []
                for row in candidates(bytes(content), block):
                    rows.append({"file": file, "path": name, **row})
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    columns = ["file", "path", "block", "offset", "successor", "exit", "record"]
    schema = f"file long, path string, block long, offset long, successor long, exit long, record struct<{_RECORD.replace(' ', ': ').replace(',:', ',')}>"
    found = cut(files.select("file", "path", "content").mapInPandas(lambda it: (df[columns] for df in search(it)), schema), "starts")

    # Pointer jumping: after n rounds the first 2 ** n blocks' entries are known.
    # The tables have a row for each candidate and are merged: none is broadcast.
    at = ["file", "offset"]
    starts = found.select(*at).hint("merge")
    jump = found.select("file", "offset", F.col("exit").alias("to"))
    reached = cut(found.where("offset = 0").select(*at), "reached")
    while True:
        more = reached.hint("merge").join(jump, at).select("file", F.col("to").alias("offset"))
        more = cut(more.join(starts, at, "left_semi").join(reached.hint("merge"), at, "left_anti"), "reached")
        if not rows_of(more):
            break
        reached = cut(reached.unionAll(more), "reached")
        nxt = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("then"))
        jump = cut(jump.join(nxt.hint("merge"), ["file", "to"]).select("file", "offset", F.col("then").alias("to")), "jump")

    ends = found.join(reached.hint("merge"), at, "left_semi").groupBy("file", "path").agg(F.max("exit").alias("end"))
    whole = files.select("file", "path", "length").hint("merge")
    broken = whole.join(ends, ["file", "path"], "left").where("end is null or end <> length").take(1)
    if broken:
        raise corrupt("the records of an archive end before its end", file=broken[0].path, end=broken[0].end, length=broken[0].length)

    # inside a block the chain is followed from its one entry
    entries = reached.select("file", F.col("offset").alias("entry"), F.floor(F.col("offset") / block).alias("block"))
    held = found.join(entries.hint("merge"), ["file", "block"]).select("file", "block", "entry", "offset", "successor")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after, on = dict(zip(pdf["offset"], pdf["successor"], strict=True)), []
        at = int(pdf["entry"].iloc[0])
        while at in after:
            on.append(at)
            at = int(after[at])
        return pd.DataFrame({"file": pdf["file"].iloc[0], "offset": np.array(on, dtype=np.int64)})

    chain = held.groupBy("file", "block", "entry").applyInPandas(walk, "file long, offset long")
    kept = found.join(chain.hint("merge"), at).where("record is not null")
    return kept.select("record.*", F.col("path").alias("file"), "offset")


def archived(pages: DataFrame, compressed: bool = True) -> DataFrame:
    """Write the pages and read their records back."""
    spark = pages.sparkSession
    with scratch(spark) as keep:
        path = write_archives(pages, new_path(spark, "warc"), compressed)
        kept = read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")
        return keep(cut(kept, "records"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
