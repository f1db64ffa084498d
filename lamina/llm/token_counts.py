"""Operator 1: token counts by a scan for separators in flat token files.

A flat token file is a run of little-endian 16-bit ids with one end-of-document
id after each document and no index. ``write_token_files`` makes such files
with Spark's text writer (raw bytes as the line, the separator as the line
end). ``separator_scan`` finds the documents again: every file is read in
Spark's splits, so one file of any length is searched by many tasks. A block is
searched as one numpy comparison. Where in its file a block begins, and so
which of its bytes begin an id, is not known to its task, so hits at even and
at odd bytes are kept apart; a prefix scan over the blocks of a file gives every
block the bytes before it (and so the alignment that holds), the number of
separators before it and the place of the last one, and so documents that cross
block borders are stitched without rereading.

The prefix scan has two levels (blocks in a chunk of ``CHUNK`` bytes, then
chunks in a file), so no task sees all block summaries of a long file. Splits
are cut behind a byte that is in no separator; a file without that byte is one
split, and then fails beyond 2 GB.

Defined results: an empty or null text has 0 tokens; a null doc_id keeps its
row; repeated rows stay repeated; an empty table gives no rows; other columns
are ignored; a text of any length is encoded whole. Ids that follow the last
separator of a file are an unfinished document and are reported with ``closed``
false; an odd byte at a file's end is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.storage import cut, new_path, scratch, small_batches, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256
#: Bytes of a file in a chunk.
CHUNK = 1 << 32
#: Ids that carry doc_id ahead of each document, see _header.
HEADER = 5

_state: dict = {}


def _encoder(path: str):
    if path not in _state:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _state[path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _state[path]


def _header(doc_id: int | None) -> list[int]:
    """doc_id in base EOD behind a sign digit, so that no digit is the separator."""
    if doc_id is None:
        return [2, 0, 0, 0, 0]
    value, sign = (doc_id, 0) if doc_id >= 0 else (-doc_id - 1, 1)
    # 4 digits hold values below EOD**4 = 6.38e18; the rest shares the sign digit
    high, value = divmod(value, EOD**4)
    return [sign + 4 * high, *(value // EOD**k % EOD for k in range(4))]


def _doc_id(digits: np.ndarray) -> int | None:
    sign, rest = int(digits[0]) % 4, int(digits[0]) // 4
    if sign == 2:
        return None
    value = rest * EOD**4 + sum(int(d) * EOD**k for k, d in enumerate(digits[1:]))
    return -value - 1 if sign else value


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> str:
    """Tokenise ``text`` of docs(doc_id, text) into flat files under ``path``.

    One file for each input split, so a file's size is bounded by the split.
    """
    if _encoder(tokenizer).max_token_value >= EOD:
        raise ValueError(f"{tokenizer} has ids of {EOD} or more, which are the separator's or need more than 16 bits")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.asarray(_header(doc_id) + enc.encode_ordinary(text or ""), dtype="<u2")
                    out.append(ids.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["line"])

    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = lines.mapInArrow(encode, "line binary")
    separator = np.array([EOD], dtype="<u2").tobytes().decode("latin-1")
    with small_batches(docs.sparkSession):
        (lines.select(F.col("line").cast("string").alias("value"))
         .write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("compression", "none").text(path))
    return path


def separator_scan(spark: SparkSession, path: str, eod: int = EOD, header: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(file, ordinal, start, n_tokens, head, closed) for each document of flat files.

    ``start`` is the position of a document's first id in its file and ``head``
    its first ``header`` ids, which ``n_tokens`` leaves out.
    """
    low, high = eod & 255, eod >> 8
    cut_at = next(c for c in "\n \t," if ord(c) not in (low, high))  # so no separator crosses a cut
    reach = 2 * header
    lines = (
        spark.read.format("text").option("lineSep", cut_at).option("pathGlobFilter", "[!_.]*").option("recursiveFileLookup", "true").load(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    )

    def found(data: bytes) -> dict:
        """The separators of a block at even and at odd bytes, each with the ids that follow it, and the documents between."""
        raw = np.frombuffer(data, np.uint8)
        hits = np.flatnonzero((raw[:-1] == low) & (raw[1:] == high))
        out = {"bytes": len(data), "lead": data[:reach].hex()}
        for parity in (0, 1):
            at = hits[hits % 2 == parity].tolist()
            opens = [None, *({"at": p, "head": data[p + 2 : p + 2 + reach].hex()} for p in at)]
            out[f"n{parity}"], out[f"last{parity}"] = len(at), opens[-1]
            out[f"docs{parity}"] = [{"open": o, "end": e} for o, e in zip(opens, at, strict=False)]
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            file, split, size, line = (batch.column(i) for i in range(4))
            new = np.ones(len(batch), dtype=bool)
            new[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(split[1:], split[:-1])).to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(new)[1:], len(batch))
            for a, b in zip(np.flatnonzero(new).tolist(), ends.tolist(), strict=True):
                data = cut_at.encode().join([*line[a:b].to_pylist(), b""])
                row = {"file": file[a].as_py(), "split": split[a].as_py(), "number": number, "size": size[a].as_py(), **found(data)}
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    opened = pa.struct([("at", pa.int64()), ("head", pa.string())])
    docs = pa.list_(pa.struct([("open", opened), ("end", pa.int64())]))
    schema = pa.schema([
        ("file", pa.string()), ("split", pa.int64()), ("number", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("lead", pa.string()),
        *((f"{name}{parity}", kind) for parity in (0, 1) for name, kind in (("n", pa.int64()), ("last", opened), ("docs", docs))),
    ])
    one, many = "struct<at: long, head: string>", "array<struct<open: struct<at: long, head: string>, end: long>>"
    blocks = lines.mapInArrow(
        scan, "file string, split long, number long, size long, bytes long, lead string, " + ", ".join(f"n{p} long, last{p} {one}, docs{p} {many}" for p in (0, 1))
    )
    # a row for each block, read again below
    blocks = cut(blocks.withColumn("chunk", F.floor(F.col("split") / chunk)), "blocks")

    def before(rows: DataFrame, **sums: Column) -> DataFrame:
        """rows with the fold of each column over the blocks of the file before, in two levels."""
        inner = Window.partitionBy("file", "chunk").orderBy("split", "number").rowsBetween(Window.unboundedPreceding, -1)
        outer = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        whole = rows.groupBy("file", "chunk").agg(*(f.alias(name) for name, f in sums.items()))
        whole = whole.select("file", "chunk", *(F.sum(n).over(outer).alias(f"{n}_above") if n != "last" else F.max(n).over(outer).alias("last_above") for n in sums))
        rows = rows.withColumns({f"{name}_in": f.over(inner) for name, f in sums.items()}).join(whole, ["file", "chunk"])
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return rows.withColumns({n: zero(f"{n}_in") + zero(f"{n}_above") if n != "last" else F.coalesce("last_in", "last_above") for n in sums})

    # The bytes before a block tell which of its two alignments holds. Then the
    # separators before it give its ordinals, and the last of them the start of
    # the document that ends first in it; a head may run on into the blocks behind.
    known = before(blocks, base=F.sum("bytes"))
    even = F.col("base") % 2 == 0
    pick = lambda c: F.when(even, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    behind = Window.partitionBy("file", "chunk").orderBy("split", "number")
    rest = F.array_join(F.collect_list("lead").over(behind.rowsBetween(1, max(reach, 1))), "")
    absolute = lambda o: F.when(o.isNotNull(), F.struct((o["at"] + F.col("base")).alias("at"), F.substring(F.concat(o["head"], F.col("rest")), 1, 2 * reach).alias("head")))
    known = known.withColumn("rest", rest).select(
        "file", "chunk", "split", "number", "size", "base", "lead", "rest", pick("n").alias("n"), pick("docs").alias("docs"), absolute(pick("last")).alias("tip")
    )
    known = cut(before(known, below=F.sum("n"), last=F.max("tip")), "known")
    start = known.where("base = 0").select("file", F.struct(F.lit(-2).cast("long").alias("at"), F.substring(F.concat("lead", "rest"), 1, 2 * reach).alias("head")).alias("opens"))
    ended = known.select("file", "base", "rest", "last", "below", F.posexplode("docs").alias("k", "doc")).select(
        "file", (F.col("below") + F.col("k")).alias("ordinal"), F.coalesce(absolute(F.col("doc.open")), F.col("last")).alias("open"),
        (F.col("base") + F.col("doc.end")).alias("end"), F.lit(True).alias("closed"),
    )
    # what follows a file's last separator
    tails = known.groupBy("file").agg(F.sum("n").alias("ordinal"), F.max("tip").alias("open"), (F.floor(F.max("size") / 2) * 2).alias("end"))
    tails = tails.where(F.coalesce(F.col("open.at") + 2, F.lit(0)) < F.col("end")).select("file", "ordinal", "open", "end", F.lit(False).alias("closed"))
    docs_ = ended.unionAll(tails)
    # a file's first document opens with the file
    first = docs_.where("open is null").drop("open").join(start, "file").withColumnRenamed("opens", "open")
    docs_ = docs_.where("open is not null").unionByName(first)
    byte = lambda i: F.conv(F.substring("open.head", 2 * i + 1, 2), 16, 10).cast("int")
    head = F.array(*(byte(2 * i) + byte(2 * i + 1) * 256 for i in range(header)))
    return docs_.select(
        "file", "ordinal", F.expr("(open.at + 2) div 2").alias("start"), (F.expr("(end - open.at - 2) div 2") - header).alias("n_tokens"),
        head.cast("array<int>").alias("head"), "closed",
    )


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs, through flat files."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        path = write_token_files(docs, new_path(spark, "tokens"), tokenizer)
        found = keep(cut(separator_scan(spark, path, header=HEADER).where("closed"), "counts"))
    sign, high = F.col("head")[0] % 4, F.floor(F.col("head")[0] / 4).cast("long")
    value = high * F.lit(EOD**4) + sum((F.col("head")[k + 1].cast("long") * F.lit(EOD**k) for k in range(4)), F.lit(0))
    doc_id = F.when(sign == 0, value).when(sign == 1, -value - 1)
    return found.select(doc_id.alias("doc_id"), "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
