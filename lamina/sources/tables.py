"""Import and export of the text formats: sealed tables and logs."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.errors import corrupt, invalid
from lamina.functions import codec
from lamina.model import HASHES
from lamina.operators.recover import log_lines, recovered
from lamina.operators.report import bloom
from lamina.operators.resolve import sealed_order

TOMBSTONE = "~"
#: Entries of a layer that may be one text file.
MOST_ENTRIES = 1_000_000


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(layer, key, value) of sealed table files, verified; raises CorruptionError.

    The last line is a footer with the CRC-32 of all before it, the first line
    a header with the number of entries; the lines between are entries.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "table-*.sst").load(path)
    number = codec.table_number(F.element_at(F.split("path", "/"), -1))
    text = F.col("content").cast("string")
    files = files.select("path", number.alias("layer"), text.alias("text")).where("layer is not null")
    body = F.regexp_extract("text", r"(?s)\A(.*\n)[^\n]*\n\z", 1)
    footer = F.regexp_extract("text", r"([^\n]*)\n\z", 1)
    files = files.withColumns({"body": body, "footer": F.from_json(footer, "bloom string, crc32 string")})
    lines = F.split(F.regexp_replace("body", r"\n\z", ""), "\n")
    files = files.withColumns({"header": F.from_json(F.element_at(lines, 1), "count long, bloomBits long, bloomHashes long"), "entries": F.slice(lines, F.lit(2), F.size(lines))})
    wrong = (
        F.when(F.length("body") == 0, "table is too short to hold a footer")
        .when(F.col("footer.crc32").isNull(), "unreadable footer")
        .when(codec.crc32_hex(F.col("body")) != F.col("footer.crc32"), "table checksum mismatch")
        .when(F.col("header.count").isNull(), "unreadable header")
        .when(F.exists("entries", lambda e: ~e.contains("\t")), "entry without a separator")
        .when(F.size(F.array_distinct(F.transform("entries", lambda e: F.split_part(e, F.lit("\t"), F.lit(1))))) != F.col("header.count"), "entry count differs from the header")
    )
    bad = files.select("path", wrong.alias("wrong")).where("wrong is not null").orderBy("path").first()
    if bad:
        raise corrupt(bad.wrong, path=bad.path)
    value = F.split_part("e", F.lit("\t"), F.lit(2))
    return files.select("layer", F.explode("entries").alias("e")).select(
        "layer", F.split_part("e", F.lit("\t"), F.lit(1)).alias("key"), F.when(value != TOMBSTONE, codec.unbase64(value)).alias("value")
    )


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, reports) of log files, see ``recovered``."""
    return recovered(log_lines(spark, path))


def log_text(changes: DataFrame) -> DataFrame:
    """(ord, line) of changes as log lines."""
    body = codec.record_json(F.col("key"), F.col("op"), F.col("seq"), F.col("value"))
    return changes.select("ord", codec.record_line(body).alias("line"))


def table_text(layer: DataFrame) -> str:
    """A sealed layer of at most ``MOST_ENTRIES`` entries as one table file's text.

    For export to single-file consumers; the file format is itself one text
    with a checksum over all of it. Layers of any size are Parquet.
    """
    entries = layer.count()
    if entries > MOST_ENTRIES:
        raise invalid("the layer is too large for one text file", entries=entries, most=MOST_ENTRIES)
    if not sealed_order(layer).isEmpty():
        raise invalid("table keys must be unique")
    entry = F.concat("key", F.lit("\t"), F.coalesce(codec.base64(F.col("value")), F.lit(TOMBSTONE)))
    rows = [r.e for r in layer.orderBy("key").select(entry.alias("e")).toLocalIterator()]
    positions = [r.position for r in bloom(layer.select(F.lit(1).alias("layer"), "key")).collect()] if rows else []
    bits = max(64, 10 * max(1, len(rows)))
    image = bytearray((bits + 7) // 8)
    for p in positions:
        image[p // 8] |= 1 << p % 8
    compact = lambda d: json.dumps(d, separators=(",", ":"))
    body = "".join(f"{line}\n" for line in [compact({"count": len(rows), "bloomBits": bits, "bloomHashes": HASHES}), *rows])
    return body + compact({"bloom": base64.b64encode(bytes(image)).decode(), "crc32": f"{zlib.crc32(body.encode()):08x}"}) + "\n"


def bloom_image_holds(image: str, bits: int, key: str, hashes: int = HASHES) -> bool:
    """Whether an exported filter may hold a key."""
    data, sha = base64.b64decode(image), hashlib.sha256(key.encode()).digest()
    places = (int.from_bytes(sha[4 * i : 4 * i + 4], "big") % bits for i in range(hashes))
    return all(data[p // 8] >> p % 8 & 1 for p in places)
