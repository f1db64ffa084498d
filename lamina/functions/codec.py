"""Scalar expressions of the log and table formats, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.model import BITS_PER_KEY, HASHES, LEAST_BITS

TABLE_NAME = r"^table-([0-9]+)\.sst$"


def crc32_hex(data: Column) -> Column:
    """CRC-32 of a string's UTF-8 bytes, or of binary, as 8 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(data.cast("binary")))), 8, "0")


def record_json(key: Column, op: Column, seq: Column, value: Column) -> Column:
    """The canonical payload: sorted keys, no spaces, value only for puts."""
    body = F.to_json(F.struct(key.alias("key"), op.alias("op"), seq.alias("seq"), F.when(op == "put", value).alias("value")))
    # Jackson escapes U+000B as \\u000B, the format as \\u000b. Strings of the
    # payload are split at backslash pairs first, so only true escapes change.
    lower = lambda part: F.reduce(
        F.lit([f"{n:04X}" for n in range(0x20) if n % 16 > 9]), part,
        lambda text, code: F.replace(text, F.concat(F.lit("\\u"), code), F.concat(F.lit("\\u"), F.lower(code))),
    )
    pairs = F.array_join(F.transform(F.split(body, r"\\\\", -1), lower), "\\\\")
    return F.when(body.contains("\\u00"), pairs).otherwise(body)


def record_line(json: Column) -> Column:
    """A log line without its end: checksum, blank, payload."""
    return F.concat(crc32_hex(json), F.lit(" "), json)


def base64(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data.cast("binary")), "[\r\n]", "")


def unbase64(text: Column) -> Column:
    return F.unbase64(text).cast("string")


def bloom_bits(keys: Column, bits_per_key: int = BITS_PER_KEY) -> Column:
    return F.greatest(F.lit(LEAST_BITS).cast("long"), F.lit(bits_per_key).cast("long") * F.greatest(keys, F.lit(1)))


def bloom_positions(key: Column, bits: Column, hashes: int = HASHES) -> Column:
    """The bits of a key: words of 4 bytes of its SHA-256, modulo the filter's size."""
    sha = F.sha2(key.cast("binary"), 256)
    word = lambda i: F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("long")
    return F.array(*(word(i) % bits for i in range(hashes)))


def table_name(number: Column) -> Column:
    return F.format_string("table-%06d.sst", number)


def table_number(name: Column) -> Column:
    """The number in a table's file name; null for other names."""
    found = F.regexp_extract(name, TABLE_NAME, 1)
    return F.when(found != "", found.cast("long"))


def key_error(key: Column) -> Column:
    """Why a key may not be written; null if it may."""
    return (
        F.when(key.isNull() | (F.length(key) == 0), "empty")
        .when(key.contains("\t"), "tab").when(key.contains("\n"), "newline")
    )
