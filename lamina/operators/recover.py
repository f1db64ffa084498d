"""Reading logs: strict decoding, and recovery up to the first bad line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.codec import crc32_hex


def decoded(line: Column) -> Column:
    """Struct (key, op, seq, value, problem) of a log line without its end.

    The checks run in a fixed order and the first that fails is the problem.
    Types are strict: numbers are not taken for strings, nor decimals for
    sequence numbers. A deletion's value is ignored.
    """
    text = line.cast("string")
    body = F.substring(text, 10, 2147483647)
    v = F.try_parse_json(body)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    get = lambda path, t: F.try_variant_get(v, path, t)
    op, key, seq, value = get("$.op", "string"), get("$.key", "string"), get("$.seq", "bigint"), get("$.value", "string")
    problem = (
        F.when(line.isNull() | (F.octet_length(line) == 0), "empty")
        .when(~F.is_valid_utf8(text), "encoding")
        .when(~text.rlike(r"^(?s).{8} ."), "layout")
        .when(crc32_hex(body) != F.substring(text, 1, 8), "checksum")
        .when(v.isNull(), "json")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "object")
        .when(F.coalesce(kind("$.op") != "STRING", F.lit(True)) | ~op.isin("put", "del"), "op")
        .when(F.coalesce(kind("$.key") != "STRING", F.lit(True)) | (F.length(key) == 0), "key")
        .when(F.coalesce(kind("$.seq") != "BIGINT", F.lit(True)) | (seq < 1), "seq")
        .when((op == "put") & F.coalesce(kind("$.value") != "STRING", F.lit(True)), "value")
    )
    return F.struct(key.alias("key"), op.alias("op"), seq.alias("seq"), F.when(op == "put", value).alias("value"), problem.alias("problem"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line, size) of log files in the order of their lines.

    A file is read whole (the reader's bound is 2 GB); many logs are read side
    by side. Lines end at \\n, \\r or \\r\\n, and ``size`` counts the end too.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    pieces = F.split("text", r"(?<=\n)|(?<=\r)(?!\n)", -1)
    rows = files.select("file", F.posexplode(pieces).alias("ord", "piece")).where(F.octet_length("piece") > 0)
    return rows.select(
        "file", (F.col("ord") + 1).cast("long").alias("ord"), F.regexp_replace("piece", r"\r?\n$|\r$", "").alias("line"),
        F.octet_length("piece").cast("long").alias("size"), F.col("piece").rlike(r"[\r\n]$").alias("ended"),
    )


def recovered(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, reports) of lines(file, ord, line, size, ended).

    records: file, ord, key, op, seq, value before each file's first bad line.
    reports: file, records, last_sequence, good_bytes, truncated_bytes. A last
    line without its end is bad: a later append would join it to the next.
    """
    read = lines.withColumn("r", decoded(F.col("line"))).withColumn("ok", F.col("r.problem").isNull() & F.col("ended"))
    bad = read.where(~F.col("ok")).groupBy("file").agg(F.min("ord").alias("bad"))
    marked = read.join(bad, "file", "left").withColumn("good", F.col("bad").isNull() | (F.col("ord") < F.col("bad")))
    reports = marked.groupBy("file").agg(
        F.count_if("good").alias("records"), F.max(F.when(F.col("good"), F.struct("ord", "r.seq")))["seq"].alias("last_sequence"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("size"))), F.lit(0)).alias("good_bytes"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("size"))), F.lit(0)).alias("truncated_bytes"),
    )
    return marked.where("good").select("file", "ord", "r.key", "r.op", "r.seq", "r.value"), reports
