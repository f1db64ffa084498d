"""The folder that driver and executors share, and single files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where all tasks run on this machine a folder of its own if that is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lamina.local.shared", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("lamina.local.shared", conf)
    return conf.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lamina-{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's interface."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """name -> bytes of the data files right below a folder; empty if there is none."""
    fs, p = file_system(spark, path)
    found = fs.listStatus(p) if fs.exists(p) else []
    return {f.getPath().getName(): f.getLen() for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))}


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file, whole or not at all; False if it is there, also if another writer makes it at this moment.

    A temporary file gets the name by a hard link on a local file system and
    by a rename that overwrites nothing on others (atomic on HDFS; an object
    store without such a rename holds one writer at a time only).
    """
    folder, _, name = path.rpartition("/")
    fs, temp = file_system(spark, f"{folder}/_{uuid.uuid4().hex}-{name}")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getScheme() == "file":
            files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
            local = lambda p: paths.get(fs.makeQualified(p).toUri())
            files.createLink(local(made), local(temp))
        else:
            none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), spark._jsc.hadoopConfiguration()).rename(temp, made, none)
    except Exception:
        if not fs.exists(made):
            raise
        return False
    finally:
        fs.delete(temp, False)
    return True
