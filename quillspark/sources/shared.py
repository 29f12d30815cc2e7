"""The folder that driver and executors share, and small files in it that are committed once."""

from __future__ import annotations

import tempfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; unset, a temporary folder serves local mode only."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(Path(tempfile.mkdtemp(prefix="quillspark-")).as_uri())
    return _own[0]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless there's one already: true if it's ours. It's written beside and then renamed, which the file system refuses for the later of two."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    to = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{to.getParent()}/.{to.getName()}.{jvm.java.util.UUID.randomUUID()}")
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(to.getParent())
    out = files.create(beside, True)
    out.write(text.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(beside, to, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        files.delete(beside, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True
