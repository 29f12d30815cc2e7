"""Shared helpers: tables in the shared folder, Python paths, documents with clash-free columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule of this subpackage: space, and tab to carriage return.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
_made: set[str] = set()
_worker: dict[object, object] = {}


def worker_model(key: object, make: Callable[[], object]) -> object:
    """What a Python worker holds between tasks (a vocabulary and its caches): one at a time, since Spark uses workers for stage after stage."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary folder serves local mode only."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(Path(tempfile.mkdtemp(prefix="quillspark-")).as_uri())
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    _made.add(path)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them."""
    for t in tables:
        delete_path(t.sparkSession, t.written_path)
        _made.discard(t.written_path)


def cleared(spark: SparkSession) -> None:
    """Delete all tables that this process has written, when no result that reads them is needed any more."""
    for path in list(_made):
        delete_path(spark, path)
        _made.discard(path)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this library when it isn't installed on them."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; a null one is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def narrow(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator reads, so that others can't clash with its own."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def carried(docs: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The text and then the columns ``carry``, and the schema of those."""
    rows = docs.select("text", *[F.col(f"`{c}`") for c in carry])
    return rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])


def fold_is(col: str, modulus: int, remainder: int):
    """crc32(id as text) mod ``modulus`` = ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus == remainder
