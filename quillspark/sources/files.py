"""JSON, binary and JDBC sources, upload checks, and append sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.text import slug

# First bytes of a PDF, largest upload.
PDF_MAGIC, MOST_BYTES = "%PDF-", 10 * 1024 * 1024


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by a given schema; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table over JDBC, read in ranges of ``column`` if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def acceptable_pdf(content: Column) -> Column:
    """Begins as a PDF and isn't larger than ``MOST_BYTES``."""
    return (F.substring(content, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC.encode())) & (F.octet_length(content) <= MOST_BYTES)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_.-]", "_")


def download_name(name: Column, version: Column, brand: str = "doc") -> Column:
    return F.concat(slug(name), F.lit(f"-{brand}-v"), version.cast("string"), F.lit(".pdf"))


def as_payload(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text and times as ISO text, for stores of flat rows."""
    out = []
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.to_json(c) if kind.startswith(("struct", "array", "map")) else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") if kind == "timestamp" else c).alias(f.name))
    return rows.select(*out)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def updated(rows: DataFrame, condition: Column, to: dict[str, Column]) -> DataFrame:
    """The snapshot in which rows of the condition have new values."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in to.items()})


def append_unseen(rows: DataFrame, path: str, keys: list[str], schema: StructType | str) -> int:
    """Append rows whose keys the JSON history at ``path`` doesn't hold yet; returns how many. One writer at a time."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(jsonl(spark, path, schema).select(*keys).distinct(), keys, "left_anti")
    rows = rows.dropDuplicates(keys).persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").json(path)
        return n
    finally:
        rows.unpersist()


def report(title: str, summary: dict, top: list[tuple[str, int]]) -> str:
    """Plain text of a collected digest."""
    lines = [title, *(f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in summary.items())]
    if top:
        lines += ["Top error signatures:", *(f"  - {n}x {s}" for s, n in top)]
    return "\n".join(lines)


def each_row(rows: DataFrame, make: Callable[[dict], str]) -> list[str]:
    """Text per row of a small, collected result."""
    return [make(r.asDict()) for r in rows.collect()]
