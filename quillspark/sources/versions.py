"""Versions of requests: a commit of several tables under one numbered entry, from batches that may come again.

A commit writes its rows (versions, artefacts, statuses, events, rejected results) into a folder of its own and then one entry of
the log, which names that folder. Entries are numbered, and the entry n + 1 can be written by one writer only: who finds it
taken counts version numbers anew on what is there now, and tries the next. Readers see what the entries name, so all tables
of a commit at once or none. An entry also names its batch: a batch that is there already isn't committed again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.lifecycle import version_gate
from quillspark.sources import shared

ENTRY = "number long, batch string, data string"
SCHEMAS = {
    "versions": "request_id long, version_number long, structured_json string, qa_report string, qa_status string, renderer_input_path string, final_path string, qa_path string, created_at timestamp",
    "artefacts": "request_id long, version_number long, kind string, path string, content_type string, owner string",
    "statuses": "request_id long, version_number long, status string, ready_at timestamp",
    "events": "request_id long, event_type string, payload string, created_at timestamp",
    "rejected": "request_id long, ord long, code string",
}
# Names of a version's files and their types.
FILES = {"input": ("input.json", "application/json"), "final": ("final.pdf", "application/pdf"), "qa": ("qa.json", "application/json")}


def entries(spark: SparkSession, root: str) -> list[tuple[int, str, str]]:
    """Number, batch and folder of each commit, in order: a few bytes per commit, on the driver."""
    if not shared.exists(spark, f"{root}/log"):
        return []
    return sorted((r["number"], r["batch"], r["data"]) for r in spark.read.schema(ENTRY).json(f"{root}/log/*.json").collect())


def read(spark: SparkSession, root: str, name: str, upto: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """The rows of a table in all commits (or in those given)."""
    found = entries(spark, root) if upto is None else upto
    if not found:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*[f"{data}/{name}" for _, _, data in found])


def _path(kind: str) -> Column:
    return F.concat(F.col("request_id").cast("string"), F.lit("/v"), F.col("version_number").cast("string"), F.lit(f"/{FILES[kind][0]}"))


def numbered(results: DataFrame, before: DataFrame) -> DataFrame:
    """Results with ``code`` (of the gate; null if they may be saved), ``version_number``, which goes on from those of ``before`` per request, in the order of ``ord``, and ``newest``: whether it's the request's last."""
    code = version_gate(F.col("request_status"), F.col("qa_status"), F.get_json_object("qa_report", "$.passed").try_cast("boolean"))
    last = before.groupBy("request_id").agg(F.max("version_number").alias("_last"))
    d = results.withColumn("code", code).join(last, "request_id", "left")
    one, own = F.col("code").isNull().cast("long"), W.partitionBy("request_id").orderBy("ord")
    d = d.withColumn("_saved", F.sum(one).over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum(one).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    d = d.withColumn("version_number", F.when(F.col("code").isNull(), F.coalesce("_last", F.lit(0)) + F.col("_saved")))
    return d.withColumn("newest", F.col("code").isNull() & (F.col("_saved") == F.col("_all"))).drop("_last", "_saved", "_all")


def commit(results: DataFrame, root: str, batch: str, at: Column, tries: int = 10) -> int:
    """Commit results (request_id, ord, structured_json, qa_report, request_status, qa_status, owner) as versions; returns the number of the entry.

    A batch that is committed already changes nothing, and its number is returned. Results that the gate refuses become rows of ``rejected``.
    The file of the structured form is the only one that may be missing: without one its path is null. Results of a request need different ``ord``.
    """
    spark = results.sparkSession
    for _ in range(tries):
        there = entries(spark, root)
        for number, name, _ in there:
            if name == batch:
                return number
        data = f"{root}/data/{uuid.uuid4().hex}"
        numbered(results, read(spark, root, "versions", there)).write.parquet(f"{data}/results")
        d = spark.read.parquet(f"{data}/results")
        ok = d.where("code is null").withColumn("renderer_input_path", F.when(F.col("structured_json").isNotNull(), _path("input"))).withColumns({"final_path": _path("final"), "qa_path": _path("qa"), "created_at": at})
        files = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("path"), F.lit(FILES[k][1]).alias("content_type")) for k, c in (("input", F.col("renderer_input_path")), ("final", F.col("final_path")), ("qa", F.col("qa_path")))])
        payload = F.to_json(F.struct("version_number", "qa_status"))
        tables = {
            "versions": ok,
            "artefacts": ok.select("request_id", "version_number", F.explode(files).alias("f"), "owner").select("request_id", "version_number", "f.*", "owner").where("path is not null"),
            "statuses": ok.where("newest").select("request_id", "version_number", F.col("request_status").alias("status"), at.alias("ready_at")),
            "events": ok.select("request_id", F.col("request_status").alias("event_type"), payload.alias("payload"), "created_at"),
            "rejected": d.where("code is not null"),
        }
        for name, rows in tables.items():
            names = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
            rows.select(*names).write.parquet(f"{data}/{name}")
        number = there[-1][0] + 1 if there else 1
        if shared.put_new(spark, f"{root}/log/{number:020d}.json", json.dumps({"number": number, "batch": batch, "data": data})):
            return number
        shared.delete(spark, data)  # another writer was first
    raise RuntimeError(f"{tries} commits in a row were overtaken")


def sink(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch of results is one commit, also if it comes again."""

    def act(batch: DataFrame, batch_id: int) -> None:
        commit(batch, root, f"{name}:{batch_id}", F.current_timestamp())

    return act


def current(requests: DataFrame, root: str) -> DataFrame:
    """Requests (id, status, ...) with the status and number of their newest version, where they have one."""
    s = read(requests.sparkSession, root, "statuses")
    new = s.groupBy("request_id").agg(F.max_by(F.struct("version_number", "status"), "version_number").alias("_new"))
    d = requests.join(new, requests["id"] == new["request_id"], "left")
    return d.select(*[(F.coalesce(F.col("_new.status"), F.col("status")) if c == "status" else F.col(f"`{c}`")).alias(c) for c in requests.columns], F.col("_new.version_number").alias("current_version"))
