"""Commits of versions, and functions for SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillspark.sources import shared, sql_functions, versions
from quillspark.streaming import events

RESULT = "request_id long, ord long, structured_json string, qa_report string, request_status string, qa_status string, owner string"
AT = lambda: F.lit("2025-01-01").cast("timestamp")


def good(request, ord, **other):
    row = {"structured_json": "{}", "qa_report": '{"passed": true}', "request_status": "ready", "qa_status": "passed", "owner": "o"} | other
    return (request, ord, *(row[k] for k in ("structured_json", "qa_report", "request_status", "qa_status", "owner")))


def numbers(spark, root):
    return sorted((r["request_id"], r["version_number"]) for r in versions.read(spark, root, "versions").collect())


def test_a_batch_is_committed_once(spark, tmp_path):
    root = tmp_path.as_uri()
    one = spark.createDataFrame([good(1, 2), good(1, 1, structured_json=None), good(2, 1, qa_status="failed"), good(3, 1, request_status="draft_ready", qa_status="draft", qa_report='{"passed": false}')], RESULT)
    assert versions.commit(one, root, "a", AT()) == 1 and versions.commit(one, root, "a", AT()) == 1
    assert versions.commit(spark.createDataFrame([good(1, 9)], RESULT), root, "b", AT()) == 2
    assert versions.commit(spark.createDataFrame([], RESULT), root, "empty", AT()) == 3
    assert numbers(spark, root) == [(1, 1), (1, 2), (1, 3), (3, 1)]
    v = {(r["request_id"], r["version_number"]): r for r in versions.read(spark, root, "versions").collect()}
    assert v[1, 1]["renderer_input_path"] is None and v[1, 2]["renderer_input_path"] == "1/v2/input.json" and v[1, 1]["final_path"] == "1/v1/final.pdf"
    assert [tuple(r) for r in versions.read(spark, root, "rejected").collect()] == [(2, 1, "unsupported_qa_status")]
    assert versions.read(spark, root, "artefacts").count() == 11
    assert sorted(r["event_type"] for r in versions.read(spark, root, "events").collect()) == ["draft_ready", "ready", "ready", "ready"]
    now = versions.current(spark.createDataFrame([(1, "processing"), (2, "processing"), (3, "x")], "id long, status string"), root)
    assert sorted(map(tuple, now.collect())) == [(1, "ready", 3), (2, "processing", None), (3, "draft_ready", 1)]


def test_the_later_of_two_writers_counts_anew(spark, tmp_path, monkeypatch):
    """Another commit takes the number between the reading of the log and the writing of the entry."""
    root = tmp_path.as_uri()
    put, calls = shared.put_new, []

    def overtaken(session, path, text):
        if not calls:
            calls.append(path)
            versions.commit(spark.createDataFrame([good(1, 1)], RESULT), root, "other", AT())
        return put(session, path, text)

    monkeypatch.setattr(shared, "put_new", overtaken)
    assert versions.commit(spark.createDataFrame([good(1, 5)], RESULT), root, "mine", AT()) == 2
    assert numbers(spark, root) == [(1, 1), (1, 2)] and [b for _, b, _ in versions.entries(spark, root)] == ["other", "mine"]
    assert len(list((tmp_path / "data").iterdir())) == 2  # nothing is left of the attempt


def test_micro_batches_come_again(spark, tmp_path):
    root, source = (tmp_path / "root").as_uri(), tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([good(1, k)], RESULT).coalesce(1).write.parquet((source / str(k)).as_uri())
    for checkpoint in ("one", "two"):  # a stream that has lost its checkpoint replays its batches under the same name
        q = events.polled(spark.readStream.schema(RESULT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source.as_uri()), versions.sink(root, "stream"), (tmp_path / checkpoint).as_uri(), once=True)
        q.awaitTermination()
    assert numbers(spark, root) == [(1, 1), (1, 2), (1, 3)] and len(versions.entries(spark, root)) == 3
    assert not shared.put_new(spark, f"{root}/log/{1:020d}.json", json.dumps({}))


def test_sql_functions(spark):
    rows = [(1, "failed", "normal", None, 0, "2024-01-01", "2024-01-01"), (2, "failed", "high", None, 0, "2024-01-01", "2024-01-03"), (3, "processing", "urgent", "2024-01-02", 1, "2024-01-01", "2024-01-02"), (4, "submitted", "urgent", None, 2, "2024-01-02", "2024-01-02"), (5, "submitted", "urgent", None, 3, "2024-01-01", "2024-01-02")]
    r = spark.createDataFrame(rows, "id long, status string, priority string, locked string, worker_attempts int, created string, updated string").selectExpr("id", "status", "priority", "CAST(locked AS TIMESTAMP) AS worker_locked_at", "worker_attempts", "CAST(created AS TIMESTAMP) AS created_at", "CAST(updated AS TIMESTAMP) AS updated_at")
    sql = sql_functions.registered(r).sql
    ids = lambda q: [x[0] for x in sql(q).collect()]
    assert ids("SELECT id FROM retryable_requests(hours => 24, as_of => TIMESTAMP '2024-01-03 12:00:00')") == [1]
    assert ids("SELECT id FROM stale_requests(as_of => TIMESTAMP '2024-01-02 00:06:00')") == [3] and ids("SELECT id FROM stale_requests(10, TIMESTAMP '2024-01-02 00:06:00')") == []
    assert ids("SELECT id FROM claimable_requests() ORDER BY rank, created_at, id LIMIT 5") == [4]
    assert sorted(map(tuple, sql("SELECT * FROM queue_counts()").collect())) == [("failed", 2), ("processing", 1), ("submitted", 2)]
    assert tuple(sql("SELECT request_rank('high'), retry_wait(3), retry_wait(1, base => 2D), safe_code(' A b!'), safe_code(NULL)").first()) == (1, 40.0, 2.0, "a_b_", "unknown")


def test_the_newest_of_a_batch_is_known_from_its_numbering(spark, tmp_path):
    """The status of a request follows without another grouping of its versions; refused results, first or last, are never the newest."""
    rows = [good(1, 1, qa_status="failed"), good(1, 2), good(1, 3, request_status="draft_ready", qa_status="draft", qa_report=None), good(1, 4, request_status="failed"), good(2, 1, qa_status="failed")]
    before = spark.createDataFrame([(1, 4)], "request_id long, version_number long")
    found = versions.numbered(spark.createDataFrame(rows, RESULT).repartition(3), before).select("request_id", "ord", "version_number", "newest").collect()
    assert sorted(map(tuple, found)) == [(1, 1, None, False), (1, 2, 5, False), (1, 3, 6, True), (1, 4, None, False), (2, 1, None, False)]
    versions.commit(spark.createDataFrame(rows, RESULT), tmp_path.as_uri(), "a", AT())
    assert [tuple(r)[:3] for r in versions.read(spark, tmp_path.as_uri(), "statuses").collect()] == [(1, 2, "draft_ready")]
