"""Functions that SQL can call: tables with arguments by name, and scalars. Bodies are SQL, so filters around a call are pushed into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEW = "quillspark_requests"
RETRYABLE, CLAIMABLE = "'failed', 'dead_letter', 'needs_human_review'", "'submitted', 'revision_requested'"
ATTEMPTS, LOCK_MINUTES = 3, 30
RANK = "CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 ELSE 2 END"

TABLES = {
    "retryable_requests(hours INT DEFAULT 1, as_of TIMESTAMP DEFAULT current_timestamp())": ("id BIGINT, status STRING, updated_at TIMESTAMP", f"SELECT id, status, updated_at FROM {VIEW} WHERE status IN ({RETRYABLE}) AND updated_at < as_of - make_interval(0, 0, 0, 0, hours)"),
    "stale_requests(minutes INT DEFAULT 5, as_of TIMESTAMP DEFAULT current_timestamp())": ("id BIGINT, worker_locked_at TIMESTAMP", f"SELECT id, worker_locked_at FROM {VIEW} WHERE status = 'processing' AND worker_locked_at < as_of - make_interval(0, 0, 0, 0, 0, minutes)"),
    # The caller orders by rank, created_at, id and limits: that is a distributed top-k, where a rank over all rows would be one task's sort.
    "claimable_requests(as_of TIMESTAMP DEFAULT current_timestamp())": (
        "id BIGINT, priority STRING, rank INT, created_at TIMESTAMP",
        f"SELECT id, priority, {RANK}, created_at FROM {VIEW} WHERE status IN ({CLAIMABLE}) AND (worker_locked_at IS NULL OR worker_locked_at < as_of - make_interval(0, 0, 0, 0, 0, {LOCK_MINUTES})) AND worker_attempts < {ATTEMPTS}",
    ),
    "queue_counts()": ("status STRING, n BIGINT", f"SELECT status, count(*) FROM {VIEW} GROUP BY status"),
}
SCALARS = {
    "request_rank(priority STRING)": ("INT", RANK),
    "retry_wait(attempt INT, base DOUBLE DEFAULT 10.0, most DOUBLE DEFAULT 300.0)": ("DOUBLE", "least(base * power(2D, greatest(attempt - 1, 0)), most)"),
    "safe_code(value STRING)": ("STRING", "coalesce(nullif(substring(regexp_replace(lower(trim(coalesce(value, ''))), '[^a-z0-9_:-]+', '_'), 1, 80), ''), 'unknown')"),
}


def registered(requests: DataFrame) -> SparkSession:
    """The session with these functions over a snapshot of requests (id, status, priority, worker_locked_at, worker_attempts, created_at, updated_at).

    They are the session's own, and follow the snapshot that was registered last.
    """
    spark = requests.sparkSession
    requests.createOrReplaceTempView(VIEW)
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return spark
