"""Requests as snapshots: claiming, unlocking, versions, gates. Time is passed in as ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Statuses, attempts, and minutes until a lock expires.
CLAIMABLE, RETRYABLE = ("submitted", "revision_requested"), ("failed", "dead_letter", "needs_human_review")
IN_PROGRESS = ("submitted", "processing", "revision_requested")
MOST_ATTEMPTS, LOCK_MINUTES = 3, 30


def priority_rank(priority: Column, urgent: str = "urgent", high: str = "high") -> Column:
    return F.when(priority == urgent, 0).when(priority == high, 1).otherwise(2)


def requeued(requests: DataFrame, as_of: Column) -> DataFrame:
    """Failed rows without a first name (empty, not null) and without attempts left are submitted again."""
    stuck = (F.col("status") == "failed") & (F.col("candidate_first_name") == "") & (F.col("worker_attempts") >= MOST_ATTEMPTS)
    stuck = F.coalesce(stuck, F.lit(False))
    to = {"status": F.lit("submitted"), "worker_locked_at": F.lit(None), "worker_locked_by": F.lit(None), "worker_attempts": F.lit(0), "last_error": F.lit(None), "updated_at": as_of}
    return requests.withColumns({k: F.when(stuck, v).otherwise(F.col(k)) for k, v in to.items() if k in requests.columns})


def claimable(as_of: Column) -> Column:
    free = F.col("worker_locked_at").isNull() | (F.col("worker_locked_at") < as_of - F.expr(f"interval {LOCK_MINUTES} minutes"))
    return F.col("status").isin(*CLAIMABLE) & free & (F.col("worker_attempts") < MOST_ATTEMPTS)


def claimed(requests: DataFrame, worker: str, as_of: Column, count: int = 1) -> DataFrame:
    """The snapshot after ``worker`` claims the first ``count`` rows by priority, age and id. One writer owns claims.

    The top rows are found by a distributed top-k, and joined back by id.
    """
    d = requeued(requests, as_of)
    top = d.where(claimable(as_of)).orderBy(priority_rank(F.col("priority")), "created_at", "id").limit(count).select("id", F.lit(True).alias("_take"))
    d = d.join(F.broadcast(top), "id", "left")  # at most ``count`` rows
    take = F.coalesce("_take", F.lit(False))
    to = {"status": F.lit("processing"), "worker_locked_at": as_of, "worker_locked_by": F.lit(worker), "worker_attempts": F.col("worker_attempts") + 1, "started_at": F.coalesce("started_at", as_of), "updated_at": as_of}
    return d.withColumns({k: F.when(take, v).otherwise(F.col(k)) for k, v in to.items()}).select(*requests.columns)


def unlocked(requests: DataFrame, request_id: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The snapshot with one request submitted again, and the event to append; both empty of change if its status isn't retryable."""
    hit = (F.col("id") == request_id) & F.col("status").isin(*RETRYABLE)
    to = {"status": F.lit("submitted"), "worker_attempts": F.lit(0), "last_error": F.lit(None), "worker_locked_at": F.lit(None), "worker_locked_by": F.lit(None), "started_at": F.lit(None), "submitted_at": as_of, "updated_at": as_of}
    events = requests.where(hit).select(F.col("id").alias("request_id"), F.lit("unlocked").alias("event_type"), F.lit("system").alias("actor_type"), F.to_json(F.struct(F.col("status").alias("from_status"), F.lit(0).alias("worker_attempts_reset_to"))).alias("payload"), as_of.alias("created_at"))
    return requests.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in to.items() if k in requests.columns}), events


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key by ``order``, as one aggregate without a sort of each key's rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(key, "_x.*")


def numbered(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds version_number from 1 per key."""
    return versions.withColumn("version_number", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def stale(requests: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    return requests.where((F.col("status") == "processing") & (F.col("worker_locked_at") < as_of - F.expr(f"interval {minutes} minutes")))


def retryable(requests: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    return requests.where(F.col("status").isin(*RETRYABLE) & (F.col("updated_at") < as_of - F.expr(f"interval {hours} hours"))).orderBy("updated_at")


def version_gate(status: Column, qa_status: Column, passed: Column) -> Column:
    """A code for the six combinations of request status, QA status and QA report that mustn't be saved, else null."""
    ok = F.coalesce(passed, F.lit(False))
    return (
        F.when(~status.isin("ready", "draft_ready"), "unsupported_status")
        .when(~qa_status.isin("passed", "draft"), "unsupported_qa_status")
        .when((status == "ready") & (qa_status != "passed"), "ready_without_passed_qa")
        .when((status == "draft_ready") & (qa_status != "draft"), "draft_without_draft_qa")
        .when((status == "ready") & ~ok, "ready_without_passing_report")
        .when((status == "draft_ready") & ok, "draft_with_passing_report")
    )


def owned(rows: DataFrame, owner: Column, metadata: str = "metadata", field: str = "owner") -> DataFrame:
    """Rows whose JSON metadata name the owner; null or unreadable metadata has none."""
    return rows.where(F.get_json_object(metadata, f"$.{field}") == owner)


# Labels of requests, and their progress in per cent.
LABELS = {
    "needs_human_review": "Validation humaine", "draft_ready": "Brouillon prêt", "ready": "Prêt à télécharger", "qa_failed": "Contrôle qualité", "failed": "À corriger", "dead_letter": "À corriger",
    "revision_requested": "À corriger", "extraction_done": "Mise au format", "processing": "Analyse du CV", "submitted": "En attente", "cancelled": "Annulé", "archived": "Archivé",
}


def label(status: Column, events: Column, brand: str = "") -> Column:
    """What a request is called by its status and the types of its events; a status of review or draft outweighs an earlier ready event.

    ``brand`` is the name of the format that an extracted request is put into.
    """
    had = lambda e: F.coalesce(F.array_contains(events, e), F.lit(False))
    named = F.when(status.isin("needs_human_review", "draft_ready"), status).when((status == "ready") | had("ready"), "ready")
    named = F.coalesce(named, F.when(status.isin("qa_failed", "failed", "dead_letter", "revision_requested"), status), F.when(had("extraction_done"), "extraction_done"), F.when((status == "processing") | had("worker_claimed"), "processing"), status)
    labels = LABELS | {"extraction_done": f"{LABELS['extraction_done']} {brand}".strip()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), named), F.lit("En attente"))


def progress(status: Column, events: Column) -> Column:
    """Per cent of the way that a request has gone."""
    had = lambda e: F.coalesce(F.array_contains(events, e), F.lit(False))
    return (
        F.when((status == "ready") | had("ready") | (status == "draft_ready"), 100)
        .when(status == "needs_human_review", 50)
        .when(status.isin("failed", "dead_letter"), 100)
        .when(status == "qa_failed", 85)
        .when(had("extraction_done"), 60)
        .when((status == "processing") | had("worker_claimed"), 35)
        .when(status == "revision_requested", 20)
        .when(status.isin("cancelled", "archived"), 0)
        .otherwise(15)
    )
