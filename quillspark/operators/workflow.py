"""Steps of a request's life beside claiming: creation, queueing, failure, comments, reuse, and its state by the event log.

Requests are snapshots: each step returns the new snapshot and the events to append. Time is passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import text_of
from quillspark.operators.intents import error_category, issue_codes, issue_counts, revision_category, revision_intent
from quillspark.operators.lifecycle import latest
from quillspark.operators.limits import suppressed
from quillspark.operators.ops import STATUSES, TERMINAL

# Queue priorities, attempts and backoff, the seconds in which a comment repeats, sizes of messages and summaries.
PRIORITIES, NORMAL = {"urgent": 100, "high": 50, "normal": 10}, 10
ATTEMPTS, BACKOFF, BACKOFF_MS = 3, "exponential", 5000
REPEAT_US, MESSAGE_CHARS, HISTORY_ISSUES = 10_000_000, 500, 3
PDF = "application/pdf"


def creation_error(id: Column, path: Column, first_name: Column, size: Column, mime: Column, is_pdf: Column, most_bytes: int) -> Column:
    """Why an upload can't become a request, else null. The first failing test counts; a null mime type is a PDF's, a null size 0."""
    blank = lambda c: F.trim(text_of(c)) == ""
    return (
        F.when((text_of(id) == "") | (text_of(path) == ""), "request_failed")
        .when(blank(first_name), "candidate_first_name_required")
        .when(F.coalesce(size, F.lit(0)) > most_bytes, "file_too_large")
        .when((F.coalesce(mime, F.lit(PDF)) != PDF) | ~F.coalesce(is_pdf, F.lit(False)), "pdf_required")
    )


def enqueued(requests: DataFrame, as_of: Column, attempts: int = ATTEMPTS) -> DataFrame:
    """One job per request; an unknown or null priority is normal."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), "priority"), F.lit(NORMAL))
    return requests.select(F.col("id").alias("request_id"), rank.alias("priority"), F.lit(attempts).alias("attempts"), F.lit(BACKOFF).alias("backoff_type"), F.lit(BACKOFF_MS).alias("backoff_ms"), as_of.alias("enqueued_at"))


def retry_delay(attempt: Column, delay_ms: int = BACKOFF_MS) -> Column:
    """Milliseconds before the attempt after ``attempt`` (from 1), doubling."""
    return (F.lit(delay_ms) * F.pow(F.lit(2), attempt - 1)).cast("long")


def known(status: Column) -> Column:
    """The status; reading an unknown one fails, a null passes."""
    return F.when(status.isNull() | status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), text_of(status))))


def failed(requests: DataFrame, failures: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Snapshot and events after ``failures`` (id, at, status, error, message); of a request's failures the last one is stored, each has its event.

    ``message`` is what may be shown; the payload has the category, and the codes and counts that ``error`` names. Failures of no request are left out.
    """
    f = failures.join(requests.select("id"), "id", "left_semi").withColumn("message", F.substring("message", 1, MESSAGE_CHARS))
    last = latest(f.select("id", "at", "status", "message"), "id", "at", "status", "message").select("id", F.col("status").alias("_status"), F.col("message").alias("_error"))
    hit = F.col("_status").isNotNull()
    to = {"status": F.col("_status"), "last_error": F.col("_error"), "updated_at": as_of}
    snapshot = requests.join(last, "id", "left").withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in to.items()}).select(*requests.columns)
    codes, (hard, soft) = issue_codes(F.col("error")), issue_counts(F.col("error"))
    both = hard.isNotNull() & soft.isNotNull()
    payload = F.struct(
        F.col("message").alias("error"),
        error_category(F.col("error")).alias("error_category"),
        F.when(F.size(codes) > 0, codes).alias("fidelity_issues"),
        F.when(both, hard).alias("fidelity_hard_count"),
        F.when(both, soft).alias("fidelity_soft_count"),
    )
    return snapshot, f.select(F.col("id").alias("request_id"), F.col("status").alias("event_type"), F.to_json(payload).alias("payload"), F.col("at").alias("created_at"))


def commented(requests: DataFrame, versions: DataFrame, comments: DataFrame, new: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted comments, snapshot and events after ``new`` (comment_id, request_id, body, category, created_at).

    Blank bodies and comments on no request are left out, and so are those that repeat an open revision comment (of
    ``comments``: request_id, version_id, body, comment_type, resolved, created_at) or one of ``new`` within ten seconds.
    """
    about = requests.select(F.col("id").alias("request_id"), F.col("current_version_id").alias("version_id"), F.col("status").alias("from_status"))
    n = new.withColumn("body", F.trim("body")).where("body != ''").join(about, "request_id")
    o = comments.where("comment_type = 'revision' and not resolved").select("request_id", "version_id", "body", F.col("created_at").alias("_before"))
    gap = F.unix_micros(n["created_at"]) - F.unix_micros(o["_before"])
    n = n.join(o, (n["request_id"] == o["request_id"]) & (n["body"] == o["body"]) & n["version_id"].eqNullSafe(o["version_id"]) & gap.between(0, REPEAT_US), "left_anti")
    keep = suppressed(n, ["request_id", "version_id", "body"], REPEAT_US, "created_at", "comment_id").where("kept").select("comment_id")
    n = n.join(keep, "comment_id", "left_semi").withColumn("category", revision_category(F.col("category")))
    accepted = n.select("comment_id", "request_id", "version_id", "body", F.lit("revision").alias("comment_type"), F.to_json(F.struct("category")).alias("metadata"), F.lit(False).alias("resolved"), "created_at")
    hit = F.col("_hit").isNotNull()
    to = {"status": F.lit("revision_requested"), "worker_locked_at": F.lit(None), "worker_locked_by": F.lit(None), "updated_at": as_of}
    snapshot = requests.join(n.select(F.col("request_id").alias("id"), F.lit(True).alias("_hit")).distinct(), "id", "left").withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in to.items() if k in requests.columns}).select(*requests.columns)
    v = versions.select(F.col("id").alias("version_id"), "version_number", "qa_status")
    payload = F.to_json(F.struct(F.lit(True).alias("source_reused"), "version_id", "version_number", "qa_status", "from_status", F.col("category").alias("feedback_category")))
    events = n.join(v, "version_id", "left").select("request_id", F.lit("revision_requested").alias("event_type"), payload.alias("payload"), "created_at")
    return accepted, snapshot, events


def with_version(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests with ``version``, the struct of their current version; null if they have none."""
    v = versions.select(F.col("id").alias("current_version_id"), F.struct(*versions.columns).alias("version"))
    return requests.join(v, "current_version_id", "left")


def reusable(requests: DataFrame, versions: DataFrame, comments: DataFrame) -> DataFrame:
    """request_id, version_id, version_number, structured_json, qa_report of requests with an open revision comment that asks for layout only.

    The current version's structured form is used again, if it has one.
    """
    asks = comments.where("comment_type = 'revision' and not resolved").where(revision_intent(F.col("body")) == "layout_only").select(F.col("request_id").alias("id")).distinct()
    v = versions.where("structured_json is not null and structured_json != ''").select(F.col("id").alias("current_version_id"), "version_number", "structured_json", "qa_report")
    d = requests.select("id", "current_version_id").join(asks, "id", "left_semi").join(v, "current_version_id")
    return d.select(F.col("id").alias("request_id"), F.col("current_version_id").alias("version_id"), "version_number", "structured_json", "qa_report")


def resolved(comments: DataFrame, done: DataFrame) -> DataFrame:
    """Comments with the revision comments of the requests ``done`` (id) marked resolved."""
    d = comments.join(done.select(F.col("id").alias("request_id"), F.lit(True).alias("_done")).distinct(), "request_id", "left")
    return d.withColumn("resolved", F.col("resolved") | (F.col("_done").isNotNull() & F.coalesce(F.col("comment_type") == "revision", F.lit(False)))).select(*comments.columns)


def history(version_number: Column, qa_status: Column, issues: Column) -> Column:
    """A comment on the version before, with its first three issues (array of struct code, message, snippet)."""

    def one(x: Column) -> Column:
        said = F.trim(F.coalesce(F.when(x["message"] != "", x["message"]), x["snippet"], F.lit("")))
        code = F.trim(text_of(x["code"]))
        return F.concat(F.when(code == "", "point_qualite").otherwise(code), F.when(said == "", "").otherwise(F.concat(F.lit(": "), said)))

    told = F.array_join(F.transform(F.slice(F.filter(F.coalesce(issues, F.array()), lambda x: x.isNotNull()), 1, HISTORY_ISSUES), one), "; ")
    head = F.concat(F.lit("Historique utile: version V"), F.coalesce(version_number.cast("string"), F.lit("None")), F.lit(" (qa="), F.coalesce(F.when(qa_status != "", qa_status), F.lit("unknown")), F.lit(")."))
    return F.concat(head, F.when(told == "", "").otherwise(F.concat(F.lit(" Points qualité précédents: "), told, F.lit("."))))


def state_of(event_type: Column) -> Column:
    """The status that an event puts its request into; null for events that leave it."""
    return F.when(event_type == "worker_claimed", "processing").when(event_type == "unlocked", "submitted").when(event_type.isin(*TERMINAL, "revision_requested"), event_type)


def states(events: DataFrame, key: str = "request_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """key, status, n_changes, claims by the whole log of each request: submitted until an event says otherwise.

    The last event that changes the state decides, so the machine is one aggregate with map-side parts, and runs on a stream as it is.
    """
    to, at = state_of(F.col("event_type")), F.struct(ts, order)
    return events.groupBy(key).agg(F.coalesce(F.max_by(to, F.when(to.isNotNull(), at)), F.lit("submitted")).alias("status"), F.count(to).alias("n_changes"), F.count_if(F.col("event_type") == "worker_claimed").alias("claims"))
