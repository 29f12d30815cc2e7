"""Digests of requests and of their event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.scalars import share

# Statuses and event types.
STATUSES = ("submitted", "processing", "qa_failed", "draft_ready", "ready", "revision_requested", "failed", "dead_letter", "cancelled", "archived", "needs_human_review")
BLOCKED = ("qa_failed", "failed", "dead_letter")
TERMINAL = ("failed", "qa_failed", "dead_letter", "needs_human_review", "ready", "draft_ready")


def known_status(status: Column, statuses: tuple[str, ...] = STATUSES) -> Column:
    return F.when(status.isin(*statuses), status).otherwise("unknown")


def by_status(requests: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    return requests.groupBy(known_status(F.col("status"), statuses).alias("status")).agg(F.count("*").alias("n"))


def rates(requests: DataFrame) -> DataFrame:
    """total and the rates of one row, 0 for no requests."""
    total = F.count("*")
    some = {"ready_rate": ("ready",), "draft_ready_rate": ("draft_ready",), "blocked_rate": BLOCKED, "needs_human_review_rate": ("needs_human_review",)}
    return requests.agg(total.alias("total"), *[share(F.count_if(F.coalesce(F.col("status").isin(*v), F.lit(False))), total).alias(k) for k, v in some.items()])


def top_errors(requests: DataFrame, n: int = 5, chars: int = 60) -> DataFrame:
    d = requests.where(F.col("status").isin(*BLOCKED, "needs_human_review")).select(F.substring(F.trim("last_error"), 1, chars).alias("error")).where("error != ''")
    return d.groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)


def summaries(events: DataFrame, key: str, terminal: tuple[str, ...], profile: str) -> DataFrame:
    """key, n, sequence, terminal (last of the terminal types, else last), first_profile of events (key, event_type, ts, event_id, payload).

    A sequence is as long as its request's log; everything else is an aggregate with map-side parts.
    """
    at = F.struct("ts", "event_id")
    ends = F.col("event_type").isin(*terminal)
    return events.groupBy(key).agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), " → ").alias("sequence"),
        F.coalesce(F.max_by(F.when(ends, F.col("event_type")), F.when(ends, at)), F.max_by("event_type", at)).alias("terminal"),
        F.min_by("payload", F.when(F.col("event_type") == profile, at)).alias("first_profile"),
    )


def signature(status: Column, category: Column, issues: Column, profile: Column, named: Column) -> Column:
    joined = F.array_join(F.slice(F.coalesce(issues, F.array().cast("array<string>")), 1, 5), "+")
    return F.concat_ws(
        "|", status, F.coalesce(category, F.lit("no_category")), F.when(joined == "", "no_specific_issue").otherwise(joined), F.coalesce(profile, F.lit("unknown_profile")), F.when(named, "first_name_present").otherwise("missing_first_name")
    )


def recommendations(category: Column, issues: Column, status: Column, profile: Column, named: Column) -> Column:
    """Priorities and rules that an incident's facts call for; the last one if no other does."""
    found = F.array_compact(
        F.array(
            F.when(~named, "P0:require_first_name"),
            F.when((category == "source_fidelity") & F.array_contains(issues, "source_coverage_missing_experience_item"), "P0:repair_missing_experience"),
            F.when(category == "contact_leak", "P0:locate_contact_leak"),
            F.when(category == "transient_model_failure", "P1:split_model_failures"),
            F.when((status == "needs_human_review") | (profile == "scanned"), "P1:review_path"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("P2:write_fixture"))).otherwise(found)


def incidents(rows: DataFrame) -> DataFrame:
    """signature, n, sample (least id) of rows (id, signature)."""
    return rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("id").alias("sample"))


def unseen(rows: DataFrame, history: DataFrame, *keys: str) -> DataFrame:
    return rows.join(history.select(*keys).distinct(), list(keys), "left_anti")


def stage_durations(events: DataFrame, key: str) -> DataFrame:
    """Adds micros (whole) and seconds since the event before of the same key; null for the first."""
    before = F.lag("ts").over(W.partitionBy(key).orderBy("ts", "event_id"))
    d = events.withColumn("micros", F.unix_micros("ts") - F.unix_micros(before))
    return d.withColumn("seconds", F.col("micros") / 1e6)
