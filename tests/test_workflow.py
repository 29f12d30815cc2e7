"""Steps of a request's life, display of checks, and blocks on small fixtures."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import blocks, display, fidelity, splitter, workflow

NOW = datetime(2024, 5, 1, 12)
REQUESTS = "id string, status string, current_version_id string, last_error string, worker_locked_at timestamp, worker_locked_by string, updated_at timestamp"


def requests(spark, *rows):
    return spark.createDataFrame([(i, s, v, None, NOW, "w", None) for i, s, v in rows], REQUESTS)


def test_creation_errors(spark):
    rows = [("a", "p", "Jo", 5, None, True), ("", "p", "Jo", 5, None, True), ("a", "p", " ", 5, None, True), ("a", "p", "Jo", 11, None, True), ("a", "p", "Jo", None, "text/plain", True), ("a", "p", "Jo", 1, None, None), (None,) * 6]
    d = spark.createDataFrame(rows, "id string, path string, name string, size long, mime string, pdf boolean")
    got = [r[0] for r in d.select(workflow.creation_error(*[F.col(c) for c in d.columns], most_bytes=10)).collect()]
    assert got == [None, "request_failed", "candidate_first_name_required", "file_too_large", "pdf_required", "pdf_required", "request_failed"]


def test_queue_jobs(spark):
    d = spark.createDataFrame([("a", "urgent"), ("b", "odd"), ("c", None)], "id string, priority string")
    got = workflow.enqueued(d, F.lit(NOW)).orderBy("request_id").collect()
    assert [(r.priority, r.attempts, r.backoff_ms) for r in got] == [(100, 3, 5000), (10, 3, 5000), (10, 3, 5000)]
    assert spark.range(1, 4).select(workflow.retry_delay(F.col("id"))).collect() == [(5000,), (10000,), (20000,)]


def test_known_status(spark):
    d = spark.createDataFrame([("ready",), (None,)], "s string")
    assert d.select(workflow.known(F.col("s"))).count() == 2
    with pytest.raises(Exception, match="unknown status: odd"):
        spark.createDataFrame([("odd",)], "s string").select(workflow.known(F.col("s"))).collect()


def test_failures(spark):
    f = spark.createDataFrame(
        [("a", NOW, "failed", "x", "first"), ("a", NOW + timedelta(seconds=1), "dead_letter", "fidelity_issues=[p, q] hard_count=2 soft_count=1", "m" * 600), ("z", NOW, "failed", "x", "x")],
        "id string, at timestamp, status string, error string, message string",
    )
    snapshot, events = workflow.failed(requests(spark, ("a", "processing", None), ("b", "ready", None)), f, F.lit(NOW))
    got = {r.id: r for r in snapshot.collect()}
    assert got["a"].status == "dead_letter" and len(got["a"].last_error) == 500 and got["a"].updated_at == NOW
    assert got["b"].status == "ready" and got["b"].last_error is None
    last = events.orderBy("created_at").collect()[-1]
    assert events.count() == 2 and last.event_type == "dead_letter" and '"fidelity_issues":["p","q"]' in last.payload and '"fidelity_hard_count":2' in last.payload


def test_comments(spark):
    r = requests(spark, ("a", "ready", "v1"), ("b", "ready", None), ("c", "ready", None))
    v = spark.createDataFrame([("v1", 3, "draft")], "id string, version_number int, qa_status string")
    old = spark.createDataFrame([("b", None, "hello", "revision", False, NOW)], "request_id string, version_id string, body string, comment_type string, resolved boolean, created_at timestamp")
    s = lambda n: NOW + timedelta(seconds=n)
    rows = [(1, "a", " fix ", "missing_content", s(0)), (2, "a", "fix", None, s(10)), (3, "a", "fix", "odd", s(11)), (4, "b", "hello", None, s(9)), (5, "b", "hello", None, s(11)), (6, "c", "  ", None, s(0)), (7, "none", "x", None, s(0)), (8, "c", None, None, s(0))]
    new = spark.createDataFrame(rows, "comment_id long, request_id string, body string, category string, created_at timestamp")
    accepted, snapshot, events = workflow.commented(r, v, old, new, F.lit(NOW))
    assert [x.comment_id for x in accepted.orderBy("comment_id").collect()] == [1, 3, 5]
    assert {x.id: (x.status, x.worker_locked_by) for x in snapshot.collect()} == {"a": ("revision_requested", None), "b": ("revision_requested", None), "c": ("ready", "w")}
    first = events.where("request_id = 'a'").orderBy("created_at").first().payload
    assert '"version_number":3' in first and '"from_status":"ready"' in first and '"feedback_category":"missing_content"' in first


def test_reuse_and_resolution(spark):
    r = requests(spark, ("a", "revision_requested", "v1"), ("b", "revision_requested", "v2"), ("c", "revision_requested", None))
    v = spark.createDataFrame([("v1", 1, "{}", "{}"), ("v2", 2, None, "{}")], "id string, version_number int, structured_json string, qa_report string")
    ask = "remonter en page 1"
    c = spark.createDataFrame([("a", ask, "revision", False), ("b", ask, "revision", False), ("c", ask, "revision", False), ("a", ask, "note", False)], "request_id string, body string, comment_type string, resolved boolean")
    assert [x.request_id for x in workflow.reusable(r, v, c).collect()] == ["a"]
    done = workflow.resolved(c, spark.createDataFrame([("a",), ("a",)], "id string"))
    assert sorted((x.request_id, x.comment_type, x.resolved) for x in done.collect()) == [("a", "note", False), ("a", "revision", True), ("b", "revision", False), ("c", "revision", False)]
    assert {x.id: x.version and x.version.version_number for x in workflow.with_version(r, v).collect()} == {"a": 1, "b": 2, "c": None}


def test_history(spark):
    kind = "n int, qa string, issues array<struct<code:string,message:string,snippet:string>>"
    d = spark.createDataFrame([(2, "passed", [("x", "m", "s"), ("", "", "s"), (None, None, None), ("y", "", "")]), (None, None, None)], kind)
    got = [x[0] for x in d.select(workflow.history(F.col("n"), F.col("qa"), F.col("issues"))).collect()]
    assert got == ["Historique utile: version V2 (qa=passed). Points qualité précédents: x: m; point_qualite: s; point_qualite.", "Historique utile: version VNone (qa=unknown)."]


def test_states(spark):
    rows = [("a", 1, "worker_claimed"), ("a", 2, "extraction_done"), ("b", 1, "failed"), ("b", 2, "unlocked"), ("b", 3, "quality_source_profiled"), ("c", 1, "extraction_done"), ("d", 1, "ready"), ("d", 1, "revision_requested")]
    d = spark.createDataFrame([(k, t, i, e) for i, (k, t, e) in enumerate(rows)], "request_id string, ts int, event_id int, event_type string")
    got = {x.request_id: (x.status, x.n_changes, x.claims) for x in workflow.states(d).collect()}
    assert got == {"a": ("processing", 1, 1), "b": ("submitted", 2, 0), "c": ("submitted", 0, 0), "d": ("revision_requested", 2, 0)}
    assert workflow.states(d.limit(0)).count() == 0


def test_blocks(spark):
    rows = [("Jane  Doe\r\n\r\nmail j.doe@x.org, linkedin.com/in/jd; 01 23 45 67 89 https://a.b/c\n C++ by DOE", ["Doe", " jane ", "C++", ""], "Jane"), (None, None, None), ("1 one\n 2 two", [None, "one"], "")]
    d = spark.createDataFrame(rows, "text string, terms array<string>, first_name string")
    a, b, c = blocks.sanitised(d).collect()
    assert a.text == "Jane\nmail , ;\nC++ by" and (a.n_linkedin, a.n_email, a.n_phone, a.n_url, a.n_identity) == (1, 1, 1, 1, 2)
    assert b.text == "" and b.n_identity == 0
    assert c.text == "1\n2 two" and c.n_identity == 1


def test_rationale(spark):
    rows = [("Jean Paul Martin",), ("Sidebar Heavy",), ("call +33 1 23 45 67 89",), (None,), ("see /in/jdoe",)]
    got = [x[0] for x in spark.createDataFrame(rows, "t string").select(blocks.unsafe_rationale(F.col("t"))).collect()]
    assert got == [True, False, True, False, True]


def test_skill_flags(spark):
    rows = [("a", "Dev", ["Java", " java ", ""]), ("a", "Autres — suite", ["x"]), ("b", "Dev", [f"s{i}" for i in range(61)]), ("c", None, None), ("d", "Dev", ["1a", "1"])]
    d = spark.createDataFrame(rows, "doc_id string, category string, items array<string>")
    got = {(x.doc_id, x.code): x.n for x in display.skill_flags(d).collect()}
    assert got == {("a", "duplicate_skill_items"): 1, ("a", "continued_autres_category"): 1, ("a", "too_many_autres_items"): 1, ("a", "autres_dominates_skills"): 1, ("b", "too_many_skill_items"): 61}


def test_labels(spark):
    d = spark.createDataFrame([("page_too_dense", "a\n\n b", None, 2), ("odd", " ", "s" * 130, 0), (None, None, None, None)], "c string, m string, s string, p int")
    got = [x[0] for x in d.select(display.draft_warning(F.col("c"), F.col("m"), F.col("s"), F.col("p"))).collect()]
    assert got == ["Page 2 · Page trop dense — a b", "Point qualité à vérifier — " + "s" * 120, "Point qualité à vérifier"]
    n = spark.createDataFrame([("49.5",), ("-3",), ("1e9",), ("x",), (None,), ("NaN",)], "v string")
    assert [x[0] for x in n.select(display.clamped(F.col("v"))).collect()] == [50, 0, 100, 0, 0, 0]


def test_packing_options(spark):
    d = spark.createDataFrame([([3, 20],), ([31, 5],), ([],), (None,)], "h array<int>")
    got = [(x.o.force_new_page, x.o.breaks) for x in d.select(display.packing_options(F.col("h")).alias("o")).collect()]
    assert got == [(False, []), (True, [1]), (True, []), (True, [])]
    assert d.limit(1).select(display.packing_options(F.col("h"), F.lit(False)).alias("o")).first().o.breaks == []


def test_lines_keep_digits_and_lose_blanks(spark):
    """Lines and items are trimmed of blanks, not of the digits of their position."""
    d = spark.createDataFrame([("0 zero 0\n  1 one 1\n2 two 2 ",)], "t string")
    assert d.select(splitter._lines(F.col("t"))).first()[0] == ["0 zero 0", "1 one 1", "2 two 2"]
    kind = "x array<struct<date:string,company_highlight:string,role:string,sections:array<struct<heading:string,content:array<string>>>>>"
    e = spark.createDataFrame([([("2019", "", "", [("Missions", ["0 premier fait 0", " 1 second fait 1 "])])],)], kind)
    assert e.select(fidelity.required_facts(F.col("x"))).first()[0] == ["2019", "0 premier fait 0", "1 second fait 1"]


def test_terms_and_contacts_leave_a_block_with_their_numbers(spark):
    """Counted by what is gone; texts without a contact's mark aren't searched for it, and letters are compared before borders."""
    rows = [(1, "The other, THE theme; a.b@example.org\n+33 6 12 34 56 78 the", ["the", "c+"]), (2, "no contact, C+ c+d", ["c+"]), (3, "Été été étés", ["été"])]
    out = blocks.sanitised(spark.createDataFrame(rows, "i int, text string, terms array<string>").withColumn("first_name", F.lit("x"))).orderBy("i").collect()
    assert [(r["text"], r["n_email"], r["n_phone"], r["n_identity"]) for r in out] == [("other, theme;", 1, 1, 3), ("no contact, C+ d", 0, 0, 1), ("étés", 0, 0, 2)]
    pattern = spark.range(1).select(blocks.whole_word(F.lit("c+"))).first()[0]
    assert pattern == r"(?iuU)(?=c\+)\bc\+\b"
