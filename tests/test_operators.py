"""Operators that SQL can't express, and awkward cases, against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import scalars, text
from quillspark.operators import coverage, intents, lifecycle, limits, ops, packing, profile, qa, sanitize, segment, taxonomy
from quillspark.sources import files
from quillspark.sources.query import TableQuery
from quillspark.streaming import events as stream

SANITISED = [
    ("Jean\nEmail :\njean.dupont@mail.example.fr\n06 12 34 56 78\nDéveloppeur Java", "Jean\nDéveloppeur Java", {"email": 1, "phone": 1, "label": 1, "empty": 2}),
    ("TJM : 500\nMobilité : Paris\nMission chez un client", "Mission chez un client", {"noise": 2}),
    ("12 rue des Lilas\n75001 Paris\nProjet 75001 Paris mission", "Projet 75001 Paris mission", {"address": 2}),
    ("Adresse : ici\n\n\n\nC# .NET et GitHub Actions", "C# .NET et GitHub Actions", {"address": 1}),
    ("Voir https://site.example.com/x et www.a.fr (lien : )", "Voir et", {"url": 2}),
    ("https://www.linkedin.com/in/abc\ngithub.com/abc suite", "suite", {"linkedin": 1, "github": 1, "empty": 1}),
    ("outil Hellowork pour le cv\noutil Hellowork interne", "outil Hellowork interne", {"noise": 1}),
]


def test_sanitiser(spark):
    rows = [(i, t) for i, (t, *_) in enumerate(SANITISED)] + [(90, None), (91, ""), (92, "x " * 20000)]
    got = {r["doc_id"]: r for r in sanitize.sanitised(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, (_, clean, counts) in enumerate(SANITISED):
        assert got[i]["clean_text"] == clean
        for k in ("email", "phone", "linkedin", "github", "url", "noise", "label", "address", "empty"):
            assert got[i][f"n_{k}"] == counts.get(k, 0), (i, k)
    assert got[90]["clean_text"] == got[91]["clean_text"] == "" and got[90]["too_short"] and not got[92]["too_short"]


def test_sanitising_twice_is_sanitising_once(spark):
    rows = [(i, t) for i, (t, *_) in enumerate(SANITISED)]
    once = sanitize.sanitised(spark.createDataFrame(rows, "doc_id int, text string"))
    twice = sanitize.sanitised(once.select("doc_id", F.col("clean_text").alias("text")))
    assert sorted(once.select("doc_id", "clean_text").collect()) == sorted(twice.select("doc_id", "clean_text").collect())
    assert once.where(sanitize.looks_like_contact(F.col("clean_text"))).count() == 0


def test_guard_raises(spark):
    sanitize.asserted_redacted(spark.createDataFrame([("ok", 3)], "a string, b int")).collect()
    with pytest.raises(Exception, match="contact"):
        sanitize.asserted_redacted(spark.createDataFrame([("write to a.b@c.org", 3)], "a string, b int")).collect()


def test_profiles(spark):
    rows = [(0, None, "scanned"), (1, "", "scanned"), (2, "TJM 3\npermis B\ndisponibilité", "ats"), (3, "mission " * 10 + "x" * 300, "senior_long"), (4, "court\n" * 60, "two_column"), (5, "y" * 9001, "senior_long"), (6, "z" * 400, "normal"), (7, "missions clients " * 30, "normal")]
    got = {r["id"]: r for r in profile.profiled(spark.createDataFrame(rows, "id int, text string, want string")).collect()}
    assert all(r["profile"] == r["want"] for r in got.values())
    assert got[0]["needs_review"] and got[6]["needs_review"] and not got[4]["needs_review"]


def chunked(lines, target):
    parts, held = [], []
    for x in lines:
        if held and len("\n".join([*held, x])) > target:
            parts.append(held)
            held = []
        held.append(x)
    return [*parts, held]


def test_chunks(spark):
    rnd = random.Random(1)
    texts = ["\n".join("w" * rnd.randint(1, 60) for _ in range(rnd.randint(1, 40))) for _ in range(30)] + ["", "a" * 500, None]
    got = segment.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), target=100).orderBy("doc_id", "part").collect()
    want = [(i, k, len("\n".join(c)), len(c)) for i, t in enumerate(texts) for k, c in enumerate(chunked((t or "").split("\n"), 100) if len(t or "") > 100 else [(t or "").split("\n")], 1)]
    assert [tuple(r) for r in got] == want


def breaks(heights, capacity):
    out, used = [], 0
    for i, h in enumerate(heights):
        if i and (used + h <= capacity or used < 10 and used + h <= capacity + 3):
            used += h
            continue
        if i:
            out.append(i)
        used = min(h, capacity)
    return out


def test_page_breaks(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.randint(3, 15) for _ in range(rnd.randint(0, 12))]) for i in range(60)]
    got = spark.createDataFrame(rows, "id int, h array<int>").select("id", packing.page_breaks(F.col("h")).alias("b")).collect()
    assert {r["id"]: r["b"] for r in got} == {i: breaks(h, packing.CAPACITY) for i, h in rows}
    units = spark.sql("select array(10, 117, 1000) as l").select(packing.units(F.lit(2), F.col("l"))).first()[0]
    assert units == 2 + 2 + 1 + 2 + 3


def test_suppression_and_limit(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice("ab"), start + dt.timedelta(seconds=rnd.randint(0, 200))) for i in range(120)] + [(500, "c", start), (501, "c", start + dt.timedelta(seconds=60)), (502, "c", start)]
    d = spark.createDataFrame(rows, "event_id long, k string, ts timestamp")
    kept, calls = {}, {}
    for key in "abc":
        last, seen = None, []
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            kept[i] = last is None or t - last > dt.timedelta(seconds=10)
            last = t if kept[i] else last
            seen = [s for s in seen if s > t - dt.timedelta(seconds=60)] + [t]
            calls[i] = len(seen)
    assert {r["event_id"]: r["kept"] for r in limits.suppressed(d, ["k"], 10_000_000).collect()} == kept
    assert {r["event_id"]: r["calls"] for r in limits.rate_limited(d, ["k"], 5, 60_000_000).collect()} == calls


def test_circuit_breaker():
    now = [0.0]
    b = limits.CircuitBreaker(lambda: now[0], most=2, wait=10)
    b.failed()
    assert b.state == "closed"
    b.failed()
    assert b.state == "open" and not b.allows()
    now[0] = 10
    assert b.state == "half_open" and b.allows()
    b.failed()
    assert b.state == "open"
    now[0] = 30
    b.succeeded()
    assert b.state == "closed"


REQUEST = "id string, status string, priority string, candidate_first_name string, worker_locked_at timestamp, worker_locked_by string, worker_attempts int, last_error string, created_at timestamp, submitted_at timestamp, started_at timestamp, updated_at timestamp"


def request(i, status="submitted", priority="normal", name="N", locked=None, attempts=0, age=60):
    now = dt.datetime(2024, 1, 2)
    at = now - dt.timedelta(minutes=age)
    return (i, status, priority, name, None if locked is None else now - dt.timedelta(minutes=locked), None, attempts, None, at, at, None, at)


def test_claim_and_unlock(spark):
    now = F.lit(dt.datetime(2024, 1, 2))
    rows = [request("a"), request("b", priority="urgent", age=5), request("c", locked=29, priority="urgent"), request("d", attempts=3), request("e", "failed", name="", attempts=3, priority="urgent", age=90), request("f", "failed", name=None, attempts=3), request("g", "processing", locked=50)]
    d = spark.createDataFrame(rows, REQUEST)
    got = {r["id"]: r for r in lifecycle.claimed(d, "w", now).collect()}
    assert got["e"]["status"] == "processing" and got["e"]["worker_attempts"] == 1 and got["b"]["status"] == "submitted"
    got = {r["id"] for r in lifecycle.claimed(d, "w", now, 10).where("worker_locked_by = 'w'").collect()}
    assert got == {"a", "b", "e"}
    after, events = lifecycle.unlocked(d, "f", now)
    assert after.where("id = 'f'").first()["worker_attempts"] == 0 and events.first()["payload"] == '{"from_status":"failed","worker_attempts_reset_to":0}'
    assert lifecycle.unlocked(d, "a", now)[1].count() == 0
    empty = spark.createDataFrame([], REQUEST)
    assert lifecycle.claimed(empty, "w", now).count() == 0


def test_intents(spark):
    want = {"remonter page 2": "layout_only", "ajouter une date et remonter": "content", "repartir de zéro": "reset", "ok": "unknown", "": "unknown", None: "unknown", "Supprimer la ligne": "content"}
    got = spark.createDataFrame([(k,) for k in want], "b string").select("b", intents.revision_intent(F.col("b")).alias("i")).collect()
    assert {r["b"]: r["i"] for r in got} == want
    want = {"faire une version courte": "explicit_short_version", "version courte mais ne pas compacter": "complete_faithful", "reformuler": "explicit_rewrite", "corrige le titre": "targeted_edit", None: "complete_faithful"}
    got = spark.createDataFrame([(k,) for k in want], "b string").select("b", intents.instruction_intent(F.col("b")).alias("i")).collect()
    assert {r["b"]: r["i"] for r in got} == want
    want = {"Coordonnées détectées": "contact_leak", "Texte source trop court": "source_sanitization", "page_too_dense": "layout_density", "timeout": "transient_model_failure", "Fidélité insuffisante": "source_fidelity", "primary_category_source_fidelity email": "source_fidelity", None: "transient_model_failure"}
    got = spark.createDataFrame([(k,) for k in want], "b string").select("b", intents.error_category(F.col("b")).alias("i")).collect()
    assert {r["b"]: r["i"] for r in got} == want


def test_sections_and_blocks(spark):
    d = spark.createDataFrame([(1, "Un\n\n \nDeux\nlignes\n\n\n"), (2, None)], "doc_id int, text string")
    got = segment.blocks(d).collect()
    assert [(r["ord"], r["block"]) for r in got] == [(1, "Un"), (2, "Deux\nlignes")] and re.fullmatch("other_001_[0-9a-f]{8}", got[0]["block_id"])
    d = spark.createDataFrame([(1, ["Expériences", "2019 - 2021 Consultant", "Livrables : x", "Compétences", "Java"]), (2, []), (3, None)], "doc_id int, blocks array<string>")
    got = {r["doc_id"]: r["types"] for r in segment.sections(d).collect()}
    assert got == {1: ["other", "experience", "experience", "other", "skills"], 2: [], 3: None}


def test_coverage(spark):
    facts = spark.createDataFrame([(1, "Migration vers PostgreSQL"), (2, "absent totally"), (3, None), (4, "Node.js Kafka")], "f int, t string")
    texts = spark.createDataFrame([(10, "une migration, vers postgresql 12"), (11, "kafka puis node js"), (12, None)], "d int, x string")
    assert sorted(tuple(r) for r in coverage.facts_found(facts, texts, "f", "t", "d", "x").collect()) == [(1, 10), (4, 11)]
    d = spark.createDataFrame([(1, "a b c", "a b z"), (2, "", "x"), (3, "a b c", "c b a")], "i int, b string, t string")
    assert [r["i"] for r in coverage.missing_blocks(d, "b", "t", 0.7).collect()] == [1]


def test_ops(spark):
    d = spark.createDataFrame([("ready", None), ("failed", " boom "), ("odd", None), (None, None)], "status string, last_error string")
    assert {r["status"]: r["n"] for r in ops.by_status(d).collect()} == {"ready": 1, "failed": 1, "unknown": 2}
    assert tuple(ops.rates(d).first()) == (4, 25.0, 0.0, 25.0, 0.0)
    assert tuple(ops.rates(d.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in ops.top_errors(d).collect()] == [("boom", 1)]
    assert "Ready rate: 25.0" in files.report("digest", ops.rates(d).first().asDict(), [("boom", 1)])


def test_taxonomy(spark):
    c = spark.createDataFrame([("Docker",), ("NoSQL",), ("rien",), (None,)], "v string").select(taxonomy.category(F.col("v"))).collect()
    assert [r[0] for r in c] == ["Cloud & DevOps", "Bases de données", None, None]
    assert spark.sql("select 'a (b, c), d' as v").select(taxonomy.top_level_commas(F.col("v"))).first()[0] == ["a (b, c)", "d"]
    d = spark.createDataFrame([(1, 0, "Anglais", None), (1, 1, "anglais", "B2"), (1, 2, "ANGLAIS", "C1")], "k int, ord int, name string, level string")
    assert [tuple(r) for r in taxonomy.merged_languages(d, "k").collect()] == [(1, "Anglais", "B2")]


def test_qa(spark):
    pages = spark.createDataFrame([(1, 1, 3700, 10, 0.95), (1, 2, 100, 2, 0.1), (2, 1, 0, 0, 0.0)], "doc_id int, page int, char_count int, block_count int, used_ratio double")
    assert {(r["page"], r["code"]) for r in qa.layout_issues(pages).collect()} == {(1, "page_too_dense"), (2, "last_page_sparse"), (2, "page_too_sparse")}
    assert {r["doc_id"]: (r["score"], r["verdict"]) for r in qa.taste(pages).collect()} == {1: (44, "poor"), 2: (100, "good")}
    s = spark.sql("select array('page_too_dense') a, array('zzz') b, array() c").select(*[qa.status(F.lit(0), F.lit(True), F.lit(True), F.lit(1), F.col(x).cast("array<string>"), F.lit(0)) for x in "abc"]).first()
    assert tuple(s) == ("draft", "failed", "passed")


def test_text_functions(spark):
    d = spark.createDataFrame([("Élève – C++ / C#, page 2 of 4 l’été",), (None,)], "t string")
    assert [r[0] for r in d.select(text.fidelity(F.col("t"))).collect()] == ["eleve c++ c# l ete", ""]
    assert [r[0] for r in d.select(text.slug(F.col("t"))).collect()] == ["Eleve-C-C-page-2-of-4-l-ete", ""]
    assert spark.sql("select 'a\r\n\r\n\r\n\r\nb  ' t").select(text.compact(F.col("t"))).first()[0] == "a\n\nb"
    assert [r[0] for r in spark.createDataFrame([("  jean-pierre x",), ("Jr.",), (None,)], "t string").select(text.first_name(F.col("t"))).collect()] == ["JEAN-PIERRE", None, None]
    j = "noise ```json\n{\"a\": 1}\n``` tail"
    assert spark.createDataFrame([(j,)], "t string").select(scalars.embedded_object(F.col("t"))).first()[0] == '{"a": 1}'
    assert spark.sql("select array(1,2,3,4,5) a").select(scalars.in_chunks(F.col("a"), 2)).first()[0] == [[1, 2], [3, 4], [5]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\té:,", max_size=40), min_size=1, max_size=5))
def test_compact_keeps_every_line_with_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.compact(F.col("t")).alias("c")).collect()
    for r in rows:
        want = [x.strip() for x in re.split("\r\n?|\n", texts[r["i"]]) if x.strip()]
        assert [x for x in r["c"].split("\n") if x] == want


def test_table_query(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    q = TableQuery(d)
    assert q.eq("k", None).frame().count() == 0 and q.is_("k", None).maybe_single()["id"] == 2 and q.eq("id", 9).maybe_single() is None
    assert [r["k"] for r in q.order("k", desc=True).frame().collect()] == [None, "b", "a"]
    with pytest.raises(ValueError):
        q.maybe_single()


def test_files(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"k": "a", "n": 1}\nbroken\n')
    assert files.jsonl(spark, str(tmp_path / "h.jsonl"), "k string, n int").count() == 1
    d = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, n int")
    out = str(tmp_path / "history")
    assert [files.append_unseen(d, out, ["k"], "k string, n int") for _ in range(2)] == [2, 0]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "y.pdf").write_bytes(b"nope")
    got = files.blobs(spark, str(tmp_path), "*.pdf").select("path", files.acceptable_pdf(F.col("content")).alias("ok")).collect()
    assert sorted((r["path"][-5:], r["ok"]) for r in got) == [("x.pdf", True), ("y.pdf", False)]
    flat = files.as_payload(spark.sql("select 1 a, array(1, 2) b, timestamp'2024-01-01 00:00:00' c")).first()
    assert tuple(flat) == (1, "[1,2]", "2024-01-01T00:00:00.000Z")


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=20 * i), i % 2, "error" if i % 3 else "view", 1.0, "{}") for i in range(30)]
    spark.createDataFrame(rows, stream.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    batches = []
    q = stream.polled(stream.read(spark, str(tmp_path / "in")), lambda d, i: batches.append(d.count()), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert sum(batches) == 30
    q = stream.polled(stream.read(spark, str(tmp_path / "in")), stream.committed(str(tmp_path / "out")), str(tmp_path / "cp2"), once=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    q = stream.failure_counts(stream.read(spark, str(tmp_path / "in")), every="5 minutes").writeStream.outputMode("complete").format("memory").queryName("fails").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("fails").collect()) == 20


def test_streaming_limit(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=20 * i), 1, "error", 1.0, "{}") for i in range(6)]
    spark.createDataFrame(rows, stream.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    limited = stream.sliding_limit(stream.read(spark, str(tmp_path / "in")), "user_id", 2, 60)
    q = limited.writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r["event_id"]: r["calls"] for r in limits.rate_limited(spark.createDataFrame(rows, stream.SCHEMA), ["user_id"], 2, 60_000_000).collect()}
    assert {r["event_id"]: r["calls"] for r in spark.table("limited").collect()} == want
