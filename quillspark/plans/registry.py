"""Queries by name, and their SQL.

The test tables hold no requests or résumés. Mapping: documents = source texts, events = event log (user = request,
error = failed, purchase = ready, signup = claimed), orders = request queue, lineitem = versions, conversations =
comments, benchmark = required facts, part = skill terms. ``as_of`` is the latest time in the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scalars, text
from quillspark.operators import blocks, coverage, display, intents, layout, lifecycle, limits, ops, packing, profile, qa, sanitize, segment, structured, taxonomy, workflow
from quillspark.plans import people
from quillspark.plans import skills as skill_queries
from quillspark.plans import skills_sql
from quillspark.plans import sources as source_queries
from quillspark.plans.sql import ORACLE_SQL
from quillspark.sources.files import download_name, safe_file_name, updated
from quillspark.sources import shared, sql_functions, versions
from quillspark.sources.query import TableQuery
from quillspark.streaming import events as stream
from quillspark.tables import table

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests: O submitted, P processing, F failed."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "submitted").when(F.col("o_orderstatus") == "P", "processing").otherwise("failed")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("normal")
    when = F.col("o_orderdate")
    processing = status == "processing"
    return o.select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        priority.alias("priority"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise("NAME").alias("candidate_first_name"),
        F.when(processing, when).alias("worker_locked_at"),
        F.when(processing, F.lit("w0")).alias("worker_locked_by"),
        (F.col("o_orderkey") % 5).cast("int").alias("worker_attempts"),
        F.lit(None).cast("string").alias("last_error"),
        when.alias("created_at"),
        when.alias("submitted_at"),
        F.when(processing, when).alias("started_at"),
        when.alias("updated_at"),
    )


def as_of(d: DataFrame, column: str):
    return F.lit(d.agg(F.max(column)).first()[0])


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumnRenamed("props", "payload").withColumn("ts", F.col("ts").cast("timestamp"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents have no blank lines, so their lines are the blocks."""
    return segment.blocks(table(spark, d, "documents"), separator="\n")


@query
def source_profile(spark, d):
    return profile.profiled(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query
def review_gate(spark, d):
    p = profile.profiled(table(spark, d, "documents").select("text"))
    return p.groupBy("profile").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("review"))


@query
def profile_distribution(spark, d):
    p = profile.profiled(table(spark, d, "documents").select("source", "text"))
    return p.groupBy("source", "profile").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query
def pii_redaction_counts(spark, d):
    kinds = {k: sanitize.CONTACTS[k] for k in ("email", "phone", "linkedin", "github")}
    return sanitize.redacted(table(spark, d, "documents").select("doc_id", text.text_of(F.col("text")).alias("text")), "text", kinds).drop("text")


@query
def sanitized_documents(spark, d):
    return sanitize.sanitised(table(spark, d, "documents")).withColumn("clean_text", F.md5("clean_text"))


@query
def line_fates(spark, d):
    return sanitize.sanitised_lines(table(spark, d, "documents")).groupBy("fate").agg(F.count("*").alias("n"), F.sum("n_email").alias("emails"))


@query
def line_blocks(spark, d):
    return lines(spark, d).drop("block")


@query
def section_carry_forward(spark, d):
    return segment.carried(lines(spark, d)).groupBy("section").agg(F.count("*").alias("n"), F.count("header").alias("headers"))


@query
def section_types(spark, d):
    """The fold over inline documents with real headings."""
    rows = [(1, ["Jane", "COMPÉTENCES", "Java, SQL", "Expériences", "2019 - 2021 Développeur", "Livrables clés", "Langues", "Anglais"]), (2, ["Profil", "2018 à 2020 consultant", "Missions principales du projet", "texte"]), (3, [])]
    found = segment.sections(spark.createDataFrame(rows, "doc_id long, blocks array<string>"))
    return found.select("doc_id", F.array_join("types", ",").alias("types"))


@query
def long_doc_chunks(spark, d):
    return segment.chunks(table(spark, d, "documents"))


@query
def normalized_text(spark, d):
    n = text.fidelity(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(n).cast("long").alias("chars"), F.md5(n).alias("digest"))


@query
def fingerprint_duplicates(spark, d):
    f = table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))
    return f.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query
def required_fact_coverage(spark, d):
    return coverage.facts_found(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query
def block_coverage(spark, d):
    """The first turn of a conversation as required block, the second as rendered text."""
    c = table(spark, d, "conversations")
    a = c.where("turn = 0").select("conv_id", F.col("text").alias("block"))
    b = c.where("turn = 1").select("conv_id", F.col("text").alias("body"))
    return coverage.missing_blocks(a.join(b, "conv_id"), "block", "body").select("conv_id", "overlap")


@query
def placeholder_repetition(spark, d):
    """Lines of the documents and, since those hold none, inline ones."""
    rows = [(-1, "Analyse des besoins 1\nAnalyse des besoins 2\n• Analyse des besoins 3."), (-2, "Atelier technique 1\nAtelier technique 9\nAtelier technique 20"), (-3, "Mission longue suite 1\nMission longue suite 2\nMission longue suite 3")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    found = coverage.placeholders(table(spark, d, "documents").select("doc_id", "text").union(own))
    return found.select("doc_id", "base", F.array_join("numbers", ",").alias("numbers"))


@query
def issue_summary(spark, d):
    codes = spark.createDataFrame([("error", "source_fact_missing"), ("click", "source_coverage_missing_section"), ("view", "title_absent_from_source")], "event_type string, code string")
    return coverage.issue_summary(log(spark, d).join(F.broadcast(codes), "event_type"), "user_id").withColumn("codes", F.array_join("codes", ","))


@query
def claim_queue_topk(spark, d):
    r = requests(spark, d)
    now = as_of(r, "created_at")
    return lifecycle.claimed(r, "w1", now, 10).where("worker_locked_by = 'w1'").select("id", "priority", "status", "worker_attempts")


@query
def requeued_requests(spark, d):
    r = requests(spark, d)
    return lifecycle.requeued(r, as_of(r, "created_at")).groupBy("status").agg(F.count("*").alias("n"), F.sum("worker_attempts").cast("long").alias("attempts"))


@query
def unlocked_request(spark, d):
    r = requests(spark, d)
    some = r.where("status = 'failed'").agg(F.min("id")).first()[0]
    after, events = lifecycle.unlocked(r, some, as_of(r, "created_at"))
    return after.where(F.col("id") == some).join(events.withColumnRenamed("request_id", "id"), "id").select("id", "status", "worker_attempts", "event_type", F.get_json_object("payload", "$.from_status").alias("from_status"))


@query
def latest_version(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lifecycle.latest(v, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query
def version_numbers(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return lifecycle.numbered(v, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey").agg(F.max("version_number").alias("versions"))


@query
def version_gate(spark, d):
    v = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "draft_ready").otherwise("qa_failed").alias("s"), F.when(F.col("o_orderkey") % 3 == 0, "passed").when(F.col("o_orderkey") % 3 == 1, "draft").otherwise("failed").alias("q"))
    gate = lifecycle.version_gate(F.col("s"), F.col("q"), F.col("o_orderkey") % 4 > 0)
    return v.select(gate.alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query
def latest_event_badge(spark, d):
    """The 50 latest orders with the last event of their customer."""
    newest = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    last = lifecycle.latest(log(spark, d).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
    return newest.join(last, newest["o_custkey"] == last["user_id"], "left").select("o_orderkey", "event_id", "event_type")


@query
def dashboard_kpis(spark, d):
    r = requests(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    count = lambda c: F.count_if(c)
    return r.agg(F.count("*").alias("total"), count(F.col("status").isin(*lifecycle.IN_PROGRESS)).alias("in_progress"), count(F.col("status") == "failed").alias("failed"), count(F.col("priority") == "urgent").alias("urgent"))


@query
def queue_stats(spark, d):
    return requests(spark, d).rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total")).alias("state"), "n")


@query
def stale_processing(spark, d):
    r = requests(spark, d)
    return lifecycle.stale(r, as_of(r, "created_at"), 60 * 24 * 365).select("id")


@query
def retryable_requests(spark, d):
    r = requests(spark, d)
    return lifecycle.retryable(r, as_of(r, "updated_at"), 24 * 365).select("id")


@query
def low_scores(spark, d):
    k = scalars.json_number(F.col("payload"), "$.k")
    return log(spark, d).withColumn("score", k).where("score < 60").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "score")


@query
def status_digest(spark, d):
    known = {"error": "failed", "purchase": "ready", "signup": "processing", "click": "draft_ready"}
    status = F.lit("mystery")
    for k, v in known.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    e = log(spark, d).select(status.alias("status"))
    return ops.by_status(e).crossJoin(F.broadcast(ops.rates(e)))  # the rates are one row


@query
def top_error_prefixes(spark, d):
    e = log(spark, d).select(F.when(F.col("event_type") == "error", "failed").otherwise("ready").alias("status"), F.col("payload").alias("last_error"))
    return ops.top_errors(e)


@query
def source_profile_by_time(spark, d):
    e = log(spark, d)
    recent = e.where(F.col("ts") > as_of(e, "ts") - F.expr("interval 7 days"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(scalars.json_number(F.col("payload"), "$.k", "long")).alias("k"))


@query
def event_sequences(spark, d):
    s = ops.summaries(log(spark, d), "user_id", ("error", "purchase"), "signup")
    return s.select("user_id", "n", F.md5("sequence").alias("sequence"), "terminal", "first_profile")


@query
def incident_signatures(spark, d):
    s = ops.summaries(log(spark, d), "user_id", ("error", "purchase"), "signup").where("terminal = 'error'")
    issues = F.when(F.col("n") > 10, F.array(F.lit("many_events"))).otherwise(F.array().cast("array<string>"))
    sig = ops.signature(F.lit("failed"), F.when(F.col("user_id") % 2 == 0, "contact_leak"), issues, F.when(F.col("first_profile").isNotNull(), "normal"), F.col("user_id") % 3 == 0)
    return ops.incidents(s.select(F.col("user_id").alias("id"), sig.alias("signature")))


@query
def incident_recommendations(spark, d):
    s = ops.summaries(log(spark, d), "user_id", ("error", "purchase"), "signup")
    category = F.when(F.col("user_id") % 3 == 0, "contact_leak").when(F.col("user_id") % 3 == 1, "source_fidelity").otherwise("transient_model_failure")
    issues = F.when(F.col("n") > 10, F.array(F.lit("source_coverage_missing_experience_item"))).otherwise(F.array().cast("array<string>"))
    r = ops.recommendations(category, issues, F.when(F.col("terminal") == "error", "failed").otherwise("needs_human_review"), F.lit("normal"), F.col("user_id") % 5 > 0)
    return s.select(F.explode(r).alias("recommendation")).groupBy("recommendation").agg(F.count("*").alias("n"))


@query
def history_anti_join(spark, d):
    e = log(spark, d)
    return ops.unseen(e.where("event_type = 'error'").select("user_id").distinct(), e.where("event_type = 'purchase'"), "user_id")


@query
def stage_durations(spark, d):
    s = ops.stage_durations(log(spark, d), "user_id")
    return s.groupBy("event_type").agg(F.count("seconds").alias("n"), F.sum("micros").alias("micros"))


@query
def rate_limit_sliding(spark, d):
    got = limits.rate_limited(log(spark, d), ["user_id", "event_type"], 3, 6 * 3600 * 1_000_000)
    return got.select("event_id", "calls", "allowed", "remaining")


@query
def dup_suppression(spark, d):
    return limits.suppressed(log(spark, d), ["user_id", "event_type"], 3600 * 1_000_000).select("event_id", "kept")


@query
def uppercase_and_glyph_qa(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(text.uppercase_ratio(t), 6).alias("uppercase"), F.coalesce(sanitize.bad_glyphs(t), F.lit(False)).alias("bad_glyphs"), F.coalesce(sanitize.looks_like_contact(t), F.lit(False)).alias("contact"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents in pages of 3,300 characters; blocks are the lines, the used ratio is of 3,600 characters."""
    size = 3300
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    p = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    body = F.substring(F.col("text"), (F.col("page") - 1) * size + 1, F.lit(size))
    return p.select("doc_id", "page", F.length(body).alias("char_count"), F.size(F.split(body, "\n")).alias("block_count")).withColumn("used_ratio", F.least(F.lit(1.0), F.col("char_count") / 3600))


@query
def page_issues(spark, d):
    return qa.layout_issues(pages(spark, d))


@query
def page_metrics_score(spark, d):
    return qa.taste(pages(spark, d))


@query
def page_overflow(spark, d):
    """Line items as text blocks of a page 100 points wide and high."""
    q = F.col("l_quantity")
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.cast("double").alias("x0"), (q * 2).cast("double").alias("y0"), (q + 50).cast("double").alias("x1"), (q * 2 + 10).cast("double").alias("y1"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    return layout.overflow(b).groupBy("l_orderkey", "side").agg(F.count("*").alias("n"))


@query
def zone_plan(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "skills").when(F.col("l_returnflag") == "A", "education").otherwise("experience")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.col("l_partkey").cast("string").alias("block_id"), kind.alias("type"), F.col("l_quantity").alias("estimated_lines"), (F.col("l_linestatus") == "O").alias("required"))
    return layout.zones(b).select("doc_id", "zone", F.size("block_ids").cast("long").alias("blocks"), F.array_join("block_ids", ",").alias("block_ids"))


@query
def retry_options(spark, d):
    p = qa.layout_issues(pages(spark, d)).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    o = layout.retry_options(F.col("codes"))
    return p.where(o.isNotNull()).select("doc_id", o["force_new_page"].alias("force_new_page"), o["dense_chars"].alias("dense_chars"), o["reserve"].alias("reserve"))


@query
def contact_paths(spark, d):
    """Contacts by JSON path in structured documents made of the texts: the first line as title, all lines as items."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    none = lambda kind: F.lit(None).cast(kind)
    parts = docs.select("doc_id", none("string").alias("name"), F.get("ls", F.lit(0)).alias("title"), none("array<struct<date:string,degree:string,school:string>>").alias("formations"), F.array(F.struct(F.lit("c").alias("category"), F.col("ls").alias("items"))).alias("skills"), none("array<struct<date:string,role:string,sections:array<struct<heading:string,content:array<string>>>>>").alias("experiences"))
    return structured.contacts_in(parts).select("doc_id", F.array_join("categories", ",").alias("categories"), F.size("paths").cast("long").alias("paths"))


@query
def heading_kinds(spark, d):
    rows = [(1, "COMPÉTENCES :"), (2, "Profil senior orienté résultats et équipes"), (3, "Formations"), (4, "Missions"), (5, "Environnement technique: AWS")]
    return spark.createDataFrame(rows, "id int, line string").select("id", structured.heading_kind(F.col("line")).alias("kind"))


@query
def packing_breaks(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("x"))
    heights = F.transform("x", lambda i: F.lit(2) + packing.item_units((i["l_quantity"] * 8).cast("int")))
    return v.select("l_orderkey", F.array_join(packing.page_breaks(heights, 9), ",").alias("breaks"))


@query
def layout_variants(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("pages"), F.sum((F.col("l_quantity") > 40).cast("int")).alias("dense"), F.sum((F.col("l_quantity") < 5).cast("int")).alias("sparse"))
    score = qa.layout_score(F.lit(0), F.lit(0), F.lit(0), F.col("sparse"), F.col("dense"), F.col("pages"))
    return qa.best_variant(v.select("l_orderkey", score.alias("score"), F.col("l_linenumber").alias("ord")), "l_orderkey")


@query
def qa_status(spark, d):
    p = qa.layout_issues(pages(spark, d)).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    docs = table(spark, d, "documents").select("doc_id").join(p, "doc_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    s = qa.status(F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0), F.lit(True), F.lit(True), F.lit(1), F.col("codes"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    score = qa.final_score(F.size("codes"), F.col("doc_id") % 2 == 0)
    return docs.select(s.alias("status"), score.alias("score")).groupBy("status", "score").agg(F.count("*").alias("n"))


@query
def eval_assertions(spark, d):
    """Cases demand two words, forbid one, and hold a page limit."""
    docs = table(spark, d, "documents")
    cases = docs.select(F.col("doc_id").alias("id"), F.lit("ready").alias("expected_status"), F.array(F.lit("the"), F.lit("and")).alias("required_terms"), F.lit("(?i)token").alias("forbidden"), F.lit(2).alias("max_pages"))
    results = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "ready").otherwise("failed").alias("status"), "text", F.ceil(F.col("n_chars") / 3000).alias("pages"))
    return qa.evaluated(cases, results).select("id", "passed", F.array_join("failures", ",").alias("failures"))


@query
def revision_intents(spark, d):
    rows = [("remonter la mission en page 1",), ("ajouter une mission et remonter le bloc",), ("tout refaire",), ("merci",), ("",), (None,)]
    own = spark.createDataFrame(rows, "text string")
    c = table(spark, d, "conversations").select("text").union(own)
    return c.select(intents.revision_intent(F.col("text")).alias("intent"), intents.instruction_intent(F.col("text")).alias("instruction")).groupBy("intent", "instruction").agg(F.count("*").alias("n"))


@query
def error_taxonomy(spark, d):
    rows = [("Coordonnées détectées : email",), ("Texte source trop court",), ("primary_category_source_fidelity",), ("page_too_dense page 3",), ("logo manquant",), ("timeout",), ("Prénom candidat absent",), (None,)]
    own = spark.createDataFrame(rows, "text string")
    e = table(spark, d, "conversations").select("text").union(own)
    return e.select(intents.error_category(F.col("text")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query
def issue_code_extraction(spark, d):
    rows = [(1, "failed fidelity_issues=[a_b, 'c'] hard_count=2 soft_count=1"), (2, "none"), (3, None)]
    m = F.col("message")
    hard, soft = intents.issue_counts(m)
    return spark.createDataFrame(rows, "id int, message string").select("id", F.array_join(intents.issue_codes(m), ",").alias("codes"), hard.alias("hard"), soft.alias("soft"))


@query
def skills_dedup(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("ord"), F.col("p_name").alias("value"), F.col("p_type").alias("category"))
    return taxonomy.deduplicated(p, "p_brand").select("p_brand", "skill_key", "value", "ord")


@query
def skill_groups(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("ord"), F.col("p_name").alias("value"), F.col("p_type").alias("category"))
    return taxonomy.grouped(p, "p_brand").select("p_brand", "category", "part", F.array_join("values", ",").alias("values"))


@query
def skill_categories(spark, d):
    rows = [("Docker, Kubernetes",), ("PostgreSQL; Redis / Oracle",), ("Méthodes Agile (Scrum, Safe)",), ("Jardinage",)]
    own = spark.createDataFrame(rows, "value string").select(F.explode(taxonomy.split_values(F.col("value"))).alias("value"))
    every = own.union(table(spark, d, "part").select("p_name").distinct())
    return every.select("value", taxonomy.category(F.col("value")).alias("category"))


@query
def language_merge(spark, d):
    rows = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("name"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("B"), (F.col("doc_id") % 2 + 1).cast("string"))).alias("level"), F.col("doc_id").alias("ord"))
    return taxonomy.merged_languages(rows, "source")


@query
def table_query(spark, d):
    q = TableQuery(table(spark, d, "orders")).select("o_orderkey, o_totalprice").eq("o_orderstatus", "F").in_("o_orderpriority", ["1-URGENT", "2-HIGH"]).like("o_orderpriority", "1%")
    return q.order("o_totalprice", desc=True).order("o_orderkey").limit(25).frame()


@query
def visible_requests(spark, d):
    """Rows of owners in a whitelist."""
    allowed = table(spark, d, "customer").where(F.lower("c_mktsegment") == "building").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(allowed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query
def request_detail(spark, d):
    """Requests with the number, total and newest of their versions."""
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("versions"), F.max("l_linenumber").alias("newest"))
    o = table(spark, d, "orders")
    return o.join(v, o["o_orderkey"] == v["l_orderkey"], "left").select("o_orderkey", F.coalesce("versions", F.lit(0)).alias("versions"), "newest")


@query
def snapshot_update(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return updated(o, F.col("o_orderkey") % 10 == 0, {"o_orderstatus": F.lit("X")}).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query
def string_scalars(spark, d):
    c = F.concat(F.col("p_name"), F.lit(" É/ç & "), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.safe_code(c).alias("code"), text.slug(c).alias("slug"), text.escaped(c).alias("escaped"), text.first_name(c).alias("first_name"), safe_file_name(c).alias("file"), download_name(c, F.col("p_size")).alias("download"))


@query
def numeric_scalars(spark, d):
    o, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", scalars.bounded_score(p / 4000).alias("score"), scalars.backoff(o % 9 + 1).alias("backoff"), scalars.ceil_div(o, 116).alias("pages"), F.round(scalars.safe_ratio(o, o % 3), 6).alias("ratio"))


@query
def stream_failure_counts(spark, d):
    """The event log as a stream, drained once in append mode: a window is written when the watermark has passed it, and its state dropped. Two failures years later let all of them out, and stay in a window of their own that isn't."""
    log_ = stream.read(spark, d, pattern="events.parquet")
    root = f"{shared.folder(spark)}/failures-{uuid.uuid4().hex}"
    end = table(spark, d, "events").limit(1).select(*[(F.timestamp_seconds(F.lit(4_000_000_000)) if f.name == "ts" else F.lit("error") if f.name == "event_type" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in log_.schema.fields])
    # Three batches: the log, an event that moves the watermark, and another in whose batch that watermark holds.
    table(spark, d, "events").select(*[F.col(f.name).cast(f.dataType) for f in log_.schema.fields]).coalesce(1).write.parquet(f"{root}/in/a")
    for name in ("b", "c"):
        end.coalesce(1).write.parquet(f"{root}/in/{name}")
    source = spark.readStream.schema(log_.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    q = stream.failure_counts(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
    q.awaitTermination()
    return spark.read.schema("start timestamp, n long").parquet(f"{root}/out").select(F.unix_micros("start").alias("start"), "n")


@query
def owner_rows(spark, d):
    """Events whose JSON names an owner."""
    return lifecycle.owned(log(spark, d), F.lit("7"), "payload", "k").select("event_id", "user_id")


@query
def status_labels(spark, d):
    """Requests with the types of their customer's events, mapped to those of a request."""
    known = F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "signup", "worker_claimed").when(F.col("event_type") == "click", "extraction_done")
    seen = log(spark, d).groupBy(F.col("user_id").alias("o_custkey")).agg(F.collect_set(known).alias("types"))
    o = table(spark, d, "orders").join(seen, "o_custkey", "left")
    status = F.when(F.col("o_orderstatus") == "O", "submitted").when(F.col("o_orderstatus") == "P", "draft_ready").otherwise("cancelled")
    return o.select(lifecycle.label(status, F.col("types")).alias("label"), lifecycle.progress(status, F.col("types")).alias("percent")).groupBy("label", "percent").agg(F.count("*").alias("n"))


@query
def integrity_issues(spark, d):
    """Orders as structured documents: their line items are formations (returned ones) and experiences (the others)."""
    text = lambda c, v: F.when(c, v).otherwise("")
    n = F.col("l_linenumber")
    section = F.struct(F.lit("Missions").alias("heading"), F.array().cast("array<string>").alias("content"))
    body = F.when(F.col("l_linestatus") == "O", F.array(section)).otherwise(F.array().cast("array<struct<heading:string,content:array<string>>>"))
    experience = F.struct("l_linenumber", "l_partkey", "l_suppkey", text(n % 3 > 0, "2019 - 2021").alias("date"), text(n % 2 > 0, "Lead").alias("role"), body.alias("sections"))
    formation = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.lit("2019 - 2021").alias("date"), text(n % 2 > 0, "Consultant Java").alias("degree"), text(n % 3 == 0, "Ecole").alias("school"))
    returned = F.col("l_returnflag") == "R"
    sort = lambda c, when: F.array_sort(F.collect_list(F.when(when, c)))
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(sort(formation, returned).alias("formations"), sort(experience, ~returned).alias("experiences"))
    return structured.integrity_issues(docs, "l_orderkey").groupBy("l_orderkey", "code").agg(F.count("*").alias("n"))


@query
def sanitized_blocks(spark, d):
    """Documents as blocks, with two common words as terms, one of which is the candidate's own name."""
    b = table(spark, d, "documents").select("doc_id", "text", F.array(F.lit("the"), F.lit(" and "), F.lit("")).alias("terms"), F.lit("And").alias("first_name"))
    return blocks.sanitised(b).select("doc_id", F.md5("text").alias("text"), "n_linkedin", "n_email", "n_phone", "n_url", "n_identity")


@query
def rationale_guard(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(blocks.unsafe_rationale(F.col("text"))).alias("unsafe"))


@query
def skills_display_quality(spark, d):
    """Suppliers as documents: the parts that they sell, by type; economy ones are unsorted, standard ones their continuation."""
    sold = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, d, "part"), "p_partkey")
    kind = F.when(F.col("p_type") == "ECONOMY", "Autres").when(F.col("p_type") == "STANDARD", "Autres — suite").otherwise(F.col("p_type"))
    rows = sold.groupBy("l_suppkey", kind.alias("category")).agg(F.collect_list(F.col("p_name")).alias("items"))
    return display.skill_flags(rows, "l_suppkey")


@query
def draft_warnings(spark, d):
    """Events as issues of drafts."""
    code = F.when(F.col("event_type") == "click", "page_too_dense").when(F.col("event_type") == "error", "bad_page_break").otherwise(F.col("event_type"))
    page = F.get_json_object("payload", "$.k").try_cast("int") % 5
    shown = display.draft_warning(code, F.when(page > 1, F.concat(F.lit("a\n\t b "), F.col("event_type"))), F.lit("s"), page)
    return log(spark, d).select(shown.alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


@query
def quality_labels(spark, d):
    """Profiles of documents by label, and prices as scores."""
    p = profile.profiled(table(spark, d, "documents").select("text")).select(display.profile_label(F.col("profile")).alias("label"), display.clamped(F.col("chars") / 40).alias("score"))
    return p.groupBy("label", "score").agg(F.count("*").alias("n"))


@query
def packing_options(spark, d):
    """Orders as documents, quantities of their items as heights."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("h")))), lambda x: x["h"]).alias("h"))
    o = o.select("l_orderkey", display.packing_options(F.col("h")).alias("o"))
    return o.select("l_orderkey", "o.force_new_page", "o.density_profile", "o.readability_reserve", (F.size("o.breaks") > 0).alias("breaks"))


@query
def enqueued_jobs(spark, d):
    q = workflow.enqueued(requests(spark, d), F.lit("2000-01-01").cast("timestamp"))
    return q.groupBy("priority", "attempts", "backoff_type", "backoff_ms").agg(F.count("*").alias("n"), F.sum(workflow.retry_delay(F.lit(3))).alias("delay"))


def _failures(spark, d):
    """Errors of the log as failures of the request with the user's number."""
    k = F.get_json_object("payload", "$.k")
    error = F.concat(F.lit("reformulation: fidelity_issues=[a"), k, F.lit(", b]; hard_count="), k, F.lit(" soft_count=1"))
    status = F.when(F.col("value") > 100, "dead_letter").otherwise("failed")
    return log(spark, d).where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), status.alias("status"), error.alias("error"), F.concat(F.lit("m"), F.repeat(k, F.lit(400))).alias("message"))


@query
def failed_requests(spark, d):
    """The snapshot after all failures."""
    r = requests(spark, d).select("id", "status", F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("updated_at"))
    snapshot, _ = workflow.failed(r, _failures(spark, d), F.lit("2025-01-01").cast("timestamp"))
    return snapshot.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("last_error")).alias("chars"), F.count("updated_at").alias("updated"))


@query
def failure_events(spark, d):
    _, events = workflow.failed(requests(spark, d).select("id", "status", F.lit("").alias("last_error"), F.lit(None).cast("timestamp").alias("updated_at")), _failures(spark, d), F.lit("2025-01-01").cast("timestamp"))
    field = lambda f: F.get_json_object("payload", f"$.{f}")
    return events.groupBy("event_type", field("error_category").alias("category"), field("fidelity_issues").alias("issues"), field("fidelity_hard_count").alias("hard")).agg(F.count("*").alias("n"))


def _comments(spark, d):
    """Snapshot with versions, and user turns as comments, six seconds apart, on the order with the conversation's number. Every second turn repeats its predecessor's first words."""
    r = requests(spark, d).select("id", "status", F.when(F.col("id") % 3 > 0, F.col("id")).alias("current_version_id"))
    v = r.where("current_version_id is not null").select(F.col("current_version_id").alias("id"), (F.col("id") % 4 + 1).alias("version_number"), F.lit("draft").alias("qa_status"), F.when(F.col("id") % 2 == 0, "{}").alias("structured_json"), F.lit("{}").alias("qa_report"))
    body = F.when(F.col("turn") % 4 < 2, "Remonter en page 1").when(F.col("turn") % 4 == 2, " ").otherwise(F.concat(F.lit("Autre "), F.col("turn")))
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("comment_id"), F.col("conv_id").alias("request_id"), body.alias("body"), F.col("role").alias("category"), F.timestamp_seconds(F.col("turn") * 6).alias("created_at"))
    return r, v, c


@query
def revision_comments(spark, d):
    """Accepted comments, with what their events say; comments of the first two seconds' turns are there already in every fifth request."""
    r, v, c = _comments(spark, d)
    old = r.where("id % 5 = 0").select(F.col("id").alias("request_id"), F.col("current_version_id").alias("version_id"), F.lit("Remonter en page 1").alias("body"), F.lit("revision").alias("comment_type"), F.lit(False).alias("resolved"), F.timestamp_seconds(F.lit(-1)).alias("created_at"))
    accepted, _, events = workflow.commented(r, v, old, c, F.lit("2025-01-01").cast("timestamp"))
    e = events.select("request_id", "created_at", F.get_json_object("payload", "$.version_number").cast("long").alias("version_number"), F.get_json_object("payload", "$.from_status").alias("from_status"))
    return accepted.join(e, ["request_id", "created_at"]).select("comment_id", "request_id", "version_id", "body", "version_number", "from_status")


@query
def revision_snapshot(spark, d):
    r, v, c = _comments(spark, d)
    none = c.select("request_id", F.col("request_id").alias("version_id"), "body", F.lit("revision").alias("comment_type"), F.lit(True).alias("resolved"), "created_at")
    _, snapshot, _ = workflow.commented(r, v, none, c, F.lit("2025-01-01").cast("timestamp"))
    return snapshot.groupBy("status").agg(F.count("*").alias("n"))


@query
def layout_only_reuse(spark, d):
    r, v, c = _comments(spark, d)
    made = c.select("request_id", "body", F.lit("revision").alias("comment_type"), (F.col("comment_id") % 100 > 3).alias("resolved"))
    return workflow.reusable(r, v, made).select("request_id", "version_id", "version_number")


@query
def resolved_comments(spark, d):
    _, _, c = _comments(spark, d)
    made = c.select("comment_id", "request_id", F.lit("revision").alias("comment_type"), (F.col("comment_id") % 3 == 0).alias("resolved"))
    return workflow.resolved(made, requests(spark, d).where("status = 'failed'")).groupBy("resolved").agg(F.count("*").alias("n"))


@query
def request_states(spark, d):
    """The log's types as those of requests: clicks change nothing."""
    to = F.when(F.col("event_type") == "signup", "worker_claimed").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "failed").otherwise("extraction_done")
    return workflow.states(log(spark, d).withColumn("event_type", to), "user_id")


@query
def version_history(spark, d):
    """Orders as versions, their items as issues."""
    issue = F.struct(F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("code"), F.when(F.col("l_linestatus") == "O", F.lit("late ")).otherwise("").alias("message"), F.lit("cut").alias("snippet"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", issue.alias("x")))), lambda y: y["x"]).alias("x"))
    return o.select("l_orderkey", workflow.history(F.col("l_orderkey") % 7, F.when(F.col("l_orderkey") % 2 == 0, "passed"), F.col("x")).alias("body"))


@query
def sql_table_functions(spark, d):
    """Requests by functions that SQL calls with arguments by name."""
    r = requests(spark, d)
    last = r.agg(F.max("updated_at")).first()[0]
    session = sql_functions.registered(r)
    at = f"TIMESTAMP '{last}'"
    return session.sql(f"""
        SELECT 'retryable' AS kind, id, CAST(NULL AS STRING) AS code FROM retryable_requests(hours => 8760, as_of => {at}) WHERE id % 3 = 0
        UNION ALL SELECT 'stale', id, NULL FROM stale_requests(minutes => 525600, as_of => {at})
        UNION ALL (SELECT 'claimable', id, safe_code(priority || ' / ' || request_rank(priority)) FROM claimable_requests(as_of => {at}) ORDER BY rank, created_at, id LIMIT 25)
        UNION ALL SELECT status, n, CAST(CAST(retry_wait(3) AS INT) AS STRING) FROM queue_counts()""")


def _results(spark, d):
    """Line items as results of their order's request: which status they want, and what their report says."""
    n = F.col("l_partkey")
    status = F.when(n % 5 == 0, "draft_ready").when(n % 11 == 0, "failed").otherwise("ready")
    qa_status = F.when(n % 5 == 0, "draft").when(n % 7 == 0, "failed").otherwise("passed")
    report = F.concat(F.lit('{"passed": '), F.when((n % 5 > 0) & (n % 13 > 0), "true").otherwise("false"), F.lit("}"))
    place = F.col("l_linenumber").cast("long") * 1_000_000_000 + n * 10_000 + F.col("l_suppkey")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), place.alias("ord"), "l_partkey").agg(F.count("*").alias("c")).select(
        "request_id", "ord", F.when(n % 3 > 0, "{}").alias("structured_json"), report.alias("qa_report"), status.alias("request_status"), qa_status.alias("qa_status"), F.lit("owner").alias("owner"),
    )


@query
def committed_versions(spark, d):
    """Two batches of results, the second of which comes twice: versions with their paths, and the request's status after them."""
    root = f"{shared.folder(spark)}/versions-{uuid.uuid4().hex}"
    every = _results(spark, d)
    first, second = every.where("ord % 2 = 0"), every.where("ord % 2 = 1")
    at = F.lit("2025-01-01").cast("timestamp")
    for batch, rows in (("q:0", first), ("q:1", second), ("q:1", second)):
        versions.commit(rows, root, batch, at)
    v = versions.read(spark, root, "versions")
    now = versions.current(requests(spark, d).select("id", "status"), root)
    files = versions.read(spark, root, "artefacts").groupBy("request_id", "version_number").agg(F.count("*").alias("files"))
    return v.join(files, ["request_id", "version_number"]).join(now.withColumnRenamed("id", "request_id"), "request_id", "left").select("request_id", "version_number", "qa_status", "final_path", "renderer_input_path", "files", "status", "current_version")


@query
def rejected_versions(spark, d):
    """Results that the gate refuses, by code."""
    root = f"{shared.folder(spark)}/versions-{uuid.uuid4().hex}"
    versions.commit(_results(spark, d), root, "q:0", F.lit("2025-01-01").cast("timestamp"))
    return versions.read(spark, root, "rejected").groupBy("code").agg(F.count("*").alias("n"))


QUERIES |= skill_queries.QUERIES | people.QUERIES | source_queries.QUERIES
ORACLE_SQL |= skills_sql.ORACLE_SQL | people.ORACLE_SQL | source_queries.ORACLE_SQL
