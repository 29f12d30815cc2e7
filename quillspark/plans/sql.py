"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quillspark.operators import intents, qa, sanitize, segment
from quillspark.operators.profile import ATS_WORDS, MISSION_WORDS
from quillspark.plans.words import category_case, fold, q

B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def has(words: str) -> str:
    """A pattern that finds one of the words, with borders that RE2 can express."""
    return q(f"(?i){B}(?:{words}){E}")


def fidelity(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({fold(c)}), '’', ''''), '\bpage\s+[0-9]+\s+(?:of|sur)\s+[0-9]+\b', ' ', 'g'), '[^a-z0-9+#]+', ' ', 'g'))"


def label(c: str) -> str:
    return rf"trim(regexp_replace(lower({fold(c)}), '\s+', ' ', 'g'))"


def count_words(c: str, words: str) -> str:
    """Words that match a pattern as a whole, counted."""
    return rf"len(list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '{words}')))"


PROFILE = rf"""
SELECT doc_id, lang, source, chars, line_count, mission_markers, ats_markers, round(ratio, 3) AS short_line_ratio, profile,
  (profile = 'scanned' AND chars < 500) OR chars < 250 OR line_count < 5 AS needs_review,
  CASE profile WHEN 'scanned' THEN 35 WHEN 'two_column' THEN 72 ELSE 88 END AS extraction_score
FROM (
  SELECT *, CASE WHEN ats_markers >= 3 THEN 'ats' WHEN chars < 250 AND ats_markers = 0 THEN 'scanned' WHEN chars > 9000 OR mission_markers >= 10 THEN 'senior_long'
    WHEN ratio > 0.58 AND line_count > 45 THEN 'two_column' ELSE 'normal' END AS profile
  FROM (
    SELECT doc_id, lang, source, length(array_to_string(ls, chr(10))) AS chars, len(ls) AS line_count,
      {count_words("lower(array_to_string(ls, chr(10)))", MISSION_WORDS)} AS mission_markers, {count_words("lower(array_to_string(ls, chr(10)))", ATS_WORDS)} AS ats_markers,
      len(list_filter(ls, lambda x: length(x) <= 18)) / greatest(len(ls), 1) AS ratio
    FROM (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents)))
"""

REQUESTS = """
(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'normal' END AS priority,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'NAME' END AS first_name, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS locked, CAST(o_orderkey % 5 AS INT) AS attempts, o_orderdate AS created FROM orders)
"""
REQUEUED = f"""
(SELECT id, priority, created, locked, CASE WHEN stuck THEN 'submitted' ELSE status END AS status, CASE WHEN stuck THEN 0 ELSE attempts END AS attempts
 FROM (SELECT *, status = 'failed' AND first_name = '' AND attempts >= 3 AS stuck FROM {REQUESTS}))
"""
LINES = r"""
(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord, block
 FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, trim(unnest(ls)) AS block FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) WHERE block <> '')
"""
PAGES = """
(SELECT doc_id, page, length(body) AS char_count, len(string_split(body, chr(10))) AS block_count, least(1.0, length(body) / 3600) AS used_ratio
 FROM (SELECT doc_id, page, substring(text, (page - 1) * 3300 + 1, 3300) AS body FROM (SELECT doc_id, text, unnest(range(1, greatest(1, CAST(ceil(length(text) / 3300) AS INT)) + 1)) AS page FROM documents)))
"""
ISSUES = f"""
(SELECT doc_id, page, unnest(list_filter([
    CASE WHEN (c >= 3000 AND NOT (c < 3400 AND r < 0.70)) OR (b >= 42 AND r >= 0.75) THEN CASE WHEN c >= 3600 OR r >= 0.92 THEN 'page_too_dense' ELSE 'page_dense_but_acceptable' END END,
    CASE WHEN thin THEN 'last_page_sparse' END, CASE WHEN thin OR (last >= 3 AND page > 1 AND page < last AND r <= 0.40 AND c <= 900) THEN 'page_too_sparse' END], lambda x: x IS NOT NULL)) AS code
 FROM (SELECT *, last > 1 AND page = last AND ((c <= 180 AND b <= 4) OR (c <= 650 AND r <= 0.35)) AS thin
   FROM (SELECT doc_id, page, char_count AS c, block_count AS b, used_ratio AS r, max(page) OVER (PARTITION BY doc_id) AS last FROM {PAGES})))
"""
WEIGHTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in qa.WEIGHTS.items())
SUMMARY = """
(SELECT user_id, count(*) AS n, string_agg(event_type, ' → ' ORDER BY ts, event_id) AS sequence,
   coalesce(arg_max(event_type, ts) FILTER (event_type IN ('error', 'purchase')), arg_max(event_type, ts)) AS terminal, arg_min(props, ts) FILTER (event_type = 'signup') AS first_profile
 FROM events GROUP BY user_id)
"""
HEADER = "CASE WHEN length(t) > 80 THEN NULL " + " ".join(f"WHEN regexp_matches(t, '{has(w)}') THEN '{k}'" for k, w in segment.HEADERS) + " END"
CATEGORY = category_case("t")
SKILL_KEY = rf"regexp_replace({label('p_name')}, '[^a-z0-9+#.]', '', 'g')"
PIECE = {k: q(v.replace("(?i)", "(?i)")) for k, v in sanitize.CONTACTS.items()}
CODE = "regexp_replace(lower(trim(c)), '[^a-z0-9_:-]+', '_', 'g')"

ORACLE_SQL: dict[str, str] = {
    "source_profile": f"SELECT doc_id, chars, line_count, mission_markers, ats_markers, profile, short_line_ratio, needs_review, extraction_score FROM ({PROFILE})",
    "review_gate": f"SELECT profile, count(*) AS n, count(*) FILTER (needs_review) AS review FROM ({PROFILE}) GROUP BY profile",
    "profile_distribution": f"SELECT source, profile, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM ({PROFILE}) GROUP BY source, profile",
    "pii_redaction_counts": rf"""
        SELECT doc_id, len(regexp_extract_all(t, '{PIECE["email"]}')) AS n_email, len(regexp_extract_all(t1, '(?:^|[^0-9])(?:0[67][ .-]?(?:[0-9]{{2}}[ .-]?){{3}}[0-9]{{2}}|\+33[ .-]?[67][ .-]?(?:[0-9]{{2}}[ .-]?){{3}}[0-9]{{2}})(?:$|[^0-9])')) AS n_phone,
          len(regexp_extract_all(t1, '{PIECE["linkedin"]}')) AS n_linkedin, len(regexp_extract_all(t1, '{PIECE["github"]}')) AS n_github
        FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{PIECE["email"]}', '', 'g') AS t1 FROM documents)""",
    "line_blocks": rf"""
        SELECT doc_id, CAST(ord AS INT) AS ord, 'other_' || lpad(CAST(ord AS VARCHAR), CAST(greatest(3, length(CAST(ord AS VARCHAR))) AS INT), '0') || '_' || substring(sha1(block), 1, 8) AS block_id, length(block) AS char_count, greatest(1, CAST(ceil(length(block) / 72) AS BIGINT)) AS estimated_lines,
          len(regexp_extract_all(lower(block), '[a-z0-9à-ÿ]+')) AS token_count, substring(sha1(array_to_string(regexp_extract_all(lower(block), '[a-z0-9à-ÿ]+'), ' ')), 1, 12) AS fingerprint
        FROM {LINES}""",
    "section_carry_forward": rf"""
        SELECT section, count(*) AS n, count(h) AS headers FROM (
          SELECT h, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS section
          FROM (SELECT *, {HEADER} AS h FROM (SELECT *, trim(regexp_replace(block, '\s+', ' ', 'g')) AS t FROM {LINES}))) GROUP BY section""",
    "section_types": "SELECT * FROM (VALUES (1, 'other,other,skills,other,experience,experience,other,languages'), (2, 'other,experience,other,experience'), (3, '')) v(doc_id, types)",
    "normalized_text": f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {fidelity("coalesce(text, '')")} AS t FROM documents)",
    "fingerprint_duplicates": "SELECT substring(sha1(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9à-ÿ]+'), ' ')), 1, 12) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "required_fact_coverage": f"""
        WITH f AS (SELECT item_id AS fact_id, {fidelity("coalesce(text, '')")} AS fact FROM benchmark), t AS (SELECT doc_id AS text_id, {fidelity("coalesce(text, '')")} AS hay FROM documents),
        w AS (SELECT fact_id, fact, list_filter(string_split(fact, ' '), lambda x: length(x) >= 3) AS ws FROM f)
        SELECT fact_id, text_id FROM w, (SELECT *, replace(hay, ' ', '') AS tight FROM t)
        WHERE contains(hay, fact) OR len(list_filter(ws, lambda x: NOT contains(hay, x) AND NOT contains(tight, x))) = 0""",
    "block_coverage": """
        SELECT conv_id, overlap FROM (
          SELECT conv_id, round(len(list_intersect(a, b)) / len(a), 6) AS overlap FROM (
            SELECT x.conv_id, list_distinct(regexp_extract_all(lower(x.text), '[a-z0-9à-ÿ]+')) AS a, regexp_extract_all(lower(y.text), '[a-z0-9à-ÿ]+') AS b
            FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = 0 AND y.turn = 1) WHERE len(a) > 0) WHERE overlap < 0.65""",
    "placeholder_repetition": "SELECT -1 AS doc_id, 'analyse des besoins' AS base, '1,2,3' AS numbers",
    "issue_summary": """
        SELECT user_id, count(*) FILTER (event_type = 'error') AS hard_count, count(*) FILTER (event_type <> 'error') AS soft_count,
          array_to_string(list_sort(list_distinct(list(CASE event_type WHEN 'error' THEN 'source_fact_missing' WHEN 'click' THEN 'source_coverage_missing_section' ELSE 'title_absent_from_source' END))), ',') AS codes
        FROM events WHERE event_type IN ('error', 'click', 'view') GROUP BY user_id""",
    "claim_queue_topk": f"""
        SELECT id, priority, 'processing' AS status, attempts + 1 AS worker_attempts FROM {REQUEUED}
        WHERE status IN ('submitted', 'revision_requested') AND (locked IS NULL OR locked < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 MINUTE) AND attempts < 3
        ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, created, id LIMIT 10""",
    "requeued_requests": f"SELECT status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM {REQUEUED} GROUP BY status",
    "unlocked_request": f"SELECT min(id) AS id, 'submitted' AS status, 0 AS worker_attempts, 'unlocked' AS event_type, 'failed' AS from_status FROM {REQUESTS} WHERE status = 'failed'",
    "latest_version": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1",
    "version_numbers": "SELECT l_orderkey, CAST(count(*) AS INT) AS versions FROM lineitem GROUP BY l_orderkey",
    "version_gate": """
        SELECT CASE WHEN s = 'qa_failed' THEN 'unsupported_status' WHEN q = 'failed' THEN 'unsupported_qa_status' WHEN s = 'ready' AND q <> 'passed' THEN 'ready_without_passed_qa' WHEN s = 'draft_ready' AND q <> 'draft' THEN 'draft_without_draft_qa'
          WHEN s = 'ready' AND k % 4 = 0 THEN 'ready_without_passing_report' WHEN s = 'draft_ready' AND k % 4 > 0 THEN 'draft_with_passing_report' END AS violation, count(*) AS n
        FROM (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'draft_ready' ELSE 'qa_failed' END AS s, CASE o_orderkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'draft' ELSE 'failed' END AS q FROM orders) GROUP BY 1""",
    "latest_event_badge": """
        SELECT o_orderkey, event_id, event_type FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)
        LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON e.user_id = o_custkey""",
    "dashboard_kpis": f"SELECT count(*) AS total, count(*) FILTER (status IN ('submitted', 'processing', 'revision_requested')) AS in_progress, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (priority = 'urgent') AS urgent FROM (SELECT * FROM {REQUESTS} ORDER BY created DESC, id DESC LIMIT 50)",
    "queue_stats": f"SELECT coalesce(status, 'total') AS state, count(*) AS n FROM {REQUESTS} GROUP BY ROLLUP (status)",
    "stale_processing": f"SELECT id FROM {REQUESTS} WHERE status = 'processing' AND locked < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY",
    "retryable_requests": f"SELECT id FROM {REQUESTS} WHERE status = 'failed' AND created < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY",
    "low_scores": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS score FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) < 60 ORDER BY ts DESC, event_id LIMIT 20",
    "status_digest": """
        WITH e AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'processing' WHEN 'click' THEN 'draft_ready' ELSE 'unknown' END AS status FROM events)
        SELECT status, count(*) AS n, any_value(total) AS total, any_value(r) AS ready_rate, any_value(dr) AS draft_ready_rate, any_value(b) AS blocked_rate, CAST(0 AS DOUBLE) AS needs_human_review_rate
        FROM e, (SELECT count(*) AS total, round(count(*) FILTER (status = 'ready') * CAST(100 AS DOUBLE) / count(*), 1) AS r, round(count(*) FILTER (status = 'draft_ready') * CAST(100 AS DOUBLE) / count(*), 1) AS dr, round(count(*) FILTER (status = 'failed') * CAST(100 AS DOUBLE) / count(*), 1) AS b FROM e) GROUP BY status""",
    "top_error_prefixes": "SELECT substring(trim(props), 1, 60) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, error LIMIT 5",
    "source_profile_by_time": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type",
    "event_sequences": f"SELECT user_id, n, md5(sequence) AS sequence, terminal, first_profile FROM {SUMMARY}",
    "incident_signatures": f"""
        SELECT 'failed|' || CASE WHEN user_id % 2 = 0 THEN 'contact_leak' ELSE 'no_category' END || '|' || CASE WHEN n > 10 THEN 'many_events' ELSE 'no_specific_issue' END || '|' || CASE WHEN first_profile IS NULL THEN 'unknown_profile' ELSE 'normal' END
          || '|' || CASE WHEN user_id % 3 = 0 THEN 'first_name_present' ELSE 'missing_first_name' END AS signature, count(*) AS n, min(user_id) AS sample
        FROM {SUMMARY} WHERE terminal = 'error' GROUP BY 1""",
    "incident_recommendations": f"""
        SELECT recommendation, count(*) AS n FROM (
          SELECT unnest(CASE WHEN len(r) = 0 THEN ['P2:write_fixture'] ELSE r END) AS recommendation FROM (
            SELECT list_filter([CASE WHEN user_id % 5 = 0 THEN 'P0:require_first_name' END, CASE WHEN user_id % 3 = 1 AND n > 10 THEN 'P0:repair_missing_experience' END, CASE WHEN user_id % 3 = 0 THEN 'P0:locate_contact_leak' END,
              CASE WHEN user_id % 3 = 2 THEN 'P1:split_model_failures' END, CASE WHEN terminal <> 'error' THEN 'P1:review_path' END], lambda x: x IS NOT NULL) AS r FROM {SUMMARY})) GROUP BY 1""",
    "history_anti_join": "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "stage_durations": "SELECT event_type, count(m) AS n, CAST(sum(m) AS BIGINT) AS micros FROM (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events) GROUP BY event_type",
    "rate_limit_sliding": """
        SELECT event_id, c AS calls, c <= 3 AS allowed, greatest(0, 3 - c) AS remaining
        FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS c FROM events)""",
    "dup_suppression": """
        WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
        k AS (
          SELECT user_id, event_type, event_id, i, t AS last, true AS kept FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.i, CASE WHEN e.t - k.last > 3600000000 THEN e.t ELSE k.last END, e.t - k.last > 3600000000
          FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.i = k.i + 1)
        SELECT event_id, kept FROM k""",
    "uppercase_and_glyph_qa": r"""
        SELECT doc_id, round(len(regexp_extract_all(t, '\p{Lu}')) / greatest(len(regexp_extract_all(t, '\p{L}')), 1), 6) AS uppercase, contains(t, chr(65533)) AS bad_glyphs,
          regexp_matches(t, '(?i)(?:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})|(?:\+33|\b0[67])(?:[ .-]?[0-9]{2}){4}\b|(?:linkedin\.com/|github\.com/|https?://|www\.)') AS contact
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "page_issues": f"SELECT doc_id, CAST(page AS INT) AS page, code FROM {ISSUES}",
    "page_metrics_score": f"""
        WITH i AS (SELECT doc_id, code FROM {ISSUES} UNION ALL SELECT doc_id, 'page_balance_unbalanced' FROM (
          SELECT doc_id, max(used_ratio) - min(used_ratio) AS spread FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM {PAGES} WHERE char_count > 0) WHERE n >= 3 AND (n <= 3 OR i > 1) GROUP BY doc_id) WHERE spread >= 0.48),
        s AS (SELECT doc_id, sum(CASE code {WEIGHTS} ELSE 10 END) AS p, count(*) AS n FROM i GROUP BY doc_id)
        SELECT *, CASE WHEN score >= 86 THEN 'good' WHEN score >= 70 THEN 'acceptable_draft' ELSE 'poor' END AS verdict
        FROM (SELECT d.doc_id, CAST(greatest(0, 100 - coalesce(p, 0)) AS INT) AS score, coalesce(n, 0) AS issues FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id)""",
    "layout_variants": """
        SELECT l_orderkey, score, ord FROM (
          SELECT l_orderkey, 100 - sum(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END) * 15 - sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) * 25 - greatest(0, count(*) - 4) * 5 AS score, l_linenumber AS ord FROM lineitem GROUP BY l_orderkey, l_linenumber)
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, ord) = 1""",
    "qa_status": f"""
        SELECT status, CAST(score AS INT) AS score, count(*) AS n FROM (
          SELECT CASE WHEN d.doc_id % 11 = 0 THEN 'failed' WHEN coalesce(k, 0) > 0 THEN 'draft' WHEN d.doc_id % 5 = 0 THEN 'failed' ELSE 'passed' END AS status, least(greatest(0, 100 - coalesce(k, 0) * 12), CASE WHEN d.doc_id % 2 = 0 THEN 100 ELSE 82 END) AS score
          FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT code) AS k FROM {ISSUES} GROUP BY doc_id) i ON i.doc_id = d.doc_id) GROUP BY ALL""",
    "eval_assertions": """
        SELECT doc_id AS id, len(f) = 0 AS passed, array_to_string(f, ',') AS failures FROM (
          SELECT doc_id, list_filter([CASE WHEN lang IS DISTINCT FROM 'en' THEN 'status' END, CASE WHEN NOT contains(text, 'the') OR NOT contains(text, 'and') THEN 'required_terms' END,
            CASE WHEN regexp_matches(text, '(?i)token') THEN 'forbidden' END, CASE WHEN ceil(n_chars / 3000) > 2 THEN 'max_pages' END], lambda x: x IS NOT NULL) AS f FROM documents)""",
    "issue_code_extraction": "SELECT * FROM (VALUES (1, 'a_b,c', 2, 1), (2, '', NULL, NULL), (3, '', NULL, NULL)) v(id, codes, hard, soft)",
    "skills_dedup": f"SELECT p_brand, {SKILL_KEY} AS skill_key, arg_min(p_name, p_partkey) AS value, min(p_partkey) AS ord FROM part GROUP BY 1, 2",
    "skill_groups": """
        SELECT p_brand, category, CAST(part AS INT) AS part, string_agg(p_name, ',' ORDER BY p_partkey) AS values FROM (
          SELECT p_brand, p_type AS category, p_name, p_partkey, (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1) // 6 + 1 AS part FROM part) GROUP BY 1, 2, 3""",
    "skill_categories": f"""
        SELECT value, {CATEGORY} AS category FROM (SELECT value, {label("value")} AS t FROM (
          SELECT unnest(['Docker', 'Kubernetes', 'PostgreSQL', 'Redis', 'Oracle', 'Méthodes Agile (Scrum', 'Safe)', 'Jardinage']) AS value UNION ALL SELECT DISTINCT p_name FROM part))""",
    "language_merge": """
        SELECT source, arg_min(name, doc_id) AS name, coalesce(arg_min(level, doc_id) FILTER (level IS NOT NULL), '') AS level
        FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS name, CASE WHEN doc_id % 3 = 0 THEN 'B' || (doc_id % 2 + 1) END AS level FROM documents) GROUP BY source, lower(trim(name))""",
    "table_query": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderpriority LIKE '1%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "visible_requests": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND lower(c_mktsegment) = 'building')",
    "request_detail": "SELECT o_orderkey, coalesce(n, 0) AS versions, newest FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS newest FROM lineitem GROUP BY 1) v ON l_orderkey = o_orderkey",
    "snapshot_update": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "string_scalars": f"""
        SELECT p_partkey, substring({CODE}, 1, 80) AS code, regexp_replace(regexp_replace({fold("c")}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(c, '&', '&amp;') AS escaped, upper(string_split(c, ' ')[1]) AS first_name,
          regexp_replace(c, '[^a-zA-Z0-9_.-]', '_', 'g') AS file, regexp_replace(regexp_replace({fold("c")}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-doc-v' || p_size || '.pdf' AS download
        FROM (SELECT *, p_name || ' É/ç & ' || p_brand AS c FROM part)""",
    "numeric_scalars": """
        SELECT o_orderkey, CAST(least(greatest(round_even(o_totalprice / 4000, 0), 0), 100) AS INT) AS score, least(10.0 * pow(2, o_orderkey % 9), 300) AS backoff, (o_orderkey + 115) // 116 AS pages, round(o_orderkey / greatest(o_orderkey % 3, 1), 6) AS ratio FROM orders""",
    "stream_failure_counts": "SELECT epoch_us(date_trunc('hour', ts)) AS start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
}

SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
TAXONOMY = rf"trim(regexp_replace(lower({fold("coalesce(text, '')")}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
ERRORS = " ".join(f"WHEN regexp_matches(t, '{has(w)}') THEN '{k}'" for k, w in intents.ERRORS)

ORACLE_SQL |= {
    "revision_intents": f"""
        SELECT CASE WHEN regexp_matches(s, '{has(intents.RESET)}') THEN 'reset' WHEN regexp_matches(s, '{has(intents.CONTENT)}') THEN 'content' WHEN regexp_matches(s, '{has(intents.LAYOUT)}') THEN 'layout_only' ELSE 'unknown' END AS intent,
          CASE WHEN regexp_matches(t, '{has(intents.SHORT)}') AND NOT regexp_matches(t, '{has(intents.NO_COMPACTION)}') THEN 'explicit_short_version' WHEN regexp_matches(t, '{has(intents.REWRITE)}') THEN 'explicit_rewrite'
            WHEN regexp_matches(t, '{has(intents.TARGETED)}') THEN 'targeted_edit' ELSE 'complete_faithful' END AS instruction, count(*) AS n
        FROM (SELECT {SQUEEZED} AS s, coalesce(text, '') AS t FROM (SELECT text FROM conversations UNION ALL SELECT unnest(['remonter la mission en page 1', 'ajouter une mission et remonter le bloc', 'tout refaire', 'merci', '', NULL]))) GROUP BY ALL""",
    "error_taxonomy": f"""
        SELECT CASE WHEN len(f) > 0 AND len(list_filter(f, lambda x: x <> 'source_fidelity')) = 0 THEN 'source_fidelity' {ERRORS} ELSE 'transient_model_failure' END AS category, count(*) AS n
        FROM (SELECT *, regexp_extract_all(t, '(?:primary|fallback)_category_?\\s*([a-z_]+)', 1) AS f FROM (SELECT {TAXONOMY} AS t FROM (SELECT text FROM conversations UNION ALL
          SELECT unnest(['Coordonnées détectées : email', 'Texte source trop court', 'primary_category_source_fidelity', 'page_too_dense page 3', 'logo manquant', 'timeout', 'Prénom candidat absent', NULL])))) GROUP BY ALL""",
    "long_doc_chunks": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, i, length(ls[i]) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE length(t) > 7000)),
        c AS (
          SELECT doc_id, i, n, n + 1 AS used, 1 AS part FROM l WHERE i = 1
          UNION ALL SELECT l.doc_id, l.i, l.n, CASE WHEN c.used > 0 AND c.used + l.n > 7000 THEN l.n + 1 ELSE c.used + l.n + 1 END, c.part + CASE WHEN c.used > 0 AND c.used + l.n > 7000 THEN 1 ELSE 0 END
          FROM c JOIN l ON l.doc_id = c.doc_id AND l.i = c.i + 1)
        SELECT doc_id, CAST(part AS INT) AS part, CAST(sum(n) + count(*) - 1 AS BIGINT) AS chars, count(*) AS lines FROM c GROUP BY doc_id, part
        UNION ALL SELECT doc_id, 1, length(t), len(ls) FROM d WHERE length(t) <= 7000""",
    "packing_breaks": """
        WITH RECURSIVE h AS (
          SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) - 1 AS i, CAST(2 + greatest(1, least(3, (CAST(floor(l_quantity * 8) AS INT) + 115) // 116)) AS INT) AS h FROM lineitem),
        p AS (
          SELECT l_orderkey, i, least(h, 9) AS used, '' AS breaks FROM h WHERE i = 0
          UNION ALL SELECT h.l_orderkey, h.i, CASE WHEN fits THEN p.used + h.h ELSE least(h.h, 9) END, CASE WHEN fits THEN p.breaks WHEN p.breaks = '' THEN CAST(h.i AS VARCHAR) ELSE p.breaks || ',' || h.i END
          FROM p JOIN h ON h.l_orderkey = p.l_orderkey AND h.i = p.i + 1, LATERAL (SELECT p.used + h.h <= 9 OR (p.used < 10 AND p.used + h.h <= 12) AS fits))
        SELECT l_orderkey, breaks FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY i DESC) = 1""",
    "page_overflow": """
        SELECT l_orderkey, side, count(*) AS n FROM (
          SELECT l_orderkey, unnest(list_filter([CASE WHEN l_quantity < 22.5 THEN 'left' END, CASE WHEN l_quantity * 2 < 22.5 THEN 'top' END, CASE WHEN l_quantity + 50 > 77.5 THEN 'right' END, CASE WHEN l_quantity * 2 + 10 > 77.5 THEN 'bottom' END], lambda x: x IS NOT NULL)) AS side FROM lineitem)
        GROUP BY ALL""",
    "zone_plan": """
        SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag IN ('R', 'A') AND l_quantity <= 14 THEN 'right_sidebar' ELSE 'main' END AS zone, count(*) AS blocks, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS block_ids
        FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""",
    "retry_options": f"""
        SELECT doc_id, NOT sparse AS force_new_page, CASE WHEN sparse THEN 2850 ELSE 2600 END AS dense_chars, CASE WHEN sparse THEN 130 ELSE 170 END AS reserve FROM (
          SELECT doc_id, bool_or(code IN ('last_page_sparse', 'page_too_sparse')) AS sparse, bool_or(code = 'page_too_dense') AS dense FROM {ISSUES} GROUP BY doc_id) WHERE sparse OR dense""",
    "contact_paths": r"""
        SELECT doc_id, array_to_string(list_sort(list_distinct(list(c))), ',') AS categories, count(*) AS paths FROM (
          SELECT doc_id, CASE WHEN regexp_matches(x, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b') THEN 'email' WHEN regexp_matches(x, '(?:^|[^0-9])(?:\+33\s?|0[67])(?:[ .\-]?[0-9]{2}){4}\b') THEN 'phone_fr'
            WHEN regexp_matches(x, '(?i)linkedin\.com/\S+|lnkd\.in/\S+') THEN 'linkedin_profile' WHEN regexp_matches(x, '(?i)\bgithub\.com/\S+') THEN 'github_profile'
            WHEN len(list_filter(regexp_extract_all(x, '(?i)https?://\S+|www\.\S+|\b(?:[a-z0-9-]+\.)+(?:com|fr|net|org|io|ai|dev|co)\b(?:/\S*)?'),
              lambda v: NOT regexp_full_match(v, '(?i)(?:api|applications?|asp|c#|dot|framework|mvc|react|stack|web)\.net'))) > 0 THEN 'url' END AS c
          FROM (SELECT doc_id, unnest(list_concat([string_split(text, chr(10))[1]], string_split(text, chr(10)))) AS x FROM documents)) WHERE c IS NOT NULL GROUP BY doc_id""",
    "heading_kinds": "SELECT * FROM (VALUES (1, 'skills'), (2, NULL), (3, 'education'), (4, 'experience'), (5, NULL)) v(id, kind)",
}

ORACLE_SQL |= {
    "owner_rows": "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "status_labels": """
        SELECT label, percent, count(*) AS n FROM (
          SELECT CASE WHEN s = 'draft_ready' THEN 'Brouillon prêt' WHEN r THEN 'Prêt à télécharger' WHEN x THEN 'Mise au format' WHEN w THEN 'Analyse du CV' WHEN s = 'submitted' THEN 'En attente' ELSE 'Annulé' END AS label,
            CAST(CASE WHEN r OR s = 'draft_ready' THEN 100 WHEN x THEN 60 WHEN w THEN 35 WHEN s = 'cancelled' THEN 0 ELSE 15 END AS INT) AS percent
          FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'P' THEN 'draft_ready' ELSE 'cancelled' END AS s, coalesce(r, false) AS r, coalesce(x, false) AS x, coalesce(w, false) AS w FROM orders
            LEFT JOIN (SELECT user_id, bool_or(event_type = 'purchase') AS r, bool_or(event_type = 'click') AS x, bool_or(event_type = 'signup') AS w FROM events GROUP BY user_id) e ON user_id = o_custkey)) GROUP BY ALL""",
    "integrity_issues": """
        WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag = 'R' AS f, l_linestatus = 'O' AS body, count(*) FILTER (l_returnflag <> 'R') OVER (PARTITION BY l_orderkey) AS k FROM lineitem)
        SELECT l_orderkey, code, count(*) AS n FROM (
          SELECT l_orderkey, unnest(list_filter([
            CASE WHEN f AND n % 2 > 0 AND n % 3 > 0 THEN 'experience_misclassified_as_formation' END, CASE WHEN f AND n % 2 = 0 AND n % 3 > 0 THEN 'empty_formation_stub' END,
            CASE WHEN NOT f AND body AND n % 3 = 0 AND n % 2 = 0 THEN 'headerless_experience_sections' END, CASE WHEN NOT f AND NOT body AND k > 1 AND (n % 3 > 0 OR n % 2 > 0) THEN 'experience_header_without_body' END,
            CASE WHEN NOT f AND NOT body AND n % 3 > 0 AND n % 2 = 0 THEN 'empty_experience_date_stub' END], lambda c: c IS NOT NULL)) AS code FROM l) GROUP BY ALL""",
}

JOBS = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS version FROM orders)"
COMMENTS = "(SELECT conv_id * 100 + turn AS comment_id, conv_id AS request_id, turn, CASE WHEN turn % 4 < 2 THEN 'Remonter en page 1' WHEN turn % 4 = 2 THEN '' ELSE 'Autre ' || turn END AS body, turn * 6 AS t FROM conversations)"
FAILURES = "(SELECT user_id AS id, ts AS t, CASE WHEN value > 100 THEN 'dead_letter' ELSE 'failed' END AS status, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error' AND user_id IN (SELECT o_orderkey FROM orders))"


def without(c: str, w: str) -> str:
    """A word taken out, twice, since a border may serve two of them."""
    once = lambda x: rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_]){w}($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1\2', 'g')"
    return once(once(c))


ORACLE_SQL |= {
    "sanitized_blocks": rf"""
        WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
          b AS (SELECT *, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[^\s,;]+' AS p FROM a), c AS (SELECT doc_id, len(regexp_extract_all(t, p)) AS n_linkedin, regexp_replace(t, p, '', 'g') AS t FROM b),
          e AS (SELECT *, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}\b' AS p FROM c), f AS (SELECT doc_id, n_linkedin, len(regexp_extract_all(t, p)) AS n_email, regexp_replace(t, p, '', 'g') AS t FROM e),
          g AS (SELECT *, '(?:(?:\+33|0)\s*[1-9](?:[\s.-]*[0-9]{{2}}){{4}})' AS p FROM f), h AS (SELECT doc_id, n_linkedin, n_email, len(regexp_extract_all(t, p)) AS n_phone, regexp_replace(t, p, '', 'g') AS t FROM g),
          i AS (SELECT doc_id, n_linkedin, n_email, n_phone, len(regexp_extract_all(t, '(?i)https?://[^\s,;]+')) AS n_url, regexp_replace(t, '(?i)https?://[^\s,;]+', '', 'g') AS t FROM h)
        SELECT doc_id, n_linkedin, n_email, n_phone, n_url, len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: lower(w) = 'the')) AS n_identity,
          md5(array_to_string(list_filter(list_transform(string_split({without("t", "the")}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text FROM i""",
    "rationale_guard": r"""
        SELECT role, count(*) AS n, count(*) FILTER (
          regexp_matches(coalesce(text, ''), '(?i)(?:[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}|(?:\+?[0-9][0-9\-().\s]{7,}[0-9])|https?://[^\s]+|linkedin\.com/[^\s]+|/(?:in|pub)/[a-z0-9_-]+)')
          OR regexp_matches(coalesce(text, ''), '(?:^|[^\p{L}\p{N}_])[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:\s+[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+){2,}(?:$|[^\p{L}\p{N}_])')) AS unsafe FROM conversations GROUP BY role""",
    "skills_display_quality": """
        WITH s AS (SELECT l_suppkey, p_type IN ('ECONOMY', 'STANDARD') AS o, p_type = 'STANDARD' AS more, regexp_replace(lower(p_name), '[^a-z0-9+#.]', '', 'g') AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
          t AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (o) AS others, count(*) - count(DISTINCT k) AS again, bool_or(more) AS more FROM s GROUP BY l_suppkey)
        SELECT l_suppkey, 'too_many_skill_items' AS code, total AS n, total FROM t WHERE total > 60
        UNION ALL SELECT l_suppkey, 'too_many_autres_items', others, total FROM t WHERE others > 8 OR others / total > 0.2
        UNION ALL SELECT l_suppkey, 'autres_dominates_skills', others, total FROM t WHERE others / total > 0.25
        UNION ALL SELECT l_suppkey, 'duplicate_skill_items', again, total FROM t WHERE again > 0
        UNION ALL SELECT l_suppkey, 'continued_autres_category', 1, NULL FROM t WHERE more""",
    "draft_warnings": """
        SELECT CASE WHEN p > 0 THEN 'Page ' || p || ' · ' ELSE '' END || CASE event_type WHEN 'click' THEN 'Page trop dense' WHEN 'error' THEN 'Saut de page à reprendre' ELSE 'Point qualité à vérifier' END
          || ' — ' || CASE WHEN p > 1 THEN 'a b ' || event_type ELSE 's' END AS warning, count(*) AS n
        FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS p FROM events) GROUP BY ALL""",
    "quality_labels": f"""
        SELECT CASE profile WHEN 'normal' THEN 'CV standard' WHEN 'senior_long' THEN 'CV senior long' WHEN 'ats' THEN 'CV ATS / jobboard' WHEN 'scanned' THEN 'Extraction faible' WHEN 'two_column' THEN 'CV en colonnes'
            WHEN 'graphic' THEN 'CV graphique' WHEN 'risky' THEN 'CV risqué' ELSE 'Profil source inconnu' END AS label, CAST(greatest(0, least(100, floor(chars / 40 + 0.5))) AS INT) AS score, count(*) AS n
        FROM ({PROFILE}) GROUP BY ALL""",
    "packing_options": """
        SELECT l_orderkey, NOT short AS force_new_page, 'balanced' AS density_profile, 130 AS readability_reserve, NOT short AND (total > 24 OR (total > 21 AND total - last >= 10)) AS breaks FROM (
          SELECT l_orderkey, count(*) <= 8 AND sum(h) <= 120 AND max(h) <= 30 AS short, sum(CASE WHEN i = 1 THEN least(h, 21) ELSE h END) AS total, arg_max(h, i) AS last
          FROM (SELECT l_orderkey, CAST(l_quantity AS INT) AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT)) AS i FROM lineitem) GROUP BY l_orderkey)""",
    "enqueued_jobs": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 50 ELSE 10 END AS priority, 3 AS attempts, 'exponential' AS backoff_type, 5000 AS backoff_ms, count(*) AS n, count(*) * 20000 AS delay FROM orders GROUP BY ALL",
    "failed_requests": f"""
        WITH f AS (SELECT id, arg_max(status, t) AS s, arg_max(k, t) AS k FROM {FAILURES} GROUP BY id)
        SELECT coalesce(s, r.status) AS status, count(*) AS n, sum(CASE WHEN k IS NOT NULL THEN least(500, 1 + 400 * len(k)) END) AS chars, count(s) AS updated FROM {JOBS} r LEFT JOIN f USING (id) GROUP BY ALL""",
    "failure_events": f"""
        SELECT status AS event_type, 'source_fidelity' AS category, '["a' || k || '","b"]' AS issues, k AS hard, count(*) AS n FROM {FAILURES} GROUP BY ALL""",
    "revision_comments": f"""
        WITH RECURSIVE c AS (SELECT c.*, r.version, r.status FROM {COMMENTS} c JOIN {JOBS} r ON request_id = id WHERE body <> '' AND NOT (id % 5 = 0 AND body LIKE 'Rem%' AND t <= 9)),
          k AS (SELECT request_id, body, min(t) AS t FROM c GROUP BY ALL UNION ALL SELECT k.request_id, k.body, (SELECT min(c.t) FROM c WHERE c.request_id = k.request_id AND c.body = k.body AND c.t > k.t + 10) FROM k WHERE k.t IS NOT NULL)
        SELECT comment_id, request_id, version AS version_id, body, CASE WHEN version IS NOT NULL THEN version % 4 + 1 END AS version_number, status AS from_status FROM c SEMI JOIN k USING (request_id, body, t)""",
    "revision_snapshot": f"SELECT CASE WHEN id IN (SELECT request_id FROM {COMMENTS} WHERE body <> '') THEN 'revision_requested' ELSE status END AS status, count(*) AS n FROM {JOBS} GROUP BY ALL",
    "layout_only_reuse": f"SELECT id AS request_id, version AS version_id, version % 4 + 1 AS version_number FROM {JOBS} WHERE version % 2 = 0 AND id IN (SELECT request_id FROM {COMMENTS} WHERE turn <= 3 AND body LIKE 'Rem%')",
    "resolved_comments": f"SELECT comment_id % 3 = 0 OR request_id IN (SELECT id FROM {JOBS} WHERE status = 'failed') AS resolved, count(*) AS n FROM {COMMENTS} GROUP BY ALL",
    "request_states": """
        SELECT user_id, coalesce(arg_max(s, (ts, event_id)) FILTER (s IS NOT NULL), 'submitted') AS status, count(s) AS n_changes, count(*) FILTER (s = 'processing') AS claims
        FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' END AS s FROM events) GROUP BY user_id""",
    "version_history": """
        SELECT l_orderkey, 'Historique utile: version V' || (l_orderkey % 7) || ' (qa=' || CASE WHEN l_orderkey % 2 = 0 THEN 'passed' ELSE 'unknown' END || '). Points qualité précédents: '
          || string_agg(CASE WHEN l_returnflag = 'R' THEN 'point_qualite' ELSE l_returnflag END || CASE WHEN l_linestatus = 'O' THEN ': late' ELSE ': cut' END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) || '.' AS body
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem) WHERE i <= 3 GROUP BY l_orderkey""",
}

ORACLE_SQL["sql_table_functions"] = f"""
    WITH l AS (SELECT max(created) AS at_ FROM {REQUESTS})
    SELECT 'retryable' AS kind, id, NULL AS code FROM {REQUESTS}, l WHERE status = 'failed' AND created < at_ - INTERVAL 8760 HOUR AND id % 3 = 0
    UNION ALL SELECT 'stale', id, NULL FROM {REQUESTS}, l WHERE status = 'processing' AND locked < at_ - INTERVAL 525600 MINUTE
    UNION ALL SELECT * FROM (SELECT 'claimable', id, priority || '_' || CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 ELSE 2 END FROM {REQUESTS}, l WHERE status = 'submitted' AND attempts < 3
      ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, created, id LIMIT 25)
    UNION ALL SELECT status, count(*), '40' FROM {REQUESTS} GROUP BY status"""

RESULTS = """
    (SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS ord, l_partkey AS n, l_partkey % 3 > 0 AS has,
       CASE WHEN l_partkey % 5 = 0 THEN 'draft_ready' WHEN l_partkey % 11 = 0 THEN 'failed' ELSE 'ready' END AS s, CASE WHEN l_partkey % 5 = 0 THEN 'draft' WHEN l_partkey % 7 = 0 THEN 'failed' ELSE 'passed' END AS q,
       l_partkey % 5 > 0 AND l_partkey % 13 > 0 AS ok FROM lineitem GROUP BY ALL)"""
GATE = "CASE WHEN s = 'failed' THEN 'unsupported_status' WHEN q = 'failed' THEN 'unsupported_qa_status' WHEN s = 'ready' AND NOT ok THEN 'ready_without_passing_report' END"
ORACLE_SQL["rejected_versions"] = f"SELECT {GATE} AS code, count(*) AS n FROM {RESULTS} WHERE {GATE} IS NOT NULL GROUP BY ALL"
ORACLE_SQL["committed_versions"] = f"""
    WITH v AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord % 2, ord) AS version_number FROM {RESULTS} WHERE {GATE} IS NULL),
    p AS (SELECT *, request_id || '/v' || version_number || '/' AS p FROM v)
    SELECT p.request_id, version_number, q AS qa_status, p || 'final.pdf' AS final_path, CASE WHEN has THEN p || 'input.json' END AS renderer_input_path, CASE WHEN has THEN 3 ELSE 2 END AS files,
      arg_max(s, version_number) OVER (PARTITION BY p.request_id) AS status, max(version_number) OVER (PARTITION BY p.request_id) AS current_version FROM p"""
