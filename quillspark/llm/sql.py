"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM items x JOIN items y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id, sets.doc_id = c.component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = sets.doc_id
"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
}

LINE_QUALITY = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, l, sum(len(string_split(l, ' '))) AS nw
  FROM (SELECT doc_id, source, trim(regexp_replace(translate(unnest(ls), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM d)
  GROUP BY ALL),
often AS (SELECT source, l FROM lines GROUP BY source, l HAVING count(*) > 10),
gone AS (
  SELECT lines.doc_id, sum(nw) AS nw, sum(CASE WHEN often.l IS NULL THEN 0 ELSE nw END) AS removed
  FROM lines LEFT JOIN often ON lines.l = often.l AND lines.source IS NOT DISTINCT FROM often.source GROUP BY lines.doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(replace(array_to_string(w, ''), chr(0), ' ')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id)
SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(removed * 100 > nw * 50, false) AS kept
FROM base LEFT JOIN gone ON gone.doc_id = base.doc_id
"""


def _deal(name: str, nodes: str, parents: str, key: str) -> str:
    """Common table expressions that deal a parent's budget among nodes with columns w, cap and budget."""
    return f"""
{name}_o AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap / CAST(w AS DOUBLE), {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS spent,
    sum(w) OVER (PARTITION BY {parents} ORDER BY cap / CAST(w AS DOUBLE), {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS ws FROM ({nodes})),
{name}_f AS (
  SELECT *, min(CASE WHEN cap * ws > (budget - spent) * w THEN spent END) OVER (PARTITION BY {parents}) AS fs,
    arg_min(CASE WHEN cap * ws > (budget - spent) * w THEN ws END, CASE WHEN cap * ws > (budget - spent) * w THEN spent END) OVER (PARTITION BY {parents}) AS fw FROM {name}_o),
{name} AS (SELECT *, CASE WHEN fs IS NULL OR spent < fs THEN cap ELSE least(((budget - fs) * w) // fw, cap) END AS take FROM {name}_f)"""


MIXING = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::HUGEINT AS n_tokens,
    ['web', 'books', 'code', 'forum'][coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % 4 + 1] AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM docs GROUP BY ALL),
{_deal('doms', "SELECT domain, (sum(tokens) * 2)::HUGEINT AS cap, CASE domain WHEN 'web' THEN 40 WHEN 'books' THEN 30 WHEN 'code' THEN 10 WHEN 'forum' THEN 20 ELSE 1 END::HUGEINT AS w, (SELECT sum(tokens)::HUGEINT * 60 // 100 FROM leaves) AS budget FROM leaves GROUP BY domain", '1', 'domain')},
{_deal('lngs', "SELECT leaves.domain, lang, (sum(tokens) * 2)::HUGEINT AS cap, CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 WHEN 'es' THEN 10 ELSE 1 END::HUGEINT AS w, any_value(doms.take) AS budget FROM leaves JOIN doms ON doms.domain = leaves.domain GROUP BY leaves.domain, lang", 'domain', 'lang')},
{_deal('srcs', "SELECT leaves.domain, leaves.lang, source, tokens, tokens * 2 AS cap, 1::HUGEINT AS w, lngs.take AS budget FROM leaves JOIN lngs ON lngs.domain = leaves.domain AND lngs.lang = leaves.lang", 'domain, lang', 'source')},
plan AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE take // tokens END AS passes, take - CASE WHEN tokens = 0 THEN 0 ELSE take // tokens END * tokens AS rest FROM srcs),
marks AS (
  SELECT docs.*, passes, rest, md5('7:' || passes || ':' || doc_id) AS mark FROM docs JOIN plan ON plan.domain = docs.domain AND plan.lang = docs.lang AND plan.source = docs.source),
at_ AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY mark, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS pos FROM marks),
more AS (SELECT *, greatest(0, least(n_tokens, rest - pos)) AS more FROM at_)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (passes + CASE WHEN more > 0 THEN 1 ELSE 0 END)::BIGINT AS epochs, (passes * n_tokens + more)::BIGINT AS taken_tokens FROM more
"""

ORACLE_SQL |= {
    "op2_line_quality": LINE_QUALITY,
    "op5_source_mixing": MIXING,
}


def _found(kind: str, pattern: str, where: str) -> str:
    """Spans of one kind: starts are running sums of the gaps between matches and of the matches."""
    return rf"""
{kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')),
{kind} AS (
  SELECT doc_id, '{kind}' AS kind, hits[i] AS v,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {kind}_m)
  WHERE {where})"""


_DIGITS = "regexp_replace(hits[i], '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substring({_DIGITS}, length({_DIGITS}) - k + 1, 1) AS INT) WHEN CAST(substring({_DIGITS}, length({_DIGITS}) - k + 1, 1) AS INT) > 4 THEN 2 * CAST(substring({_DIGITS}, length({_DIGITS}) - k + 1, 1) AS INT) - 9 ELSE 2 * CAST(substring({_DIGITS}, length({_DIGITS}) - k + 1, 1) AS INT) END)) % 10 = 0"

PII = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")},
{_found("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(hits[i], '.'), lambda x: CAST(x AS HUGEINT))) <= 255")},
{_found("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")},
{_found("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")},
base AS (
  SELECT *, s + length(v) AS e, CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 ELSE 4 END AS o,
    kind || ':' || CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE regexp_replace(v, '[^0-9]', '', 'g') END AS c
  FROM (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone)),
n_c AS (SELECT c, count(DISTINCT doc_id) AS n_c FROM base GROUP BY c HAVING count(DISTINCT doc_id) >= 3),
plain AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '\p{{L}}+')) AS t FROM d),
held AS (SELECT doc_id, t FROM plain UNION SELECT doc_id, left(t, 3) || '*' FROM plain WHERE length(t) > 3),
pairs AS (SELECT c, t, count(*) AS n_ct FROM (SELECT DISTINCT doc_id, c FROM base JOIN n_c USING (c)) JOIN held USING (doc_id) GROUP BY c, t HAVING count(*) >= 3),
n_t AS (SELECT t, count(*) AS n_t FROM held WHERE t IN (SELECT t FROM pairs) GROUP BY t),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
shares AS (
  SELECT c, t, log2(n_ct * n / (n_c * n_t)) / log2(n / n_c) AS share FROM pairs JOIN n_c USING (c) JOIN n_t USING (t), n WHERE n_c < n),
rules AS (
  SELECT x.c, x.t, x.share >= 0.95 OR length(x.t) <= 3 OR coalesce(y.share >= 0.8, false) AS gone
  FROM shares x LEFT JOIN shares y ON y.c = x.c AND y.t = left(x.t, 3) || '*' WHERE x.share >= 0.8 AND x.t NOT LIKE '%*'),
own AS (SELECT doc_id, t, bool_or(gone) AS gone FROM base JOIN rules ON rules.c = base.c GROUP BY doc_id, t),
words AS (
  SELECT doc_id, lower(hits[i]) AS v, length(hits[i]) AS n, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '\p{{L}}+') AS hits, string_split_regex(t, '\p{{L}}+') AS gaps FROM d WHERE doc_id IN (SELECT doc_id FROM own)))),
term AS (
  SELECT words.doc_id, words.s, words.s + words.n AS e, own.gone FROM words JOIN own ON own.doc_id = words.doc_id AND own.t = words.v
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = words.doc_id AND base.s < words.s + words.n AND words.s < base.e)),
listed AS (
  SELECT doc_id, o, s, kind || ':' || s || ':' || e AS x, false AS gone FROM base UNION ALL SELECT doc_id, 5, s, 'term:' || s || ':' || e, gone FROM term),
per AS (
  SELECT doc_id, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
    count(*) FILTER (o = 5 AND gone) AS n_removed, count(*) FILTER (o = 5 AND NOT gone) AS n_generalised,
    string_agg(x, ',' ORDER BY o, s) FILTER (o < 5) AS b, string_agg(x, ',' ORDER BY o, s) AS a FROM listed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  coalesce(n_removed, 0) AS n_removed, coalesce(n_generalised, 0) AS n_generalised,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""

ORACLE_SQL["op3_pii_disclosure"] = PII

#: Base32 of a SHA-1: character i holds the bits from 5 i on, which lie in two hex digits.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (
  SELECT h, first, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substring(h, CAST(5 * i // 4 + 1 AS INT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1 AS INT), 1)), '') AS d FROM f)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN b ON b.h = p.h
"""

ORACLE_SQL["op9_warc"] = WARC


def _codes(rounds: int, parts: int = 4, entries: int = 256) -> str:
    """Codebooks after so many rounds, one pair of tables for each, and the codes by the last."""

    def assigned(k: int) -> str:
        return f"""
a{k} AS (
  SELECT row, p.part, min({{'d': CAST(list_dot_product(x, x) - 2 * list_dot_product(x, b) + list_dot_product(b, b) AS BIGINT), 'e': entry}}) AS m
  FROM part p JOIN b{k} ON b{k}.part = p.part GROUP BY row, p.part)"""

    steps = []
    for k in range(rounds):
        steps += [
            assigned(k),
            f"""
m{k} AS (
  SELECT part, entry, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS b FROM (
    SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n
    FROM (SELECT p.part, m.e AS entry, x, unnest(range(1, len(x) + 1)) AS i FROM part p JOIN a{k} ON a{k}.row = p.row AND a{k}.part = p.part)
    GROUP BY part, entry, i) GROUP BY part, entry),
b{k + 1} AS (SELECT b{k}.part, b{k}.entry, coalesce(m{k}.b, b{k}.b) AS b FROM b{k} LEFT JOIN m{k} ON m{k}.part = b{k}.part AND m{k}.entry = b{k}.entry)""",
        ]
    return rf"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(embedding) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS row FROM v),
part AS (SELECT row, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM numbered, (SELECT unnest(range(0, {parts})) AS part)),
b0 AS (SELECT part, row AS entry, x AS b FROM part WHERE row < {entries}),
{",".join([*steps, assigned(rounds)])},
book AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS s FROM (SELECT part, entry, unnest(b) AS c, unnest(range(1, len(b) + 1)) AS i FROM b{rounds})),
codes AS (SELECT row, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM numbered JOIN codes ON codes.row = numbered.row, book
"""


ORACLE_SQL["op11_vector_codes"] = _codes(4)

#: CRC-32 of a decimal number, bit by bit, and the tries of its conversations as sets of beginnings.
PREFIX_TRIE = r"""
WITH t AS (
  SELECT conv_id, turn, md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(dig ORDER BY turn NULLS FIRST, dig) AS d, list(n ORDER BY turn NULLS FIRST, dig) AS n FROM t GROUP BY conv_id),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(0, 8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h FROM own),
seq AS (
  SELECT a.conv_id, list_concat(coalesce(b.d[1:h], []), a.d[h + 1:]) AS d, list_concat(coalesce(b.n[1:h], []), a.n[h + 1:]) AS n
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
pre AS (
  SELECT conv_id, len(d) AS len, depth, CASE WHEN depth = 0 THEN '' ELSE md5(array_to_string(d[1:depth], ',')) END AS key, CASE WHEN depth = 0 THEN 0 ELSE n[depth] END AS size
  FROM (SELECT *, unnest(range(0, len(d) + 1)) AS depth FROM seq)),
node AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM pre GROUP BY depth, key),
above AS (SELECT y.depth AS below, y.key AS of, p.depth, p.key FROM node y JOIN pre p ON p.conv_id = y.conv_id AND p.depth <= y.depth),
kids AS (SELECT depth, key, count(*) AS n FROM above WHERE below = depth + 1 GROUP BY depth, key),
sums AS (
  SELECT a.depth, a.key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((y.n_convs - 1) * y.size) AS saved
  FROM above a JOIN node y ON y.depth = a.below AND y.key = a.of LEFT JOIN kids k ON k.depth = y.depth AND k.key = y.key GROUP BY a.depth, a.key)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM node x JOIN sums ON sums.depth = x.depth AND sums.key = x.key LEFT JOIN kids k ON k.depth = x.depth AND k.key = x.key
LEFT JOIN above a ON a.below = x.depth AND a.of = x.key AND a.depth = x.depth - 1 LEFT JOIN node u ON u.depth = a.depth AND u.key = a.key
"""

ORACLE_SQL["op13_prefix_trie"] = PREFIX_TRIE
