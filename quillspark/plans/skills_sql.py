"""DuckDB SQL of the skill queries; it spells the constants that the data reach itself."""

from __future__ import annotations

from quillspark.plans.words import category_case, fold

EDGE = r"^[ ,;:.\-–—()]+|[ ,;:.\-–—()]+$"
LABEL = lambda c: rf"trim(regexp_replace(replace(lower({fold(c)}), 'ß', 'ss'), '\s+', ' ', 'g'))"
KEY = lambda c: f"regexp_replace({LABEL(c)}, '[^a-z0-9+#.]', '', 'g')"
LEVELLED = lambda c: rf"({c} <> '' AND (regexp_matches(lower(strip_accents({c})), 'lu|parle|ecrit|courant|bilingue|natif|native|maternel|professionnel|technique|scolaire|notions') OR lower({c}) IN ('a1', 'a2', 'b1', 'b2', 'c1', 'c2') OR contains({c}, ',')))"

HOISTED = rf"""
WITH i AS (
  SELECT p_brand, p_partkey AS k, trim(CASE p_partkey % 11 WHEN 0 THEN 'anglais' WHEN 1 THEN 'Lu, parlé' WHEN 3 THEN 'Espagnol : B2 ' WHEN 4 THEN ' C1' WHEN 7 THEN 'Allemand' WHEN 8 THEN '-' ELSE p_name END) AS item FROM part),
f AS (SELECT *, regexp_extract(lower(item), '^(?:anglais|espagnol|allemand)') AS lang, regexp_replace(item, '{EDGE}', '', 'g') AS bare FROM i),
g AS (SELECT *, lang = '' AND {LEVELLED("bare")} AS lvl, regexp_replace(substring(item, length(lang) + 1), '{EDGE}', '', 'g') AS tail FROM f),
h AS (SELECT *, sum(CASE WHEN lvl THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY k) AS grp FROM g),
m AS (SELECT *, first_value(lang <> '') OVER (PARTITION BY p_brand, grp ORDER BY k) AS headed FROM h),
langs AS (
  SELECT p_brand, min(k) AS k, max(upper(substring(lang, 1, 1)) || substring(lang, 2)) AS name,
    regexp_replace(coalesce(string_agg(CASE WHEN lang = '' THEN bare WHEN {LEVELLED("tail")} THEN tail END, ' ' ORDER BY k), ''), '{EDGE}', '', 'g') AS level
  FROM m WHERE headed GROUP BY p_brand, grp),
l AS (SELECT p_brand, string_agg(name || ':' || level, ';' ORDER BY k) AS languages, count(DISTINCT name) AS n FROM langs GROUP BY p_brand)
SELECT m.p_brand, coalesce(string_agg(item, ';' ORDER BY m.k) FILTER (WHERE NOT headed), '') AS remaining, coalesce(any_value(languages), '') AS languages, coalesce(any_value(n), 0) AS n_languages
FROM m LEFT JOIN l ON l.p_brand = m.p_brand GROUP BY m.p_brand
"""

#: Candidates of a part: place within it, category of a prefix (null: its own), label.
CANDIDATES = """
CASE p_partkey % 23
  WHEN 0 THEN [{'i': 1, 'c': NULL, 'v': 'AWS'}] WHEN 1 THEN [{'i': 1, 'c': NULL, 'v': 'Docker Compose'}] WHEN 2 THEN [{'i': 1, 'c': NULL, 'v': 'Docker Compose'}] WHEN 3 THEN [{'i': 1, 'c': NULL, 'v': 'SQL Server'}]
  WHEN 4 THEN [{'i': 1, 'c': 'Outils & Environnements', 'v': 'vim'}, {'i': 2, 'c': 'Outils & Environnements', 'v': 'gulp'}, {'i': 3, 'c': 'Outils & Environnements', 'v': 'Redis'}]
  WHEN 5 THEN [{'i': 1, 'c': NULL, 'v': 'Bootstrap'}, {'i': 2, 'c': 'Frontend', 'v': 'Node.js'}, {'i': 3, 'c': 'Frontend', 'v': 'Node.js'}] WHEN 6 THEN [] ELSE [{'i': 1, 'c': NULL, 'v': p_name}] END
"""
OWN = "CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'STANDARD' THEN 'Cloud & DevOps' WHEN 'PROMO' THEN 'Bases de données' ELSE p_type END"
RAW = "CASE p_type WHEN 'ECONOMY' THEN 'Autres' WHEN 'STANDARD' THEN 'Cloud / DevOps' WHEN 'PROMO' THEN 'Data — suite 2' ELSE p_type END"


def displayed(candidates: str) -> str:
    """Of candidates (p_brand, spot, category, value): the first of each key, by category in the order of their first."""
    return rf"""
  firsts AS (SELECT p_brand, min(spot) AS spot, arg_min(category, spot) AS category, arg_min(value, spot) AS value FROM {candidates} WHERE {KEY("value")} <> '' GROUP BY p_brand, {KEY("value")}),
  shown AS (SELECT p_brand, category, min(spot) AS spot, string_agg(value, ';' ORDER BY spot) AS items FROM firsts GROUP BY ALL)
  SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY spot) - 1 AS INT) AS rank, category, items"""


def _candidates(where: str = "true") -> str:
    own = f"coalesce(x.c, {OWN}, {category_case(LABEL('x.v'))}, 'Autres')"
    return f"SELECT p_brand, ({RAW}, p_partkey, x.i) AS spot, {own} AS category, x.v AS value FROM (SELECT *, unnest({CANDIDATES}) AS x FROM part WHERE {where})"


DISPLAY = f"WITH c AS ({_candidates()}), {displayed('c')} FROM shown"

#: What the source's section gives, for each third brand, after the brand's own.
MERGED = rf"""
WITH own AS ({_candidates("p_partkey % 5 = 0")}),
b AS (SELECT DISTINCT p_brand, CAST(substring(p_brand, 7) AS INT) % 3 = 0 AS has FROM part WHERE p_partkey % 5 = 0),
c AS (
  SELECT p_brand, (1, spot) AS spot, category, value FROM own
  UNION ALL SELECT p_brand, (2, ('', s.i, 0)), s.c, s.v FROM b, (SELECT unnest([{{'i': 1, 'c': 'Cloud & DevOps', 'v': 'AWS'}}, {{'i': 2, 'c': 'Cloud & DevOps', 'v': 'Azure'}}, {{'i': 3, 'c': 'Bases de données', 'v': 'MySQL'}},
    {{'i': 4, 'c': 'Bases de données', 'v': 'SQL Server'}}, {{'i': 5, 'c': 'Bases de données', 'v': 'PostgreSQL'}}, {{'i': 6, 'c': 'Méthodologies', 'v': 'TOGAF'}}, {{'i': 7, 'c': 'Méthodologies', 'v': 'C4 Jardinage'}},
    {{'i': 8, 'c': 'Systèmes & Environnements', 'v': 'Windows'}}]) AS s) WHERE has),
{displayed("c")}, CASE WHEN CAST(substring(p_brand, 7) AS INT) % 3 = 0 THEN 'anglais:Lu, parlé' ELSE 'anglais:' END AS languages FROM shown
"""

_WORD = r"(?:^|[^a-z0-9])(?:{})(?:$|[^a-z0-9])"
FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower(v), '{p}') THEN {i}" for i, p in enumerate((
    _WORD.format("java|spring|hibernate|api|microservices|node|php|symfony|python|django|fastapi|maven") + r"|\.net|c#",
    _WORD.format("react|angular|vue|next|typescript|javascript|html5|css3|html|css"),
    _WORD.format("aws|azure|gcp|cloud|docker|kubernetes|terraform|jenkins|ansible|helm") + "|gitlab ci|ci/cd",
    _WORD.format("sql|postgres|mysql|oracle|mongodb|mongo|tableau|spark|databricks|snowflake") + "|power bi|^postgresql|^mongodb",
    _WORD.format("iam|sso|oauth|cyber|security|sécurité|dora") + "|iso 27001",
    _WORD.format("agile|scrum|kanban|jira|confluence|git|sonarqube|sonar|uml|itil"),
), 1)) + " ELSE 7 END"
FAMILIES = rf"""
WITH r AS (
  SELECT p_brand, p_partkey AS k, CASE p_type WHEN 'ECONOMY' THEN 'Compétences techniques' WHEN 'PROMO' THEN 'Processus métiers' WHEN 'SMALL' THEN 'Certifications' WHEN 'LARGE' THEN 'Projets' ELSE p_type END AS cat, p_type IN ('PROMO', 'SMALL', 'LARGE') AS whole,
    CASE p_partkey % 19 WHEN 0 THEN 'Java' WHEN 1 THEN 'Spring, React' WHEN 2 THEN 'PostgreSQL' WHEN 3 THEN 'git|gitlab ci' WHEN 4 THEN 'Kubernetes; Helm' WHEN 5 THEN 'Javanais' WHEN 6 THEN '.NET core' WHEN 7 THEN 'Cybersécurité' WHEN 8 THEN 'cyber' ELSE p_name || ' ' || p_size % 4 END AS item
  FROM part WHERE p_type <> 'STANDARD' OR p_partkey % 7 = 0),
s AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i, trim(unnest(parts)) AS v FROM (SELECT *, CASE WHEN whole THEN [item] ELSE string_split_regex(item, '[,|;]') END AS parts FROM r)),
d AS (SELECT p_brand, cat, whole, min((k, i)) AS spot, arg_min(v, (k, i)) AS v FROM s WHERE v <> '' GROUP BY p_brand, cat, whole, regexp_replace(lower(v), '[^a-z0-9+#.]+', '', 'g')),
n AS (SELECT *, count(*) OVER (PARTITION BY p_brand, cat) AS n, {FAMILY} AS f FROM d),
x AS (SELECT *, NOT whole AND (n > 6 OR cat = 'Compétences techniques') AS dealt FROM n),
c AS (SELECT *, CASE WHEN dealt THEN (row_number() OVER (PARTITION BY p_brand, cat, f ORDER BY spot) - 1) // 6 ELSE 0 END AS part, CASE WHEN dealt THEN f ELSE 0 END AS fam FROM x),
o AS (
  SELECT p_brand, cat, fam, part, string_agg(v, ';' ORDER BY spot) AS items,
    CASE WHEN fam = 0 THEN cat ELSE ['Backend', 'Frontend', 'Cloud / DevOps', 'Data', 'Sécurité', 'Outils & méthodes', 'Autres'][fam] || CASE part WHEN 0 THEN '' WHEN 1 THEN ' — suite' ELSE ' — suite ' || part END END AS category
  FROM c GROUP BY ALL)
SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY cat, fam, part) - 1 AS INT) AS rank, category, items FROM o
"""

CERTIFICATIONS = """
WITH f AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, year(l_shipdate)) AS i, CASE WHEN n % 7 > 0 THEN CAST(year(l_shipdate) AS VARCHAR) ELSE '' END AS date,
    CASE WHEN n % 2 = 0 THEN 'Scrum ' || n WHEN n % 3 = 0 THEN 'Master AWS' WHEN n % 5 = 0 THEN 'ITIL' ELSE 'Licence' END AS degree, CASE WHEN n % 4 > 0 THEN 'S' || (l_suppkey % 3) ELSE '' END AS school
  FROM (SELECT *, l_partkey AS n FROM lineitem)),
g AS (SELECT *, degree <> 'Licence' AS cert, count(*) FILTER (degree <> 'Licence') OVER (PARTITION BY l_orderkey) > 3 AS many FROM f),
s AS (SELECT l_orderkey, school, min(i) AS i FROM g WHERE cert AND many AND school <> '' GROUP BY ALL),
one AS (
  SELECT l_orderkey, 1000000 AS i, 'Certifications' AS date, string_agg(CASE WHEN date = '' THEN degree ELSE date || ' — ' || degree END, '; ' ORDER BY i) AS degree,
    coalesce((SELECT string_agg(school, ', ' ORDER BY s.i) FROM s WHERE s.l_orderkey = g.l_orderkey), '') AS school FROM g WHERE cert AND many GROUP BY l_orderkey)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS INT) AS rank, date, degree, school
FROM (SELECT l_orderkey, i, date, degree, school FROM g WHERE NOT (cert AND many) UNION ALL SELECT * FROM one)
"""

RESCUED = """
WITH p AS (
  SELECT p_brand, p_partkey AS k, p_partkey % 10 AS n, p_name, CASE p_type WHEN 'SMALL' THEN 'Langues' WHEN 'STANDARD' THEN 'Certifications' WHEN 'PROMO' THEN 'Langages' WHEN 'ECONOMY' THEN 'Backend' ELSE p_type END AS cat FROM part WHERE p_partkey % 10 < 4),
lang AS (SELECT *, k % 3 > 0 AS spoken FROM p WHERE cat = 'Langues'),
rest AS (SELECT p_brand, k, CASE WHEN NOT spoken THEN p_name WHEN n = 0 THEN 'Java17' END AS v FROM lang),
found AS (
  SELECT p_brand, k, x.i AS i, x.n AS name, x.l AS level FROM (SELECT p_brand, k, unnest(CASE n WHEN 0 THEN [{'i': 1, 'n': 'Arabe', 'l': '5'}, {'i': 2, 'n': 'Français', 'l': '4'}] WHEN 1 THEN [{'i': 1, 'n': 'Anglais', 'l': 'courant'}]
    WHEN 2 THEN [{'i': 1, 'n': 'anglais', 'l': 'COURANT'}] ELSE [{'i': 1, 'n': 'turc', 'l': ''}, {'i': 2, 'n': 'hindi', 'l': '2'}] END) AS x FROM lang WHERE spoken)),
named AS (SELECT p_brand, min((k, i)) AS spot, arg_min(name || ':' || level, (k, i)) AS v FROM found WHERE NOT (lower(name) = 'turc' AND level = '') GROUP BY p_brand, lower(name), lower(level)),
b AS (SELECT p_brand, bool_or(cat = 'Backend') AS back, bool_or(cat = 'Langages') AS lg, bool_or(cat = 'Langues') AS has FROM p GROUP BY p_brand),
to_cat AS (SELECT *, CASE WHEN back THEN 'Backend' WHEN lg THEN 'Langages' ELSE 'Stack principale' END AS target FROM b),
own AS (SELECT p_brand, cat, k, p_name AS v FROM p WHERE cat NOT IN ('Langues', 'Certifications')),
moved AS (
  SELECT r.p_brand, target AS cat, min(k) AS k, v FROM rest r JOIN to_cat t ON t.p_brand = r.p_brand WHERE v IS NOT NULL AND target <> 'Stack principale' AND NOT EXISTS (SELECT 1 FROM own WHERE own.p_brand = r.p_brand AND own.cat = target AND own.v = r.v) GROUP BY ALL
  UNION ALL SELECT r.p_brand, target, k, v FROM rest r JOIN to_cat t ON t.p_brand = r.p_brand WHERE v IS NOT NULL AND target = 'Stack principale'),
every AS (SELECT p_brand, cat, 0 AS late, k, v FROM own UNION ALL SELECT p_brand, cat, 1, k, v FROM moved),
lists AS (SELECT p_brand, cat, string_agg(v, ';' ORDER BY late, k) AS items, CASE WHEN cat = 'Stack principale' THEN 'Langues' ELSE cat END AS place FROM every GROUP BY ALL),
certs AS (SELECT p_brand, arg_min(CASE n WHEN 0 THEN 'Oracle Certified' ELSE 'oracle  certified' END, k) AS v FROM p WHERE cat = 'Certifications' AND n < 2 GROUP BY p_brand)
SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY place) - 1 AS INT) AS rank, cat AS category, items,
  'Turc:' || coalesce((SELECT string_agg(';' || v, '' ORDER BY spot) FROM named WHERE named.p_brand = lists.p_brand), '') AS languages, 'pmp' || coalesce((SELECT ';' || v FROM certs WHERE certs.p_brand = lists.p_brand), '') AS certifications
FROM lists
"""

ENVIRONMENTS = r"""
WITH t AS (
  SELECT l_suppkey, (l_orderkey, l_linenumber, p_partkey) AS spot, string_split_regex(CASE p_partkey % 17 WHEN 0 THEN 'React, Java | java / Docker' WHEN 1 THEN 'Sécurité, SQL Server' WHEN 2 THEN ' , ' ELSE p_name || '/' || lower(p_type) END, '[,|/]') AS parts
  FROM lineitem JOIN part ON l_partkey = p_partkey),
v AS (SELECT l_suppkey, spot, unnest(range(1, len(parts) + 1)) AS i, trim(unnest(parts)) AS v FROM t),
d AS (SELECT l_suppkey, min((spot, i)) AS spot, arg_min(v, (spot, i)) AS v FROM v WHERE v <> '' GROUP BY l_suppkey, lower(v)),
f AS (SELECT *, CASE WHEN regexp_matches(lower(v), 'react|next|vue|angular|javascript|typescript|html|css') THEN 1 WHEN regexp_matches(lower(v), 'java|spring|node|php|symfony|\.net|c#|python|django|fastapi|api|sql server') THEN 2
  WHEN regexp_matches(lower(v), 'aws|azure|gcp|cloud|kubernetes|eks|aks|gke') THEN 3 WHEN regexp_matches(lower(v), 'docker|kubernetes|terraform|jenkins|gitlab|ci/cd|ansible|helm') THEN 4
  WHEN regexp_matches(lower(v), 'sql|postgres|mysql|oracle|power bi|tableau|spark|databricks|snowflake') THEN 5 WHEN regexp_matches(lower(v), 'iam|sso|oauth|cyber|security|sécurité|dora') THEN 6 ELSE 7 END AS f FROM d),
g AS (SELECT l_suppkey, f, ['Frontend', 'Backend', 'Cloud', 'DevOps', 'Data', 'Sécurité', 'Autres'][f] || ': ' || string_agg(v, ', ' ORDER BY spot) AS line FROM f GROUP BY l_suppkey, f)
SELECT s.l_suppkey, coalesce(string_agg(line, ' | ' ORDER BY f), '') AS terms FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN g ON g.l_suppkey = s.l_suppkey GROUP BY s.l_suppkey
"""

READABLE = r"""
WITH i AS (
  SELECT p_brand, p_type, p_partkey AS k, trim(CASE p_partkey % 6 WHEN 0 THEN p_name || ', ' || repeat(p_name || '; ', p_size % 20) || ', ' || p_brand WHEN 1 THEN repeat(p_brand, p_size % 25) ELSE p_name END) AS t FROM part),
w AS (
  SELECT *, list_reduce(list_filter(list_transform(string_split_regex(t, '\s*[;,]\s*'), lambda x: trim(x)), lambda x: x <> ''),
    lambda a, p: CASE WHEN a.held <> '' AND length(a.held) + 2 + length(p) > 125 THEN {'held': p, 'done': list_append(a.done, a.held)} ELSE {'held': CASE WHEN a.held = '' THEN p ELSE a.held || ', ' || p END, 'done': a.done} END,
    {'held': '', 'done': CAST([] AS VARCHAR[])}) AS x FROM i),
p AS (
  SELECT p_brand, p_type, k, CASE WHEN t = '' THEN [] WHEN length(t) <= 125 OR length(t) - length(translate(t, ',;', '')) < 2 THEN [t] ELSE list_append(x.done, x.held) END AS parts FROM w),
l AS (SELECT p_brand, p_type, flatten(list(parts ORDER BY k)) AS items FROM p GROUP BY ALL),
b AS (
  SELECT p_brand, p_type, list_reduce(items,
    lambda a, v: CASE WHEN len(a.held) > 0 AND ((len(a.held) >= 8 AND len(items) - a.seen - 1 > 0) OR a.used + length(v) + 2 > 470) THEN {'held': [v], 'used': length(v), 'seen': a.seen + 1, 'done': list_append(a.done, array_to_string(a.held, ';'))}
      ELSE {'held': list_append(a.held, v), 'used': a.used + length(v) + CASE WHEN len(a.held) > 0 THEN 2 ELSE 0 END, 'seen': a.seen + 1, 'done': a.done} END,
    {'held': CAST([] AS VARCHAR[]), 'used': CAST(0 AS BIGINT), 'seen': CAST(0 AS BIGINT), 'done': CAST([] AS VARCHAR[])}) AS x FROM l),
o AS (SELECT p_brand, p_type, unnest(range(0, len(every))) AS i, unnest(every) AS items FROM (SELECT *, CASE WHEN len(x.held) > 0 THEN list_append(x.done, array_to_string(x.held, ';')) WHEN len(x.done) = 0 THEN [''] ELSE x.done END AS every FROM b))
SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type, i) - 1 AS INT) AS rank, p_type || CASE WHEN i > 0 THEN ' (suite)' ELSE '' END AS category, items FROM o
"""


def _visual(blocks: str, anchor: str, inline: str, heading: str, stop: str) -> str:
    """Tables up to m: lines in reading order with what the rules say of them. Blocks are (l_suppkey, page, y, x, ord, texts)."""
    return rf"""
b AS ({blocks}),
l AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY page, round(y, 1), round(x, 1), ord, i) AS pos, line FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i, unnest(texts) AS line FROM b) WHERE line <> '3 / 6'),
s AS (SELECT *, coalesce(max({anchor}) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS started, {anchor} AS anchor FROM l),
h AS (SELECT *, CASE WHEN started THEN {heading} WHEN anchor THEN {inline} END AS heading FROM s),
m AS (
  SELECT *, max(started AND heading IS NULL AND {stop}) OVER w AS stopped, last_value(heading IGNORE NULLS) OVER w AS category FROM h
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT l_suppkey, category, pos, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS v FROM (SELECT *, CASE WHEN line = 'React, Vue (a, b)' THEN ['React', 'Vue (a, b)'] ELSE string_split(line, ', ') END AS vs FROM m WHERE started AND NOT stopped AND heading IS NULL AND category IS NOT NULL AND line <> 'Maintenance applicative')),
d AS (SELECT l_suppkey, category, v, min((pos, i)) AS spot FROM n GROUP BY ALL),
f AS (SELECT l_suppkey, heading AS category, min(pos) AS pos FROM m WHERE NOT stopped AND heading IS NOT NULL GROUP BY ALL),
c AS (SELECT d.l_suppkey, d.category, any_value(pos) AS pos, count(*) AS n, string_agg(v, ';' ORDER BY spot) AS items FROM d JOIN f ON f.l_suppkey = d.l_suppkey AND f.category = d.category GROUP BY ALL),
g AS (SELECT l_suppkey, count(*) AS categories, sum(n) AS n, string_agg(category || '=' || items, '|' ORDER BY pos) AS skills, string_agg(category, ',' ORDER BY pos) AS names FROM c GROUP BY l_suppkey),
a AS (SELECT l_suppkey, max(anchor) AS started FROM m GROUP BY l_suppkey),
r AS (
  SELECT a.l_suppkey, CASE WHEN NOT started THEN 0.0 WHEN coalesce(categories, 0) < 3 OR coalesce(n, 0) < 8 THEN 0.4 ELSE 0.9 END AS confidence, CASE WHEN NOT started THEN 'skills_heading_not_found' WHEN coalesce(categories, 0) < 3 OR coalesce(n, 0) < 8 THEN 'too_few_visual_skills' ELSE '' END AS warnings,
    coalesce(categories, 0) AS categories, coalesce(skills, '') AS skills, names FROM a LEFT JOIN g ON g.l_suppkey = a.l_suppkey)"""


_BLOCKS = """
  SELECT l_suppkey, l_linenumber AS page, l_quantity AS y, l_discount * 100 AS x, l_orderkey * 1000000 + l_partkey AS ord,
    CASE WHEN n = 210 AND l_linenumber > 1 THEN ['Langues'] ELSE CASE n % 13 WHEN 0 THEN ['Compétences Java'] WHEN 1 THEN ['Mainframe'] WHEN 2 THEN ['Front-end', 'React, Vue (a, b)'] WHEN 3 THEN ['3 / 6'] WHEN 4 THEN ['Base De Données']
      WHEN 5 THEN ['Maintenance applicative'] WHEN 6 THEN ['Technologies'] ELSE [p_name || ', ' || (l_partkey % 50)] END END AS texts
  FROM (SELECT *, (l_orderkey * 7 + l_partkey) % 211 AS n FROM lineitem JOIN part ON l_partkey = p_partkey)"""
VISUAL = (
    "WITH "
    + _visual(_BLOCKS, "(line IN ('Compétences Java', 'Technologies'))", "CASE WHEN line = 'Compétences Java' THEN 'Java' END", "CASE WHEN line IN ('Mainframe', 'Front-end', 'Base De Données') THEN line END", "line = 'Langues'")
    + " SELECT l_suppkey, CAST(confidence AS DOUBLE) AS confidence, warnings, categories, md5(skills) AS skills FROM r"
)
_FEW = """
  SELECT l_suppkey, l_linenumber AS page, l_quantity AS y, 0 AS x, l_orderkey * 1000000 + l_partkey AS ord, [CASE l_partkey % 9 WHEN 0 THEN 'Compétences' WHEN 1 THEN 'Java' WHEN 2 THEN 'Ops' WHEN 3 THEN 'Data' ELSE 'item ' || (l_partkey % 30) END] AS texts
  FROM lineitem WHERE l_suppkey % 4 > 0"""
OVERRIDDEN = (
    "WITH "
    + _visual(_FEW, "(line = 'Compétences')", "NULL", "CASE WHEN line IN ('Java', 'Ops', 'Data') THEN line END", "false")
    + " SELECT s_suppkey AS l_suppkey, CAST(CASE WHEN confidence >= 0.75 THEN confidence ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.75 THEN names ELSE 'Backend' END AS categories FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey"
)

PLAN = """
WITH b AS (SELECT l_orderkey AS k, 'b' || l_linenumber AS id, l_returnflag = 'R' AS required FROM lineitem),
o AS (SELECT k, list(id ORDER BY id) AS ids, list_sort(list_distinct(list(id) FILTER (required))) AS need FROM b GROUP BY k),
u AS (SELECT *, CASE WHEN k % 7 = 0 THEN list_append(ids, 'b99') WHEN k % 7 = 1 THEN ids[2:] ELSE ids END AS used FROM o),
f AS (
  SELECT k, CASE WHEN k % 23 = 0 THEN ['invalid_json:'] ELSE list_concat(
    CASE WHEN k % 17 > 0 AND k % 19 = 0 THEN ['missing_key:rationale'] ELSE [] END, CASE WHEN k % 13 = 0 THEN ['invalid_strategy:odd'] ELSE [] END, CASE WHEN k % 5 = 0 THEN ['invalid_density:dense'] ELSE [] END, CASE WHEN k % 11 = 0 THEN ['unauthorized_zone:margin'] ELSE [] END,
    CASE WHEN k % 7 = 0 THEN ['unknown_block:b99'] ELSE [] END, list_transform(list_filter(list_distinct(used), lambda x: len(list_filter(used, lambda y: x = y)) > 1), lambda x: 'doubled_block:' || x),
    list_transform(list_filter(coalesce(need, []), lambda x: NOT list_contains(used, x)), lambda x: 'missing_block:' || x), CASE WHEN k % 17 = 0 THEN ['unsafe_rationale:'] ELSE [] END) END AS f FROM u)
SELECT k AS doc_id, len(f) = 0 AS accepted, array_to_string(list_sort(f), ',') AS faults FROM f
"""

SYNTHESES = """
WITH e AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey % 4 AS m, l_partkey % 3 = 0 AS stack FROM lineitem),
o AS (
  SELECT o_orderkey, CASE WHEN p = '5-LOW' THEN NULL WHEN NOT o_orderkey % 4 > 0 THEN 'complete' WHEN p = '1-URGENT' THEN 'urgent' WHEN p = '2-HIGH' THEN 'standard' ELSE 'complete' END AS mode FROM (SELECT *, o_orderpriority AS p FROM orders)),
x AS (
  SELECT e.*, o_orderkey, mode, coalesce(CASE mode WHEN 'urgent' THEN n >= 3 AND i >= 1 WHEN 'standard' THEN n >= 5 AND i >= 3 END, false) AS short, CASE mode WHEN 'urgent' THEN 1 ELSE 2 END AS most FROM e JOIN o ON o_orderkey = l_orderkey),
t AS (
  SELECT *, CASE WHEN NOT short THEN 'Missions=' || CASE m WHEN 0 THEN ';' WHEN 1 THEN 'm1' WHEN 2 THEN 'm1;m2' ELSE 'm1;m2;m3' END || '/Stack=' || CASE WHEN stack THEN 'Java, React' ELSE ' ' END
    ELSE 'Synthèse mission=' || CASE WHEN m = 0 THEN 'Mission ancienne conservée sous forme synthétique faute de détail exploitable.' WHEN m = 1 OR most = 1 THEN 'm1' ELSE 'm1;m2' END
      || CASE WHEN m > most THEN ';Synthèse: ' || (m - most) || ' élément(s) de détail condensé(s) pour lisibilité client; consulter le CV source si besoin.' ELSE ';Synthèse: mission ancienne volontairement condensée pour lisibilité client.' END
      || CASE WHEN stack THEN '/Environnement technique=Frontend: React | Backend: Java' ELSE '' END END AS body FROM x)
SELECT o_orderkey, mode AS synthesis_mode, md5(string_agg(body, '|' ORDER BY i)) AS experiences FROM t GROUP BY o_orderkey, mode
"""

COVERED = f"""
WITH k AS (SELECT p_brand, p_partkey AS n, {KEY("p_name || ' ' || p_size % 3")} AS k FROM part),
b AS (SELECT p_brand, coalesce(list(DISTINCT k) FILTER (n % 40 = 0), []) AS want, coalesce(list(DISTINCT k) FILTER (n % 7 < 4), []) AS have FROM k GROUP BY p_brand)
SELECT p_brand, CAST(substring(p_brand, 7) AS INT) % 4 > 0 AND len(want) > 0 AND len(have) > 0 AND len(list_intersect(want, have)) / greatest(len(want), 1) >= 0.7 AS covered FROM b
"""

ORACLE_SQL = {
    "covered_skills": COVERED,
    "hoisted_languages": HOISTED,
    "display_skills": DISPLAY,
    "merged_skills": MERGED,
    "skill_families": FAMILIES,
    "grouped_certifications": CERTIFICATIONS,
    "rescued_skills": RESCUED,
    "environment_families": ENVIRONMENTS,
    "readable_skill_blocks": READABLE,
    "visual_skills": VISUAL,
    "overridden_skills": OVERRIDDEN,
    "plan_contract": PLAN,
    "syntheses": SYNTHESES,
}
