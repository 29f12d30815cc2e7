"""Queries of sources with sections: facts that mustn't be lost, blocks of long documents. Documents get headings put between their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import fidelity, splitter
from quillspark.plans.words import fold
from quillspark.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: What stands before the lines of a document, by their number from 0 modulo 17: a heading, or a bullet.
HEADINGS = {0: "Projets significatifs :", 3: "Missions clés", 6: "Langues: Anglais courant et lu", 7: "Autres", 9: "Formations", 11: "Responsabilités :", 14: "COMPÉTENCES", 16: "Loisirs"}
BULLETS = {1: "✓ ", 4: "• ", 5: "- ", 8: "* anglais et sql ", 12: "•", 13: "rue "}
#: The same for blocks of long documents: headings, starts of experiences, and noise.
STARTS = {0: "PROFIL", 2: "EXPÉRIENCES", 3: "2019 - 2021 Consultant Java", 5: "Missions principales", 7: "Formations", 8: "2015 à 2018 Lead developer", 9: "2012", 10: "a.b@example.org", 12: "COMPÉTENCES TECHNIQUES", 15: "Formation"}
TARGET = 600


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _documents(spark, d, before: dict[int, str], bullets: dict[int, str]) -> DataFrame:
    """doc_id and text of the documents, with lines put before some of theirs and bullets at the start of others."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def put(x, i):
        n = i % 17
        marked = F.concat(F.coalesce(*[F.when(n == k, v) for k, v in bullets.items()], F.lit("")), x) if bullets else x
        return F.concat(F.coalesce(*[F.when(n == k, f"{v}\n") for k, v in before.items()], F.lit("")), marked)

    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(lines, put), "\n").alias("text"))


def _found(docs: DataFrame, items) -> DataFrame:
    return docs.select("doc_id", F.posexplode(items).alias("rank", "x")).select("doc_id", "rank", F.col("x.section").alias("section"), F.md5("x.fact").alias("fact"))


@query
def business_facts(spark, d):
    """Facts of the valued sections of each source."""
    return _found(_documents(spark, d, HEADINGS, BULLETS), fidelity.business_facts(F.col("text")))


@query
def experience_items(spark, d):
    """Items under the headings of experiences of each source."""
    return _found(_documents(spark, d, HEADINGS, BULLETS), fidelity.experience_items(F.col("text")))


@query
def document_blocks(spark, d):
    """Blocks of long documents, cut at headings and starts of experiences."""
    b = splitter.split(_documents(spark, d, STARTS, {}), target=TARGET)
    return b.select("doc_id", "ord", "kind", F.length("block").cast("long").alias("chars"), F.md5("block").alias("block"))


NORMAL = lambda c: rf"trim(regexp_replace(regexp_replace(replace(lower({fold(c)}), '’', ''''), '\bpage\s+[0-9]+\s+(?:of|sur)\s+[0-9]+\b', ' ', 'g'), '[^a-z0-9+#]+', ' ', 'g'))"
CUT = lambda c, marks: f"regexp_replace({c}, '^[{marks}]+|[{marks}]+$', '', 'g')"
SQUEEZED = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
ENDS, COLON = r" •✓\-–—\t", r" :•✓\-–—\t"
SECTION = r"(?i)^(?:(?:exemples?\s+de\s+)?r[ée]alisations?(?:\s+professionnelles?)?|projets?(?:\s+significatifs?)?|certifications?|comp[ée]tences?(?:\s+(?:techniques?|et\s+outils?))?|lang(?:ues|uages)|autres)$"
KNOWN = """CASE {} WHEN 'exemples de realisations professionnelles' THEN 'Exemples de réalisations professionnelles' WHEN 'realisations professionnelles' THEN 'Réalisations professionnelles' WHEN 'realisations' THEN 'Réalisations'
  WHEN 'projets' THEN 'Projets' WHEN 'projets significatifs' THEN 'Projets significatifs' WHEN 'certifications' THEN 'Certifications' WHEN 'competences' THEN 'Compétences' WHEN 'competences techniques' THEN 'Compétences techniques'
  WHEN 'competences et outils' THEN 'Compétences et outils' WHEN 'langues' THEN 'Langues' WHEN 'languages' THEN 'Langues' WHEN 'autres' THEN 'Autres' END"""
BOUNDARY = r"(?i)^(?:processus\s+m[ée]tiers|loisirs?|formations?|dipl[oô]mes?|exp[ée]riences?|parcours|mots[-\s]?cl[ée]s?|contact|coordonn[ée]es?)(?:$|[^\p{L}\p{N}_])"
HEADING = r"(?i)^(?:missions?(?:\s+cl[ée]s?)?|responsabilit[ée]s?|r[ée]alisations?|livrables?(?:\s+cl[ée]s?)?|activit[ée]s?|t[âa]ches?)\s*:?$"
EXCLUDED = r"(?i)@|linkedin|github\.com|https?://|\+33|\b0[67](?:[ .-]?[0-9]{2}){4}\b|rue|avenue|boulevard|impasse|all[ée]e|\b[0-9]{5}\b|cv envoyé par hellowork|données personnelles|donnees personnelles"
BUSINESS = "projet|realisation|certification|formation|langue|anglais|espagnol|allemand|italien|java|python|react|angular|node|aws|azure|gcp|docker|kubernetes|sql|agile|agiles|scrum|itil|erp|crm|si|rpa|api|devops|cloud|data|bi|cyber|management|pilotage|moa|moe|recette|migration|deploiement"
VALUED = "('realisations', 'realisations professionnelles', 'exemples de realisations professionnelles', 'projets', 'projets significatifs', 'certifications', 'competences', 'competences techniques', 'competences et outils', 'langues', 'languages')"
RANGE = r"(?:[0-9]{2}/[0-9]{4}|[0-9]{4})\s*(?:[-–—]|à|a|au|to)\s*(?:[0-9]{2}/[0-9]{4}|[0-9]{4}|aujourd|présent|present|ce\s+jour)"
MONTHS = "janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
ROLES = r"cdi|cdd|freelance|stage|consultant|consultante|développeur|developpeur|engineer|lead|tech\s*lead|business\s*analyst|rpa|chef\s+de\s+projet"


def starts(c: str) -> str:
    """Whether a line starts an experience: a date before it, a role or capitals in it."""
    begins = rf"regexp_matches({c}, '(?i)^(?:{RANGE}|(?:{MONTHS})\s+[0-9]{{4}}|[0-9]{{4}}(?:[^\p{{L}}\p{{N}}_]).+)')"
    who = rf"(regexp_matches({c}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{ROLES})(?:$|[^\p{{L}}\p{{N}}_])') OR regexp_matches({c}, '(?:^|[^\p{{L}}\p{{N}}_])[A-ZÉÈÀÂÊÎÔÛÄËÏÖÜÇ]{{3,}}(?:$|[^\p{{L}}\p{{N}}_])'))"
    when = rf"(regexp_matches({c}, '(?i){RANGE}') OR regexp_matches({c}, '(?i)^(?:{MONTHS})\s+[0-9]{{4}}') OR regexp_matches({c}, '^(?:19|20)[0-9]{{2}}(?:[^\p{{L}}\p{{N}}_]).+'))"
    return f"({begins} AND {who} AND {when} AND NOT regexp_matches({NORMAL(c)}, '^(?:19|20)[0-9]{{2}}$'))"


def _put(before: dict[int, str], bullets: dict[int, str]) -> str:
    case = lambda cases, end: "CASE i % 17 " + " ".join(f"WHEN {k} THEN '{v}'{end}" for k, v in cases.items()) + " ELSE '' END" if cases else "''"
    text = f"{case(before, ' || chr(10)')} || {case(bullets, '')} || x"
    return f"SELECT doc_id, string_agg({text}, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) GROUP BY doc_id"


#: Lines of a text as the compacted form has them: trimmed, blank ones between others kept.
MARKED = rf"""
d AS ({_put(HEADINGS, BULLETS)}),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, trim(regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g')) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
h AS (SELECT *, {SQUEEZED(CUT("x", ENDS))} AS e, {SQUEEZED(CUT("x", COLON))} AS c, {CUT("x", "✓•*  -")} AS b FROM l),
n AS (SELECT *, regexp_matches(e, '^[^:：]{{3,80}}\s*[:：]\s*.*$') AS has, regexp_extract(e, '^([^:：]{{3,80}})\s*[:：]\s*(.*)$', 1) AS head, trim(regexp_extract(e, '^([^:：]{{3,80}})\s*[:：]\s*(.*)$', 2)) AS val FROM h),
o AS (SELECT *, {SQUEEZED(CUT("CASE WHEN has THEN head ELSE e END", COLON))} AS name FROM n),
s AS (
  SELECT *, coalesce({KNOWN.format(NORMAL("name"))}, CASE WHEN regexp_matches(name, '{SECTION}') THEN upper(substring(name, 1, 1)) || substring(name, 2) END) AS section,
    coalesce({KNOWN.format(NORMAL("c"))}, CASE WHEN regexp_matches(c, '{SECTION}') THEN c END) AS own FROM o),
m AS (
  SELECT doc_id, list({{'line': x, 'opens': regexp_matches(x, '^[✓•*-]\s*\S'), 'body': CASE WHEN b = '' OR x = ':' OR regexp_matches(b, '{EXCLUDED}') THEN '' ELSE b END, 'section': section,
    'value': CASE WHEN has AND val <> '' AND NOT regexp_matches(val, '{EXCLUDED}') THEN val ELSE '' END, 'ends': c <> '' AND (regexp_matches(c, '{BOUNDARY}') OR own IS NOT NULL OR section IS NOT NULL OR {starts("c")} OR regexp_matches(c, '{HEADING}')),
    'heading': CASE WHEN regexp_matches(c, '{HEADING}') THEN c END}} ORDER BY i) AS xs FROM s GROUP BY doc_id)"""

START = "{'now': CAST(NULL AS VARCHAR), 'item': '', 'out': CAST([] AS STRUCT(section VARCHAR, fact VARCHAR)[])}"
_DONE = "CASE WHEN a.now IS NOT NULL AND a.item <> '' THEN list_append(a.out, {'section': a.now, 'fact': a.item}) ELSE a.out END"


def _reported(last: str, keep: str) -> str:
    return rf"""
f AS (SELECT doc_id, {_DONE.replace("a.", "a.")} AS out FROM (SELECT doc_id, {last} AS a FROM m)),
u AS (SELECT doc_id, unnest(range(0, len(out))) AS i, unnest(out) AS o FROM f),
t AS (SELECT doc_id, i, o.section AS section, {CUT(SQUEEZED("o.fact"), COLON)} AS fact FROM u),
k AS (SELECT doc_id, min(i) AS i, section, fact FROM t WHERE {keep} AND NOT regexp_matches(fact, '{EXCLUDED}') GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS rank, section, md5(fact) AS fact FROM k"""


BUSINESS_FACTS = f"WITH {MARKED}," + _reported(
    f"""list_reduce(xs, lambda a, x: CASE WHEN x.line = '' THEN a
      WHEN x.section IS NOT NULL THEN {{'now': x.section, 'item': '', 'out': CASE WHEN x.value <> '' THEN list_append({_DONE}, {{'section': x.section, 'fact': x.value}}) ELSE {_DONE} END}}
      WHEN a.now IS NOT NULL AND x.ends THEN {{'now': NULL, 'item': '', 'out': {_DONE}}} WHEN a.now IS NULL OR x.body = '' THEN a
      WHEN x.opens THEN {{'now': a.now, 'item': x.body, 'out': {_DONE}}} ELSE {{'now': a.now, 'item': CASE WHEN a.item = '' THEN x.body ELSE a.item || ' ' || x.body END, 'out': a.out}} END, {START})""",
    rf"length({NORMAL('fact')}) >= 12 AND ({NORMAL('section')} IN {VALUED} OR ({NORMAL('section')} = 'autres' AND regexp_matches({NORMAL('fact')}, '(?:^|[^a-z0-9])(?:{BUSINESS})(?:$|[^a-z0-9])')))",
)
EXPERIENCE_ITEMS = f"WITH {MARKED}," + _reported(
    f"""list_reduce(xs, lambda a, x: CASE WHEN x.line = '' THEN {{'now': a.now, 'item': '', 'out': {_DONE}}} WHEN x.heading IS NOT NULL THEN {{'now': x.heading, 'item': '', 'out': {_DONE}}}
      WHEN a.now IS NOT NULL AND x.ends THEN {{'now': NULL, 'item': '', 'out': {_DONE}}} WHEN a.now IS NULL OR x.body = '' THEN a
      WHEN x.opens OR a.item = '' OR (regexp_matches(a.item, '[.!?…]\\s*$') AND NOT regexp_matches(x.body, '^(?:[a-zàâçéèêëîïôûùüÿñæœ]|[,;:.)])')) THEN {{'now': a.now, 'item': x.body, 'out': {_DONE}}}
      ELSE {{'now': a.now, 'item': a.item || ' ' || x.body, 'out': a.out}} END, {START})""",
    f"length({NORMAL('fact')}) >= 18",
)

ORACLE_SQL = {"business_facts": BUSINESS_FACTS, "experience_items": EXPERIENCE_ITEMS}

#: Kinds of headings: what a line that is short or in capitals begins with.
HEADING_WORDS = (
    ("profile", "profil|résumé|resume|summary|présentation|a propos|à propos"), ("skills", "comp[ée]tences|skills|expertises|technologies|environnements? techniques?"), ("education", "formations?|formation académique|dipl[oô]mes?|certifications?"),
    ("experience", "exp[ée]riences?|exp[ée]riences? professionnelles?|parcours professionnel|missions?"),
)
CONTACT, ADDRESS = r"(?i)@|linkedin|https?://|\+33|\b0[67](?:[ .-]?[0-9]{2}){4}\b", r"(?i)rue|avenue|boulevard|impasse|\b[0-9]{5}\b"
BODY = r"(?i)(?:^|[^\p{L}\p{N}_])(?:missions?|livrables?)(?:$|[^\p{L}\p{N}_])|environnement\s+technique"
TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def heading_kind(c: str) -> str:
    raw = rf"regexp_replace(trim({c}), '^[•\-–— ]+|[•\-–— ]+$', '', 'g')"
    bare = f"trim(regexp_replace({raw}, '^:+|:+$', '', 'g'))"
    words = rf"len(regexp_extract_all({bare}, '[\p{{L}}\p{{N}}_]+'))"
    kinds = " ".join(rf"WHEN regexp_matches({bare}, '(?i)^(?:{names})(?:$|[^\p{{L}}\p{{N}}_])') THEN '{k}'" for k, names in HEADING_WORDS)
    return rf"CASE WHEN {raw} = '' OR regexp_matches({raw}, ':\s*\S') OR NOT ({words} <= 4 OR (upper({bare}) = {bare} AND {words} <= 8)) THEN NULL {kinds} END"


BLOCKS = "CAST([] AS STRUCT(kind VARCHAR, text VARCHAR)[])"
LINES_OF = lambda c: f"list_filter(list_transform(string_split({c}, chr(10)), lambda q: trim(q)), lambda q: q <> '')"


def _repaired(source: str, name: str) -> str:
    """Noise goes, education that begins as an experience is one, and the head of an experience waits for its body."""
    noise = rf"""len({LINES_OF("b.text")}) = 0 OR (b.kind = 'experience' AND regexp_matches(b.text, '{CONTACT}') AND len(list_filter({LINES_OF("b.text")}, lambda q: coalesce({heading_kind("q")}, '') <> 'experience' AND NOT regexp_matches(q, '{CONTACT}') AND NOT regexp_matches(q, '{ADDRESS}'))) = 0)
      OR (b.kind = 'experience' AND coalesce({heading_kind("b.text")}, '') = 'experience') OR regexp_matches({TRIM("b.text")}, '^[0-9]{{4}}$')"""
    join = r"regexp_replace(a.wait.text, '\s+$', '') || chr(10) || regexp_replace(b.text, '^\s+', '')"
    wait = "CASE WHEN a.wait IS NOT NULL THEN list_append(a.out, a.wait) ELSE a.out END"
    return rf"""
{name}_k AS (
  SELECT doc_id, list_transform(list_filter(bs, lambda b: NOT ({noise})), lambda b: {{'kind': CASE WHEN b.kind = 'education' AND {starts(f"coalesce({LINES_OF('b.text')}[1], '')")} THEN 'experience' ELSE b.kind END, 'text': b.text,
    'starts': len(list_filter({LINES_OF("b.text")}, lambda q: {starts("q")})) > 0, 'body': regexp_matches(b.text, '{BODY}')}}) AS ks FROM {source}),
{name} AS (
  SELECT doc_id, CASE WHEN r.wait IS NOT NULL THEN list_append(r.out, r.wait) ELSE r.out END AS bs FROM (SELECT doc_id, list_reduce(ks, lambda a, b:
      CASE WHEN b.kind = 'experience' AND b.starts AND NOT b.body THEN {{'wait': {{'kind': b.kind, 'text': b.text}}, 'out': {wait}}}
      WHEN b.kind = 'experience' AND NOT b.starts AND a.wait IS NOT NULL THEN {{'wait': {{'kind': a.wait.kind, 'text': {join}}}, 'out': a.out}}
      ELSE {{'wait': NULL, 'out': list_append({wait}, {{'kind': b.kind, 'text': b.text}})}} END,
    {{'wait': CAST(NULL AS STRUCT(kind VARCHAR, text VARCHAR)), 'out': {BLOCKS}}}) AS r FROM {name}_k))"""


_ALONE = rf"len({LINES_OF('b.text')}) = 1 AND length({LINES_OF('b.text')}[1]) <= 50 AND {heading_kind(LINES_OF('b.text') + '[1]')} IS NOT NULL AND upper({fold(LINES_OF('b.text') + '[1]')}) = {fold(LINES_OF('b.text') + '[1]')}"
_CUT = rf"""list_reduce(string_split(b.text, chr(10)), lambda s, q: CASE WHEN s.held IS NOT NULL AND length({TRIM("s.held || chr(10) || q")}) > {TARGET} THEN {{'held': q, 'out': list_append(s.out, s.held)}}
      ELSE {{'held': CASE WHEN s.held IS NULL THEN q ELSE s.held || chr(10) || q END, 'out': s.out}} END, {{'held': CAST(NULL AS VARCHAR), 'out': CAST([] AS VARCHAR[])}})"""
_SIZED = f"list_append({_CUT}.out, {_CUT}.held)"
DOCUMENT_BLOCKS = rf"""
WITH d AS ({_put(STARTS, {})}),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, {TRIM("unnest(ls)")} AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
f AS (SELECT doc_id, list({{'line': x, 'starts': {starts("x")}, 'heading': {heading_kind("x")}}} ORDER BY i) AS xs FROM l GROUP BY doc_id),
c AS (
  SELECT doc_id, list_reduce(xs, lambda a, x:
      CASE WHEN (x.starts AND a.started) OR (x.heading IS NOT NULL AND NOT (x.heading = 'experience' AND a.kind = 'experience' AND a.started))
        THEN {{'kind': CASE WHEN x.starts AND a.started THEN 'experience' ELSE x.heading END, 'held': x.line, 'started': true, 'out': CASE WHEN {TRIM("a.held")} <> '' THEN list_append(a.out, {{'kind': a.kind, 'text': {TRIM("a.held")}}}) ELSE a.out END}}
      ELSE {{'kind': a.kind, 'held': CASE WHEN a.started THEN a.held || chr(10) || x.line ELSE x.line END, 'started': true, 'out': a.out}} END,
    {{'kind': 'header', 'held': '', 'started': false, 'out': {BLOCKS}}}) AS r FROM f),
c1 AS (SELECT doc_id, CASE WHEN {TRIM("r.held")} <> '' THEN list_append(r.out, {{'kind': r.kind, 'text': {TRIM("r.held")}}}) ELSE r.out END AS bs FROM c),
{_repaired("c1", "c2")},
c3 AS (
  SELECT doc_id, flatten(list_transform(bs, lambda b: CASE WHEN length(b.text) <= {TARGET} THEN [{{'kind': b.kind, 'text': b.text}}]
    ELSE list_transform({_SIZED}, lambda q: {{'kind': b.kind, 'text': {TRIM("q")}}}) END)) AS bs FROM c2),
{_repaired("c3", "c4")},
c5 AS (
  SELECT doc_id, list_reduce(list_transform(bs, lambda b: {{'kind': b.kind, 'text': b.text, 'alone': {_ALONE}}}), lambda a, b:
      CASE WHEN b.alone AND len(a.out) = 0 THEN {{'wait': coalesce(a.wait, {TRIM("b.text")}), 'out': a.out}}
      WHEN b.alone THEN {{'wait': NULL, 'out': list_append(a.out[:-2], {{'kind': a.out[-1].kind, 'text': regexp_replace(a.out[-1].text, '\s+$', '') || chr(10) || {TRIM("b.text")} || chr(10)}})}}
      ELSE {{'wait': NULL, 'out': list_append(a.out, {{'kind': b.kind, 'text': CASE WHEN a.wait IS NOT NULL THEN a.wait || chr(10) || regexp_replace(b.text, '^\s+', '') ELSE b.text END}})}} END,
    {{'wait': CAST(NULL AS VARCHAR), 'out': {BLOCKS}}}).out AS bs FROM c4),
c6 AS (
  SELECT doc_id, list_reduce(bs, lambda a, b:
      CASE WHEN a.held IS NOT NULL AND {TRIM("a.held.text")} <> '' AND length({TRIM("a.held.text")}) <= 450 AND a.held.kind IN ('education', 'skills', 'header')
        AND (b.kind = 'skills' OR contains({NORMAL("b.text")}, 'competences techniques')) AND regexp_matches({NORMAL("a.held.text")}, '\b[0-9]+(?: [0-9]+)? competences\b')
        THEN {{'held': NULL, 'out': list_append(a.out, {{'kind': b.kind, 'text': regexp_replace(a.held.text, '\s+$', '') || chr(10) || regexp_replace(b.text, '^\s+', '')}})}}
      ELSE {{'held': {{'kind': b.kind, 'text': b.text}}, 'out': CASE WHEN a.held IS NOT NULL THEN list_append(a.out, a.held) ELSE a.out END}} END,
    {{'held': CAST(NULL AS STRUCT(kind VARCHAR, text VARCHAR)), 'out': {BLOCKS}}}) AS r FROM c5),
c7 AS (SELECT doc_id, CASE WHEN r.held IS NOT NULL THEN list_append(r.out, r.held) ELSE r.out END AS bs FROM c6)
SELECT doc_id, CAST(ord AS INT) AS ord, b.kind AS kind, length(b.text) AS chars, md5(b.text) AS block FROM (SELECT doc_id, unnest(range(1, len(bs) + 1)) AS ord, unnest(bs) AS b FROM c7)
"""

ORACLE_SQL["document_blocks"] = DOCUMENT_BLOCKS
