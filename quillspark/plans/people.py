"""Queries of identities, and their SQL. Documents get lines with names put before their own text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import identity, structured
from quillspark.plans.words import REJECTED_WORDS, fold
from quillspark.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

HEADS = {
    0: "Jean Dupont", 1: "Mr. Marie CURIE-SKLODOWSKA", 2: "CV | Paul Page | Page 1", 3: "Charles de GAULLE", 4: "INGÉNIEUR DEVOPS\nFlorian HODARD", 5: "FLORIAN\nDUPONT", 7: "Nicolas GONZALEZ est DATA Analyst basé à Lyon",
    8: "ligne de texte\n" * 14 + "Anne DURAND", 9: "ligne de texte\n" * 25 + "Anne DURAND", 10: "Dossier de compétences | Paul Martin Consultant", 11: "Jean MARTIN DUVAL PETIT\nJean MARTIN",
}
GIVEN = {2: "paul", 7: "Nicolas Dupont", 10: " Paul ", 11: "Jean", 12: "Nobody", 3: "jr"}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _documents(spark, d) -> DataFrame:
    """doc_id, source, candidate_first_name."""
    n = F.col("doc_id") % 13
    pick = lambda cases: F.coalesce(*[F.when(n == k, v) for k, v in cases.items()])
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", pick(HEADS), F.coalesce("text", F.lit(""))).alias("source"), pick(GIVEN).alias("candidate_first_name"))


@query
def forbidden_identities(spark, d):
    """The first name of each document, given or inferred, and the terms that mustn't be shown."""
    out = identity.identified(_documents(spark, d))
    return out.select("doc_id", "first_name", F.array_join("forbidden", ",").alias("forbidden"))


@query
def inferred_names(spark, d):
    """What the first lines of each document alone say."""
    out = identity.inferred(_documents(spark, d))
    return out.select("doc_id", "inferred_first_name", F.array_join("inferred_terms", ",").alias("inferred_terms"))


@query
def anonymous_titles(spark, d):
    """Documents whose title is their first name and first line of text, without the terms that mustn't be shown."""
    out = identity.identified(_documents(spark, d))
    title = structured.without_terms(F.concat_ws(" ", F.initcap("first_name"), F.element_at(F.split("source", "\n"), 1)), F.col("forbidden"))
    return out.select("doc_id", title.alias("title"))


NORMAL = lambda c: rf"trim(regexp_replace(replace(lower({fold(c)}), '’', ''''), '[^a-z0-9+#]+', ' ', 'g'))"
HEADER = "('dossier', 'competences', 'cv', 'curriculum', 'vitae', 'page', 'profil', 'consultant', 'consultante')"
ENDING = "('est', 'base', 'a', 'au', 'aux', 'de', 'du', 'des', 'chez', 'specialise')"
REJECTED = "(" + ", ".join(f"'{w}'" for w in REJECTED_WORDS.split()) + ")"
CAPITAL = lambda t: rf"(regexp_matches(substring({t}, 1, 1), '^\p{{L}}') AND upper(substring({t}, 1, 1)) = substring({t}, 1, 1))"


def _cases(cases: dict[int, str]) -> str:
    return "CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN '{v}'".replace("\n", "' || chr(10) || '") for k, v in cases.items()) + " END"


FACTS = rf"""
d AS (SELECT doc_id, concat_ws(chr(10), {_cases(HEADS)}, coalesce(text, '')) AS source, nullif(upper(string_split(trim(coalesce({_cases(GIVEN)}, '')), ' ')[1]), '') AS given FROM documents),
g AS (SELECT doc_id, source, CASE WHEN given NOT IN ('JR', 'SR') THEN given END AS given, string_split(source, chr(10))[1:250] AS ls FROM d),
x AS (SELECT doc_id, given, unnest(range(0, len(ls))) AS i, ls, trim(unnest(ls)) AS line FROM g),
y AS (SELECT *, list_transform(list_filter(string_split_regex(line, '\s+'), lambda t: regexp_matches(t, '[A-Za-zÀ-ÿ]')), lambda t: trim(t, ' ,;:/\()[]{{}}')) AS ts, {NORMAL("line")} AS folded FROM x),
z AS (SELECT *, list_transform(ts, lambda t: {NORMAL("t")}) AS ns, len(ts) AS n, string_split(folded, ' ') AS fw FROM y),
f AS (
  SELECT *, list_has_any(fw, ['dossier', 'competences', 'cv', 'curriculum', 'vitae', 'page']) AS marked,
    n BETWEEN 2 AND 4 AND NOT regexp_matches(line, '@|https?://|[0-9]|&') AND len(list_filter(ns, lambda w: w = '' OR w IN {REJECTED})) = 0 AND {CAPITAL("ts[1]")} AND {CAPITAL("ts[2]")} AS alone FROM z),
facts AS (
  SELECT *, folded = '' OR (regexp_matches(line, '(?i)\bpage\s+[0-9]+\s*(?:/|sur|of)?\s*[0-9]*\b') AND marked) OR (list_contains(fw, 'dossier') AND list_contains(fw, 'competences')) OR contains(folded, 'curriculum vitae') OR folded IN ('cv', 'page') OR (contains(line, '|') AND marked) AS header FROM f)"""

INFERRED = rf"""
head AS (SELECT *, CASE WHEN ns[1] IN ('mr', 'm', 'mme', 'ms', 'mrs', 'dr', 'pr', 'prof') THEN 1 ELSE 0 END AS skip, lead(ts) OVER (PARTITION BY doc_id ORDER BY i) AS next_ts, lead(ns) OVER (PARTITION BY doc_id ORDER BY i) AS next_ns, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next_line FROM facts WHERE i < 50),
cut AS (SELECT *, ts[skip + 1:] AS us, ns[skip + 1:] AS ms FROM head WHERE line <> '' AND NOT header),
own AS (
  SELECT *, list_transform(list_filter(range(2, len(us) + 1), lambda k: ms[k] NOT IN {HEADER}), lambda k: us[k]) AS names,
    list_transform(list_filter(range(2, len(us) + 1), lambda k: ms[k] NOT IN {ENDING} AND ms[k] NOT IN {REJECTED} AND {CAPITAL("us[k]")}), lambda k: us[k]) AS surnames,
    list_filter(range(1, len(us) + 1), lambda k: ms[k] IN {ENDING})[1] AS ending FROM cut),
cand AS (
  SELECT doc_id, i, 1 AS rule, line, us[1] AS first, names AS terms FROM own WHERE alone AND len(us) >= 2 AND len(names) > 0
  UNION ALL SELECT doc_id, i, 2, line, us[1], [surnames[-1]] FROM own
    WHERE len(us) BETWEEN 3 AND 5 AND ending >= 2 AND ms[1] NOT IN {REJECTED} AND ms[1] NOT IN {HEADER} AND {CAPITAL("us[1]")} AND len(surnames) > 0 AND (i > 0 OR NOT (alone AND len(us) >= 2 AND len(names) > 0))
  UNION ALL SELECT doc_id, i, 3, line || ' | ' || next_line, ts[1], next_ts FROM own
    WHERE len(ts) = 1 AND len(next_ts) = 1 AND {CAPITAL("ts[1]")} AND {CAPITAL("next_ts[1]")} AND ns[1] NOT IN {REJECTED} AND next_ns[1] NOT IN {REJECTED} AND ns[1] NOT IN {HEADER} AND next_ns[1] NOT IN {HEADER} AND ns[1] <> '' AND next_ns[1] <> ''),
placed AS (SELECT c.*, greatest(0, coalesce(list_position(ls[1:50], line), 0) - 1) AS place FROM cand c JOIN g ON g.doc_id = c.doc_id),
kept AS (SELECT *, place >= 12 AS deep, bool_or(place < 12) OVER (PARTITION BY doc_id) AS any_shallow FROM placed),
chosen AS (SELECT * FROM kept WHERE NOT deep OR (place >= 20 AND NOT any_shallow) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(terms), CASE WHEN deep THEN place ELSE 0 END, i, rule) = 1)"""

NAMES_SQL = f"WITH {FACTS}, {INFERRED} SELECT d.doc_id, first AS inferred_first_name, coalesce(array_to_string(terms, ','), '') AS inferred_terms FROM d LEFT JOIN chosen ON chosen.doc_id = d.doc_id"

FORBIDDEN = rf"""
who AS (SELECT g.doc_id, coalesce(given, CASE WHEN lower(first) NOT IN ('jr', 'sr') THEN upper(first) END) AS allowed FROM g LEFT JOIN chosen ON chosen.doc_id = g.doc_id),
named AS (
  SELECT f.*, allowed, list_position(list_transform(ts, lambda t: upper(t)), allowed) AS spot FROM facts f JOIN who ON who.doc_id = f.doc_id WHERE line <> '' AND n >= 2 AND list_contains(list_transform(ts, lambda t: upper(t)), allowed)
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY CASE WHEN regexp_matches(line, '[|•]') THEN 1 ELSE 0 END, abs(len(list_filter(ns, lambda w: w NOT IN {HEADER})) - 2), n, i) = 1),
rest AS (SELECT *, list_filter(list_transform(range(spot + 1, n + 1), lambda k: {{'t': ts[k], 'n': ns[k]}}), lambda y: length(y.n) >= 3) AS rs FROM named),
taken AS (
  SELECT *, list_reduce(rs, lambda a, y: CASE WHEN a.over OR y.n IN {ENDING} OR y.n IN {REJECTED} THEN {{'o': a.o, 'over': true}}
      WHEN y.n IN {HEADER} THEN CASE WHEN len(a.o) > 0 THEN a ELSE {{'o': [y], 'over': false}} END
      ELSE {{'o': list_append(a.o, y), 'over': NOT alone OR len(a.o) >= 1}} END, {{'o': CAST([] AS STRUCT(t VARCHAR, n VARCHAR)[]), 'over': false}}).o AS os FROM rest),
told AS (SELECT *, list_filter(os, lambda y: upper(y.t) <> allowed AND lower(y.t) NOT IN ('jr', 'sr')) AS ps FROM taken),
terms AS (SELECT doc_id, list_transform(list_filter(ps, lambda y, k: NOT (header AND y.n IN {HEADER} AND k > 1)), lambda y: y.t) AS v FROM told),
final AS (SELECT doc_id, list_filter(v, lambda t, k: list_position(v, t) = k) AS v FROM terms)"""

FORBIDDEN_SQL = f"WITH {FACTS}, {INFERRED}, {FORBIDDEN} SELECT who.doc_id, allowed AS first_name, coalesce(array_to_string(v, ','), '') AS forbidden FROM who LEFT JOIN final ON final.doc_id = who.doc_id"


def _without(c: str, t: str) -> str:
    """A whole word taken out, twice, since a border may serve two of them."""
    once = lambda x: rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}_])' || regexp_replace({t}, '([^\p{{L}}\p{{N}}])', '\\\1', 'g') || '($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return once(once(c))


TITLES_SQL = rf"""
WITH {FACTS}, {INFERRED}, {FORBIDDEN}
SELECT who.doc_id, CASE WHEN len(coalesce(v, [])) = 0 THEN title ELSE trim(regexp_replace(list_reduce(v, lambda a, t: {_without("a", "t")}, title), '\s+', ' ', 'g')) END AS title
FROM who LEFT JOIN final ON final.doc_id = who.doc_id
JOIN (SELECT g.doc_id, concat_ws(' ', upper(substring(allowed, 1, 1)) || lower(substring(allowed, 2)), ls[1]) AS title FROM g JOIN who w ON w.doc_id = g.doc_id) t ON t.doc_id = who.doc_id
"""

ORACLE_SQL = {"inferred_names": NAMES_SQL, "forbidden_identities": FORBIDDEN_SQL, "anonymous_titles": TITLES_SQL}
