"""Whose document is it: the first name at the head of a source, and the terms of the identity that mustn't be shown.

All rules work on the arrays of a row: lines, their tokens, and each token's folded form. What wins is the least of a struct
(an argmin in the order in which the rules rank), so a row needs no sort and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import unused
from quillspark.functions.scalars import bound
from quillspark.functions.text import fidelity_each, first_name, text_of, upper

# Words that no name has, words that end one, titles before one, and words of a document's header.
REJECTED = (
    "production gestion flux donnees donnee fichiers fichier competences experiences experience professionnelles professionnelle formation formations missions mission profil resume objectif projet projets sql server edi transact ssis api "
    "sftp postgre postgresql data analyst engineer responsable applicatif applicative developpeur developpeuse architecte senior niveau langue langues universite ingenieur java spring devops docker kubernetes aws azure python javascript "
    "typescript react angular vue node php ruby golang rust terraform ansible jenkins gitlab jira confluence agile scrum kanban sre linux windows macos ios android reactjs nextjs vuejs nuxt nestjs dotnet csharp cpp postgres mysql mongodb "
    "redis kafka spark hadoop snowflake airflow dbt etl elt sap oracle salesforce figma sketch master licence bachelor doctorat docteur phd bts dut baccalaureat baccalaureate bac these memoire diplome certification certificat hnd hnc mba "
    "cap bep dea dess deps ingenierie programmation langages infrastructure conteneurisation orchestration securite observabilite proactivite initiatives atouts frameworks outils collaboration esprit reseau reseaux centres interet homelab "
    "retrogaming guitare competence analyse"
).split()
ENDING = ("est", "base", "a", "au", "aux", "de", "du", "des", "chez", "specialise")
TITLES = ("mr", "m", "mme", "ms", "mrs", "dr", "pr", "prof")
HEADER = ("dossier", "competences", "cv", "curriculum", "vitae", "page", "profil", "consultant", "consultante")
HEADER_MARKS = ("dossier", "competences", "cv", "curriculum", "vitae", "page")
PAGE = r"(?i)\bpage\s+[0-9]+\s*(?:/|sur|of)?\s*[0-9]*\b"
#: Lines in which a given first name is looked for, in which one is inferred, and the depths between which none counts.
KNOWN_LINES, INFERRED_LINES, SHALLOW, DEEP = 250, 50, 12, 20
#: Most tokens of a line that can be a name: five, and a title before them.
MOST_TOKENS = 6

_TRIM = r" ,;:/\\()\[\]{}"
_EDGE = rf"^[{_TRIM}]+|[{_TRIM}]+$"
_SPACE = r"[\s  -  　]"


def _lines(source: Column, most: int) -> Column:
    """The first lines, as they are."""
    return F.slice(F.split(text_of(source), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), 1, most)


def _tokens(line: Column) -> Column:
    return F.transform(F.filter(F.split(line, f"{_SPACE}+"), lambda t: t.rlike("[A-Za-zÀ-ÿ]")), lambda t: F.regexp_replace(t, _EDGE, ""))


def _header(line: Column, folded: Column) -> Column:
    """Whether a line heads a document or page rather than a person."""
    words = F.split(folded, " ")
    marked = F.arrays_overlap(words, F.array(*map(F.lit, HEADER_MARKS)))
    return (
        (folded == "") | (line.rlike(PAGE) & marked) | (F.array_contains(words, "dossier") & F.array_contains(words, "competences")) | folded.contains("curriculum vitae") | folded.isin("cv", "page") | (line.contains("|") & marked)
    )


def _facts(lines: Column, most: int | None = None) -> Column:
    """Of each line: itself trimmed, its tokens with their folded forms, whether it's a header, and its place from 0.

    Lines with more than ``most`` tokens have none here and aren't folded: folding is what costs. All that a lambda reads is bound first,
    since a column would be computed again for every line.
    """
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", ""))
    # Where the tokens of each line begin among all: their sizes summed up, so that the flat array of folded words is dealt back.
    starts = lambda k: F.aggregate(k, F.array(F.lit(1)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.size(t))))

    def some(x: Column) -> Column:
        t = _tokens(x)
        return t if most is None else bound(t, lambda k: F.when(F.size(k) <= most, k).otherwise(F.slice(k, 1, 0)))

    def split(t: Column, k: Column) -> Column:
        told = F.transform(t, lambda x, i: F.when(F.size(F.get(k, i)) > 0, x).otherwise(""))
        return bound(F.struct(t.alias("lines"), k.alias("tokens"), fidelity_each(told).alias("folds"), fidelity_each(F.flatten(k)).alias("words"), starts(k).alias("starts")), of)

    def of(s: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            own = F.get(s["tokens"], i)
            pairs = F.zip_with(own, F.slice(s["words"], F.get(s["starts"], i), F.size(own)), lambda t, n: F.struct(t.alias("t"), n.alias("n")))
            return F.struct(x.alias("line"), pairs.alias("tokens"), _header(x, F.get(s["folds"], i)).alias("header"), i.alias("at"))

        return F.transform(s["lines"], line)

    return bound(trimmed, lambda t: bound(F.transform(t, some), lambda k: split(t, k)))


def _capital(t: Column) -> Column:
    """Whether a token begins with a letter that isn't a small one."""
    first = F.substring(F.regexp_replace(t, _EDGE, ""), 1, 1)
    return first.rlike(r"^\p{L}") & (upper(first) == first)


def _alone(x: Column) -> Column:
    """Whether a line is nothing but a name: two to four tokens, none of them rejected, the first two with capitals."""
    t = x["tokens"]
    return ~x["line"].rlike(r"@|https?://|[0-9]|&") & F.size(t).between(2, 4) & ~F.exists(t, lambda y: (y["n"] == "") | y["n"].isin(*REJECTED)) & F.forall(F.slice(t, 1, 2), lambda y: _capital(y["t"]))


def _untitled(t: Column) -> Column:
    """Tokens without a title before them."""
    return F.when((F.size(t) > 0) & F.get(t, F.lit(0))["n"].isin(*TITLES), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)


def _candidate(when: Column, rank: Column, line: Column, first: Column, forbidden: Column) -> Column:
    terms = F.transform(forbidden, lambda y: y["t"])
    return F.when(when, F.struct(rank.cast("int").alias("rank"), F.size(terms).alias("n"), line.alias("line"), first.alias("first"), terms.alias("forbidden")))


def _candidates(facts: Column) -> Column:
    """Candidates for a name in the order of lines and, in a line, of the three rules: a name alone, a name with a particle, a name over two lines."""

    def of(x: Column) -> Column:
        t = _untitled(x["tokens"])
        first, rest = F.get(t, F.lit(0)), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
        names = F.filter(rest, lambda y: ~y["n"].isin(*HEADER))
        alone = _candidate(_alone(x) & (F.size(t) >= 2) & (F.size(names) > 0), F.size(F.filter(names, lambda y: y["n"].isin(*REJECTED))), x["line"], first["t"], names)
        surnames = F.filter(rest, lambda y: ~y["n"].isin(*ENDING) & ~y["n"].isin(*REJECTED) & _capital(y["t"]))
        ending = F.array_position(F.transform(t, lambda y: y["n"].isin(*ENDING)), True)
        proper = ~first["n"].isin(*REJECTED) & ~first["n"].isin(*HEADER) & _capital(first["t"])
        # Of the first line, a particle counts only if the line isn't a name alone.
        particle = _candidate(F.size(t).between(3, 5) & (ending >= 2) & proper & (F.size(surnames) > 0) & ((x["at"] > 0) | alone.isNull()), F.lit(0), x["line"], first["t"], F.slice(surnames, -1, 1))
        below = F.get(facts, x["at"] + 1)
        single = lambda y: _capital(y["t"]) & (y["n"] != "") & ~y["n"].isin(*REJECTED) & ~y["n"].isin(*HEADER)
        this, that = F.get(x["tokens"], F.lit(0)), F.get(below["tokens"], F.lit(0))
        two = (x["at"] + 1 < F.size(facts)) & (F.size(x["tokens"]) == 1) & (F.size(below["tokens"]) == 1) & single(this) & single(that)
        over = _candidate(two, F.lit(0), F.concat_ws(" | ", x["line"], below["line"]), this["t"], below["tokens"])
        return F.when((x["line"] != "") & ~x["header"], F.array_compact(F.array(alone, particle, over)))

    return F.flatten(F.array_compact(F.transform(facts, of)))


def _best(lines: Column) -> Column:
    """The chosen candidate of the first lines."""
    return bound(F.slice(lines, 1, INFERRED_LINES), lambda first: bound(_facts(first, MOST_TOKENS), lambda facts: bound(_candidates(facts), lambda c: _chosen(c, first))))


def _chosen(candidates: Column, lines: Column) -> Column:
    """The candidate of least rank and fewest terms: among those of the first lines, or else of those far down whose line stands there as it is."""
    place = lambda c: F.greatest(F.coalesce(F.array_position(lines, c["line"]), F.lit(0)).cast("int") - 1, F.lit(0))
    ranked = F.transform(candidates, lambda c, i: F.struct((place(c) >= SHALLOW).alias("deep"), c["rank"].alias("rank"), c["n"].alias("n"), F.when(place(c) >= SHALLOW, place(c)).otherwise(0).alias("at"), i.alias("i"), c["first"].alias("first"), c["forbidden"].alias("forbidden")))
    return bound(ranked, lambda r: F.array_min(F.filter(r, lambda c: ~c["deep"] | ((c["at"] >= DEEP) & ~F.exists(r, lambda o: ~o["deep"])))))


def _named(facts: Column, allowed: Column) -> Column:
    """The line that names the allowed person best: without separators, nearest to two tokens, with the fewest, the first."""

    def of(x: Column) -> Column:
        holds = F.exists(x["tokens"], lambda y: first_name(y["t"]).eqNullSafe(allowed))
        own = F.size(F.filter(x["tokens"], lambda y: ~y["n"].isin(*HEADER)))
        rank = F.struct(x["line"].rlike("[|•]").cast("int").alias("mark"), F.abs(own - 2).alias("far"), F.size(x["tokens"]).alias("n"), x["at"].alias("at"))
        return F.when((x["line"] != "") & holds & (F.size(x["tokens"]) >= 2), rank)

    return F.get(facts, F.array_min(F.array_compact(F.transform(facts, of)))["at"])


def _forbidden(x: Column, allowed: Column) -> Column:
    """Tokens of the line after the allowed first name that are likely the rest of a name; distinct.

    They end at the first word that no name has, and after one (two where the line is a name alone). A header's word counts only right after the first name.
    """
    t = x["tokens"]
    at = F.array_position(F.transform(t, lambda y: first_name(y["t"]).eqNullSafe(allowed)), True).cast("int")
    rest = F.filter(F.slice(t, at + 1, F.greatest(F.size(t) - at, F.lit(0))), lambda y: F.length(y["n"]) >= 3)
    state = F.struct(F.slice(t, 1, 0).alias("out"), F.lit(False).alias("over"))

    def step(a: Column, y: Column) -> Column:
        ends = y["n"].isin(*ENDING) | y["n"].isin(*REJECTED)
        header = y["n"].isin(*HEADER)
        taken = F.when(a["over"] | ends | (header & (F.size(a["out"]) > 0)), a["out"]).otherwise(F.concat(a["out"], F.array(y)))
        full = ~header & (~_alone(x) | (F.size(taken) >= 2))
        return F.struct(taken.alias("out"), (a["over"] | ends | full).alias("over"))

    found = F.aggregate(rest, state, step, lambda a: a["out"])
    named = F.filter(found, lambda y: first_name(y["t"]).isNotNull() & ~first_name(y["t"]).eqNullSafe(allowed))
    # On a header line, header words after a kept token go.
    kept = F.filter(named, lambda y, i: ~(x["header"] & y["n"].isin(*HEADER) & (i > 0)))
    return F.array_distinct(F.transform(kept, lambda y: y["t"]))


def identified(docs: DataFrame, source: str = "source", given: str = "candidate_first_name") -> DataFrame:
    """``docs`` with ``first_name`` (upper case) and ``forbidden``, the array of terms of the identity that mustn't be shown.

    The first name is the first token of the column ``given`` or, where that has none, the name inferred from the first lines of
    ``source``. Without a name, and where no line names it together with others, nothing is forbidden. Null texts are empty; other columns pass as they are,
    but columns named like the two results are replaced.
    """
    lines, found, line = unused(docs, "lines", "found", "line")
    name = first_name(F.col(given))
    d = docs.withColumn(lines, _lines(F.col(source), KNOWN_LINES)).withColumn(found, F.when(name.isNull(), _best(F.col(lines))))
    d = d.withColumn("first_name", F.coalesce(name, first_name(F.col(found)["first"])))
    # Only lines that hold the name in some way are split and folded: both in Java's upper case, in which a capital sharp s stays.
    holds = lambda x, name: F.upper(F.replace(x, F.lit("ß"), F.lit("ẞ"))).contains(F.upper(name))
    both = F.struct(F.col(lines).alias("lines"), F.col("first_name").alias("name"))
    d = d.withColumn(line, bound(both, lambda b: bound(_facts(F.filter(b["lines"], lambda x: holds(x, b["name"]))), lambda f: _named(f, b["name"]))))
    terms = bound(F.struct(F.col(line).alias("line"), F.col("first_name").alias("name")), lambda b: _forbidden(b["line"], b["name"]))
    return d.withColumn("forbidden", F.coalesce(F.when(F.col(line).isNotNull(), terms), F.array().cast("array<string>"))).drop(lines, found, line)


def inferred(docs: DataFrame, source: str = "source") -> DataFrame:
    """``docs`` with ``inferred_first_name`` and ``inferred_terms`` (null and empty without a confident name) of the first lines alone."""
    (found,) = unused(docs, "found")
    d = docs.withColumn(found, _best(_lines(F.col(source), INFERRED_LINES)))
    return d.withColumn("inferred_first_name", F.col(found)["first"]).withColumn("inferred_terms", F.coalesce(F.col(found)["forbidden"], F.array().cast("array<string>"))).drop(found)
