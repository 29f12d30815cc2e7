"""Skills of structured documents: items of a source's skills section, spoken languages hoisted out of them, labels, display, families.

All rules are folds over the arrays of one row, so nothing is shuffled. Types: SKILLS is an array of (category, items),
LANGUAGES one of (name, level). Null arrays and texts count as empty, null items as empty texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import chunked, first_by, grouped_by, unused
from quillspark.functions.scalars import bound
from quillspark.functions.text import START, STOP, compatible, fidelity, fidelity_each, folded_each, squeezed, text_of
from quillspark.operators.structured import skills_lines
from quillspark.operators.taxonomy import category_of_folded

SKILLS = "array<struct<category:string,items:array<string>>>"
LANGUAGES = "array<struct<name:string,level:string>>"
STRINGS = "array<string>"

# Names of spoken languages as they're looked for in items, and words of a level.
NAMES = (
    "fran[çc]ais|anglais|espagnol|allemand|italien|portugais|arabe|russe|chinois|japonais|mandarin|coreen|coréen|neerlandais|néerlandais|suedois|suédois|polonais|tcheque|tchèque|hongrois|roumain|bulgare|"
    "grec|turc|hindi|vietnamien|indonesien|indonésien|ukrainien|catalan|croate|slovaque|estonien|letton|lituanien|breton|occitan|corse|basque"
)
TAIL_LEVELS = "lu|parl[ée]|écrit|courant|bilingue|natif|native|maternel|maternelle|professionnel|technique|scolaire|notions|a1|a2|b1|b2|c1|c2"
LEVEL_PARTS = "lu|parle|ecrit|courant|bilingue|natif|native|maternel|maternelle|professionnel|technique|scolaire|notions"
GRADES = ("a1", "a2", "b1", "b2", "c1", "c2")

# One spelling for the folded forms of a label.
LABELS = {
    "azure": "Azure", "aws": "AWS", "gcp": "GCP", "gitlab cicd": "GitLab CI/CD", "gitlab ci/cd": "GitLab CI/CD", "gitlab ci cd": "GitLab CI/CD", "docker-compose": "Docker Compose", "docker compose": "Docker Compose",
    "sqlserver": "SQL Server", "sql server": "SQL Server", "postegresql": "PostgreSQL", "postgresql": "PostgreSQL", "graphana": "Grafana", "grafana": "Grafana", "elasticsearch": "Elasticsearch", "logstash": "LogStash",
    "kibana": "Kibana", "dynatrace": "Dynatrace", "redis": "Redis", "tomcat": "Tomcat", "spring boot": "Spring Boot", "spring": "Spring", "hibernate": "Hibernate", "jwt": "JWT", "oauth2": "OAuth2", "oauth 2": "OAuth2",
    "ldap": "LDAP", "x509": "X509", "openssl": "OpenSSL", "openssh": "OpenSSH", "pkcs7": "PKCS7", "owasp": "OWASP", "ubuntu": "Ubuntu", "centos": "CentOS", "aix": "AIX", "windows": "Windows", "linux": "Linux",
    "macos": "macOS", "ios": "iOS", "android": "Android", "node.js": "Node.js", "nodejs": "Node.js", "node js": "Node.js", "typescript": "TypeScript", "javascript": "JavaScript", "angularjs": "AngularJS",
    "websocket": "WebSocket", "html5": "HTML5", "css3": "CSS3", "groovy": "Groovy", "kotlin": "Kotlin", "swift": "Swift", "c++": "C++", "c#": "C#", "f#": "F#", "toad": "TOAD",
}

# What stands before a colon and the category that it means, in order; those that also open an item inside another.
PREFIXES = (
    ("web|front(?:end)?", "Frontend"), ("javascript", "Frontend"), ("php|back(?:end)?", "Backend"), ("interop[ée]rabilit[ée]", "Architecture & Conception"), ("industrialisation|versioning", "Cloud & DevOps"),
    (r"serveurs?\s+web", "Outils & Environnements"), ("outils?", "Outils & Environnements"), ("cloud|devops", "Cloud & DevOps"), ("s[ée]curit[ée]", "Sécurité"),
    (r"data\s*stores?|data\s*bases?|bases?\s+de\s+donn[ée]es?", "Bases de données"), ("syst[èe]mes?", "Systèmes & Environnements"), ("observabilit[ée]|apm", "Observabilité"),
    (r"architecture\s+logicielle|architecture", "Architecture & Conception"),
)
INLINE = r"web|front(?:end)?|javascript|php|back(?:end)?|interop[ée]rabilit[ée]|industrialisation|versioning|serveurs?\s+web|outils?|data\s*stores?|data\s*bases?|bases?\s+de\s+donn[ée]es?|syst[èe]mes?"
CATEGORY_ALIASES = {"Cloud / DevOps": "Cloud & DevOps", "Data": "Bases de données", "Outils & méthodes": "Méthodologies", "Frameworks & Librairies": "Langages & Frameworks"}
FALLBACK, UNSORTED = "Outils & Environnements", "Autres"
KEY_ALIASES = {"postegresql": "postgresql", "graphana": "grafana"}

# Families of long lists with their keywords, in order; categories that are generic, and those kept as the source has them.
FAMILIES = (
    ("Backend", ("java", "spring", "hibernate", "api", "microservices", "node", "php", "symfony", ".net", "c#", "python", "django", "fastapi", "maven")),
    ("Frontend", ("react", "angular", "vue", "next", "typescript", "javascript", "html5", "css3", "html", "css")),
    ("Cloud / DevOps", ("aws", "azure", "gcp", "cloud", "docker", "kubernetes", "terraform", "jenkins", "gitlab ci", "ci/cd", "ansible", "helm")),
    ("Data", ("sql", "postgres", "mysql", "oracle", "mongodb", "mongo", "power bi", "tableau", "spark", "databricks", "snowflake")),
    ("Sécurité", ("iam", "sso", "oauth", "cyber", "security", "sécurité", "dora", "iso 27001")),
    ("Outils & méthodes", ("agile", "scrum", "kanban", "jira", "confluence", "git", "sonarqube", "sonar", "uml", "itil")),
)
#: Names whose beginning stands for the keywords inside them.
WHOLE_NAMES = ("postgresql", "mongodb")
GENERIC = ("compétences", "competences", "skills", "expertises", "technologies", "technique", "techniques", "environnements techniques")
FAITHFUL = (
    "competences et outils", "processus metiers", "exemples de realisations professionnelles", "realisations professionnelles", "realisations", "projets", "projets significatifs", "certifications", "competences fonctionnelles",
    "methodologie de travail", "mainframe", "web .net", "testeur fonctionnel", "base de donnees", "competences organisationnelles", "java",
)
DEFAULT_CATEGORY = "Compétences"
CERTIFYING = ("certification", "certifié", "certifie", "aws", "azure", "scrum", "itil", "pmp")

# Spoken languages and levels inside a run of words, marks of certifications, and where the rest of a language list goes.
SPOKEN = (
    "arabe", "francais", "français", "anglais", "espagnol", "allemand", "italien", "portugais", "chinois", "mandarin", "cantonais", "japonais", "coreen", "coréen", "russe", "neerlandais", "néerlandais", "suedois", "suédois",
    "norvegien", "norvégien", "danois", "finnois", "polonais", "tcheque", "tchèque", "hongrois", "roumain", "bulgare", "grec", "turc", "hindi", "bengali", "hebreu", "thaï", "thai", "vietnamien", "indonesien", "indonésien",
    "malais", "tagalog", "ukrainien", "catalan", "galicien", "serbe", "croate", "slovaque", "slovene", "slovène", "estonien", "letton", "lituanien", "breton", "occitan", "corse", "basque",
)
WORD_LEVELS = "natif|native|maternel|maternelle|bilingue|courant|fluent|fluide|avance|avancé|intermediaire|intermédiaire|c1|c2|b1|b2|a1|a2|technique|professionnel|notions|scolaire|lu|parlé|ecrit|écrit|read|spoken|written"
TOKEN = "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9+#./]*[A-Za-zÀ-ÿ0-9+#.]?|[0-9]+"
CERTIFICATES = (
    "certified", "certification", "certifié", "certifiee", "ocp", "oca", "ocm", "aws solutions architect", "aws developer", "aws sysops", "azure administrator", "azure developer", "azure architect", "az-900", "az-104", "az-204",
    "az-303", "az-304", "gcp professional", "gcp associate", "professional cloud architect", "cka", "ckad", "cks", "rhcsa", "rhce", "prince2", "prince 2", "pmp", "pmi", "capm", "safe agilist", "scaled agile", "scrum master", "psm i",
    "pspo", "togaf", "itil", "mcts", "mcsa", "mcse", "java se 8", "java se 11", "java se 17",
)
SHORT_CERTIFICATES = ("cert", "aws", "azure", "gcp", "oracle", "scrum", "pmp", "itil", "togaf", "java se", "rhcsa", "rhce", "cka", "ckad", "cks", "mcts", "mcsa", "mcse")
LANGUAGE_CATEGORIES, CERTIFICATE_CATEGORIES = ("langues", "languages", "language", "langue"), ("certifications", "certification", "certifs", "certificat")
RELOCATED = ("Stack principale", "Outils & Environnements", "Backend", "Langages", "Frontend", "Outils & méthodes", "Méthodologies")
LONGEST_CERTIFICATE = 140

# Families of technical environments.
ENVIRONMENTS = (
    ("Frontend", ("react", "next", "vue", "angular", "javascript", "typescript", "html", "css")),
    ("Backend", ("java", "spring", "node", "php", "symfony", ".net", "c#", "python", "django", "fastapi", "api", "sql server")),
    ("Cloud", ("aws", "azure", "gcp", "cloud", "kubernetes", "eks", "aks", "gke")),
    ("DevOps", ("docker", "kubernetes", "terraform", "jenkins", "gitlab", "ci/cd", "ansible", "helm")),
    ("Data", ("sql", "postgres", "mysql", "oracle", "power bi", "tableau", "spark", "databricks", "snowflake")),
    ("Sécurité", ("iam", "sso", "oauth", "cyber", "security", "sécurité", "dora")),
)

_EDGES = r" ,;:.\-–—()"


def _cut(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _some(items: Column, kind: str) -> Column:
    return F.coalesce(items, F.array().cast(kind))


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, words))


# Items and languages.


def skill_items(lines: Column) -> Column:
    """Items of the lines of a skills section: a bullet opens one, also alone on its line; a spoken language with its level at the end is an item of its own."""
    bullet = r"^[➢>•\-–—]+\s*"
    state = F.struct(F.lit("").alias("held"), F.array().cast(STRINGS).alias("out"))
    flushed = lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"])

    def step(a: Column, raw: Column) -> Column:
        # Lines of an item are held apart by a mark, since an item of one line that is a language stays whole.
        x = squeezed(raw)
        opens = x.rlike(bullet)
        joined = F.when(a["held"] == "", x).when(x == "", a["held"]).otherwise(F.concat_ws("\x01", a["held"], x))
        return F.struct(F.when(opens, F.trim(F.regexp_replace(x, bullet, ""))).otherwise(joined).alias("held"), F.when(opens, flushed(a)).otherwise(a["out"]).alias("out"))

    tail = rf"(?iu)^(.*?[\s,])({NAMES})\s*((?:{TAIL_LEVELS})[^\n]*)$"

    def split(held: Column) -> Column:
        x = _cut(squeezed(F.replace(held, F.lit("\x01"), F.lit(" "))), r" :;•➢\-–—")
        head = _cut(F.regexp_extract(x, tail, 1), " ,")
        spoken = F.trim(F.concat_ws(" ", F.regexp_extract(x, tail, 2), F.trim(F.regexp_extract(x, tail, 3))))
        whole = ~x.rlike(tail) | ((head == "") & ~held.contains("\x01"))
        return F.when(x == "", F.array().cast(STRINGS)).when(whole, F.array(x)).when(head == "", F.array(spoken)).otherwise(F.array(head, spoken))

    return F.flatten(F.transform(F.aggregate(lines, state, step, flushed), split))


def hoisted(items: Column) -> Column:
    """Struct of ``remaining`` items and ``languages``: an item that begins with a spoken language is one, with the level in it and in the items that follow as long as they look like a level.

    What an item does depends on the last one before it that doesn't look like a level: so the places of those alone cut the list into runs, each a language with
    the items of its level, or items that remain. Nothing grows item by item, so a list of any length costs in proportion to it.
    """

    def of(given: Column) -> Column:
        plain = F.transform(given, lambda x: F.trim(text_of(x)))
        bare = F.transform(given, lambda x: _cut(F.trim(text_of(x)), _EDGES))
        tails = F.transform(given, lambda x: _cut(F.regexp_replace(F.trim(text_of(x)), rf"(?iu)^(?:{NAMES})", ""), _EDGES))
        return bound(F.struct(plain.alias("items"), bare.alias("bare"), tails.alias("tails")), told)

    def told(s: Column) -> Column:
        level = F.arrays_zip(s["bare"].alias("bare"), folded_each(s["bare"]).alias("folded"), s["items"].alias("item"))
        opens = lambda x: x["item"].rlike(heading)
        # An item that opens a language begins with its name, bare or not, so it goes on with none.
        mark = F.transform(level, lambda x: F.when(opens(x), "o").when(~x["bare"].rlike(heading) & levelled(x["folded"], x["bare"]), "-").otherwise("x"))
        return bound(F.struct(s["items"].alias("items"), s["bare"].alias("bare"), s["tails"].alias("tails"), folded_each(s["tails"]).alias("folded_tails"), mark.alias("marks")), cut)

    def cut(s: Column) -> Column:
        starts = F.filter(F.transform(s["marks"], lambda m, i: F.struct(i.alias("at"), m.alias("mark"))), lambda x: (x["mark"] != "-") | (x["at"] == 0))
        return bound(starts, lambda c: runs(s, F.transform(c, lambda x, k: F.struct(x["mark"].alias("mark"), x["at"].alias("at"), (F.coalesce(F.get(c, k + 1)["at"], F.size(s["items"])) - x["at"]).alias("n")))))

    def runs(s: Column, every: Column) -> Column:
        def language(r: Column) -> Column:
            name = F.regexp_extract(F.get(s["items"], r["at"]), rf"(?iu)({NAMES})", 1)
            name = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 99)))
            own = F.when(levelled(F.get(s["folded_tails"], r["at"]), F.get(s["tails"], r["at"])), F.get(s["tails"], r["at"])).otherwise("")
            level = F.array_join(F.filter(F.concat(F.array(own), F.slice(s["bare"], r["at"] + 2, r["n"] - 1)), lambda x: x != ""), " ")
            return F.struct(name.alias("name"), squeezed(_cut(level, _EDGES)).alias("level"))

        def result(e: Column) -> Column:
            remaining = F.flatten(F.transform(F.filter(e, lambda r: r["mark"] != "o"), lambda r: F.slice(s["items"], r["at"] + 1, r["n"])))
            return F.struct(remaining.cast(STRINGS).alias("remaining"), F.transform(F.filter(e, lambda r: r["mark"] == "o"), language).cast(LANGUAGES).alias("languages"))

        return bound(every, result)

    levelled = lambda folded, raw: (raw != "") & (folded.rlike(LEVEL_PARTS) | folded.isin(*GRADES) | raw.contains(","))
    heading = rf"(?iu)^\s*(?:{NAMES}){STOP}"
    return bound(_some(items, STRINGS), of)


def merged(languages: Column) -> Column:
    """One language per name whatever its case, in order: the first spelling and the first level that isn't empty."""

    def of(every: Column) -> Column:
        tidy = F.filter(F.transform(every, lambda x: F.struct(F.trim(text_of(x["name"])).alias("name"), F.trim(text_of(x["level"])).alias("level"))), lambda x: x["name"] != "")
        return bound(tidy, lambda t: F.transform(F.array_distinct(F.transform(t, lambda x: F.lower(x["name"]))), lambda k: one(F.filter(t, lambda x: F.lower(x["name"]) == k))))

    def one(same: Column) -> Column:
        level = F.coalesce(F.get(F.filter(same, lambda x: x["level"] != ""), F.lit(0))["level"], F.lit(""))
        return F.struct(F.get(same, F.lit(0))["name"].alias("name"), level.alias("level"))

    return bound(_some(languages, LANGUAGES), of).cast(LANGUAGES)


# Labels and categories.


def labels(items: Column) -> Column:
    """The labels of an array's items, one for each: squeezed, without marks at their ends, in the fixed spelling of their folded form."""
    cut = F.transform(items, lambda x: _cut(squeezed(x), r" .,;:()\[\]{}•➢"))
    return bound(cut, lambda c: bound(folded_each(c), lambda f: F.transform(c, lambda x, i: F.coalesce(F.try_element_at(_map(LABELS), F.get(f, i)), x))))


def pieces(item: Column) -> Column:
    """An item cut before the known prefixes that stand inside it with a colon."""
    x = squeezed(item)
    parts = F.filter(F.transform(F.split(x, rf"(?iu)(?={START}(?:{INLINE})\s*[:：])"), lambda p: _cut(p, " ,;")), lambda p: p != "")
    return F.when(x == "", F.array().cast(STRINGS)).when(F.size(parts) == 0, F.array(x)).otherwise(parts)


def by_prefix(item: Column) -> Column:
    """Struct of the category that the words before a colon mean, null without, and what stands after it (else the item)."""
    pattern = r"^([^:：]{3,80})\s*[:：]\s*(.+)$"
    head, rest = F.trim(F.regexp_extract(item, pattern, 1)), F.trim(F.regexp_extract(item, pattern, 2))
    category = F.lit(None).cast("string")
    for words, name in reversed(PREFIXES):
        category = F.when(head.rlike(rf"(?iu)^(?:{words}){STOP}"), name).otherwise(category)
    return bound(category, lambda c: F.struct(c.alias("category"), F.when(c.isNotNull(), rest).otherwise(item).alias("rest")))


def values(item: Column) -> Column:
    """Values between commas, semicolons and spaced slashes; without those that are empty."""
    return F.filter(F.transform(F.split(item, r",|;|\s+/\s+"), squeezed), lambda x: x != "")


def plain_category(c: Column) -> Column:
    """A category's name without its mark of continuation, by its alias; the fallback if it's empty."""
    name = F.trim(F.regexp_replace(squeezed(c), r"(?i)\s*[—-]\s*suite(?:\s+[0-9]+)?$", ""))
    return F.coalesce(F.try_element_at(_map(CATEGORY_ALIASES), name), F.when(name != "", name), F.lit(FALLBACK))


def _labelled(found: Column) -> Column:
    """Candidates (category, value, sorted) with labels, without empty ones; a null category is that of the label's keywords, else ``sorted``."""

    def of(c: Column) -> Column:
        return bound(labels(F.transform(c, lambda x: x["value"])), lambda names: bound(folded_each(names), lambda folds: F.transform(c, lambda x, i: entry(x, F.get(names, i), F.get(folds, i)))))

    def entry(x: Column, name: Column, folded: Column) -> Column:
        key = F.regexp_replace(folded, "[^a-z0-9+#.]", "")
        return F.struct(
            F.coalesce(x["category"], category_of_folded(folded), x["otherwise"]).alias("category"), name.alias("value"), F.coalesce(F.try_element_at(_map(KEY_ALIASES), key), key).alias("key")
        )

    return F.filter(bound(found, of), lambda x: x["value"] != "")


def _as_skills(groups: Column) -> Column:
    return F.transform(groups, lambda g: F.struct(g["key"].alias("category"), g["values"].alias("items"))).cast(SKILLS)


_CANDIDATES = "array<struct<category:string,value:string,otherwise:string>>"


def _candidate(category: Column, value: Column, otherwise: str) -> Column:
    return F.struct(category.cast("string").alias("category"), value.alias("value"), F.lit(otherwise).alias("otherwise"))


def source_skills(text: Column) -> Column:
    """Struct of ``skills`` and ``languages`` of the skills section of a source, by the words before colons or the keywords of each value; empty without such a section."""

    def of(h: Column) -> Column:
        every = F.flatten(F.transform(h["remaining"], pieces))
        found = F.transform(F.transform(every, by_prefix), lambda p: F.transform(values(p["rest"]), lambda v: _candidate(p["category"], v, FALLBACK)))
        ready = _labelled(F.flatten(found).cast(_CANDIDATES))
        groups = F.transform(grouped_by(ready, "category", "value"), lambda g: F.struct(g["key"].alias("key"), F.array_distinct(g["values"]).alias("values")))
        return F.struct(_as_skills(groups).alias("skills"), h["languages"].alias("languages"))

    return bound(hoisted(skill_items(skills_lines(text))), of)


def displayed(skills: Column) -> Column:
    """Skills for display: one label per skill key over all categories, the first; categories in the order in which they're first used.

    A prefix before a colon sends its values to the prefix's category. Unsorted items go to the category of their
    keywords if they have one.
    """

    def of_skill(s: Column) -> Column:
        category = plain_category(s["category"])
        every = labels(F.flatten(F.transform(_some(s["items"], STRINGS), lambda x: pieces(text_of(x)))))

        def of_label(name: Column) -> Column:
            own = F.when(category == UNSORTED, F.lit(None).cast("string")).otherwise(category)
            return bound(by_prefix(name), lambda p: F.when(p["category"].isNotNull(), F.transform(values(p["rest"]), lambda v: _candidate(p["category"], v, UNSORTED))).otherwise(F.array(_candidate(own, name, UNSORTED))))

        return F.flatten(F.transform(F.filter(every, lambda x: x != ""), of_label)).cast(_CANDIDATES)

    ready = F.filter(_labelled(F.flatten(F.transform(_some(skills, SKILLS), of_skill)).cast(_CANDIDATES)), lambda x: x["key"] != "")
    return _as_skills(grouped_by(first_by(ready, lambda x: x["key"]), "category", "value"))


def with_skills(docs: DataFrame, source: str = "source") -> DataFrame:
    """``docs`` with its columns ``skills`` and ``languages`` merged with those of the skills section in the column ``source``.

    Languages leave the skills for ``languages``; those that were there come first, then the hoisted, then the source's.
    The document's own skills come before the source's, and both are displayed together.
    """
    own, found, every, spoken = unused(docs, "own", "found", "every", "spoken")
    skill = lambda s: F.struct(F.trim(text_of(s["category"])).alias("category"), hoisted(s["items"]).alias("h"))
    kept = F.transform(F.filter(F.col(own), lambda s: F.size(s["h"]["remaining"]) > 0), lambda s: F.struct(s["category"].alias("category"), s["h"]["remaining"].alias("items")))
    # Each step is a column of its own: nested in one expression, lambdas would need too many rounds of analysis.
    d = docs.withColumn(own, F.transform(_some(F.col("skills"), SKILLS), skill)).withColumn(found, source_skills(F.col(source)))
    d = d.withColumn(every, F.concat(kept.cast(SKILLS), F.col(found)["skills"]))
    d = d.withColumn(spoken, F.concat(_some(F.col("languages"), LANGUAGES).cast(LANGUAGES), F.flatten(F.transform(own, lambda s: s["h"]["languages"])).cast(LANGUAGES), F.col(found)["languages"].cast(LANGUAGES)))
    return d.withColumns({"skills": displayed(F.col(every)), "languages": merged(F.col(spoken))}).drop(own, found, every, spoken)


def keys(skills: Column) -> Column:
    """The distinct keys of all items: folded, of [a-z0-9+#.] only, by the aliases; without empty ones."""
    folded = folded_each(F.flatten(F.transform(_some(skills, SKILLS), lambda x: _some(x["items"], STRINGS))))
    plain = F.transform(folded, lambda f: F.regexp_replace(f, "[^a-z0-9+#.]", ""))
    return F.array_distinct(F.filter(F.transform(plain, lambda k: F.coalesce(F.try_element_at(_map(KEY_ALIASES), k), k)), lambda k: k != ""))


def covered(section: Column, want: Column, have: Column, least: float = 0.70) -> Column:
    """Whether a fact of a skills section needs no place of its own: that share of the wanted keys (of the source's parsed skills) is among those of the skills.

    False for other sections, and if either side has no key.
    """
    share = F.size(F.array_intersect(want, have)) / F.greatest(F.size(want), F.lit(1))
    return fidelity(section).isin("competences", "competences techniques", "competences et outils") & (F.size(want) > 0) & (F.size(have) > 0) & (share >= least)


# Families and long lists.


def family(item: Column) -> Column:
    """The first family of which the item holds a keyword: short words between other characters than letters and digits, others anywhere; else unsorted.

    One pattern per family instead of a search per keyword.
    """
    x = F.lower(item)
    out = F.lit(UNSORTED)
    for name, words in reversed(FAMILIES):
        out = F.when(x.rlike(family_pattern(words, "(?<![a-z0-9])", "(?![a-z0-9])")), name).otherwise(out)
    return out


def family_pattern(words: tuple[str, ...], start: str, stop: str) -> str:
    """A pattern for any of the keywords, with the given borders."""
    short, anywhere = [w for w in words if w.isalnum()], [w for w in words if not w.isalnum()]
    names = [n for n in WHOLE_NAMES if any(w in n for w in words)]
    parts = [f"{start}(?:{_any_of(tuple(short))}){stop}"] + ([_any_of(tuple(anywhere))] if anywhere else []) + [f"^{n}" for n in names]
    return "|".join(parts)


def distinct_items(items: Column, packed: Column) -> Column:
    """Items without marks, the first of each key [a-z0-9+#.]; ``packed`` ones are cut at commas, bars and semicolons first."""
    parts = F.flatten(F.transform(items, lambda x: F.when(packed, F.split(x, "[,|;]")).otherwise(F.array(x))))
    cut = F.filter(F.transform(parts, lambda x: _cut(x, r" •\t")), lambda x: x != "")
    return first_by(cut, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9+#.]+", ""))


def grouped_long(skills: Column, size: int = 6) -> Column:
    """Skills in which generic or long categories are dealt to families, in parts of ``size`` with marks of continuation; faithful ones and certifications stay whole."""

    named = lambda s: F.coalesce(F.when(F.trim(text_of(s["category"])) != "", F.trim(s["category"])), F.lit(DEFAULT_CATEGORY))

    def of(s: Column, folded: Column) -> Column:
        category = named(s)
        name, faithful = F.lower(category), folded.isin(*FAITHFUL)
        given = F.filter(F.transform(_some(s["items"], STRINGS), lambda x: F.trim(text_of(x))), lambda x: x != "")
        return bound(distinct_items(given, ~faithful), lambda items: parts(category, name, faithful, items))

    def parts(category: Column, name: Column, faithful: Column, items: Column) -> Column:
        keep = faithful | ((F.size(items) <= size) & ~name.rlike(_any_of(GENERIC))) | name.contains("certif")
        whole = F.array(F.struct(category.alias("category"), items.alias("items")))
        dealt = F.transform(items, lambda x: F.struct(family(x).alias("family"), x.alias("item")))
        each = bound(dealt, lambda d: F.flatten(F.array(*[chunks(n, F.transform(F.filter(d, lambda x: x["family"] == n), lambda x: x["item"])) for n, _ in (*FAMILIES, (UNSORTED, ()))])))
        return F.when(F.size(items) == 0, F.array().cast(SKILLS)).when(keep, whole.cast(SKILLS)).otherwise(each.cast(SKILLS))

    def chunks(name: str, items: Column) -> Column:
        suffix = lambda i: F.when(i == 0, "").when(i == 1, " — suite").otherwise(F.concat(F.lit(" — suite "), i.cast("string")))
        return F.transform(chunked(items, size), lambda x, i: F.struct(F.concat(F.lit(name), suffix(i)).alias("category"), x.alias("items")))

    folds = lambda every: fidelity_each(F.transform(every, named))
    return bound(_some(skills, SKILLS), lambda every: bound(folds(every), lambda n: F.flatten(F.transform(every, lambda s, i: of(s, F.get(n, i)))))).cast(SKILLS)


FORMATIONS = "array<struct<date:string,degree:string,school:string>>"


def grouped_certifications(formations: Column, most: int = 6) -> Column:
    """Formations in which more than ``most`` certifications are one entry after the others: dates and degrees in a row, schools once each."""
    text = lambda c: F.trim(text_of(c))
    certifying = lambda f: F.lower(F.concat_ws(" ", text_of(f["degree"]), text_of(f["school"]))).rlike(_any_of(CERTIFYING))

    def of(every: Column) -> Column:
        certificates, others = F.filter(every, certifying), F.filter(every, lambda f: ~certifying(f))
        some = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x != ""), " — ")
        one = F.struct(
            F.lit("Certifications").alias("date"), F.array_join(F.transform(certificates, lambda f: some(text(f["date"]), text(f["degree"]))), "; ").alias("degree"),
            F.array_join(F.array_distinct(F.filter(F.transform(certificates, lambda f: text(f["school"])), lambda x: x != "")), ", ").alias("school"),
        )
        return F.when(F.size(certificates) <= most, every).otherwise(F.concat(others, F.array(one)))

    return bound(_some(formations, FORMATIONS).cast(FORMATIONS), of)


# Rescues.


def spoken_in(item: Column) -> Column:
    """Struct of the ``languages`` named in a run of words, each with the level in the word after it, and the ``residual`` words; the item itself without any."""
    grade = rf"(?iu)^(?:{WORD_LEVELS}){STOP}"

    def base(token: Column) -> Column:
        x = _cut(F.lower(token), r" \t\n.,;:()\[\]{}•·")
        return _cut(F.regexp_replace(x, r"[0-9]+[#+.]*$", ""), r" \t\n.,;:()\[\]{}•·")

    def of(tokens: Column) -> Column:
        name = lambda i: F.coalesce(base(F.get(tokens, i)).isin(*SPOKEN), F.lit(False))
        level = lambda i: F.coalesce(F.get(tokens, i).rlike(grade) | F.get(tokens, i).rlike("^0*[1-5]$"), F.lit(False))
        marked = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), name(i).alias("name"), F.when(name(i) & level(i + 1), F.get(tokens, i + 1)).otherwise("").alias("level"), ((i > 0) & name(F.greatest(i - 1, F.lit(0))) & level(i)).alias("used")))
        return bound(marked, lambda m: F.struct(
            F.transform(F.filter(m, lambda x: x["name"]), lambda x: F.struct(_cut(x["t"], r" \t\n.,;:()\[\]{}•·").alias("name"), x["level"].alias("level"))).cast(LANGUAGES).alias("languages"),
            F.when(F.exists(m, lambda x: x["name"]), F.array_join(F.transform(F.filter(m, lambda x: ~x["name"] & ~x["used"]), lambda x: x["t"]), " ")).otherwise(text_of(item)).alias("residual"),
        ))

    return bound(F.regexp_extract_all(text_of(item), F.lit(TOKEN), 0), of)


def certificate_like(item: Column) -> Column:
    """Whether an item names a certification and doesn't begin with a spoken language."""
    x = F.lower(F.trim(text_of(item)))
    first = _cut(F.get(F.split(x, r"\s+"), F.lit(0)), r"\t\n.,;:()\[\]{}•·")
    first = _cut(F.regexp_replace(first, r"[0-9]+[#+.]*$", ""), r"\t\n.,;:()\[\]{}•·")
    return x.rlike(_any_of(CERTIFICATES)) & ~first.isin(*SPOKEN)


def rescued(docs: DataFrame) -> DataFrame:
    """``docs`` (skills, languages, certifications) whose skills have no category of languages or certifications any more.

    Languages are those named in the items; what is left of such items goes to the first of the fixed technical categories that
    stands before it, else to a new one. Certifications are kept if they look like one, or are short and hold a mark of one; one per
    composed form whatever its case. Lists that hold nothing new stay as they are.
    """
    skills, given = _some(F.col("skills"), SKILLS), _some(F.col("languages"), LANGUAGES)
    certificates = _some(F.col("certifications"), STRINGS)
    kind = lambda s: fidelity(s["category"])
    spoken = F.transform(skills, lambda s: F.struct(s["category"].alias("category"), _some(s["items"], STRINGS).alias("items"), kind(s).alias("kind")))

    def step(a: Column, s: Column) -> Column:
        found = F.transform(s["items"], spoken_in)
        return bound(found, lambda f: F.when(s["kind"].isin(*LANGUAGE_CATEGORIES), hoist(a, f)).when(s["kind"].isin(*CERTIFICATE_CATEGORIES), state(a["skills"], a["languages"], F.concat(a["certificates"], s["items"]))).otherwise(
            state(F.concat(a["skills"], F.array(F.struct(s["category"].alias("category"), s["items"].alias("items"))).cast(SKILLS)), a["languages"], a["certificates"])))

    def state(skills: Column, languages: Column, certificates: Column) -> Column:
        return F.struct(skills.cast(SKILLS).alias("skills"), languages.cast(LANGUAGES).alias("languages"), certificates.cast(STRINGS).alias("certificates"))

    def hoist(a: Column, found: Column) -> Column:
        names = F.concat(a["languages"], F.flatten(F.transform(found, lambda x: x["languages"])))
        left = F.filter(F.transform(found, lambda x: x["residual"]), lambda x: x != "")
        places = F.filter(F.array(*map(F.lit, RELOCATED)), lambda c: F.exists(a["skills"], lambda s: s["category"] == c))
        to = F.get(places, F.lit(0))
        first = F.array_position(F.transform(a["skills"], lambda s: s["category"] == to), True) - 1
        put = F.transform(a["skills"], lambda s, i: F.struct(s["category"].alias("category"), F.when(i == first, F.concat(s["items"], F.array_except(left, s["items"]))).otherwise(s["items"]).alias("items")))
        new = F.concat(a["skills"], F.array(F.struct(F.lit(RELOCATED[0]).alias("category"), left.alias("items"))).cast(SKILLS))
        return state(F.when(F.size(left) == 0, a["skills"]).when(F.size(places) > 0, put.cast(SKILLS)).otherwise(new), names, a["certificates"])

    none = state(F.array(), F.array(), F.array())
    folded = F.aggregate(spoken, none, step)

    def finish(x: Column) -> Column:
        key = lambda l: F.struct(F.lower(F.trim(text_of(l["name"]))).alias("n"), F.lower(F.trim(text_of(l["level"]))).alias("l"))
        held = F.transform(given, key)
        new = F.filter(first_by(x["languages"], key), lambda l: ~F.array_contains(held, key(l)))
        taken = F.transform(certificates, lambda c: F.lower(F.trim(text_of(c))))
        fresh = first_by(F.filter(F.transform(x["certificates"], lambda c: F.trim(text_of(c))), lambda c: c != ""), composed)
        short = lambda c: (F.length(c) <= LONGEST_CERTIFICATE) & F.lower(c).rlike(_any_of(SHORT_CERTIFICATES))
        kept = F.filter(fresh, lambda c: ~F.array_contains(taken, composed(c)) & (certificate_like(c) | short(c)))
        every = F.filter(F.transform(F.concat(certificates, kept), lambda c: F.trim(text_of(c))), lambda c: composed(c) != "")
        return F.struct(x["skills"].alias("skills"), F.concat(given.cast(LANGUAGES), new).alias("languages"), first_by(every, composed).alias("certificates"))

    fold, found = unused(docs, "fold", "found")
    d = docs.withColumn(fold, folded).withColumn(found, finish(F.col(fold)))
    return d.withColumns({"skills": F.col(found)["skills"], "languages": F.col(found)["languages"], "certifications": F.col(found)["certificates"]}).drop(fold, found)


def composed(c: Column) -> Column:
    """The key of a certification: compatibility characters composed (NFKC), squeezed, lower case."""
    return F.lower(squeezed(compatible(text_of(c))))


# Technical environments and syntheses.


def technical_terms(items: Column) -> Column:
    """Terms between commas, bars and slashes, the first of each whatever its case, by family: ``A: x, y | B: z``; unsorted ones last, empty without terms."""
    cut = F.filter(F.transform(F.flatten(F.transform(items, lambda x: F.split(x, "[,|/]"))), lambda x: _cut(x, r" •\t")), lambda x: x != "")

    def of(x: Column) -> Column:
        out = F.lit(UNSORTED)
        for name, words in reversed(ENVIRONMENTS):
            out = F.when(F.lower(x).rlike(_any_of(words)), name).otherwise(out)
        return out

    def rendered(terms: Column) -> Column:
        lists = [(n, F.array_join(F.transform(F.filter(terms, lambda x: x["family"] == n), lambda x: x["term"]), ", ")) for n, _ in (*ENVIRONMENTS, (UNSORTED, ()))]
        return F.array_join(F.filter(F.array(*[F.when(x != "", F.concat(F.lit(f"{n}: "), x)).otherwise("") for n, x in lists]), lambda x: x != ""), " | ")

    return bound(F.transform(first_by(cut, F.lower), lambda x: F.struct(of(x).alias("family"), x.alias("term"))), rendered)
