"""Structured documents against their sources: contacts in nested values, gates, entities, facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import contains_fact, fidelity, squeezed, substantial_tokens, text_of, word
from quillspark.operators.sanitize import CONTACTS

# Detectors in the order in which the first one names a string, and the letters of acronyms.
DETECTORS = {
    "email": CONTACTS["email"],
    "phone_fr": r"(?<![0-9])(?:\+33\s?|0[67])(?:[ .\-]?[0-9]{2}){4}\b",
    "linkedin_profile": r"(?i)(?:https?://)?(?:www\.)?(?:[a-z]{2}\.)?linkedin\.com/\S+|lnkd\.in/\S+",
    "github_profile": r"(?i)\bgithub\.com/\S+",
    "url": r"(?i)https?://\S+|www\.\S+|\b(?:[a-z0-9-]+\.)+(?:com|fr|net|org|io|ai|dev|co)\b(?:/\S*)?",
}
LINKEDIN = r"(?i)\b(?:[a-z]{2}\.)?linkedin(?:\.com)?(?:/\S*)?\b|\blinkedin\b"
CONTACT_LABEL = r"(?iu)(?<![\p{L}\p{N}_])(?:coordonn[ée]es?|contact|t[ée]l(?:[ée]phone)?|email|mail|e-mail|linkedin|site\s+web)(?![\p{L}\p{N}_])\s*:?"
# Words before .NET that make it a technology, not a domain.
DOTNET = ("api", "application", "applications", "asp", "c#", "dot", "framework", "mvc", "react", "stack", "web")
CAPITALS = "A-ZÉÈÀÂÊÎÔÛÄËÏÖÜÇ"
ACRONYM = rf"(?<![\p{{L}}\p{{N}}_])[{CAPITALS}]{{2,}}(?![\p{{L}}\p{{N}}_])"
TITLE_RUN = rf"(?<![\p{{L}}\p{{N}}_])(?:[{CAPITALS}][A-Za-zÀ-ÿ]+\s+)+[{CAPITALS}A-Za-zÀ-ÿ]{{2,}}(?![\p{{L}}\p{{N}}_])"
LOCATION = r"(?iu)(?:📌|(?<![\p{L}])(?:lieu|localisation)\s*[:\-])\s*([^\n|•]+?\(\s*[0-9]{2,3}\s*\))"

# First words of headings, in order.
HEADINGS = (
    ("profile", "profil|résumé|resume|summary|présentation|a propos|à propos"),
    ("skills", "comp[ée]tences|skills|expertises|technologies|environnements? techniques?"),
    ("education", "formations?|formation académique|dipl[oô]mes?|certifications?"),
    ("experience", "exp[ée]riences?|exp[ée]riences? professionnelles?|parcours professionnel|missions?"),
)
MONTHS = "janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
ROLE_WORDS = r"cdi|cdd|freelance|stage|consultant|consultante|développeur|developpeur|engineer|lead|tech\s*lead|business\s*analyst|rpa|chef\s+de\s+projet"
SKILLS_START = r"(?iu)^comp[ée]tences(?:\s+techniques?)?$"
SKILLS_STOP = r"(?iu)^(?:exp[ée]riences?|parcours|missions?|formations?|dipl[oô]mes?|certifications?|langues?|centres?\s+d['’]int[ée]r[êe]t|loisirs?|projets?|r[ée]alisations?|coordonn[ée]es?|contact)(?![\p{L}\p{N}_])"


# Ranges of dates, marks of a degree, headings whose content is looked for, and where a section ends.
DATE_RANGE = r"(?iu)(?:[0-9]{2}/[0-9]{4}|[0-9]{4})\s*(?:[-–—]|à|a|au|to)\s*(?:[0-9]{2}/[0-9]{4}|[0-9]{4}|aujourd|présent|present|ce\s+jour)"
DEGREE = r"bachelor|master|mast[eè]re|licence|dut|bts|mba|doctorat|ing[eé]nieur|dipl[oô]me|certificat|certification|formation|titre\s+professionnel|universit[ée]|école|ecole|school|campus|institute|institut|academy"

DOCUMENT = (
    "name string, title string, formations array<struct<date:string,degree:string,school:string>>, skills array<struct<category:string,items:array<string>>>,"
    " experiences array<struct<date:string,role:string,sections:array<struct<heading:string,content:array<string>>>>>"
)


def strings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, path, value of every string of a structured document (columns as in ``DOCUMENT``)."""
    path = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    entry = lambda p, v: F.struct(p.alias("path"), v.alias("value"))
    flat = F.array(entry(F.lit("name"), F.col("name")), entry(F.lit("title"), F.col("title")))
    formations = F.flatten(F.transform("formations", lambda x, i: F.array(*[entry(path("formations[", i, f"].{f}"), x[f]) for f in ("date", "degree", "school")])))  # noqa: B023
    skills = F.flatten(F.transform("skills", lambda s, i: F.concat(F.array(entry(path("skills[", i, "].category"), s["category"])), F.transform(s["items"], lambda v, k: entry(path("skills[", i, "].items[", k, "]"), v)))))
    experiences = F.flatten(
        F.transform(
            "experiences",
            lambda e, i: F.concat(
                F.array(*[entry(path("experiences[", i, f"].{f}"), e[f]) for f in ("date", "role", "company_highlight") if f in fields(docs, "experiences")]),
                F.flatten(
                    F.transform(
                        e["sections"],
                        lambda s, k: F.concat(
                            F.array(entry(path("experiences[", i, "].sections[", k, "].heading"), s["heading"])),
                            F.transform(s["content"], lambda v, j: entry(path("experiences[", i, "].sections[", k, "].content[", j, "]"), v)),
                        ),
                    )
                ),
            ),
        )
    )
    none = F.array().cast("array<struct<path:string,value:string>>")
    every = F.concat(flat, *[F.coalesce(c, none) for c in (formations, skills, experiences)])
    return docs.select(key, F.explode(every).alias("x")).select(key, "x.path", "x.value").where("value is not null")


def dotnet(match: Column) -> Column:
    """Whether a match of the web address pattern is a technology name such as React.NET."""
    token = F.regexp_replace(F.trim(match), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")
    name = F.lower(F.regexp_replace(token, r"(?i)\.net$", ""))
    bare = ~(F.lower(token).contains("://") | F.lower(token).startswith("www.") | token.contains("/"))
    return F.lower(token).endswith(".net") & bare & name.isin(*DOTNET)


def contact_category(value: Column) -> Column:
    """The first detector that finds something; technology names that end with .NET are no web addresses."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(DETECTORS.items()):
        hit = value.rlike(pattern)
        if name == "url":
            hit &= F.exists(F.regexp_extract_all(value, F.lit(pattern), 0), lambda m: ~dotnet(m))
        out = F.when(hit, name).otherwise(out)
    return out


def _tidied(text: Column) -> Column:
    for pattern, to in ((r"\(\s*\)", ""), (r"\s+([,;:])", "$1"), (r"\s+\.(?!\s*(?:NET|Net|net)\b)", "."), (r"(?:\s*[-–—|•]\s*){2,}", " - "), (r"^[\s,;:|•\-–—]+|[\s,;:|•\-–—]+$", "")):
        text = F.regexp_replace(text, pattern, to)
    return squeezed(text)


def without_contacts(value: Column) -> Column:
    """A string without e-mails, numbers, profiles, web addresses and their labels, its punctuation tidied; a lone label of a removed contact becomes ``Contact``."""
    had = value.rlike(DETECTORS["email"]) | value.rlike(DETECTORS["phone_fr"])
    left = value
    for pattern in (DETECTORS["email"], DETECTORS["phone_fr"], LINKEDIN, DETECTORS["github_profile"]):
        left = F.regexp_replace(left, pattern, "")
    # Technology names are set apart by a private mark, so that the address pattern doesn't see their dot.
    names = "|".join(n.replace("#", r"\#") for n in DOTNET)
    left = F.regexp_replace(left, rf"(?i)(?<![A-Za-z0-9.#-])({names})\.(net)(?![\w/])", "$1\uf8ff$2")
    left = F.regexp_replace(F.regexp_replace(left, DETECTORS["url"], ""), "\uf8ff", ".")
    plain = F.regexp_replace(F.regexp_replace(left, CONTACT_LABEL, ""), r"(?i)\(\s*(?:site\s+web|linkedin|contact)\s*\)", "")
    return F.when(had & squeezed(left).rlike(r"(?i)^contact\s*:?,?$"), "Contact").otherwise(_tidied(plain))


def _mapped(docs: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """A structured document with each string changed; entries of arrays that this empties are dropped, sections and their contents stay."""
    some = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    texts = lambda a: F.filter(F.transform(a, change), some)

    def parts(c: str, x: Column, names: tuple[str, ...]) -> list[Column]:
        return [change(x[n]).alias(n) for n in names if n in fields(docs, c)]

    formation = lambda x: F.struct(*parts("formations", x, ("date", "degree", "school")))
    skill = lambda s: F.struct(change(s["category"]).alias("category"), texts(s["items"]).alias("items"))
    section = lambda s: F.struct(change(s["heading"]).alias("heading"), texts(s["content"]).alias("content"))
    experience = lambda e: F.struct(*parts("experiences", e, ("date", "role", "company_highlight")), F.transform(e["sections"], section).alias("sections"))
    d = docs.withColumns({"name": change(F.col("name")), "title": change(F.col("title"))})
    d = d.withColumn("formations", F.filter(F.transform("formations", formation), lambda x: some(x["date"]) | some(x["degree"]) | some(x["school"])))
    d = d.withColumn("skills", F.filter(F.transform("skills", skill), lambda s: some(s["category"]) | (F.size(s["items"]) > 0)))
    return d.withColumn("experiences", F.transform("experiences", experience))


def fields(docs: DataFrame, column: str) -> list[str]:
    """Names of the fields of an array of structs."""
    return docs.schema[column].dataType.elementType.names


def sanitised_document(docs: DataFrame) -> DataFrame:
    """A structured document without contacts in any string, and without what is then empty."""
    return _mapped(docs, without_contacts)


def without_identity(docs: DataFrame, terms: str = "forbidden") -> DataFrame:
    """A structured document without the whole words of the array column ``terms`` in any string, and without what is then empty."""
    return _mapped(docs, lambda c: F.when(F.size(F.col(terms)) > 0, _tidied(without_terms(c, F.col(terms)))).otherwise(c))


def contacts_in(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, categories, paths of documents with a contact; never a value."""
    hits = strings(docs, key).withColumn("category", contact_category(F.col("value"))).where("category is not null")
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("path")).alias("paths"))


def without_terms(text: Column, terms: Column) -> Column:
    """Whole-word terms removed whatever their case, the longest first; the pattern follows from each row's own terms."""
    quoted = F.transform(F.reverse(F.array_sort(F.transform(terms, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))), lambda x: F.concat(F.lit(r"\Q"), x["t"], F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    return F.when(F.size(terms) > 0, squeezed(F.regexp_replace(text, pattern, F.lit("")))).otherwise(text)


def holds_term(normal: Column, terms: Column) -> Column:
    """Whether a normalised text holds a normalised term as whole words."""
    return F.exists(terms, lambda t: (t != "") & F.concat(F.lit(" "), normal, F.lit(" ")).contains(F.concat(F.lit(" "), t, F.lit(" "))))


def high_risk(value: Column) -> Column:
    """Numbers, per cents and acronyms need a source."""
    return text_of(value).rlike("[0-9%]") | text_of(value).rlike(ACRONYM)


def gated(items: Column, source: Column, only_risky: bool = False) -> Column:
    """Items that the normalised source contains; those without risk pass too if ``only_risky``."""
    backed = lambda x: contains_fact(source, fidelity(x))
    return F.filter(items, lambda x: (F.trim(x) != "") & ((~high_risk(x) | backed(x)) if only_risky else backed(x)))


def gated_skills(docs: DataFrame, source: str = "source") -> DataFrame:
    """Skills with the items that the source holds, categories without any dropped; as they are if the source is empty."""
    d = docs.withColumn("_source", fidelity(F.col(source)))
    kept = F.filter(F.transform("skills", lambda s: F.struct(s["category"].alias("category"), gated(s["items"], F.col("_source")).alias("items"))), lambda s: F.size(s["items"]) > 0)
    return d.withColumn("skills", F.when(F.col("_source") == "", F.col("skills")).otherwise(kept)).drop("_source")


def gated_experiences(docs: DataFrame, source: str = "source") -> DataFrame:
    """Risky bullets that the source doesn't hold are dropped, and sections that this empties."""
    d = docs.withColumn("_source", fidelity(F.col(source)))
    sections = lambda e: F.filter(F.transform(e["sections"], lambda s: F.struct(s["heading"].alias("heading"), gated(s["content"], F.col("_source"), True).alias("content"))), lambda s: F.size(s["content"]) > 0)
    kept = F.transform("experiences", lambda e: F.struct(e["date"].alias("date"), e["role"].alias("role"), sections(e).alias("sections")))
    return d.withColumn("experiences", F.when(F.col("_source") == "", F.col("experiences")).otherwise(kept)).drop("_source")


def locations(text: Column) -> Column:
    """Places with a department number after a pin or a label."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(text), F.lit(LOCATION), 1), squeezed))


def entities(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Fragments with an acronym or a run of capitalised words, without continuation marks and stop words; in order, distinct."""
    pieces = F.filter(F.transform(F.split(text_of(text), r"[\n|,•–—]"), lambda x: F.regexp_replace(squeezed(x), r"^[ .;:\-\t]+|[ .;:\-\t]+$", "")), lambda x: F.length(x) >= 4)

    def sensitive(x: Column) -> Column:
        n = fidelity(x)
        known = F.forall(F.split(n, " "), lambda t: t.isin(*stop)) if stop else F.lit(False)
        return ~n.endswith(" suite") & (n != "") & ~known & (x.rlike(ACRONYM) | x.rlike(TITLE_RUN))

    return F.array_distinct(F.filter(pieces, sensitive))


def role_fragments(role: Column) -> Column:
    """Parts of a role with at least four letters and two substantial tokens or an acronym."""
    parts = F.transform(F.split(text_of(role), r"(?i)\||\n|\s+chez\s+"), lambda x: F.regexp_replace(x, r"^[ \-–—•\t.;:]+|[ \-–—•\t.;:]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 4) & ((F.size(substantial_tokens(fidelity(x))) >= 2) | x.rlike(ACRONYM))))


def experience_like(formation: Column) -> Column:
    """A formation that is an experience: a range of dates and a role word, and no mark of a degree or school."""
    of = lambda n: F.trim(text_of(formation[n]))
    whole = F.concat_ws(" ", of("date"), of("degree"), of("school"))
    return of("date").rlike(DATE_RANGE) & whole.rlike(word(ROLE_WORDS)) & ~F.concat_ws(" ", of("degree"), of("school")).rlike(word(DEGREE))


def has_body(experience: Column) -> Column:
    """Whether a section of an experience has a heading or content."""
    text = lambda c: F.trim(text_of(c)) != ""
    return F.coalesce(F.exists(experience["sections"], lambda s: text(s["heading"]) | F.coalesce(F.exists(s["content"], text), F.lit(False))), F.lit(False))


def integrity_codes() -> Column:
    """Array of (code, place) of the structural faults of a document's formations and experiences, in order; places count from 1."""
    text = lambda c: F.trim(text_of(c))
    issue = lambda when, code, i: F.when(when, F.struct(F.lit(code).alias("code"), (i + 1).cast("string").alias("place")))

    def formation(f: Column, i: Column) -> Column:
        stub = (text(f["date"]) != "") & (text(f["degree"]) == "") & (text(f["school"]) == "")
        return F.array(issue(experience_like(f), "experience_misclassified_as_formation", i), issue(~experience_like(f) & stub, "empty_formation_stub", i))

    def experience(e: Column, i: Column) -> Column:
        dated, named, body = text(e["date"]) != "", text(e["role"]) != "", has_body(e)
        lone = (F.size("experiences") > 1) & (dated | named) & ~body & (fidelity(e["role"]) != "projets academiques")
        return F.array(issue(body & ~dated & ~named, "headerless_experience_sections", i), issue(lone, "experience_header_without_body", i), issue(dated & ~named & ~body, "empty_experience_date_stub", i))

    none = F.array().cast("array<struct<code:string,place:string>>")
    found = [F.coalesce(F.flatten(F.transform(c, f)), none) for c, f in (("formations", formation), ("experiences", experience))]
    return F.array_compact(F.concat(*found))


def integrity_issues(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, code, place of structural faults of a document that would break its layout."""
    return docs.select(key, F.explode(integrity_codes()).alias("x")).select(key, "x.code", "x.place")


def skills_lines(text: Column, start: str | None = None, stop: str | None = None) -> Column:
    """Lines with text after the first skills heading, up to the next other heading once a line is there."""
    lines = F.filter(F.transform(F.split(text_of(text), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    start, stop = start or SKILLS_START, stop or SKILLS_STOP
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        ends = (a["at"] == 1) & (F.size(a["out"]) > 0) & x.rlike(stop)
        at = F.when((a["at"] == 0) & x.rlike(start), 1).when(ends, 2).otherwise(a["at"])
        return F.struct(at.alias("at"), F.when((a["at"] == 1) & ~ends, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    return F.aggregate(lines, state, step, lambda a: a["out"])


def arrow_items(lines: Column) -> Column:
    """Lines joined into items: one that begins with a bullet opens an item, also if it holds the bullet alone."""
    bullet = r"^[➢>•\-–—]+\s*"
    state = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))
    flushed = lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"])

    def step(a: Column, raw: Column) -> Column:
        x = squeezed(raw)
        opens = x.rlike(bullet)
        rest = F.regexp_replace(x, bullet, "")
        return F.struct(F.when(opens, rest).otherwise(F.trim(F.concat_ws(" ", a["held"], x))).alias("held"), F.when(opens, flushed(a)).otherwise(a["out"]).alias("out"))

    return F.aggregate(lines, state, step, flushed)


def prefixed(item: Column, prefixes: dict[str, str]) -> tuple[Column, Column]:
    """Category and rest of ``prefix: rest`` by the first pattern that the prefix matches; null and the item otherwise."""
    head, rest = F.regexp_extract(item, r"^([^:：]{3,80}?)\s*[:：]\s*(.+)$", 1), F.regexp_extract(item, r"^([^:：]{3,80}?)\s*[:：]\s*(.+)$", 2)
    category = F.lit(None).cast("string")
    for pattern, name in reversed(prefixes.items()):
        category = F.when((head != "") & head.rlike(rf"(?iu)^(?:{pattern})(?![\p{{L}}\p{{N}}_])"), name).otherwise(category)
    return category, F.when(category.isNotNull(), rest).otherwise(item)


def heading_kind(line: Column) -> Column:
    """profile, skills, education or experience for a line that looks like a heading, else null."""
    # The words of a heading stand in the first characters; whether the line is short enough is asked only where they do.
    head = lambda b: F.substring(b, 1, 64)
    every = "|".join(names for _, names in HEADINGS)

    def of(raw: Column, bare: Column) -> Column:
        words = F.regexp_count(bare, F.lit(r"[\p{L}\p{N}_]+"))
        fits = ~raw.rlike(r":\s*\S") & ((words <= 4) | ((F.upper(bare) == bare) & (words <= 8)))
        out = F.lit(None).cast("string")
        for kind, names in reversed(HEADINGS):
            out = F.when(head(bare).rlike(rf"(?iu)^(?:{names})(?![\p{{L}}\p{{N}}_])"), kind).otherwise(out)
        return F.when((raw != "") & head(bare).rlike(rf"(?iu)^(?:{every})") & fits, out)

    return bound(F.btrim(text_of(line), F.lit(" •-–—")), lambda raw: bound(F.trim(F.btrim(raw, F.lit(":"))), lambda bare: of(raw, bare)))


def experience_start(line: Column) -> Column:
    """A date at the start, a role word or a word of three capitals, and a range, a month with its year or a year with text; a bare year isn't enough."""
    x = F.trim(text_of(line))
    starts = x.rlike(rf"(?iu)^(?:(?:[0-9]{{2}}/[0-9]{{4}}|[0-9]{{4}})\s*(?:[-–—]|à|a|au|to)\s*(?:[0-9]{{2}}/[0-9]{{4}}|[0-9]{{4}}|aujourd|présent|present|ce\s+jour)|(?:{MONTHS})\s+[0-9]{{4}}|[0-9]{{4}}(?![\p{{L}}\p{{N}}_]).+)(?:(?<=[\p{{L}}\p{{N}}_])(?![\p{{L}}\p{{N}}_])|(?<![\p{{L}}\p{{N}}_])(?=[\p{{L}}\p{{N}}_]))")
    who = x.rlike(word(ROLE_WORDS)) | x.rlike(rf"(?<![\p{{L}}\p{{N}}_])[{CAPITALS}]{{3,}}(?![\p{{L}}\p{{N}}_])")
    when = x.rlike(DATE_RANGE) | x.rlike(rf"(?iu)^(?:{MONTHS})\s+[0-9]{{4}}") | x.rlike(r"^(?:19|20)[0-9]{2}(?![\p{L}\p{N}_]).+")
    dated = F.substring(x, 1, 9).rlike(rf"(?iu)^(?:[0-9]|{MONTHS})")  # most lines end here
    return dated & starts & who & when  # a role word or capitals make it more than a year
