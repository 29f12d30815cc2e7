"""Is a structured document faithful to its source: facts of the source's sections, and issues with codes and severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import compact, contains_fact, contains_strictly, fidelity, fidelity_each, squeezed, text_of, word, year_tokens
from quillspark.operators.coverage import placeholders, severity
from quillspark.operators.structured import entities, experience_start, holds_term, integrity_codes, locations, role_fragments, strings

# Headings of valued sections by their folded form, what is one, what ends one, and the headings of an experience.
SECTIONS = {
    "exemples de realisations professionnelles": "Exemples de réalisations professionnelles", "realisations professionnelles": "Réalisations professionnelles", "realisations": "Réalisations",
    "projets": "Projets", "projets significatifs": "Projets significatifs", "certifications": "Certifications", "competences": "Compétences", "competences techniques": "Compétences techniques",
    "competences et outils": "Compétences et outils", "langues": "Langues", "languages": "Langues", "autres": "Autres",
}
SECTION = r"(?iu)^(?:(?:exemples?\s+de\s+)?r[ée]alisations?(?:\s+professionnelles?)?|projets?(?:\s+significatifs?)?|certifications?|comp[ée]tences?(?:\s+(?:techniques?|et\s+outils?))?|lang(?:ues|uages)|autres)$"
BOUNDARY = r"(?iu)^(?:processus\s+m[ée]tiers|loisirs?|formations?|dipl[oô]mes?|exp[ée]riences?|parcours|mots[-\s]?cl[ée]s?|contact|coordonn[ée]es?)(?![\p{L}\p{N}_])"
EXPERIENCE_HEADING = r"(?iu)^(?:missions?(?:\s+cl[ée]s?)?|responsabilit[ée]s?|r[ée]alisations?|livrables?(?:\s+cl[ée]s?)?|activit[ée]s?|t[âa]ches?)\s*:?$"
#: What a line begins with if it's a heading of an experience.
HEADING_BEGINS = r"(?iu)^[ :•✓\-–—\t]*+(?:mission|responsabilit|r[ée]alisation|livrable|activit|t[âa]che)"
EXCLUDED = r"(?iu)@|linkedin|github\.com|https?://|\+33|\b0[67](?:[ .-]?[0-9]{2}){4}\b|rue|avenue|boulevard|impasse|all[ée]e|\b[0-9]{5}\b|cv envoyé par hellowork|données personnelles|donnees personnelles"
VALUED = ("realisations", "realisations professionnelles", "exemples de realisations professionnelles", "projets", "projets significatifs", "certifications", "competences", "competences techniques", "competences et outils", "langues", "languages")
MIXED, BUSINESS = "autres", "projet|realisation|certification|formation|langue|anglais|espagnol|allemand|italien|java|python|react|angular|node|aws|azure|gcp|docker|kubernetes|sql|agile|agiles|scrum|itil|erp|crm|si|rpa|api|devops|cloud|data|bi|cyber|management|pilotage|moa|moe|recette|migration|deploiement|déploiement"
LEAST_FACT, LEAST_ITEM, LEAST_LOOKUP = 12, 18, 20
#: Lines whose folded form may be that of a section: they begin with its first word or a page's mark, or need folding to tell.
MAYBE = r"(?i)[^\x00-\x7F]|^[^a-z0-9+#]*(?:exemples|realisations|projets|certifications|competences|langu|autres|page)"
#: No heading's pattern matches longer lines.
LONGEST_HEADING = 80
#: So many plain letters before any digit stay when a line is folded, but for the start of a page's mark: more than a section's name has.
TOO_LONG = r"^(?:[^A-Za-z\p{N}\p{So}]*+[A-Za-z]){60}"
#: Parts of which excluded lines hold one in lower case, or a character of the class: digits, marks, and what equals a plain letter but for its case.
TELLTALES, TELLTALE = ("ue", "linkedin", "github.com", "http", "boulevard", "impasse", "all", "hellowork", "personnelles"), r"[@+0-9\u017F\u0130\u0131\u212A]"
FALLBACK_TITLES = ("consultant it", "consultant", "dev", "developpeur")
TECHNICAL = ("environnement technique", "environnements techniques", "stack technique", "stacks techniques", "technologies")
SYNTHESIS = "synthese"
ENTITY_STOP = ("cv", "profil", "competences", "experiences", "formations", "missions", "mission", "cles", "environnement", "technique", "consultant", "consultante", "chef", "projet", "developpeur", "architecte")

ITEMS = "array<struct<section:string,fact:string>>"
ISSUE = "array<struct<code:string,place:string,fact:string>>"


def _cut(c: Column, marks: str) -> Column:
    """A text without the given characters at its ends."""
    return F.btrim(c, F.lit(marks))


_ENDS, _COLON = " •✓-–—\t", " :•✓-–—\t"


def _single_spaced(line: Column) -> Column:
    """``squeezed`` for a line that isn't null: most hold nothing but single spaces and pass as they are."""
    return bound(line, lambda x: F.trim(F.when(x.rlike(r"[\t\n\x0b\f\r]|  "), F.regexp_replace(x, r"\s+", " ")).otherwise(x)))


def section_name(line: Column) -> Column:
    """The name of a valued section for a line that is its heading, else null."""
    x = squeezed(_cut(line, _COLON))
    return _named(x, fidelity(x))


def _named(x: Column, folded: Column) -> Column:
    """The same for a line that is cut and squeezed, and its folded form."""
    known = F.create_map(*[F.lit(v) for kv in SECTIONS.items() for v in kv])
    spelled = F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 999))
    return F.coalesce(F.try_element_at(known, folded), F.when((F.length(x) <= LONGEST_HEADING) & x.rlike(SECTION), spelled))


def inline_section(line: Column) -> Column:
    """Struct of the section that a line opens (null if none) and the value after its colon."""
    x = squeezed(_cut(line, _ENDS))
    split = r"^([^:：]{3,80})\s*[:：]\s*(.*)$"
    has = x.rlike(split)
    return F.struct(F.when(has, section_name(F.regexp_extract(x, split, 1))).otherwise(section_name(x)).alias("section"), F.when(has, F.trim(F.regexp_extract(x, split, 2))).otherwise("").alias("value"))


def boundary(line: Column) -> Column:
    """Whether a line starts another section, an experience or a heading within one."""
    x = squeezed(_cut(line, _COLON))
    return (x != "") & (x.rlike(BOUNDARY) | section_name(x).isNotNull() | inline_section(x)["section"].isNotNull() | experience_start(x) | x.rlike(EXPERIENCE_HEADING))


def excluded(line: Column) -> Column:
    """Contact data, addresses and notices, which no coverage rule asks for; empty lines too."""

    def maybe(x: Column) -> Column:
        low = lambda y: reduce(lambda a, b: a | b, [y.contains(t) for t in TELLTALES])
        return x.rlike(TELLTALE) | bound(F.lower(x), low)

    # The pattern tries all of its alternatives at every character, so few lines get to it.
    return (F.trim(line) == "") | (maybe(line) & line.rlike(EXCLUDED))


def relevant(section: Column, fact: Column) -> Column:
    """Facts of valued sections count; those of mixed ones only with a business word."""
    s, f = fidelity(section), fidelity(fact)
    return (f != "") & (s.isin(*VALUED) | ((s == MIXED) & f.rlike(word(BUSINESS))))


def _folds_to(fact: Column, least: int) -> Column:
    """Whether the folded form has at least so many characters. Plain letters before any digit stay, but for four that may begin a page's mark."""
    plain = fact.rlike(rf"^(?:[^A-Za-z+#\p{{N}}\p{{So}}]*+[A-Za-z+#]){{{least + 4}}}")
    return F.when(plain, F.lit(True)).otherwise(F.length(fidelity(fact)) >= least)


def _may_name(x: Column) -> Column:
    """Whether the folded form of a text may be the name of a section."""
    return ((F.length(x) <= LONGEST_HEADING) | ~x.rlike(TOO_LONG)) & x.rlike(MAYBE)


def _opens(line: Column) -> Column:
    """Whether a trimmed line opens an item: a bullet and something after it."""
    return F.substring(line, 1, 1).isin("✓", "•", "-", "*") & (F.length(line) > 1)


def _body(line: Column) -> Column:
    return F.when(line == ":", "").otherwise(_cut(line, "✓•-* "))


def _lines(text: Column) -> Column:
    return F.transform(F.split(compact(text), "\n"), lambda x: F.trim(x))


def _experience_heading(line: Column) -> Column:
    """The heading within an experience that a trimmed line is, else null. The words that they begin with are asked for first."""
    return bound(F.when(line.rlike(HEADING_BEGINS), _single_spaced(_cut(line, _COLON))), lambda x: F.when((F.length(x) <= LONGEST_HEADING) & x.rlike(EXPERIENCE_HEADING), x))


def _ends(line: Column) -> Column:
    """``boundary`` of a trimmed line that is no heading within an experience; what needs folding is asked last."""
    split = r"^([^:：]{3,80})\s*[:：]"
    named = lambda x: _named(x, F.when(_may_name(x), fidelity(x)).otherwise("")).isNotNull()

    def of(plain: Column) -> Column:
        inline = bound(_single_spaced(_cut(line, _ENDS)), lambda x: F.when((x.contains(":") | x.contains("：")) & x.rlike(split), F.regexp_extract(x, split, 1)).otherwise(x))
        both = F.array_distinct(F.array(plain, _single_spaced(_cut(inline, _COLON))))
        return (plain != "") & (F.substring(plain, 1, 32).rlike(BOUNDARY) | experience_start(plain) | F.exists(both, named))

    return bound(_single_spaced(_cut(line, _COLON)), of)


def _marked(text: Column) -> Column:
    """Of each line: itself, whether it opens an item or ends a section, the section that it opens and its value, and its text without bullets (whether that's excluded is asked only within a section).

    Lines and what stands before their colon are folded in two strokes for the whole text, and only where they can be the heading of a section. Each
    array is bound before the next is made of it: one that isn't is made again for every use.
    """
    split = r"^([^:：]{3,80})\s*[:：]\s*(.*)$"
    short = lambda a: F.transform(a, lambda x: F.when(_may_name(x), x).otherwise(""))

    def of(own: Column) -> Column:
        cuts = F.transform(own, lambda x: F.struct(x.alias("line"), _cut(x, "✓•-* ").alias("bare"), _single_spaced(_cut(x, _COLON)).alias("plain"), _single_spaced(_cut(x, _ENDS)).alias("inline")))
        return bound(cuts, headed)

    def headed(c: Column) -> Column:
        def parts(x: Column) -> Column:
            colon = (x["inline"].contains(":") | x["inline"].contains("：")) & x["inline"].rlike(split)
            head = F.when(colon, F.regexp_extract(x["inline"], split, 1)).otherwise(x["inline"])
            return F.struct(_single_spaced(_cut(head, _COLON)).alias("head"), F.when(colon, F.trim(F.regexp_extract(x["inline"], split, 2))).otherwise("").alias("value"))

        return bound(F.transform(c, parts), lambda h: folded(c, h))

    def folded(c: Column, h: Column) -> Column:
        both = F.struct(short(F.transform(c, lambda x: x["plain"])).alias("plain"), short(F.transform(h, lambda x: x["head"])).alias("heads"))
        folds = lambda k: F.struct(fidelity_each(k["plain"]).alias("plain"), fidelity_each(k["heads"]).alias("heads"))
        return bound(bound(both, folds), lambda k: F.transform(c, lambda x, i: facts(x, F.get(h, i), F.get(k["plain"], i), F.get(k["heads"], i))))

    def facts(x: Column, head: Column, folded: Column, folded_head: Column) -> Column:
        plain = x["plain"]
        sections = F.struct(_named(head["head"], folded_head).alias("own"), _named(plain, folded).alias("whole"), ((F.length(plain) <= LONGEST_HEADING) & plain.rlike(EXPERIENCE_HEADING)).alias("heading"))

        def told(s: Column) -> Column:
            ends = (plain != "") & (s["own"].isNotNull() | s["whole"].isNotNull() | s["heading"] | F.substring(plain, 1, 32).rlike(BOUNDARY) | experience_start(plain))
            return F.struct(
                x["line"].alias("line"), _opens(x["line"]).alias("opens"), F.when(x["line"] == ":", "").otherwise(x["bare"]).alias("body"), s["own"].alias("section"),
                F.when(excluded(head["value"]), "").otherwise(head["value"]).alias("value"), ends.alias("ends"),
            )

        return bound(sections, told)

    return bound(_lines(text), of)


def _put(out: Column, section: Column, item: Column) -> Column:
    """The items found so far, and the one that ends now if there's any."""
    return F.when(section.isNotNull() & (item != ""), F.concat(out, F.array(F.struct(section.alias("section"), _cut(_single_spaced(item), _COLON).alias("fact"))))).otherwise(out)


_START = lambda: F.struct(F.lit(None).cast("string").alias("now"), F.lit("").alias("item"), F.array().cast(ITEMS).alias("out"))


def _state(now: Column, item: Column, out: Column) -> Column:
    return F.struct(now.cast("string").alias("now"), item.alias("item"), out.cast(ITEMS).alias("out"))


def business_facts(text: Column) -> Column:
    """Array of (section, fact) of a source's valued sections: inline values, bullets, and lines that go on; distinct, in order.

    A fold over the text's lines. A null text has none.
    """

    def step(a: Column, x: Column) -> Column:
        done = _put(a["out"], a["now"], a["item"])
        more = F.when(a["item"] == "", x["body"]).otherwise(F.concat_ws(" ", a["item"], x["body"]))
        return (
            F.when(x["line"] == "", a)
            .when(x["section"].isNotNull(), _state(x["section"], F.lit(""), _put(done, x["section"], x["value"])))
            .when(a["now"].isNotNull() & x["ends"], _state(F.lit(None), F.lit(""), done))
            .when(a["now"].isNull() | excluded(x["body"]), a)
            .when(x["opens"], _state(a["now"], x["body"], done))
            .otherwise(_state(a["now"], more, a["out"]))
        )

    found = F.aggregate(_marked(text), _START(), step, lambda a: _put(a["out"], a["now"], a["item"]))
    relevant_to = lambda x: bound(fidelity(x["section"]), lambda s: F.when(s.isin(*VALUED), F.lit(True)).when(s == MIXED, fidelity(x["fact"]).rlike(word(BUSINESS))).otherwise(False))
    keep = lambda x: ~excluded(x["fact"]) & _folds_to(x["fact"], LEAST_FACT) & relevant_to(x)
    return F.array_distinct(F.filter(found, keep))


def experience_items(text: Column) -> Column:
    """Array of (section: the heading within an experience, fact: an item under it), distinct, in order.

    A line opens an item if it has a bullet, if none is open, or if the open one ends a sentence and the line isn't
    its continuation (a small letter or a mark at its start). A null text has none.
    """
    goes_on = r"^(?:[a-zàâçéèêëîïôûùüÿñæœ]|[,;:.)])"
    closed = lambda c: F.substring(F.rtrim(c, F.lit(" \t\n\x0b\f\r")), -1, 1).isin(".", "!", "?", "…")

    def step(a: Column, line: Column, heading: Column) -> Column:
        done = _put(a["out"], a["now"], a["item"])
        within = lambda x: F.when(excluded(x), a).when(_opens(line) | (a["item"] == "") | (closed(a["item"]) & ~F.substring(x, 1, 1).rlike(goes_on)), _state(a["now"], x, done)).otherwise(_state(a["now"], F.concat_ws(" ", a["item"], x), a["out"]))
        return (
            F.when(line == "", _state(a["now"], F.lit(""), done))
            .when(heading.isNotNull(), _state(heading, F.lit(""), done))
            .when(a["now"].isNull(), a)
            .when(_ends(line), _state(F.lit(None), F.lit(""), done))
            .otherwise(bound(_body(line), within))
        )

    # Lines outside of experiences, most of a source, are only asked whether they're headings.
    found = F.aggregate(_lines(text), _START(), lambda a, x: bound(_experience_heading(x), lambda h: step(a, x, h)), lambda a: _put(a["out"], a["now"], a["item"]))
    return F.array_distinct(F.filter(found, lambda x: ~excluded(x["fact"]) & _folds_to(x["fact"], LEAST_ITEM)))


def section_of(facts: Column, item: Column) -> Column:
    """The section of the first fact that holds an item of at least 20 folded characters; null without."""
    n = fidelity(item)
    holds = lambda x: fidelity(x["fact"]).contains(n) | contains_fact(fidelity(x["fact"]), n)
    return F.when(F.length(n) >= LEAST_LOOKUP, F.get(F.filter(facts, holds), F.lit(0))["section"])


def full_name(name: Column) -> Column:
    """Two words with letters, where a first name alone is expected."""
    t = F.filter(F.split(F.trim(text_of(name)), r"\s+"), lambda x: x != "")
    letter = lambda i: F.coalesce(F.get(t, F.lit(i)).rlike("[A-Za-zÀ-ÿ]"), F.lit(False))
    return letter(0) & letter(1)


def technical_allowed(source: Column, heading: Column) -> Column:
    """Headings of technical environments need to stand in the folded source."""
    n = fidelity(heading)
    return ~n.isin(*TECHNICAL) | F.concat(F.lit(" "), source, F.lit(" ")).contains(F.concat(F.lit(" "), n, F.lit(" ")))


def required_facts(experiences: Column, highlights: bool = True) -> Column:
    """Distinct facts that a rendered document must show: dates, companies, parts of roles, contents; of at least four characters."""
    long = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: F.length(x) >= 4)

    def of(e: Column) -> Column:
        head = [text_of(e["date"])] + ([text_of(e["company_highlight"])] if highlights else [])
        contents = F.flatten(F.transform(e["sections"], lambda s: F.coalesce(s["content"], F.array().cast("array<string>"))))
        return F.concat(long(F.array(*head)), role_fragments(e["role"]), F.coalesce(long(contents), F.array().cast("array<string>")))

    return F.coalesce(F.array_distinct(F.flatten(F.transform(experiences, of))), F.array().cast("array<string>"))


def _absent(code: str, facts: Column, hay: Column, fact=lambda x: x, place=lambda x: F.lit("")) -> Column:
    """Issues for the facts that a folded text doesn't contain."""
    gone = F.filter(facts, lambda x: ~contains_fact(hay, fidelity(fact(x))))
    return F.transform(gone, lambda x: F.struct(F.lit(code).alias("code"), place(x).alias("place"), fact(x).alias("fact")))


def rendered_issues(docs: DataFrame, key: str = "doc_id", rendered: str = "rendered", source: str = "source", allowed: tuple[str, ...] = ()) -> DataFrame:
    """key, code, place, fact: a document's facts that its rendered text lacks, and entities there that the source lacks.

    Docs have the columns of a structured document, ``rendered`` and ``source``; rules that need the source are left out where it's empty.
    """
    names = docs.schema["experiences"].dataType.elementType.names
    d = docs.withColumn("_r", fidelity(F.col(rendered))).withColumn("_s", fidelity(F.col(source)))
    r, s, given = F.col("_r"), F.col("_s"), F.col("_s") != ""
    none = F.array().cast(ISSUE)
    where = lambda test, c: F.when(test, c).otherwise(none)
    found = [
        _absent("json_fact_missing_from_pdf", required_facts(F.col("experiences"), "company_highlight" in names), r),
        where(given, _absent("source_experience_location_missing_from_pdf", locations(F.col(source)), r)),
        where(given, _absent("source_coverage_missing_section", business_facts(F.col(source)), r, lambda x: x["fact"], lambda x: x["section"])),
        where(given, F.filter(_absent("pdf_fact_absent_from_source", entities(F.col(rendered), ENTITY_STOP), s), lambda x: ~x["fact"].isin(*allowed) if allowed else F.lit(True))),
    ]
    return d.select(key, F.explode(F.concat(*[f.cast(ISSUE) for f in found])).alias("x")).select(key, "x.*")


def issues(docs: DataFrame, key: str = "doc_id", source: str = "source", forbidden: str | None = None, synthesis: bool = False, brand: str = "") -> DataFrame:
    """key, code, place, fact, severity of every fault of a structured document against its source.

    Docs have the columns of a structured document (experiences with company_highlight), ``source`` and, if named, an
    array of forbidden identity terms. A code in neither list of severities is hard. With ``synthesis`` the rules that
    forbid shortening are left out; ``brand`` is a name whose syntheses they forbid besides those of missions. Documents repeated by key each report their own.
    """
    row = docs.withColumn("_row", F.monotonically_increasing_id())
    every = strings(row, "_row")
    whole = every.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"]), "\n").alias("_json"))
    d = row.join(whole, "_row", "left").withColumn("_s", fidelity(F.col(source))).withColumn("_j", fidelity(F.col("_json")))
    s, j, given = F.col("_s"), F.col("_j"), F.col("_s") != ""
    none = F.array().cast(ISSUE)
    where = lambda test, c: F.when(test, c.cast(ISSUE)).otherwise(none)
    one = lambda test, code, fact: F.when(test, F.array(F.struct(F.lit(code).alias("code"), F.lit("").alias("place"), fact.alias("fact")))).otherwise(none)
    title = F.trim(text_of(F.col("title")))
    faults = F.transform(integrity_codes(), lambda x: F.struct(x["code"].alias("code"), x["place"].alias("place"), F.lit("").alias("fact")))
    found = [
        faults,
        one(full_name(F.col("name")), "full_name_display", F.trim(text_of(F.col("name")))),
        one(given & (title != "") & ~contains_fact(s, fidelity(title)) & ~fidelity(title).isin(*FALLBACK_TITLES), "title_absent_from_source", title),
    ]
    if not synthesis:
        short = F.lit(False)
        for x in ("mission", *([brand] if brand else [])):
            short |= j.contains(F.concat(F.lit(f"{SYNTHESIS} "), fidelity(F.lit(x))))
        found.append(one(short, "unexpected_synthesis_section", F.lit("")))
        found.append(where(given, _absent("experience_location_missing_from_json", locations(F.col(source)), j)))
        found.append(where(given, _absent("source_coverage_missing_section", business_facts(F.col(source)), j, lambda x: x["fact"], lambda x: x["section"])))
        found.append(where(given, _absent("source_coverage_missing_experience_item", experience_items(F.col(source)), j, lambda x: x["fact"], lambda x: x["section"])))
    found.append(where(given, F.flatten(F.transform("experiences", lambda e, i: _experience_faults(e, i + 1, s, F.col(source))))))
    out = d.select("_row", F.explode(F.concat(*[f.cast(ISSUE) for f in found])).alias("x")).select("_row", "x.*")
    if forbidden is not None:
        seen = every.where("not (path like '%company_highlight' or path like '%school' or path like '%role')").join(row.select("_row", F.col(forbidden).alias("_terms")), "_row")
        hit = seen.where(holds_term(fidelity(F.col("value")), F.transform("_terms", fidelity))).groupBy("_row").agg(F.min("path").alias("place"))
        out = out.unionByName(hit.select("_row", F.lit("candidate_identity_term_exposed").alias("code"), "place", F.lit("").alias("fact")))
    repeated = placeholders(every.groupBy("_row").agg(F.array_join(F.collect_list("value"), "\n").alias("t")), "_row", "t").join(d.select("_row", "_s"), "_row")
    example = lambda n: contains_fact(s, F.concat_ws(" ", "base", n.cast("string")))
    repeated = repeated.where(~((s != "") & F.forall("numbers", example)))
    out = out.unionByName(repeated.select("_row", F.lit("numbered_placeholder_repetition").alias("code"), F.lit("").alias("place"), F.col("base").alias("fact")))
    return out.join(row.select("_row", key), "_row").select(key, "code", "place", "fact", severity(F.col("code")).alias("severity"))


def _experience_faults(e: Column, number: Column, source: Column, text: Column) -> Column:
    """Of one experience: company, years, parts of the role and contents that the folded source lacks, and technical headings that it doesn't have."""
    at = number.cast("string")
    issue = lambda code, fact: F.struct(F.lit(code).alias("code"), at.alias("place"), fact.alias("fact"))
    company = F.trim(text_of(e["company_highlight"]))
    years = F.filter(year_tokens(fidelity(e["date"])), lambda y: ~source.contains(y))
    first = F.array(F.when((F.length(company) >= 3) & ~contains_fact(source, fidelity(company)), issue("company_highlight_absent_from_source", company)), F.when((F.size(year_tokens(text)) > 0) & (F.size(years) > 0), issue("experience_date_absent_from_source", F.trim(text_of(e["date"])))))
    roles = F.transform(F.filter(role_fragments(e["role"]), lambda x: ~contains_fact(source, fidelity(x))), lambda x: issue("experience_role_fact_absent_from_source", x))

    def content(section: Column) -> Column:
        items = F.filter(F.transform(F.coalesce(section["content"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
        allowed = technical_allowed(source, section["heading"]) | (F.trim(text_of(section["heading"])) == "")
        bad = lambda x: F.when(~allowed, issue("synthetic_technical_environment", x)).when(~contains_strictly(source, fidelity(x)), issue("experience_content_rewritten_or_absent_from_source", x))
        return F.array_compact(F.transform(items, bad))

    none = F.array().cast(ISSUE)
    contents = F.coalesce(F.flatten(F.transform(e["sections"], content)).cast(ISSUE), none)
    return F.concat(F.array_compact(first).cast(ISSUE), roles.cast(ISSUE), contents)


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, codes (distinct, sorted), hard_count, soft_count, message of ``issues``; the message is null where nothing is hard."""
    g = found.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count_if(F.col("severity") == "hard").alias("hard_count"), F.count_if(F.col("severity") == "soft").alias("soft_count"))
    text = F.format_string("fidelity_issues=[%s] hard_count=%d soft_count=%d", F.array_join("codes", ","), "hard_count", "soft_count")
    return g.withColumn("message", F.when(F.col("hard_count") > 0, text))


__all__ = ["business_facts", "experience_items", "issues", "rendered_issues", "required_facts", "section_of", "summary"]
