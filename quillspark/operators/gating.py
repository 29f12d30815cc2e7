"""A structured document held to its source, gate after gate, and shortened where that was asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import unused
from quillspark.functions.scalars import bound
from quillspark.functions.text import contains_fact, fidelity, fidelity_each, text_of
from quillspark.operators.fidelity import business_facts, section_of
from quillspark.operators.skills import FAITHFUL, SKILLS, STRINGS, covered, grouped_certifications, grouped_long, keys, rescued, source_skills, technical_terms, with_skills

# Of each mode that shortens, how many experiences stay whole, how many items older ones keep, and from how many experiences on.
MODES = {"standard": (3, 2, 5), "urgent": (1, 1, 3)}
COMPLETE = "complete"
FAITHFUL_MODES = ("faithful", "fidèle", "fidele", "full")
TECHNICAL = "environnement|technique|stack"
SYNTHESIS, ENVIRONMENT = "Synthèse mission", "Environnement technique"
NO_DETAIL = "Mission ancienne conservée sous forme synthétique faute de détail exploitable."
CONDENSED = "mission ancienne volontairement condensée pour lisibilité client."
OMITTED = "élément(s) de détail condensé(s) pour lisibilité client; consulter le CV source si besoin."

SECTIONS = "array<struct<heading:string,content:array<string>>>"


def _some(items: Column, kind: str) -> Column:
    return F.coalesce(items, F.array().cast(kind))


def gated_skills(docs: DataFrame, source: str = "source") -> DataFrame:
    """``docs`` whose skills hold only items of the source, with the source's business facts that they lacked.

    If any category is one that sources use themselves, items of other categories only stay if a business fact holds them, in that fact's section. Facts of the source that then stand nowhere
    are added to their section, a new category if there's none, unless they belong to a skills section whose parsed keys are covered. An empty source gates nothing.
    """
    folded, facts, kept, want = unused(docs, "folded", "facts", "kept", "want")
    d = docs.withColumn(folded, fidelity(F.col(source))).withColumn(facts, business_facts(F.col(source)))
    skills = _some(F.col("skills"), SKILLS)
    named = lambda s: fidelity_each(F.transform(s, lambda x: text_of(x["category"])))

    def backed(items: Column, folded: Column) -> Column:
        trimmed = F.filter(F.transform(_some(items, STRINGS), lambda x: F.trim(text_of(x))), lambda x: x != "")
        return bound(trimmed, lambda t: bound(fidelity_each(t), lambda n: F.filter(t, lambda x, i: contains_fact(folded, F.get(n, i)))))

    def gate(every: Column, folded: Column, facts: Column) -> Column:
        checked = lambda names: F.transform(every, lambda s, i: F.struct(s["category"].alias("category"), backed(s["items"], folded).alias("items"), F.get(names, i).isin(*FAITHFUL).alias("own")))
        return bound(bound(named(every), checked), lambda c: F.when(F.exists(c, lambda s: s["own"]), F.concat(plain(F.filter(c, lambda s: s["own"])), promoted(F.filter(c, lambda s: ~s["own"]), facts))).otherwise(plain(c)))

    plain = lambda c: F.transform(F.filter(c, lambda s: F.size(s["items"]) > 0), lambda s: F.struct(s["category"].alias("category"), s["items"].alias("items"))).cast(SKILLS)

    def promoted(others: Column, facts: Column) -> Column:
        found = F.filter(F.transform(F.flatten(F.transform(others, lambda s: s["items"])), lambda x: F.struct(section_of(facts, x).alias("section"), x.alias("item"))), lambda x: x["section"].isNotNull())
        return bound(found, lambda f: F.transform(F.array_distinct(F.transform(f, lambda x: x["section"])), lambda s: F.struct(s.alias("category"), F.array_distinct(F.transform(F.filter(f, lambda x: x["section"] == s), lambda x: x["item"])).alias("items")))).cast(SKILLS)

    # What lambdas read is bound: a column would be computed again for every item.
    source_of = F.struct(skills.alias("skills"), F.col(folded).alias("folded"), F.col(facts).alias("facts"))
    d = d.withColumn(kept, bound(source_of, lambda b: gate(b["skills"], b["folded"], b["facts"])))
    d = d.withColumn(want, keys(source_skills(F.col(source))["skills"]))
    # Facts are looked for in what the skills say, names of the fields included as a reader of the JSON would see them.
    said = lambda s: fidelity(F.to_json(s))

    def put(skills: Column, f: Column, want: Column) -> Column:
        names = F.transform(skills, lambda s: fidelity(s["category"]))
        at = F.array_position(names, fidelity(f["section"])) - 1
        added = F.transform(skills, lambda s, i: F.struct(s["category"].alias("category"), F.when(i == at, F.array_union(s["items"], F.array(f["fact"]))).otherwise(s["items"]).alias("items")))
        new = F.concat(skills, F.array(F.struct(f["section"].alias("category"), F.array(f["fact"]).alias("items"))).cast(SKILLS))
        there = contains_fact(said(skills), fidelity(f["fact"])) | covered(f["section"], want, keys(skills))
        return F.when(there, skills).when(at >= 0, added.cast(SKILLS)).otherwise(new)

    d = d.withColumn(kept, bound(F.struct(F.col(facts).alias("facts"), F.col(kept).alias("kept"), F.col(want).alias("want")), lambda b: F.aggregate(b["facts"], b["kept"], lambda a, f: put(a, f, b["want"]))))
    return d.withColumn("skills", F.when(F.col(folded) == "", F.col("skills").cast(SKILLS)).otherwise(F.col(kept))).drop(folded, facts, kept, want)


def gated(docs: DataFrame, source: str = "source") -> DataFrame:
    """``docs`` (skills, languages, certifications, source) through the gates in their order.

    Languages are hoisted and skills merged first, so that no fragment of a level is left in a category; then languages and certifications
    that are still among the skills are rescued; then the source gates the skills, and what it added is merged once more.
    """
    return with_skills(gated_skills(rescued(with_skills(docs, source)), source), source)


def mode_of(mode: Column, allowed: Column) -> Column:
    """complete, standard or urgent: faithful modes, and those that shorten without leave, are complete; an unknown one is null."""
    x = F.lower(F.trim(F.coalesce(mode, F.lit(COMPLETE))))
    x = F.when(x == "", COMPLETE).otherwise(x)
    return F.when(x.isin(COMPLETE, *FAITHFUL_MODES) | (x.isin(*MODES) & ~F.coalesce(allowed, F.lit(False))), COMPLETE).when(x.isin(*MODES), x)


def condensed(experience: Column, most: Column, brand: str = "") -> Column:
    """The sections of a shortened experience: the first items of its missions with a note, and its technical terms by family."""
    prefix = f"Synthèse {brand}".strip() + ": "

    def of(x: Column) -> Column:
        missions = F.flatten(F.transform(F.filter(x, lambda s: ~s["technical"]), lambda s: F.slice(s["items"], F.lit(1), most)))
        omitted = F.aggregate(F.filter(x, lambda s: ~s["technical"]), F.lit(0), lambda a, s: a + F.greatest(F.lit(0), F.size(s["items"]) - most))
        terms = technical_terms(F.flatten(F.transform(F.filter(x, lambda s: s["technical"]), lambda s: s["items"])))
        note = F.when(omitted > 0, F.concat(F.lit(prefix), omitted.cast("string"), F.lit(f" {OMITTED}"))).otherwise(F.lit(prefix + CONDENSED))
        items = F.when(F.size(missions) > 0, F.slice(missions, F.lit(1), most)).otherwise(F.array(F.lit(NO_DETAIL)))
        first = F.array(F.struct(F.lit(SYNTHESIS).alias("heading"), F.concat(items, F.array(note)).alias("content"))).cast(SECTIONS)
        return bound(terms, lambda t: F.when(t == "", first).otherwise(F.concat(first, F.array(F.struct(F.lit(ENVIRONMENT).alias("heading"), F.array(t).alias("content"))).cast(SECTIONS))))

    trimmed = lambda c: F.filter(F.transform(_some(c, STRINGS), lambda v: F.trim(text_of(v))), lambda v: v != "")
    marked = F.transform(_some(experience["sections"], SECTIONS), lambda s: F.struct(F.lower(text_of(s["heading"])).rlike(TECHNICAL).alias("technical"), trimmed(s["content"]).alias("items")))
    return bound(marked, of)


def synthesised(docs: DataFrame, mode: str = "mode", allowed: str = "allow_condensation", brand: str = "") -> DataFrame:
    """``docs`` (skills, formations, experiences) by the mode in one column and the leave in another, with ``synthesis_mode``.

    Long skills and certifications are grouped in every mode. Experiences are only shortened in a mode with leave, if there are enough of them, and
    then those after the first ones, which stay as they are. A row whose mode is unknown has a null ``synthesis_mode`` and stays as it is.
    """
    name = mode_of(F.col(mode), F.col(allowed))
    limit = lambda i: F.coalesce(*[F.when(F.col("synthesis_mode") == m, v[i]) for m, v in MODES.items()])
    known = F.col("synthesis_mode").isNotNull()
    fields = docs.schema["experiences"].dataType.elementType.names
    short = lambda e: F.struct(*[(condensed(e, limit(1), brand) if f == "sections" else e[f]).alias(f) for f in fields])
    shorten = F.coalesce(F.size("experiences") >= limit(2), F.lit(False))
    experiences = F.when(shorten, F.transform("experiences", lambda e, i: F.when(i < limit(0), e).otherwise(short(e)))).otherwise(F.col("experiences"))
    d = docs.withColumn("synthesis_mode", name)
    return d.withColumns({
        "skills": F.when(known, grouped_long(F.col("skills"))).otherwise(F.col("skills").cast(SKILLS)),
        "formations": F.when(known, grouped_certifications(F.col("formations"))).otherwise(F.col("formations")),
        "experiences": experiences,
    })
