"""What is shown of a document's checks: flags of a skills list, labels of warnings and profiles, packing options, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import skill_key, text_of
from quillspark.operators.packing import page_breaks

# Limits of a skills list and of a document that is packed as it is; labels.
MOST_ITEMS, MOST_OTHERS, OTHERS_SHARE, OTHERS_RULE = 60, 8, 0.20, 0.25
SHORT_ENTRIES, SHORT_TOTAL, SHORT_LARGEST = 8, 120, 30
PACKING = {"anti_crowding": True, "allow_grouping": True, "density_profile": "balanced", "page_dense_char_threshold": 2850, "max_used_ratio": 0.86, "readability_reserve": 130}
WARNING = "Point qualité à vérifier"
WARNINGS = {
    "page_too_dense": "Page trop dense", "last_page_sparse": "Dernière page trop vide", "bad_page_break": "Saut de page à reprendre", "skill_block_too_long": "Bloc de compétences trop long",
    "skills_too_dense": "Compétences trop denses", "experience_orphan_heading": "Titre d’expérience isolé", "experience_section_orphan_heading": "Section d’expérience isolée",
    "skill_overflow_page_created": "Compétences reportées sur une page de suite", "source_fidelity_soft_warning": "Fidélité source à confirmer", "extraction_low_confidence": "Extraction peu fiable",
}
PROFILES = {
    "normal": "CV standard", "senior_long": "CV senior long", "ats": "CV ATS / jobboard", "scanned": "Extraction faible", "two_column": "CV en colonnes", "graphic": "CV graphique",
    "risky": "CV risqué", "unknown": "Profil source inconnu",
}


def _named(names: dict[str, str], code: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), text_of(code)), F.lit(other))


def warning_label(code: Column) -> Column:
    return _named(WARNINGS, code, WARNING)


def profile_label(profile: Column) -> Column:
    return _named(PROFILES, profile, PROFILES["unknown"])


def one_line(value: Column, size: int = 180) -> Column:
    """The text without line breaks and runs of blanks, cut after ``size`` characters; null is empty."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text_of(value), r"[\r\n\t]+", " "), r"(?U)\s{2,}", " ")), 1, size)


def page_prefix(page: Column) -> Column:
    return F.when(page > 0, F.concat(F.lit("Page "), page.cast("string"), F.lit(" · "))).otherwise("")


def draft_warning(code: Column, message: Column, snippet: Column, page: Column) -> Column:
    """How an issue of a draft is shown: its page, its label, and its message or else its snippet."""
    said = one_line(message)
    said = F.when(said == "", one_line(snippet, 120)).otherwise(said)
    return F.concat(page_prefix(page), warning_label(code), F.when(said == "", "").otherwise(F.concat(F.lit(" — "), said)))


def clamped(score: Column) -> Column:
    """Rounded half up into 0 to 100; 0 for null and for what isn't a finite number."""
    n = score.try_cast("double")
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    return F.when(bad, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(n + 0.5)))).cast("int")


def skill_flags(skills: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, code, n, total of skills (key, category, items) that are too many, too often unsorted, or repeated.

    Items are counted per (key, item) before they are summed per key; blank items don't count.
    """
    d = skills.select(key, F.lower(F.trim(text_of(F.col("category")))).alias("c"), F.filter(F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "").alias("items"))
    other = F.col("c").startswith("autres")
    each = d.select(key, other.cast("long").alias("o"), F.explode("items").alias("item")).groupBy(key, skill_key(F.col("item")).alias("k")).agg(F.count("*").alias("n"), F.sum("o").alias("o"))
    s = each.groupBy(key).agg(F.sum("n").alias("total"), F.sum("o").alias("others"), (F.sum("n") - F.count("*")).alias("again"))
    flag = lambda code, when, n: F.when(when, F.struct(F.lit(code).alias("code"), n.alias("n")))
    total, others, again = F.col("total"), F.col("others"), F.col("again")
    found = F.array(
        flag("too_many_skill_items", total > MOST_ITEMS, total),
        flag("too_many_autres_items", (others > MOST_OTHERS) | (others / total > OTHERS_SHARE), others),
        flag("autres_dominates_skills", others / total > OTHERS_RULE, others),
        flag("duplicate_skill_items", again > 0, again),
    )
    flags = s.select(key, "total", F.explode(F.array_compact(found)).alias("f")).select(key, "f.code", "f.n", "total")
    more = d.where(other & F.col("c").contains("suite")).select(key, F.lit("continued_autres_category").alias("code"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("total"))
    return flags.unionByName(more)


def packing_options(heights: Column, new_page: Column | None = None) -> Column:
    """Struct of the options of a layout, from the ordered heights of entries; ``new_page`` forces entries onto a new page or not.

    A short document is left to flow: it gets no breaks, unless the caller decides.
    """
    h = F.coalesce(heights, F.array().cast("array<int>"))
    total = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    short = (F.size(h) > 0) & (F.size(h) <= SHORT_ENTRIES) & (total <= SHORT_TOTAL) & (F.array_max(h) <= SHORT_LARGEST)
    given = F.lit(None).cast("boolean") if new_page is None else new_page
    breaks = F.when(given.isNull() & short, F.array().cast("array<int>")).otherwise(page_breaks(h))
    return F.struct(*[F.lit(v).alias(k) for k, v in PACKING.items()], F.coalesce(given, ~short).alias("force_new_page"), breaks.alias("breaks"))
