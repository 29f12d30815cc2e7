"""Skills from the text blocks of pages: a state machine over lines in the order in which they're read.

Blocks come as a table with their places. Lines of a document are ordered by page, height and left edge; what a line is follows from
windows over those before it (started, stopped, the last heading), so a document's lines are streamed, not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.arrays import unused
from quillspark.functions.scalars import bound
from quillspark.functions.text import FOOTER, folded_label, squeezed, text_of
from quillspark.operators.skills import SKILLS
from quillspark.operators.taxonomy import top_level_commas

# Headings of skills by their folded form, what opens and what ends their section, and the marks of a sentence about an experience.
HEADINGS = {
    "competences fonctionnelles": "Compétences fonctionnelles", "methodologie de travail": "Méthodologie de travail", "mainframe": "Mainframe", "web .net": "Web .NET", "testeur fonctionnel": "Testeur fonctionnel",
    "base de donnees": "Base De Données", "competences organisationnelles": "Compétences Organisationnelles", "java": "Java", "plateformes": "Technologies Plateformes", "technologies plateformes": "Technologies Plateformes",
    "front-end": "Front-end", "frontend": "Front-end", "data": "Data", "ops": "Ops", "methodologies": "Méthodologies", "reseau & securite": "Réseau & Sécurité", "qualite & analyse": "Qualité & Analyse", "messaging": "Messaging", "divers": "Divers",
}
ANCHORS = ("competences", "domaines de competences", "synthese des competences", "technologies")
ANCHOR_WORD = "competences "
STOPS = ("formations", "formation", "diplomes", "diplomes et formations", "langues", "certifications", "titres / certifications", "experiences professionnelles", "experience professionnelle")
SENTENCES = (
    "maintenance applicative", "analyse et redaction", "chiffrage des demandes", "mise en place et suivi", "developpement des batchs", "developpement des composants", "livraisons des programmes", "realisation des plans de tests",
    "correction et suivi", "environnement technique", "projet :",
)
LONGEST_ITEM, LONGEST_PHRASE = 120, 45
LEAST_CATEGORIES, LEAST_ITEMS = 3, 8
LEAST_CONFIDENCE = 0.75
SOURCE = "visual_pdf_blocks"


def _fold(c: Column) -> Column:
    return F.btrim(folded_label(c), F.lit(" :;•-–—"))


def _heading(folded: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), folded)


def _footer(c: Column) -> Column:
    """Whether a text is a page's footer; few begin as one does."""
    return text_of(c).rlike(r"^\s*+[cC0-9]") & squeezed(c).rlike(FOOTER)


def _single_spaced(x: Column) -> Column:
    """``squeezed`` for a text that isn't null: most hold nothing but single spaces."""
    return F.trim(F.when(x.rlike(r"[\t\n\x0b\f\r]|  "), F.regexp_replace(x, r"\s+", " ")).otherwise(x))


def _sentence(item: Column, folded: Column) -> Column:
    """Whether an item is a sentence about an experience: long, or a phrase with its full stop, or with one of their marks."""
    return (F.length(item) > LONGEST_ITEM) | (item.endswith(".") & (F.length(item) > LONGEST_PHRASE)) | folded.rlike("|".join(SENTENCES))


def _items(line: Column) -> Column:
    """A line's items between commas that no parenthesis holds; the line itself if they're no more than one."""
    x = F.btrim(_single_spaced(line), F.lit(" ,;:•"))
    parts = bound(top_level_commas(x), lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(x)))
    return F.when(x == "", F.array().cast("array<string>")).when(x.contains(","), parts).otherwise(F.array(x))


def lines(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos (from 1, in reading order), line, folded of the blocks (key, page, x0, y0, ord, text); footers and empty lines are left out.

    Places are rounded to a tenth; blocks at one place stand in the order of ``ord``. A null text has no lines.
    """
    split = F.transform(F.split(F.regexp_replace(text_of(F.col("text")), "\r", "\n"), "\n"), lambda x: F.btrim(_single_spaced(x), F.lit(" •")))
    b = blocks.where(~_footer(F.trim(text_of(F.col("text"))))).select(F.col(key), "page", F.round("y0", 1).alias("y"), F.round("x0", 1).alias("x"), "ord", F.posexplode(split).alias("i", "line"))
    b = b.where((F.col("line") != "") & ~_footer(F.col("line")))
    pos = F.row_number().over(W.partitionBy(key).orderBy("page", "y", "x", "ord", "i"))
    return b.select(key, pos.alias("pos"), "line", _fold(F.col("line")).alias("folded"))


def marked(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with ``started`` (a line before opened the section), ``heading``, ``category`` (the last heading) and ``stopped``."""
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    f = F.col("folded")
    anchor = f.isin(*ANCHORS) | f.startswith(ANCHOR_WORD)
    d = found.withColumn("started", F.coalesce(F.max(anchor).over(before), F.lit(False)))
    inline = _heading(_fold(F.regexp_replace(F.col("line"), r"(?iu)^comp[ée]tences(?![\p{L}\p{N}_])", "")))
    heading = F.when(F.col("started"), _heading(f)).when(anchor & f.startswith(ANCHOR_WORD), inline)
    d = d.withColumn("anchor", anchor).withColumn("heading", heading)
    stop = F.col("started") & F.col("heading").isNull() & f.isin(*STOPS)
    return d.withColumn("stopped", F.max(stop).over(so_far)).withColumn("category", F.last("heading", ignorenulls=True).over(so_far))


def skills(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, skills, confidence, warnings of every document with blocks.

    Categories stand in the order of their first heading, items in that of the lines, once each. Confidence is 0 if no line opens the section, 0.4 with too few
    categories or items, else 0.9 (0.5 if a footer or an oversized item had come through; the rules above leave none).
    """
    m = marked(lines(blocks, key), key)
    # One walk gives headings (without an item), items, and of other lines only whether they open the section: neither lines nor windows are made again for each.
    item = F.when(F.expr("started and not stopped and heading is null and category is not null"), _items(F.col("line")))
    heading = F.expr("not stopped and heading is not null")
    of = m.select(key, "anchor", "pos", "category", heading.alias("opens"), F.posexplode_outer(item).alias("i", "item"))
    good = (F.col("item") != "") & ~_footer(F.col("item")) & ~_sentence(F.col("item"), _fold(F.col("item")))
    of = of.select(key, "anchor", "opens", "category", F.when(good, F.col("item")).alias("item"), (F.shiftleft(F.col("pos").cast("long"), 32) + F.coalesce("i", F.lit(0))).alias("at"))
    of = of.withColumn("category", F.when(F.col("opens") | F.col("item").isNotNull(), F.col("category")))
    once = of.groupBy(key, "category", "item").agg(F.min("at").alias("at"), F.max("anchor").alias("started"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("at", "item")))), lambda x: x["item"])
    lists = once.groupBy(key, "category").agg(listed.alias("items"), F.min(F.when(F.col("item").isNull(), F.col("at"))).alias("at"), F.max("started").alias("started"))
    whole = F.col("category").isNotNull() & (F.size("items") > 0) & F.col("at").isNotNull()
    ranked = F.array_sort(F.collect_list(F.when(whole, F.struct("at", "category", "items"))))
    d = lists.groupBy(key).agg(F.transform(ranked, lambda x: F.struct(x["category"].alias("category"), x["items"].alias("items"))).cast(SKILLS).alias("skills"), F.max("started").alias("started"))
    return d.select(key, "skills", *_confidence(F.col("skills"), F.col("started")))


def _confidence(skills: Column, started: Column) -> tuple[Column, Column]:
    """Confidence and warnings of a document's skills."""
    items = F.flatten(F.transform(skills, lambda s: s["items"]))
    few = (F.size(skills) < LEAST_CATEGORIES) | (F.size(items) < LEAST_ITEMS)
    rules = (
        (~started, 0.0, "skills_heading_not_found"), (few, 0.4, "too_few_visual_skills"), (F.exists(items, _footer), 0.5, "footer_leak_detected"), (F.exists(items, lambda x: F.length(x) > LONGEST_ITEM), 0.5, "oversized_skill_item_detected"),
    )
    score, warning = F.lit(0.9), F.lit(None).cast("string")
    for when, value, name in reversed(rules):
        score, warning = F.when(when, value).otherwise(score), F.when(when, name).otherwise(warning)
    return score.alias("confidence"), F.array_compact(F.array(warning)).alias("warnings")


def overridden(docs: DataFrame, found: DataFrame, key: str = "doc_id", least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``docs`` (key, skills, ...) with the skills of ``found`` where those are sure enough and not empty, and ``source_override`` (source, confidence, warnings), null elsewhere."""
    there, own, confidence, warnings = unused(docs, "there", "own", "confidence", "warnings")
    sure = found.where((F.col("confidence") >= least) & (F.size("skills") > 0)).select(F.col(key).alias(there), F.col("skills").alias(own), F.col("confidence").alias(confidence), F.col("warnings").alias(warnings))
    d = docs.join(sure, docs[key] == F.col(there), "left")
    took = F.col(there).isNotNull()
    override = F.when(took, F.struct(F.lit(SOURCE).alias("source"), F.col(confidence).alias("confidence"), F.col(warnings).alias("warnings")))
    return d.withColumn("skills", F.when(took, F.col(own)).otherwise(F.col("skills").cast(SKILLS))).withColumn("source_override", override).drop(there, own, confidence, warnings)
