"""Ordered keyword rules: what a comment asks for, what kind an error is, which label a status has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import squeezed, taxonomy_text, text_of, word

# Keywords of the rules, in the order in which they apply.
LAYOUT = r"remont(?:e|er)|descend(?:s|re)?|d[eé]plac(?:e|er)|mets?|mettre|page\s*[0-9]+|derni[eè]re\s+page|saut(?:s)?\s+de\s+page|a[eé]rer|resserrer|compacter|remonter|mont(?:e|er)|rapproch(?:e|er)"
CONTENT = r"ajout(?:e|er)|supprim(?:e|er)|corrig(?:e|er)\s+le\s+texte|modifi(?:e|er)\s+le\s+texte|r[eé][eé]cris|r[eé]dige|enl[eè]ve|change\s+la\s+mission|manquant|oubli[eé]|rajout(?:e|er)|compl[eé]ter"
RESET = r"repart(?:ir|ons)?\s+de\s+z[eé]ro|refaire\s+de\s+z[eé]ro|tout\s+refaire|repartir\s+du\s+source"
ERRORS = (
    ("source_sanitization", "source sanitization error|sourcesanitizationerror|sanitization|sanitisation|sanitized text shrunk unusually|texte source trop court"),
    ("structuring_invalid_json", "json hermes invalide|json renderer invalide|json renderer incomplet|sans json exploitable|cles manquantes|objet racine attendu|doit etre une liste"),
    ("contact_leak", "coordonnees|contact leak|email|linkedin|github|phone_fr|telephone"),
    ("identity_leak", "identity|identite|forbidden_name|nom complet|full_name|nom de famille|surname"),
    ("layout_density", "page_too_dense|page_dense|last_page_sparse|page_too_sparse|layout|pagination|densite|dense|overflow|orphan"),
    ("renderer_asset", "renderer_asset|logo|watermark|filigrane|asset|ressource renderer|has_logo|has_watermark"),
    ("missing_candidate_first_name", "missing_candidate_first_name|inferable|prenom candidat"),
    ("source_fidelity", "fidelite|source_fidelity|source_coverage|source|reformulation|copier-coller|hallucination|absent du cv source|fait pdf absent"),
)
ERROR_DEFAULT = "transient_model_failure"
NO_COMPACTION = r"ne\s+pas\s+(?:compacter|condenser|r[ée]sumer|synth[ée]tiser|raccourcir)|sans\s+(?:compaction|condensation|r[ée]sum[ée]|synth[èe]se|reformulation)|sans\s+[^.\n]{0,100}\b(?:condens(?:er|ation|é|e)|synth[ée]tiser|synth[èe]se|omettre|omission)|cv\s+complet|contenu\s+complet|fid[èe]le|conserver\s+(?:tout|l['’]?int[ée]gralit[ée])"
SHORT = r"version\s+courte|cv\s+court|cv\s+synth[ée]tique|client\s+short|raccourci[rs]?|raccourcir|r[ée]sumer(?:\s+(?:le\s+)?cv)?|r[ée]sum[ée]\s+(?:du|de\s+ce)\s+cv|synth[ée]tiser|synth[èe]se|condens(?:er|ation|é|e)|compacter|all[ée]ger|tenir\s+en\s+(?:[0-9]+|deux|trois)\s+pages?|(?:[0-9]+|deux|trois)\s+pages?\s+max"
REWRITE = r"r[ée][ée]cri(?:s|re|t|ture)|rewrite|reformul(?:e|er|ation)|am[ée]liore\s+(?:l['’]?|la\s+|le\s+)?(?:pr[ée]sentation|accroche|profil|r[ée]sum[ée])"
TARGETED = r"(?s)(?:corrige|corriger|modifie|modifier|change|changer|remplace|remplacer|ajoute|ajouter|supprime|supprimer|retire|retirer|mets\s+[àa]\s+jour|mettre\s+[àa]\s+jour)\b.{0,120}\b(?:titre|pr[ée]sentation|profil|r[ée]sum[ée]|comp[ée]tences?|formation|exp[ée]rience|mission|date|client|entreprise|stack|outil|certification)"
MOVES = "remont(?:e|er)|montez?|descend(?:s|re)?|d[eé]plac(?:e|er)|mets?|mettre|rapproch(?:e|er)"
PAGE_REFERENCE = r"page\s*[0-9]+|derni[eè]re\s+page|premi[eè]re\s+page"
REVISION_CATEGORIES = ("layout_sparse_page", "missing_content", "fidelity_issue", "skills_classification", "contact_leak", "other")


def revision_intent(body: Column) -> Column:
    """reset, layout_only, content (also if both are asked for), unknown."""
    t = squeezed(body)
    layout, content = t.rlike(word(LAYOUT)), t.rlike(word(CONTENT))
    return F.when(t.rlike(word(RESET)), "reset").when(content, "content").when(layout, "layout_only").otherwise("unknown")


def instruction_intent(text: Column) -> Column:
    """explicit_short_version, explicit_rewrite, targeted_edit, complete_faithful."""
    t = text_of(text)
    short = t.rlike(word(SHORT)) & ~t.rlike(word(NO_COMPACTION))
    return F.when(short, "explicit_short_version").when(t.rlike(word(REWRITE)), "explicit_rewrite").when(t.rlike(word(TARGETED)), "targeted_edit").otherwise("complete_faithful")


def synthesis_mode(mode: Column, instructions: Column) -> Column:
    """complete unless the instructions ask for a short version; then urgent if they say so, else standard. A faithful mode stays complete."""
    faithful = F.lower(F.trim(F.coalesce(mode, F.lit("complete")))).isin("faithful", "fidèle", "fidele", "full")
    short = instruction_intent(instructions) == "explicit_short_version"
    return F.when(faithful | ~short, "complete").when(F.lower(text_of(instructions)).contains("urgent"), "urgent").otherwise("standard")


def moves_from_last_page(body: Column) -> Column:
    t = text_of(body)
    return t.rlike(word(PAGE_REFERENCE)) & t.rlike(word(MOVES))


def error_category(message: Column) -> Column:
    """The first category whose words the folded message holds; a message that names categories itself is of source fidelity if all of them are."""

    def of(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(r"(?:primary|fallback)_category_?\s*([a-z_]+)"), 1)
        out = F.lit(ERROR_DEFAULT)
        for name, words in reversed(ERRORS):
            out = F.when(t.rlike(word(words)), name).otherwise(out)
        return F.when((F.size(found) > 0) & F.forall(found, lambda c: c == "source_fidelity"), "source_fidelity").otherwise(out)

    return bound(taxonomy_text(message), of)


def issue_codes(message: Column) -> Column:
    """Codes in ``fidelity_issues=[a, b]``."""
    inside = F.regexp_extract(text_of(message), r"fidelity_issues=\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")


def issue_counts(message: Column) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(text_of(message), rf"{k}_count=([0-9]+)", 1).try_cast("int") for k in ("hard", "soft"))


def revision_category(value: Column) -> Column:
    v = F.trim(text_of(value))
    return F.when(v.isin(*REVISION_CATEGORIES), v).otherwise("other")
