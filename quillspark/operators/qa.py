"""Rules over page metrics: density, sparseness, balance, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.scalars import bounded_score
from quillspark.functions.text import fidelity, safe_code, squeezed, text_of, uppercase_ratio, word
from quillspark.operators.sanitize import looks_like_contact

# Thresholds, weights of issue codes, codes that leave a draft.
DENSE_CHARS, DENSE_BLOCKS, SPARSE_CHARS, SPARSE_BLOCKS, UNDER_CHARS, UNDER_RATIO = 3000, 42, 180, 4, 650, 0.35
GOOD, DRAFT, UNBALANCED, OTHER_WEIGHT = 86, 70, 0.48, 10
WEIGHTS = {
    "page_too_dense": 22, "page_dense_but_acceptable": 6, "last_page_sparse": 16, "page_too_sparse": 18, "page_underfilled_with_next_experience_fit": 14, "bad_page_break": 20,
    "experience_orphan_heading": 24, "experience_section_orphan_heading": 22, "skill_block_too_long": 12, "skills_too_dense": 14, "skill_overflow_page_created": 10, "experience_split_mid_block": 16,
    "continuation_tail_page": 12, "page_balance_unbalanced": 10,
}
SOFT = (
    "page_too_dense", "last_page_sparse", "bad_page_break", "skill_block_too_long", "skills_too_dense", "experience_orphan_heading", "experience_section_orphan_heading",
    "skill_overflow_page_created", "page_dense_but_acceptable", "page_too_sparse", "experience_split_mid_block", "page_underfilled_with_next_experience_fit",
)


#: Measures of a page that rules read besides its counts, and what they are where a table has no such column.
OTHERS = {"blank_after_pt": 0.0, "starts_with_suite": False, "has_experience_heading": False}


def whole(pages: DataFrame) -> DataFrame:
    """Pages with all measures: those of ``OTHERS`` that are missing or null get the value there."""
    have = {k: F.coalesce(F.col(k), F.lit(v)) if k in pages.columns else F.lit(v) for k, v in OTHERS.items()}
    return pages.withColumns(have)


def layout_issues(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, code of pages (key, page, char_count, block_count, used_ratio, ``OTHERS``): dense, sparse last, sparse middle pages.

    A middle page is sparse if it's short and low, a low continuation, mostly blank, or low below a heading of an experience.
    """
    d = whole(pages).withColumn("_last", F.max("page").over(W.partitionBy(key)))
    c, b, r = F.col("char_count"), F.col("block_count"), F.col("used_ratio")
    dense = ((c >= DENSE_CHARS) & ~((c < 3400) & (r < 0.70))) | ((b >= DENSE_BLOCKS) & (r >= 0.75))
    last = (F.col("_last") > 1) & (F.col("page") == F.col("_last"))
    thin = last & (((c <= SPARSE_CHARS) & (b <= SPARSE_BLOCKS)) | ((c <= UNDER_CHARS) & (r <= UNDER_RATIO)))
    low = ((r <= 0.40) & (c <= 900)) | (F.col("starts_with_suite") & (r <= 0.45)) | ((F.col("blank_after_pt") >= 430) & (c <= 1200))
    low |= F.col("has_experience_heading") & (r <= 0.46) & (c <= 1700)
    middle = (F.col("_last") >= 3) & (F.col("page") > 1) & (F.col("page") < F.col("_last")) & low
    codes = F.array(
        F.when(dense, F.when((c >= 3600) | (r >= 0.92), "page_too_dense").otherwise("page_dense_but_acceptable")),
        F.when(thin, "last_page_sparse"),
        F.when(thin | middle, "page_too_sparse"),
    )
    return d.select(key, "page", F.explode(F.array_compact(codes)).alias("code"))


def balance(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, spread of used_ratio over pages with text, without the first of more than three; 0 for fewer than three."""
    useful = pages.where("char_count > 0").withColumn("_n", F.count("*").over(W.partitionBy(key))).withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy("page")))
    counted = useful.where("_n >= 3 and (_n <= 3 or _i > 1)")
    return counted.groupBy(key).agg((F.max("used_ratio") - F.min("used_ratio")).alias("spread"))


def weight(code: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, v in WEIGHTS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def verdict(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= DRAFT, "acceptable_draft").otherwise("poor")


def taste(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, score, verdict, issues of every document with a page."""
    issues = layout_issues(pages, key)
    unbalanced = balance(pages, key).where(F.col("spread") >= UNBALANCED).select(key, F.lit(None).cast("int").alias("page"), F.lit("page_balance_unbalanced").alias("code"))
    tail = whole(pages).where("char_count > 0 and starts_with_suite and char_count <= 900 and round(used_ratio, 3) <= 0.48")
    tail = tail.select(key, F.col("page").cast("int"), F.lit("continuation_tail_page").alias("code"))
    every = issues.select(key, F.col("page").cast("int"), "code").unionByName(unbalanced).unionByName(tail)
    sums = every.groupBy(key).agg(F.sum(weight(F.col("code"))).alias("_sum"), F.count("*").alias("issues"))
    d = pages.select(key).distinct().join(sums, key, "left")
    score = F.greatest(F.lit(0), F.lit(100) - F.coalesce("_sum", F.lit(0))).cast("int")
    return d.select(key, score.alias("score"), F.coalesce("issues", F.lit(0)).alias("issues")).withColumn("verdict", verdict(F.col("score")))


def status(contact_hits: Column, has_logo: Column, has_watermark: Column, pages: Column, codes: Column, content_issues: Column, draft: Column | None = None) -> Column:
    """passed, draft or failed; a report marked ``draft`` after a layout failure is a draft unless it fails for good."""
    hard = (contact_hits > 0) | ~has_logo | ~has_watermark | (pages <= 0)
    unknown = F.exists(codes, lambda c: ~c.isin(*SOFT))
    marked = F.coalesce(draft, F.lit(False)) if draft is not None else F.lit(False)
    return F.when(hard, "failed").when(marked, "draft").when(unknown, "failed").when(F.size(codes) > 0, "draft").when(content_issues > 0, "failed").otherwise("passed")


def layout_score(missing: Column, contact: Column, identity: Column, sparse: Column, dense: Column, pages: Column) -> Column:
    return F.lit(100) - (missing + contact + identity) * 1000 - sparse * 15 - dense * 25 - F.greatest(F.lit(0), pages - 4) * 5


def best_variant(scores: DataFrame, key: str) -> DataFrame:
    """The row of the highest score per key; among equals one that passed (where there's such a column), then the first by ``ord``."""
    passed = F.coalesce(F.col("passed"), F.lit(False)) if "passed" in scores.columns else F.lit(False)
    best = F.struct("score", passed.alias("p"), (-F.col("ord")).alias("o"))
    return scores.groupBy(key).agg(F.max_by(F.struct(*[c for c in scores.columns if c != key]), best).alias("x")).select(key, "x.*")


def fewest_missing(variants: DataFrame, key: str) -> DataFrame:
    """The row with the fewest missing blocks per key, the first by ``ord`` among equals, of rows (key, missing, ord, ...)."""
    return variants.groupBy(key).agg(F.min_by(F.struct(*[c for c in variants.columns if c != key]), F.struct("missing", "ord")).alias("x")).select(key, "x.*")


# Patterns of headings, of continued pages and of contacts in rendered text.
SKILL_HEADING = r"(?iu)comp[ée]tences|cloud|devops|backend|frontend|outils|m[ée]thodes|data"
EXPERIENCE_SECTION = r"(?iu)exp[ée]riences?|missions?|prestations?|r[ée]alis[ée]e?s?|activit[ée]s?|environnement"
EXPERIENCE_DATE = r"(?iu)(?:19|20)[0-9]{2}|aujourd|janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[ûu]t|septembre|octobre|novembre|d[ée]cembre"
EXPERIENCE_ROLE = "chez|client|architecte|d[ée]veloppeur|consultant|lead|chef de projet|ing[ée]nieur"
CONTINUATION = r"(?iu)^(?:\(suite\)|missions?\s*\(suite\)|livrables?\s+cl[ée]s?\s*\(suite\))(?:\s|$|[:–—-])"
RENDERED_CONTACTS = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "linkedin": r"(?i)(?:https?://)?(?:www\.)?(?:[a-z]{2}\.)?linkedin\.com/\S+|lnkd\.in/\S+",
    "url": r"(?i)https?://\S+|www\.\S+|(?:https?://)?(?:www\.)?github\.com/\S+|(?:https?://)?(?:www\.)?(?:[a-z0-9-]+\.)+(?:com|fr|net|org|io|ai|dev|co)/\S+",
    "phone_fr": r"(?:\+33|\b0[67])(?:[ .-]?[0-9]{2}){4}\b",
}
ORPHAN_ZONE, ORPHAN_CHARS, HEADING_CHARS, DENSE_SKILL_CHARS, DENSE_SKILL_MARKS = 150, 80, 90, 700, 18


def experience_heading(text: Column) -> Column:
    """A date, mostly capitals, or a role word in at most 140 characters."""
    t = squeezed(text)
    shouted = (uppercase_ratio(t) >= 0.65) & (F.length(t) >= 12)
    return (t != "") & (F.length(t) <= 140) & (t.rlike(EXPERIENCE_DATE) | shouted | t.rlike(word(EXPERIENCE_ROLE)))


def skill_heading(text: Column) -> Column:
    t = F.regexp_replace(squeezed(text), r"^[ :\-–—•]+|[ :\-–—•]+$", "")
    bullet = F.ltrim(text_of(text)).rlike("^[•-]")
    return (t != "") & (F.length(t) <= 90) & ~bullet & ~t.rlike(EXPERIENCE_SECTION) & t.rlike(SKILL_HEADING)


def page_metrics(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, char_count, block_count, used_top, used_bottom, used_ratio, blank_after_pt, starts_with_suite, has_experience_heading of text blocks (key, page, ord, y0, y1, text, height)."""
    heading = experience_heading(F.col("text")) | F.col("text").rlike(EXPERIENCE_SECTION)
    g = blocks.groupBy(key, "page").agg(
        F.sum(F.length("text")).cast("long").alias("char_count"),
        F.count("*").alias("block_count"),
        F.min("y0").alias("used_top"),
        F.max("y1").alias("used_bottom"),
        F.max("height").alias("_height"),
        squeezed(F.min_by("text", F.struct("y0", "ord"))).rlike(CONTINUATION).alias("starts_with_suite"),
        F.coalesce(F.bool_or(heading), F.lit(False)).alias("has_experience_heading"),
    )
    ratio = F.when(F.col("_height") > 0, (F.col("used_bottom") - F.col("used_top")) / F.col("_height")).otherwise(0.0)
    return g.withColumn("used_ratio", ratio).withColumn("blank_after_pt", F.greatest(F.lit(0.0), F.col("_height") - F.col("used_bottom"))).drop("_height")


def public_metrics(metrics: DataFrame, key: str = "doc_id") -> DataFrame:
    """The measures of ``page_metrics`` as reports show them: the ratio to 3 places, points to 1."""
    to = {"used_ratio": 3, "blank_after_pt": 1, "used_top": 1, "used_bottom": 1}
    cols = ["page", "char_count", "block_count", "used_ratio", "blank_after_pt", "starts_with_suite", "has_experience_heading", "used_top", "used_bottom"]
    return metrics.select(key, *[F.round(c, to[c]).alias(c) if c in to else F.col(c) for c in cols])


def break_issues(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, code: continued skills pages, dense skill blocks, and headings left alone at the end of a page.

    Blocks are rows (key, page, ord, y0, y1, text, height). A page's blocks and the text of the page after it are
    looked at in order; the first block with a finding ends a page's search. Windows hold one page or one document.
    """
    page, upto = W.partitionBy(key, "page").orderBy("ord"), W.partitionBy(key, "page").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rest = W.partitionBy(key, "page").orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    t = F.col("text")
    texts = blocks.groupBy(key, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("_page"))
    texts = texts.withColumn("_next", F.coalesce(F.lead("_page").over(W.partitionBy(key).orderBy("page")), F.lit("")))
    continued = F.col("_page").contains("(suite)") & F.col("_page").rlike(SKILL_HEADING) & ~F.substring_index("_page", "(suite)", 1).rlike(EXPERIENCE_SECTION)
    overflow = texts.where(continued).select(key, "page", F.lit("skill_overflow_page_created").alias("code"))
    leaves = experience_heading(t) | (t.rlike(EXPERIENCE_SECTION) & ~F.lower(t).contains("comp"))
    toggle = F.when(leaves, False).when(skill_heading(t), True)
    d = blocks.withColumn("_skills", F.coalesce(F.last(toggle, ignorenulls=True).over(upto), F.lit(False)))
    d = d.withColumn("_rest", F.coalesce(F.sum(F.length(F.trim("text"))).over(rest), F.lit(0)) + F.count("*").over(rest)).join(texts.drop("_page"), [key, "page"])
    marks = F.regexp_count("text", F.lit("[;,]"))
    dense = F.col("_skills") & ((F.length("text") >= DENSE_SKILL_CHARS) | (marks >= DENSE_SKILL_MARKS))
    alone = F.col("_rest") <= ORPHAN_CHARS
    again = fidelity(F.col("_next")).contains(F.concat(fidelity(t), F.lit(" suite"))) & (fidelity(t) != "")
    section = (F.length("text") <= HEADING_CHARS) & t.rlike(EXPERIENCE_SECTION) & alone & again
    opener = (F.col("y1") >= F.col("height") - ORPHAN_ZONE) & experience_heading(t) & alone & F.col("_next").rlike(EXPERIENCE_SECTION)
    codes = (
        F.when(dense & (F.length("text") >= DENSE_SKILL_CHARS), F.array(F.lit("skill_block_too_long"), F.lit("skills_too_dense")))
        .when(dense, F.array(F.lit("skills_too_dense")))
        .when(section, F.array(F.lit("experience_section_orphan_heading"), F.lit("bad_page_break")))
        .when(opener, F.array(F.lit("experience_orphan_heading"), F.lit("bad_page_break")))
    )
    hits = d.withColumn("_codes", codes).where("_codes is not null").withColumn("_i", F.row_number().over(page)).where("_i = 1")
    return overflow.unionByName(hits.select(key, "page", F.explode("_codes").alias("code")))


def rendered_hits(text: Column, forbidden: Column | None = None) -> Column:
    """Names of the contact patterns that a rendered text holds, then ``forbidden_name:`` and each forbidden name in it as a whole word."""
    found = [F.when(text.rlike(p), k) for k, p in RENDERED_CONTACTS.items()]
    hits = F.array_compact(F.array(*found))
    if forbidden is None:
        return hits
    quoted = lambda n: F.concat(F.lit(r"(?iu)(?<![A-Za-zÀ-ÿ])\Q"), n, F.lit(r"\E(?![A-Za-zÀ-ÿ])"))
    names = F.filter(forbidden, lambda n: (n != "") & F.rlike(text, quoted(n)))
    return F.concat(hits, F.transform(names, lambda n: F.concat(F.lit("forbidden_name:"), n)))


def report(docs: DataFrame) -> DataFrame:
    """Adds ``passed`` to reports (contact_hits, bad_glyphs, content_issues, overflow_hits, layout_codes, has_logo, has_watermark, pages): nothing found and everything there."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    clean = none("contact_hits") & ~F.col("bad_glyphs") & none("content_issues") & none("overflow_hits") & none("layout_codes")
    return docs.withColumn("passed", clean & F.col("has_logo") & F.col("has_watermark") & (F.col("pages") > 0))


# Scores that every quality report has, and the profiles that it may name.
SCORES = ("extraction", "fidelity", "layout", "overall")
PROFILES = ("normal", "senior_long", "ats", "scanned", "two_column", "graphic", "risky", "unknown")


def quality_report(rows: DataFrame, key: str, stage: str) -> DataFrame:
    """key, schema_version, source_profile, stage, scores, metrics, hard_blockers, soft_warnings of rows (key, profile, scores, metrics, hard, soft).

    ``scores`` and ``metrics`` are maps, ``hard`` and ``soft`` arrays of codes. Names and codes become safe ones, scores
    whole numbers of 0 to 100 (the four that every report has are 0 if absent); a metric with a contact is 1, a long one cut at 120 characters.
    """
    safe = lambda m, value: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(safe_code(e["key"]), value(e["value"]))))
    cut = lambda v: F.when(looks_like_contact(v), "1").otherwise(F.substring(v, 1, 120))
    have = F.coalesce(safe(F.col("scores"), lambda v: bounded_score(v).cast("int")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    base = F.create_map(*[x for s in SCORES for x in (F.lit(s), F.coalesce(F.try_element_at(have, F.lit(s)), F.lit(0)))])
    extra = F.map_filter(have, lambda k, _: ~k.isin(*SCORES))
    codes = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), safe_code)
    profile = F.when(F.col("profile").isin(*PROFILES), F.col("profile")).otherwise("unknown")
    return rows.select(
        key, F.lit(1).alias("schema_version"), profile.alias("source_profile"), safe_code(F.lit(stage)).alias("stage"), F.map_concat(base, extra).alias("scores"),
        safe(F.col("metrics"), cut).alias("metrics"), codes(F.col("hard")).alias("hard_blockers"), codes(F.col("soft")).alias("soft_warnings"),
    )


def draft_fallback(contact_hits: Column, has_logo: Column, has_watermark: Column, pages: Column, codes: Column, scored: Column) -> Column:
    """Whether a report that failed may go out as a draft: nothing but layout or taste speaks against it."""
    safe = (contact_hits <= 0) & has_logo & has_watermark & (pages > 0)
    return F.coalesce(safe & ((F.size(codes) > 0) | scored), F.lit(False))


def final_score(layout_issues: Column, fidelity_ok: Column) -> Column:
    return F.least(F.greatest(F.lit(0), F.lit(100) - layout_issues * 12), F.when(fidelity_ok, 100).otherwise(82))


def evaluated(cases: DataFrame, results: DataFrame) -> DataFrame:
    """id, passed, failures of cases (id, expected_status, required_terms, forbidden, max_pages) against results (id, status, text, pages).

    Cases with an array ``disallowed`` and results with an array ``codes`` also fail by a common code.
    """
    d = cases.join(results, "id", "left")
    codes = F.coalesce(F.arrays_overlap("disallowed", "codes"), F.lit(False)) if {"disallowed", "codes"} <= {*d.columns} else F.lit(False)
    missing = F.filter("required_terms", lambda t: ~F.coalesce(F.col("text").contains(t), F.lit(False)))
    failures = F.array_compact(
        F.array(
            F.when(~F.col("status").eqNullSafe(F.col("expected_status")), "status"),
            F.when(F.size(missing) > 0, "required_terms"),
            F.when(F.coalesce(F.rlike("text", F.col("forbidden")), F.lit(False)), "forbidden"),
            F.when(F.coalesce(F.col("pages"), F.lit(0)) > F.col("max_pages"), "max_pages"),
            F.when(codes, "disallowed_codes"),
        )
    )
    return d.select("id", failures.alias("failures")).withColumn("passed", F.size("failures") == 0)
