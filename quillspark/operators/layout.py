"""Reading order, zones, overflow, and what a failed layout may try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Column borders as shares of the width, least blocks of two columns; margins; zones; codes.
LEFT_START, LEFT_END, LEFT_BLOCKS, MAIN_BLOCKS = 0.34, 0.42, 4, 6
MARGIN, TOLERANCE = 24.0, 1.5
SIDEBAR, SIDEBAR_LINES = ("skills", "education", "languages", "certifications"), 14
DENSE_SKILLS, SEPARATORS = 700, 18
SPARSE_CODES = ("last_page_sparse", "page_too_sparse", "page_underfilled_with_next_experience_fit")
DENSE_CODES = ("page_too_dense", "bad_page_break", "experience_orphan_heading", "experience_section_orphan_heading")


def reading_order(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ord (from 1) to blocks (key, page, width, x0, y0, x1): top to bottom, or header, main column and sidebar on two-column pages."""
    page = W.partitionBy(key, "page")
    left = (F.col("x0") < F.col("width") * LEFT_START) & (F.col("x1") < F.col("width") * LEFT_END)
    main = F.col("x0") >= F.col("width") * LEFT_START
    d = blocks.withColumn("_left", left).withColumn("_main", main)
    two = (F.count_if("_left").over(page) >= LEFT_BLOCKS) & (F.count_if("_main").over(page) >= MAIN_BLOCKS)
    header = ~F.col("_left") & ~F.col("_main") & (F.col("y0") <= F.min(F.when(F.col("_main"), F.col("y0"))).over(page) + 2)
    d = d.withColumn("_rank", F.when(~two, 0).when(header, 0).when(F.col("_left"), 2).otherwise(1))
    order = W.partitionBy(key).orderBy("page", "_rank", F.bround("y0", 1), F.bround("x0", 1))
    return d.withColumn("ord", F.row_number().over(order)).drop("_left", "_main", "_rank")


def overflow(blocks: DataFrame, margin: float = MARGIN, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per side on which a block (x0, y0, x1, y1, width, height) leaves the readable area."""
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.round(at, 2).alias("coordinate"), F.round(limit, 2).alias("limit"), out.alias("out"))
            for side, at, limit, out in (
                ("left", F.col("x0"), F.lit(margin), F.col("x0") < margin - tolerance),
                ("top", F.col("y0"), F.lit(margin), F.col("y0") < margin - tolerance),
                ("right", F.col("x1"), F.col("width") - margin, F.col("x1") > F.col("width") - margin + tolerance),
                ("bottom", F.col("y1"), F.col("height") - margin, F.col("y1") > F.col("height") - margin + tolerance),
            )
        ]
    )
    keep = [c for c in blocks.columns if c not in ("x0", "y0", "x1", "y1", "width", "height")]
    return blocks.select(*keep, F.explode(F.filter(sides, lambda s: s["out"])).alias("s")).select(*keep, "s.side", "s.coordinate", "s.limit")


def zones(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, zone, block_ids of required blocks (key, ord, block_id, type, estimated_lines): short ones of four types go beside."""
    zone = F.when(F.col("type").isin(*SIDEBAR) & (F.col("estimated_lines") <= SIDEBAR_LINES), "right_sidebar").otherwise("main")
    g = blocks.where("required").groupBy(key, zone.alias("zone")).agg(F.array_sort(F.collect_list(F.struct("ord", "block_id"))).alias("x"))
    return g.select(key, "zone", F.transform("x", lambda b: b["block_id"]).alias("block_ids"))


def plan_faults(required: Column, used: Column, known: Column) -> tuple[Column, Column]:
    """Required ids that a plan leaves out, and ids that it makes up."""
    return F.array_except(required, used), F.array_except(used, known)


def dense_skills(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, code for the first block of a page's skills area that is too long or has too many separators."""
    separators = F.length("text") - F.length(F.translate("text", ",;", ""))
    hits = blocks.where("in_skills").where((F.length("text") >= DENSE_SKILLS) | (separators >= SEPARATORS))
    first = hits.groupBy(key, "page").agg(F.min_by(F.length("text"), "ord").alias("n"))
    codes = F.array_compact(F.array(F.when(F.col("n") >= DENSE_SKILLS, "skill_block_too_long"), F.lit("skills_too_dense")))
    return first.select(key, "page", F.explode(codes).alias("code"))


def safe_to_retry(codes: Column, contacts: Column, identities: Column, glyphs: Column, integrity: Column, overflows: Column, logo: Column, watermark: Column) -> Column:
    """Only density faults, and nothing that a new layout could hide."""
    layout = F.arrays_overlap(codes, F.array(*[F.lit(c) for c in (*SPARSE_CODES, *DENSE_CODES)]))
    exposed = F.arrays_overlap(codes, F.array(F.lit("candidate_identity_term_exposed"), F.lit("full_name_display")))
    return layout & ~exposed & (contacts == 0) & (identities == 0) & ~glyphs & (integrity == 0) & (overflows == 0) & logo & watermark


def retry_options(codes: Column) -> Column:
    """Options of the second attempt: sparse pages win over dense ones; null if neither is there."""
    has = lambda names: F.arrays_overlap(codes, F.array(*[F.lit(c) for c in names]))
    options = lambda new, grouped, chars, ratio, reserve: F.struct(F.lit(new).alias("force_new_page"), F.lit(grouped).alias("allow_grouping"), F.lit(chars).alias("dense_chars"), F.lit(ratio).alias("max_used_ratio"), F.lit(reserve).alias("reserve"))
    return F.when(has(SPARSE_CODES), options(False, True, 2850, 0.86, 130)).when(has(DENSE_CODES), options(True, False, 2600, 0.80, 170))


def regressed(moved: Column, pages_before: Column, pages_after: Column, codes_after: Column) -> Column:
    """Whether a revision that moves the tail up added pages or left sparse ones."""
    sparse = F.arrays_overlap(codes_after, F.array(F.lit("page_too_sparse"), F.lit("last_page_sparse")))
    return moved & ((pages_after > pages_before) | sparse)


def attempts(variants: DataFrame, key: str, most: int = 2) -> DataFrame:
    """The first ``most`` variants (key, ord, options) with different options."""
    d = variants.withColumn("_o", F.to_json("options")).groupBy(key, "_o").agg(F.min("ord").alias("ord"), F.min_by("options", "ord").alias("options")).drop("_o")
    return d.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ord"))).where(F.col("_n") <= most).drop("_n")


def unchanged(before: Column, after: Column) -> Column:
    """Whether two structured values hold the same content."""
    return F.xxhash64(F.to_json(before)).eqNullSafe(F.xxhash64(F.to_json(after)))
