"""Source profiles of texts, and the gate that sends weak ones to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import text_of, word

# Marker words, thresholds in characters, lines and markers, and scores.
MISSION_WORDS = "mission|projet|client|exp[ée]rience|consultant|d[ée]veloppeur|architecte"
ATS_WORDS = "tjm|disponibilit[ée]|mobilit[ée]|permis|salaire|contrat"
ATS_MARKERS, SCANNED_CHARS, LONG_CHARS, LONG_MARKERS, SHORT_LINE, SHORT_SHARE, SHORT_LINES = 3, 250, 9000, 10, 18, 0.58, 45
REVIEW_SCANNED, REVIEW_CHARS, REVIEW_LINES = 500, 250, 5
SCORES = {"scanned": 35, "two_column": 72}
SCORE = 88


def profiled(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds profile, chars, line_count, mission_markers, ats_markers, short_line_ratio, needs_review, extraction_score.

    Works on trimmed lines with text; a null text is empty, and so scanned and for review.
    """
    lines = F.filter(F.transform(F.split(text_of(F.col(text)), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    d = docs.withColumn("_lines", lines).withColumn("_norm", F.lower(F.array_join("_lines", "\n")))
    n = F.size("_lines")
    d = d.select(
        *docs.columns,
        F.length(F.array_join("_lines", "\n")).cast("long").alias("chars"),
        n.cast("long").alias("line_count"),
        F.regexp_count("_norm", F.lit(word(MISSION_WORDS))).cast("long").alias("mission_markers"),
        F.regexp_count("_norm", F.lit(word(ATS_WORDS))).cast("long").alias("ats_markers"),
        (F.size(F.filter("_lines", lambda x: F.length(x) <= SHORT_LINE)) / F.greatest(n, F.lit(1))).alias("_ratio"),
    )
    profile = (
        F.when(F.col("ats_markers") >= ATS_MARKERS, "ats")
        .when((F.col("chars") < SCANNED_CHARS) & (F.col("ats_markers") == 0), "scanned")
        .when((F.col("chars") > LONG_CHARS) | (F.col("mission_markers") >= LONG_MARKERS), "senior_long")
        .when((F.col("_ratio") > SHORT_SHARE) & (F.col("line_count") > SHORT_LINES), "two_column")
        .otherwise("normal")
    )
    d = d.withColumn("profile", profile).withColumn("short_line_ratio", F.round("_ratio", 3)).drop("_ratio")
    review = ((F.col("profile") == "scanned") & (F.col("chars") < REVIEW_SCANNED)) | (F.col("chars") < REVIEW_CHARS) | (F.col("line_count") < REVIEW_LINES)
    score = F.lit(SCORE)
    for k, v in SCORES.items():
        score = F.when(F.col("profile") == k, v).otherwise(score)
    return d.withColumn("needs_review", review).withColumn("extraction_score", score)
