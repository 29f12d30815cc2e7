"""Removal of contacts and identity terms from blocks, and the guard of a rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import text_of

# What leaves a block, in this order.
CONTACTS = {
    "linkedin": r"(?iu)(?:https?://)?(?:www\.)?linkedin\.com/in/[^\s,;]+",
    "email": r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?U)(?:(?:\+33|0)\s*[1-9](?:[\s.-]*\d{2}){4})",
    "url": r"(?iu)https?://[^\s,;]+",
}
#: A text without this holds no contact of the kind.
NEEDS = {"linkedin": lambda t: t.rlike("(?iu)/in/"), "email": lambda t: t.contains("@"), "phone": lambda t: t.contains("0") | t.contains("+33"), "url": lambda t: t.contains("://")}
# What a rationale mustn't hold.
PERSONAL = r"(?i)(?:[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}|(?:\+?\d[\d\-().\s]{7,}\d)|(?:https?://[^\s]+)|(?:linkedin\.com/[^\s]+)|(?:/(?:in|pub)/[a-zA-Z0-9_-]+))"
NAMES = r"(?U)\b[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+\b(?:\s+[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+\b){2,}"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def whole_word(term: Column) -> Column:
    """A pattern for the term as it stands between word borders, whatever its case."""
    # Letters are compared before borders, which are slow to tell.
    plain = F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(F.lit("(?iuU)(?="), plain, F.lit(r")\b"), plain, F.lit(r"\b"))


def _without(text: Column, n: Column, terms: Column) -> Column:
    """Struct text, n after the terms left one by one."""
    start = F.struct(text.alias("text"), n.cast("long").alias("n"))
    # Every match is as long as its term, so what is gone tells their number.
    gone = lambda a, left, t: F.struct(left.alias("text"), (a["n"] + ((F.length(a["text"]) - F.length(left)) / F.length(t)).cast("long")).cast("long").alias("n"))
    take = lambda a, t: bound(F.regexp_replace(a["text"], whole_word(t), F.lit("")), lambda left: gone(a, left, t))
    return F.aggregate(terms, start, take)


def sanitised(blocks: DataFrame, text: str = "text", terms: str = "terms", first_name: str = "first_name") -> DataFrame:
    """``text`` of each row without contacts and identity terms, without blank lines, and n_<kind>, n_identity.

    Blank terms and the candidate's own first name don't count. Null texts, terms and names are empty.
    """
    d = blocks.withColumn(text, text_of(F.col(text)))
    for kind, pattern in CONTACTS.items():
        d = d.withColumn(f"n_{kind}", F.when(NEEDS[kind](F.col(text)), F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long"))
        d = d.withColumn(text, F.when(F.col(f"n_{kind}") > 0, F.regexp_replace(text, pattern, "")).otherwise(F.col(text)))
    own = F.lower(F.trim(text_of(F.col(first_name))))
    named = F.filter(F.transform(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: (t != "") & (F.lower(t) != own))
    left = d.withColumn("_left", _without(F.col(text), F.lit(0), named))
    lines = F.transform(F.split(F.col("_left.text"), LINE_END), lambda x: F.trim(F.regexp_replace(x, r"(?U)[\s\x1C-\x1F]+", " ")))
    return left.withColumn(text, F.array_join(F.filter(lines, lambda x: x != ""), "\n")).withColumn("n_identity", F.col("_left.n")).drop("_left")


def unsafe_rationale(text: Column) -> Column:
    """Does a text hold personal data, or three capitalised words in a row? False for null."""
    return text_of(text).rlike(PERSONAL) | text_of(text).rlike(NAMES)
