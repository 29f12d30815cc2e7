"""Blocks, sections and chunks of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import block_id, estimated_lines, fingerprint, squeezed, text_of, tokens, word

# Headers of sections in order, and the rules for what follows them.
HEADERS = (
    ("experience", "exp[ée]riences?|parcours|missions?"),
    ("skills", "comp[ée]tences?|skills?|technologies?"),
    ("education", "formations?|dipl[oô]mes?|education"),
    ("languages", "langues?"),
    ("certifications", "certifications?"),
)
HEADER_CHARS, CHUNK_CHARS = 80, 7000
DATES = r"(?iu)\b(?:19|20)[0-9]{2}\b.*\b(?:19|20)[0-9]{2}|\baujourd[’']?hui\b"
ROLES = "d[ée]veloppeur|consultant|architecte|ing[ée]nieur|chef de projet|tech lead|lead"
CONTINUES = r"(?iu)^(?:r[ée]alisations? cl[ée]s?|missions?|livrables?|environnement technique)(?![\p{L}\p{N}_])"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = r"\n\s*\n") -> DataFrame:
    """key, ord (from 1), block of every block with text; with its id, size, lines, tokens and fingerprint."""
    parts = F.filter(F.transform(F.split(text_of(F.col(text)), separator), lambda x: F.trim(x)), lambda x: x != "")
    d = docs.select(key, F.posexplode(parts).alias("ord", "block")).withColumn("ord", F.col("ord") + 1)
    return d.select(
        key,
        "ord",
        "block",
        block_id(F.lit("other"), F.col("ord"), F.col("block")).alias("block_id"),
        F.length("block").cast("long").alias("char_count"),
        estimated_lines(F.col("block")).cast("long").alias("estimated_lines"),
        F.size(tokens(F.col("block"))).cast("long").alias("token_count"),
        fingerprint(F.col("block")).alias("fingerprint"),
    )


def header_kind(block: Column) -> Column:
    t = squeezed(block)
    out = F.lit(None).cast("string")
    for kind, words in reversed(HEADERS):
        out = F.when(t.rlike(word(words)), kind).otherwise(out)
    return F.when(F.length(t) <= HEADER_CHARS, out)


def carried(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds header (of the block itself) and section: the last header up to the block, ``other`` before any."""
    upto = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    d = parts.withColumn("header", header_kind(F.col("block")))
    return d.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(upto), F.lit("other")))


def sections(docs: DataFrame, key: str = "doc_id", items: str = "blocks") -> DataFrame:
    """key, types: the section type of each block of an ordered array of blocks.

    A fold, since a continuation line looks at the type that the block before was given.
    """
    start = F.struct(F.lit("other").alias("now"), F.array().cast("array<string>").alias("types"))
    experience = lambda b: b.rlike(DATES) & b.rlike(word(ROLES))

    def step(a: Column, b: Column) -> Column:
        head = header_kind(b)
        goes_on = (F.coalesce(F.try_element_at(a["types"], F.lit(-1)), F.lit("")) == "experience") & F.trim(b).rlike(CONTINUES)
        kind = F.when(head.isNotNull(), "other").when(goes_on | experience(b), "experience").otherwise(a["now"])
        return F.struct(F.coalesce(head, a["now"]).alias("now"), F.concat(a["types"], F.array(kind)).alias("types"))

    return docs.select(key, F.aggregate(items, start, step, lambda a: a["types"]).alias("types"))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = CHUNK_CHARS) -> DataFrame:
    """key, part (from 1), chars of chunks of whole lines, each of at most ``target`` characters unless one line is longer.

    Greedy, so a fold over the lengths of a text's lines; chunk texts are cut from the line array afterwards.
    """
    lines = F.split(text_of(F.col(text)), "\n")
    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("part"), F.array().cast("array<int>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        over = (a["used"] > 0) & (a["used"] + x > target)
        part = a["part"] + F.when(over, 1).otherwise(0)
        return F.struct(F.when(over, x + 1).otherwise(a["used"] + x + 1).alias("used"), part.alias("part"), F.concat(a["parts"], F.array(part)).alias("parts"))

    parts = F.when(F.length(text_of(F.col(text))) <= target, F.array_repeat(F.lit(1), F.size(lines))).otherwise(F.aggregate(F.transform(lines, lambda x: F.length(x)), start, step, lambda a: a["parts"]))
    d = docs.select(key, F.posexplode(F.arrays_zip(lines.alias("line"), parts.alias("part"))).alias("ord", "x")).select(key, "ord", "x.line", "x.part")
    return d.groupBy(key, "part").agg((F.sum(F.length("line")) + F.count("*") - 1).cast("long").alias("chars"), F.count("*").alias("lines"))
