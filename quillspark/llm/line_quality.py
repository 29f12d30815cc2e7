"""Quality rules with cross-document line frequency; DataFrame functions only.

Base counts come from each whole text alone. The method hashes every normalised line, counts the distinct
documents of each host (``source``) that hold it, removes lines above the limit (``cleaned``), and rejects
documents that lose the most part of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: A line is removed if more documents of its host hold it than this number, whatever the host's size.
LINE_DOCS = 10
#: A document is depleted if more than this share (per cent) of its words stands in removed lines.
DEPLETED_PERCENT = 50
#: Most frequent lines that are broadcast; beyond it, a shuffled join takes over.
BROADCAST_LINES = 10_000
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(text, common.WS), lambda w: w != "")


def normalised(line: Column) -> Column:
    """A-Z lower-cased, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), common.WS, " "))


def _long(c: Column) -> Column:
    return c.cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to rows with a ``text``.

    Windows of three words are compared by 64-bit hashes. Where some repeat, the positions of repeated
    ones are found by sorting (hash, position), and the words they cover are summed from the gaps.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    none = F.array().cast("array<bigint>")
    d = docs.withColumn("_lines", lines).withColumn("_w", words(text))
    d = d.select(
        *docs.columns,
        _long(F.size("_w")).alias("n_words"),
        _long(F.length(F.translate(text, BLANKS, ""))).alias("word_chars"),
        _long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.size("_w") > 2, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(none).alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(repeats, pairs))
    twice = F.filter("_s", lambda e, i: (e["h"] == F.get("_s", i - 1)["h"]) | (e["h"] == F.get("_s", i + 1)["h"]))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda e: e["i"]))))
    covered = F.aggregate(F.transform("_p", lambda v, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", _long(F.coalesce(covered, F.lit(0)))).drop("_h", "_s", "_p")


def held_lines(docs: DataFrame) -> DataFrame:
    """host, line (hash), doc_id of each distinct normalised line of a document."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    each = docs.select("doc_id", F.col("source").alias("host"), line.alias("l")).withColumn("l", normalised(F.col("l"))).where("l != ''")
    return each.select("host", F.xxhash64("l").alias("line"), "doc_id").distinct()


def frequent(lines: DataFrame) -> DataFrame:
    """h (host), l: the lines above the limit; written."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    return common.written(counts.where(F.col("n") > LINE_DOCS).select(F.col("host").alias("h"), F.col("line").alias("l")), "often")


def cleaned(documents: DataFrame) -> DataFrame:
    """``documents`` with the lines above the limit of their host taken out of each text; the others stay as they are, in order.

    A null text stays null. Rows that repeat a doc_id are one document for line counts. Few frequent lines are
    broadcast by host; beyond ``BROADCAST_LINES`` each document gets its own ones by a shuffled join.
    """
    docs = common.narrow(documents, "doc_id", "text", "source")
    lines = common.written(held_lines(docs), "lines")
    often = frequent(lines)
    if often.count() <= BROADCAST_LINES:
        gone = F.broadcast(often.groupBy(F.col("h").alias("_host")).agg(F.collect_set("l").alias("_gone")))
        d = documents.join(gone, F.col("source").eqNullSafe(F.col("_host")), "left")
    else:
        held = lines.join(often, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
        gone = held.groupBy(F.col("doc_id").alias("_id"), F.col("host").alias("_host")).agg(F.collect_set("line").alias("_gone"))
        d = documents.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_host")), "left")
    stays = lambda x: ~F.array_contains("_gone", F.xxhash64(normalised(x)))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
    return d.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])


def quality(documents: DataFrame) -> DataFrame:
    """The base counts, base_failed, removed_words and kept of every row of ``documents`` (doc_id, text, source).

    removed_words are the words that ``cleaned`` takes out. A null text is an empty one. Rows that repeat a
    doc_id (null included) are one document for line counts and depletion, and keep base counts of their own.
    A null source is a host of its own.
    """
    docs = common.narrow(documents, "doc_id", "text", "source").withColumn("whole", F.col("text"))
    left = F.when(~F.col("text").eqNullSafe(F.col("whole")), _long(F.size(words(F.coalesce("text", F.lit(""))))))
    d = cleaned(docs).select("doc_id", F.col("whole").alias("text"), left.alias("_left"))
    base = common.written(base_counts(d).drop("text"), "base")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    lost = base.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("n_words").alias("_words"), F.sum(F.col("n_words") - F.coalesce("_left", "n_words")).alias("removed_words"))
    out = base.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")))
    kept = ~F.col("base_failed") & ~(F.col("removed_words") * 100 > F.col("_words") * DEPLETED_PERCENT)
    return out.withColumn("kept", kept).drop("_id", "_left", "_words")
