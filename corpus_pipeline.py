"""From raw documents to token ids: language, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of documents;
the last returns ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, common, lang_id, mixing, near_dedup, pii
from quillspark.llm.registry import WORD_BPE, tokenizer_path
from quillspark.tables import table

#: SQL can't express the language model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None
#: A word and the white space before it.
UPTO_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with ``lang`` as identified; those without letters (null and empty texts too) go."""
    model = lang_id.fitted(docs.where(~lang_id.held_out()).select("text", "lang"))
    found = lang_id.identified(docs.select("text", F.struct(*_named(docs)).alias("doc")), model, ("doc",)).where(F.col("lang_pred") != lang_id.UNKNOWN)
    return found.select(*[(F.col("lang_pred") if c == "lang" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates; rows without a doc_id stay.

    Of rows that repeat a kept doc_id the one with the longest text stays, of equally long ones the first by text.
    """
    few = lambda ids: F.broadcast(ids) if ids.count() <= near_dedup.BROADCAST_IDS else ids
    gone = common.written(near_dedup.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    again = common.written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    kept = docs.join(few(gone), "doc_id", "left_anti").select(*_named(docs))
    once = kept.join(few(again), "doc_id", "left_anti")
    best = F.min_by(F.struct(*_named(docs)), F.struct(-F.coalesce(F.length("text"), F.lit(-1)), F.col("text")))
    more = kept.join(few(again), "doc_id", "left_semi").groupBy("doc_id").agg(best.alias("doc"))
    return once.select(*_named(docs)).unionByName(more.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns]))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, disclosing terms generalised or removed; ``n_chars`` follows the new text.

    Every row stays; a null text stays null and has a null ``n_chars``, an empty one has 0.
    """
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*_named(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its leaf's epochs take it; the last one of a leaf's prefix ends after its taken tokens, and ``n_chars`` follows.

    A text without words has no tokens to take, so its row goes; rows that repeat a doc_id are taken each for itself.
    """
    rows = common.written(docs.select(F.struct(*_named(docs)).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    taken = mixing.mixed(rows.select("row", *[F.col("doc").getField(c).alias(c) for c in ("doc_id", "text", "lang", "source")]), ("row",))
    taken = taken.where("epochs > 0").select("row", F.col("n_tokens").alias("n"), F.col("epochs").cast("int").alias("epochs"), F.col("taken_tokens").alias("taken"))
    out = rows.join(taken, "row").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    due = (F.col("taken") - (F.col("epoch") - 1) * F.col("n")).cast("int")
    text = F.col("doc").getField("text")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(UPTO_WORD), 0), F.lit(1), due), "")
    out = out.withColumn("cut", F.when(due < F.col("n"), part))
    new = {"text": F.coalesce("cut", text), "n_chars": F.coalesce(F.length("cut").cast(docs.schema["n_chars"].dataType), F.col("doc").getField("n_chars"))}
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (decimal, joined by a space), decoded_sha256 of every row; a null text is empty, with no ids."""
    codes = bpe.encoded(docs, tokenizer_path(WORD_BPE), ("doc_id", "lang", "source"))
    return codes.select("doc_id", "lang", "source", bpe.token_count(F.col("ids")).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", distinct), ("personal_data", private), ("mixing", mixed), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
