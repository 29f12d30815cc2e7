"""Mixing sources to target weights by hierarchical budgets; DataFrame functions only.

A budget of tokens flows down the tree domain - language - source. Among siblings it's dealt by weight;
what a node can't take (its tokens times ``MAX_EPOCHS``) goes to its siblings in proportion to their
weights, and so never to a cousin while a sibling has room. Each leaf then takes its budget from
seeded epochs: whole passes over the leaf, then the prefix of one more shuffled pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SEED = 7
#: Tokens to select, per cent of all tokens.
BUDGET_PERCENT = 60
#: Most times a document may be taken.
MAX_EPOCHS = 2
#: Domain of a source by the number in its name, and weights; anything else has weight 1.
DOMAINS = ("web", "books", "code", "forum")
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "code": 10, "forum": 20}
LANG_WEIGHTS = {"en": 50, "fr": 20, "de": 20, "es": 10}
#: Hex digits of the hash that order a leaf's buckets: 4096 buckets.
DIGITS = 3


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int)"), F.lit(0)) % len(DOMAINS)
    return F.get(F.array(*[F.lit(x) for x in DOMAINS]), number)


def weight(col: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(col) == k, v).otherwise(out)
    return out.cast("decimal(38,0)")


def dealt(nodes: DataFrame, parents: list[str], key: str) -> DataFrame:
    """Adds ``take`` to nodes (parents, key, w, cap, budget of the parent): shares by weight, no more than cap.

    Siblings in order of cap / w: those before the first whose cap exceeds its share of what's left are
    filled, the others share the rest by weight, rounded down. The windows hold the nodes of a tree,
    never documents.
    """
    order = W.partitionBy(*parents).orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), key)
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    n = nodes.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("decimal(38,0)")).withColumn("weights", F.sum("w").over(after).cast("decimal(38,0)"))
    left = F.col("budget").cast("decimal(38,0)") - F.col("spent")
    n = n.withColumn("open", (F.col("cap") * F.col("weights") > left * F.col("w")))
    first = F.min(F.when(F.col("open"), F.struct("spent", "weights"))).over(W.partitionBy(*parents))
    n = n.withColumn("first", first)
    share = F.expr("((cast(budget as decimal(38,0)) - first.spent) * w) div first.weights")
    filled = F.col("first").isNull() | (F.col("spent") < F.col("first.spent"))
    return n.withColumn("take", F.when(filled, F.col("cap").cast("long")).otherwise(F.least(share, F.col("cap").cast("long")))).drop("spent", "weights", "open", "first")


def budgets(leaves: DataFrame) -> DataFrame:
    """domain, lang, source, tokens, take of leaves (domain, lang, source, tokens)."""
    cap = (F.sum("tokens") * MAX_EPOCHS).cast("decimal(38,0)").alias("cap")
    domains = leaves.groupBy("domain").agg(cap, F.sum("tokens").alias("tokens")).withColumn("w", weight("domain", DOMAIN_WEIGHTS)).withColumn("root", F.lit(0))
    domains = domains.withColumn("all", F.sum("tokens").over(W.partitionBy("root"))).withColumn("budget", F.expr(f"`all` * {BUDGET_PERCENT} div 100"))
    domains = dealt(domains, ["root"], "domain").select("domain", F.col("take").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(cap).withColumn("w", weight("lang", LANG_WEIGHTS)).join(domains, "domain")
    langs = dealt(langs, ["domain"], "lang").select("domain", "lang", F.col("take").alias("budget"))
    sources = leaves.withColumn("cap", (F.col("tokens") * MAX_EPOCHS).cast("decimal(38,0)")).withColumn("w", F.lit(1).cast("decimal(38,0)")).join(langs, ["domain", "lang"])
    return dealt(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "take")


def sized(documents: DataFrame, tokens: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry``, doc_id, domain, lang, source, n_tokens (white-space words unless given) of each row; null names are ``unknown``."""
    n = tokens if tokens is not None else F.size(F.filter(F.split(F.coalesce("text", F.lit("")), common.WS), lambda w: w != ""))
    unknown = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("lang", "source")]
    return documents.select(*carry, "doc_id", *unknown, n.cast("long").alias("n_tokens")).withColumn("domain", domain_of(F.col("source")))


def mixed(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry``, doc_id, domain, lang, source, n_tokens, epochs, taken_tokens of every row of ``documents`` (doc_id, text, lang, source).

    epochs: how many times the document is taken whole or in part; taken_tokens: over all epochs (the last
    document of a leaf's prefix may be taken in part). Order within an epoch: md5 of seed, epoch and
    doc_id; equal ids take their rows in order of size. A null doc_id orders as the empty text.

    A leaf is summed by 4096 buckets of that order; only rows of the one bucket per leaf in which the prefix
    ends are sorted, so that no leaf meets in one task.
    """
    docs = common.written(sized(common.narrow(documents, *carry, "doc_id", "text", "lang", "source"), carry=carry), "sized")
    leaf = ["domain", "lang", "source"]
    leaves = docs.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves).withColumn("passes", F.expr("if(tokens = 0, 0L, take div tokens)")).withColumn("rest", F.col("take") - F.col("passes") * F.col("tokens"))
    marks = docs.join(plan.select(*leaf, "passes", "rest"), leaf)
    marks = marks.withColumn("mark", F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    marks = common.written(marks.withColumn("bucket", F.substring("mark", 1, DIGITS)), "marks")
    sums = marks.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("held"))
    upto = W.partitionBy(*leaf).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    rows = marks.join(sums, [*leaf, "bucket"])
    whole = rows.where("before + held <= rest").withColumn("more", F.col("n_tokens"))
    none = rows.where("before >= rest and before + held > rest").withColumn("more", F.lit(0).cast("long"))
    inside = W.partitionBy(*leaf, "bucket").orderBy("mark", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    edge = rows.where("before < rest and before + held > rest").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least("n_tokens", F.col("rest") - F.col("at")))).drop("at")
    out = whole.unionByName(none).unionByName(edge)
    return out.select(*carry, "doc_id", *leaf, "n_tokens", (F.col("passes") + (F.col("more") > 0).cast("long")).alias("epochs"), (F.col("passes") * F.col("n_tokens") + F.col("more")).alias("taken_tokens"))
