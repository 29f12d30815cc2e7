"""How much of a source survives in a text: facts, blocks and placeholders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import contains_fact, fidelity, substantial_tokens, text_of, tokens, without_accents

# Least overlap, and the rule for numbered placeholders.
LEAST_OVERLAP, LEAST_BASE, LEAST_NUMBERS, SPAN_SLACK = 0.65, 8, 3, 2
PLACEHOLDER = r"^(.{8,}?)[\s\x{a0}]+([1-9][0-9]?)$"
# Issue codes that leave a draft; any other code is hard.
SOFT_CODES = (
    "title_absent_from_source", "experience_location_missing_from_json", "experience_misclassified_as_formation", "experience_content_rewritten_or_absent_from_source",
    "source_coverage_missing_section", "synthetic_technical_environment", "source_coverage_missing_experience_item", "headerless_experience_sections",
    "company_highlight_absent_from_source", "experience_role_fact_absent_from_source", "experience_date_absent_from_source",
)


#: Most characters of facts whose tokens become patterns and go to every task.
MOST_FACT_CHARS = 400_000


def grams(c: Column) -> Column:
    """Distinct runs of three characters; the text is split once, so that a run doesn't cost a walk from the start."""
    some = F.array().cast("array<string>")
    runs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2))))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.coalesce(bound(letters(c), lambda x: F.when(F.size(x) >= 3, runs(x))), some)


def facts_found(facts: DataFrame, texts: DataFrame, fact_id: str, fact: str, text_id: str, text: str, most: int = MOST_FACT_CHARS) -> DataFrame:
    """fact_id, text_id of facts contained in a text as a substring, or by tokens of three or more letters anywhere in it or in its spaceless form.

    A text that holds a fact as a substring holds its tokens too, and what stands in a text stands in its spaceless form: so tokens in that form decide.
    Of facts of at most ``most`` characters in all, which are counted first, the tokens that the fewest facts have become patterns that find all of them in one walk through the text, so that a
    text meets the facts whose token it holds and nothing is shuffled. Beyond that, facts meet texts by the rarest run of three characters of
    their tokens. A fact without such a token is in every text (a pair for each, by the rule); an empty one matches nothing here.
    """
    f = facts.select(F.col(fact_id).alias("fact_id"), fidelity(F.col(fact)).alias("fact")).where("fact != ''")
    size = f.agg(F.coalesce(F.sum(F.length("fact")), F.lit(0))).first()[0]
    if size <= most:
        return _walked(f, texts.select(F.col(text_id).alias("text_id"), _tight(F.col(text)).alias("tight")))
    return _met(f, texts.select(F.col(text_id).alias("text_id"), fidelity(F.col(text)).alias("hay")))


def _tight(text: Column) -> Column:
    """The folded form (``fidelity``) without its spaces. Blanks go first, so that a pattern meets few marks instead of a match per word."""
    unmarked = lambda x: F.when(x.contains("page"), F.regexp_replace(x, r"\bpage\s+[0-9]+\s+(?:of|sur)\s+[0-9]+\b", " ")).otherwise(x)
    return F.regexp_replace(F.replace(bound(F.lower(without_accents(text_of(text))), unmarked), F.lit(" "), F.lit("")), "[^a-z0-9+#]+", "")


def _pattern(words: list[str]) -> str:
    """A pattern for any of the words, of which none begins another, branching by character."""
    if len(words) == 1:
        return re.escape(words[0])
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    return f"(?:{_branches(sorted(heads.items()))})"


def _branches(heads: list[tuple[str, list[str]]]) -> str:
    """Alternatives by first character; of many, a look ahead decides for one half of them, so that a place is compared with few."""
    if len(heads) <= 3:
        return "|".join(re.escape(c) + (_pattern(rest) if rest != [""] else "") for c, rest in heads)
    halves = heads[: len(heads) // 2], heads[len(heads) // 2 :]
    return "|".join(f"(?=[{''.join(re.escape(c) for c, _ in half)}])(?:{_branches(half)})" for half in halves)


def _layers(words: list[str]) -> list[list[str]]:
    """The words dealt to lists in none of which a word begins another: by how many of the others begin it."""
    every, out = set(words), []
    for w in sorted(every):
        n = sum(w[:k] in every for k in range(1, len(w)))
        while len(out) <= n:
            out.append([])
        out[n].append(w)
    return out


def _ranked(f: DataFrame) -> DataFrame:
    """fact_id and tokens of each fact, those that the fewest facts have first, of such the longest."""
    rows = f.select("fact_id", F.array_distinct(substantial_tokens(F.col("fact"))).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    each = rows.select("fact_id", "row", F.explode("tokens").alias("x"))
    known = each.join(each.groupBy("x").agg(F.count("*").alias("n")), "x")
    return known.groupBy("row", "fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", -F.length("x"), "x"))), lambda t: t["x"]).alias("tokens")).drop("row")


def _walked(f: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs by the first token of each fact, which the fewest facts have: at every place of a text, a look ahead by each layer's pattern of those.

    Only facts whose first token stands in a text are looked at further, by the text itself.
    """
    keyed = _ranked(f).withColumn("key", F.get("tokens", F.lit(0)))
    words = [r[0] for r in keyed.select("key").distinct().collect()]  # of counted size
    always = f.where(F.size(substantial_tokens(F.col("fact"))) == 0).select("fact_id").crossJoin(t.select("text_id"))
    if not words:
        return always
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("tight", F.lit(f"(?=({_pattern(layer)}))"), 1) for layer in _layers(words)]))
    # The outer form has no filter on the array's size, which would walk through each text a second time.
    some = t.select("text_id", "tight", F.explode_outer(found).alias("key")).where("key is not null")
    met = some.join(F.broadcast(keyed), "key")
    return met.where(F.forall("tokens", lambda x: F.col("tight").contains(x))).select("fact_id", "text_id").unionByName(always)


def _met(f: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs by an equality join on the rarest run of each fact; a text or its spaceless form must hold it. Texts are joined to the candidates that are left."""
    runs = f.select("fact_id", F.explode(F.array_distinct(F.flatten(F.transform(substantial_tokens(F.col("fact")), grams)))).alias("run"))
    held = t.select("text_id", F.explode(bound(F.col("hay"), lambda h: F.array_union(grams(h), grams(F.replace(h, F.lit(" "), F.lit("")))))).alias("run"))
    held = held.join(runs.select("run").distinct(), "run", "left_semi")
    known = held.groupBy("run").agg(F.count("*").alias("n"))
    rarest = runs.join(known, "run", "left").groupBy("fact_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("run")))["run"].alias("run"))
    pairs = held.join(rarest, "run").select("fact_id", "text_id").distinct().join(f, "fact_id").join(t, "text_id")
    found = pairs.where(contains_fact(F.col("hay"), F.col("fact"))).select("fact_id", "text_id")
    short = f.where(F.size(substantial_tokens(F.col("fact"))) == 0)
    return found.unionByName(short.select("fact_id").crossJoin(t.select("text_id")))


def overlap(block: Column, text: Column) -> Column:
    """Share of a block's distinct tokens that a text holds; null for a block without tokens."""
    own = F.array_distinct(tokens(block))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens(text))) / F.size(own))


def missing_blocks(pairs: DataFrame, block: str, text: str, least: float = LEAST_OVERLAP) -> DataFrame:
    """Rows whose required block is covered by less than ``least``."""
    return pairs.withColumn("overlap", F.round(overlap(F.col(block), F.col(text)), 6)).where(F.col("overlap") < least)


def placeholders(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base, numbers of lines repeated with running numbers: at least three, without wide gaps."""
    pieces = F.split(text_of(F.col(text)), "\n|[•▪●]")
    line = F.regexp_replace(F.regexp_replace(F.col("x"), r"\s+", " "), r"^[ \-–—•\t.;]+|[ \-–—•\t.;]+$", "")
    d = docs.select(key, F.explode(pieces).alias("x")).select(key, line.alias("x")).where(F.col("x").rlike(PLACEHOLDER))
    base = fidelity(F.regexp_extract("x", PLACEHOLDER, 1))
    d = d.select(key, base.alias("base"), F.regexp_extract("x", PLACEHOLDER, 2).cast("int").alias("n"))
    d = d.where((F.length("base") >= LEAST_BASE) & ~F.concat(F.lit(" "), "base", F.lit(" ")).contains(" suite"))
    g = d.groupBy(key, "base").agg(F.array_sort(F.collect_set("n")).alias("numbers"))
    n = F.size("numbers")
    return g.where((n >= LEAST_NUMBERS) & (F.element_at("numbers", -1) - F.element_at("numbers", 1) <= n + SPAN_SLACK))


def severity(code: Column) -> Column:
    return F.when(code.isin(*SOFT_CODES), "soft").otherwise("hard")


def issue_summary(issues: DataFrame, key: str) -> DataFrame:
    """key, hard_count, soft_count, codes of rows (key, code)."""
    s = severity(F.col("code"))
    return issues.groupBy(key).agg(F.count_if(s == "hard").alias("hard_count"), F.count_if(s == "soft").alias("soft_count"), F.array_sort(F.collect_set("code")).alias("codes"))
