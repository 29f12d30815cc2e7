"""Personal data: base patterns, and terms that disclose what they found; DataFrame functions only.

Base spans are the protected entities of a document. Every term (run of letters, lower-cased) of a document
co-occurs with its entities, and so does the class of each longer term (its first ``STEM`` letters and ``*``). Over
the whole corpus, with N documents, n(c) holding entity c, n(t) holding term or class t and n(c,t) holding both,

    PMI(c; t) = log2(n(c,t) N / (n(c) n(t)))   and   IC(c) = log2(N / n(c)).

A term discloses the share PMI / IC of what is to know about c. With ``SUPPORT`` documents behind it and a share of
``GENERALISE`` or more, a term is generalised to its class wherever it stands in a document that holds c. It is
removed there if its share is ``REMOVE`` or more, or if its class discloses c too (``GENERALISE``) or if it is no
longer than a class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
STEM, SUPPORT = 3, 3
GENERALISE, REMOVE = 0.8, 0.95
#: Most rows (rules, entities, repeated ids) that are broadcast; beyond it, a shuffled join takes over.
BROADCAST_ROWS = 100_000
#: Rows of texts with spans per partition, where terms are looked for.
ROWS_PER_TASK = 500

# The base patterns, written so that a failing start is never tried again within the same run of characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this holds no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
TERM = r"\p{L}+"
SPAN = "array<struct<s:int,e:int,v:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, not once per element of the lambdas that use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(a: Column) -> Column:
    """Running sums of an array of numbers, by blocks of about the square root of its size."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda y, z: y + z)

    def sums(a: Column, k: Column) -> Column:
        block = lambda i: F.floor(i / k).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(a) - 1)), lambda b: total(F.slice(a, b * k + 1, k)))
        before = lambda blocks: F.transform(blocks, lambda _, i: total(F.slice(blocks, F.lit(1), i)))
        inside = lambda i: total(F.slice(a, block(i) * k + 1, i - block(i) * k + 1))
        return bound(bound(blocks, before), lambda held: F.transform(a, lambda _, i: F.get(held, block(i)) + inside(i)))

    root = lambda a: F.greatest(F.lit(1), F.floor(F.sqrt(F.size(a))).cast("int"))
    return F.when(F.size(a) > 0, bound(a, lambda a: bound(root(a), lambda k: sums(a, k)))).otherwise(F.array().cast("array<int>"))


def matches(df: DataFrame, text: str, pattern: str, to: str, gate: Column) -> DataFrame:
    """Adds ``to``: the leftmost, non-overlapping matches (start and end in code points, value)."""
    hits, gaps = f"_{to}_hits", f"_{to}_gaps"
    df = df.withColumn(hits, F.when(gate, F.regexp_extract_all(text, F.lit(pattern), 0)))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.transform(F.split(text, pattern, -1), F.length)))
    size = F.size(hits)
    own = F.concat(F.array(F.lit(0)), F.transform(F.slice(hits, F.lit(1), size - 1), F.length))
    starts = running(F.zip_with(F.slice(gaps, F.lit(1), size), own, lambda g, h: g + h))
    span = lambda h, s: F.struct(s.alias("s"), (s + F.length(h)).alias("e"), h.alias("v"))
    found = F.when(size > 0, F.zip_with(hits, starts, span)).otherwise(F.array().cast(SPAN))
    return df.withColumn(to, found).drop(hits, gaps)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(9)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns email, ip, card, phone: arrays of valid spans. A null text has none."""
    out = docs
    for kind in KINDS:
        gate = F.col(text).contains("@") if kind == "email" else F.col(text).rlike(NEEDS[kind])
        out = matches(out, text, PATTERNS[kind], kind, F.coalesce(gate, F.lit(False)))
        out = out.withColumn(kind, F.when(F.size(kind) > 0, F.filter(kind, lambda x: valid(kind, x["v"]))).otherwise(F.array().cast(SPAN)))  # noqa: B023
    return out


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def class_of(t: Column) -> Column:
    return F.concat(F.left(t, F.lit(STEM)), F.lit("*"))


def with_classes(text: Column) -> Column:
    """The distinct terms of a text, and the classes of those longer than a class."""
    classes = lambda t: F.array_distinct(F.transform(F.filter(t, lambda x: F.length(x) > STEM), class_of))
    return bound(F.array_distinct(terms(text)), lambda t: F.concat(t, classes(t)))


def _entities() -> Column:
    """Of a row with the base spans: its distinct entities."""

    def named(kind: str):
        return lambda x: F.concat(F.lit(kind + ":"), F.lower(x["v"]) if kind == "email" else F.regexp_replace(x["v"], "[^0-9.]" if kind == "ip" else "[^0-9]", ""))

    return F.array_distinct(F.flatten(F.array(*[F.transform(k, named(k)) for k in KINDS])))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scanned(documents: DataFrame, carry: list[str]) -> DataFrame:
    """_carry (the columns ``carry``), _id, _text and _key (null without spans), base spans, _entities of every row; written."""
    d = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    d = base_spans(d, "_text")
    some = F.size(F.concat(*KINDS)) > 0
    slim = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    key = F.when(some, F.monotonically_increasing_id())
    return common.written(d.select("_carry", "_id", F.when(some, F.col("_text")).alias("_text"), *slim, F.when(some, _entities()).alias("_entities"), key.alias("_key")), "spans")


def _counted(rows: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n: documents of each; rows (_id, by) are distinct but for the ids in ``again``, which are made so."""
    once = rows.join(again, "_id", "left_anti").select(*by)
    more = rows.join(again, "_id", "left_semi").distinct().select(*by)
    return once.unionByName(more).groupBy(*by).agg(F.count("*").alias("n"))


def disclosing(found: DataFrame, documents: DataFrame) -> DataFrame:
    """c, t, action of every disclosing pair of the corpus; written."""
    again = common.written(found.where("_id is not null").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"), "again")
    some = again.count()
    alone, repeated = found.join(_few(again), "_id", "left_anti").count(), some
    total = F.lit(float(alone + repeated))
    again = F.broadcast(again) if some <= BROADCAST_ROWS else again
    own = found.where("_key is not null").select("_id", "_key", F.explode("_entities").alias("c"))
    n_c = _counted(own.select("_id", "c"), again, ["c"]).where(F.col("n") >= SUPPORT).withColumnRenamed("n", "n_c")
    n_c = common.written(n_c, "entities")
    held = own.join(_few(n_c.select("c")), "c", "left_semi").groupBy("_key").agg(F.collect_set("c").alias("cs"))
    both = found.where("_key is not null").select("_id", "_key", "_text").join(held, "_key").select("_id", "cs", F.explode(with_classes(F.col("_text"))).alias("t"))
    pairs = _counted(both.select("_id", F.explode("cs").alias("c"), "t"), again, ["c", "t"]).where(F.col("n") >= SUPPORT).withColumnRenamed("n", "n_ct")
    pairs = common.written(pairs, "pairs")
    every = common.narrow(documents, "doc_id", "text").select(F.col("doc_id").alias("_id"), F.explode(with_classes(F.col("text"))).alias("t"))
    n_t = _counted(every, again, ["t"]).withColumnRenamed("n", "n_t").join(_few(pairs.select("t").distinct()), "t", "left_semi")
    share = F.log2(F.col("n_ct") * total / (F.col("n_c") * F.col("n_t"))) / F.log2(total / F.col("n_c"))
    shares = pairs.join(_few(n_c), "c").where(F.col("n_c") < total).join(n_t, "t").select("c", "t", share.alias("share")).where(F.col("share") >= GENERALISE)
    shares = common.written(shares, "shares")
    stems = shares.where("endswith(t, '*')").select("c", F.col("t").alias("stem")).withColumn("known", F.lit(True))
    out = shares.where("not endswith(t, '*')").withColumn("stem", class_of(F.col("t"))).join(_few(stems), ["c", "stem"], "left")
    gone = (F.col("share") >= REMOVE) | F.col("known").isNotNull() | (F.length("t") <= STEM)
    rules = common.written(out.select("c", "t", F.when(gone, "remove").otherwise("generalise").alias("action")), "rules")
    common.dropped(n_c, pairs, shares)
    return rules


def _spans(documents: DataFrame, carry: list[str]) -> DataFrame:
    """_carry, _text (null without spans), email, ip, card, phone, term of every row; see ``spans``."""
    found = scanned(documents, carry)
    rules = disclosing(found, documents)
    with_rules = _few(rules.select("c").distinct())
    own = found.where("_key is not null").select("_key", "_text", F.filter("_entities", lambda c: c.isNotNull()).alias("cs"))
    held = own.select("_key", F.explode("cs").alias("c")).join(with_rules, "c", "left_semi").groupBy("_key").agg(F.collect_set("c").alias("cs"))
    held = own.select("_key", "_text").join(held, "_key").select("_key", "cs", F.explode(F.array_distinct(terms(F.col("_text")))).alias("t"))
    chosen = held.select("_key", "t", F.explode("cs").alias("c")).join(_few(rules), ["c", "t"]).groupBy("_key", "t").agg(F.max("action").alias("action"))
    chosen = chosen.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("t", "action"))).alias("_rules"))
    kind = "array<struct<s:int,e:int,action:string>>"
    some = found.where("_key is not null")
    tasks = some.count() // ROWS_PER_TASK + 1
    some = some.repartition(tasks, "_key").join(chosen, "_key", "left")
    some = matches(some, "_text", TERM, "_words", F.col("_rules").isNotNull())
    base = F.concat(*KINDS)
    hit = F.filter("_words", lambda x: F.map_contains_key("_rules", F.lower(x["v"])) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    term = F.when(F.col("_rules").isNotNull(), F.transform(hit, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at("_rules", F.lower(x["v"])).alias("action")))).otherwise(F.array().cast(kind))
    cols = ["_carry", "_text", *KINDS]
    rest = found.where("_key is null").select(*cols, F.array().cast(kind).alias("term"))
    return some.select(*cols, term.cast(kind).alias("term")).unionByName(rest)


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, _text (null without spans), email, ip, card, phone, term of every row of ``documents`` (doc_id, text).

    Spans are (s, e) in code points, end exclusive; a term's also have the action, and terms within base
    spans are left out. Rows that repeat a doc_id count as one document in the statistics, rows without a
    doc_id as one each; a null text has no spans.
    """
    return _spans(documents, ["doc_id"]).select("_carry.doc_id", "_text", *KINDS, "term")


def sanitised(documents: DataFrame) -> DataFrame:
    """``documents`` with each span of its text replaced: [EMAIL] and the like, the class of a generalised term, nothing for a removed one.

    Where spans of several kinds overlap, the first one by start, then the longest, is replaced. A null text
    stays null; columns of any name are carried along.
    """
    names = documents.columns
    out = _spans(documents, names)
    mark = "array<struct<s:int,ne:int,to:string>>"
    marked = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), F.lit(f"[{k.upper()}]").alias("to"))).cast(mark) for k in KINDS]  # noqa: B023
    stem = lambda x: class_of(F.substring("_text", x["s"] + 1, x["e"] - x["s"]))
    marked.append(F.transform("term", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), F.when(x["action"] == "remove", "").otherwise(stem(x)).alias("to"))).cast(mark))
    out = out.withColumn("_all", F.when(F.col("_text").isNotNull(), F.sort_array(F.concat(*marked))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        more = F.array(F.substring("_text", a["at"] + 1, x["s"] - a["at"]), x["to"])
        return F.when(x["s"] < a["at"], a).otherwise(F.struct((-x["ne"]).alias("at"), F.concat(a["parts"], more).alias("parts")))

    whole = F.aggregate("_all", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("_text", a["at"] + 1, F.length("_text"))))
    kept = lambda c: F.col("_carry").getField(c)
    text = F.when(F.col("_text").isNotNull(), whole).otherwise(kept("text"))
    return out.select(*[text.alias(c) if c == "text" else kept(c).alias(c) for c in names])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_removed, n_generalised (terms), base_sha256, spans of ``spans``'s result."""
    listed = {k: F.transform(F.array_sort(k), lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string"))) for k in (*KINDS, "term")}  # noqa: B023
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    counts += [F.size(F.filter("term", lambda x: x["action"] == a)).cast("long").alias(to) for a, to in (("remove", "n_removed"), ("generalise", "n_generalised"))]  # noqa: B023
    base = F.concat(*[listed[k] for k in KINDS])
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, listed["term"]), ",").alias("spans"))
