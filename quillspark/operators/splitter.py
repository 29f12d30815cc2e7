"""Long documents cut at headings and experience starts into blocks that a later step can take one by one.

A text's lines are cut into runs by boundary, runs are repaired, long ones are cut by size, and headings or crumbs
without content join their neighbours. Every step is a fold over one row's own array; nothing is shuffled and no
line with text is lost but those that the repair names as noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import compact, fidelity, text_of, without_accents
from quillspark.operators.structured import experience_start, heading_kind

# Sizes, and patterns of contact noise, of addresses and of an experience's body.
TARGET_CHARS, HEADING_CHARS, CRUMB_CHARS = 7000, 50, 450
CONTACT = r"(?iu)@|linkedin|https?://|\+33|\b0[67](?:[ .-]?[0-9]{2}){4}\b"
ADDRESS = r"(?iu)rue|avenue|boulevard|impasse|\b[0-9]{5}\b"
BODY = r"(?iu)(?<![\p{L}\p{N}_])(?:missions?|livrables?)(?![\p{L}\p{N}_])|environnement\s+technique"
BRIDGE = r"\b[0-9]+(?: [0-9]+)? competences\b"
BLANK = " \t\n\x0b\f\r"
SIDE = ("education", "skills", "header")

BLOCK = "struct<kind:string,text:string>"
BLOCKS = f"array<{BLOCK}>"


def _block(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"))


def _none() -> Column:
    return F.array().cast(BLOCKS)


def _nothing() -> Column:
    return F.lit(None).cast(BLOCK)


def _lines(text: Column) -> Column:
    """Lines with text, trimmed."""
    return F.filter(F.transform(F.split(text_of(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def cut(text: Column) -> Column:
    """Runs of lines as (kind, text): an experience start always opens one, a heading does unless it's one of experiences within an experience."""
    facts = F.transform(F.split(compact(text), "\n"), lambda x: F.struct(x.alias("line"), experience_start(x).alias("starts"), heading_kind(x).alias("heading")))
    state = F.struct(F.lit("header").alias("kind"), F.lit("").alias("held"), F.lit(False).alias("any"), _none().alias("out"))

    def step(a: Column, x: Column) -> Column:
        opens = (x["starts"] & a["any"]) | (x["heading"].isNotNull() & ~((x["heading"] == "experience") & (a["kind"] == "experience") & a["any"]))
        kind = F.when(x["starts"] & a["any"], "experience").when(opens, x["heading"]).otherwise(a["kind"])
        full = opens & (_trimmed(a["held"]) != "")
        return F.struct(
            kind.alias("kind"),
            F.when(opens | ~a["any"], x["line"]).otherwise(F.concat_ws("\n", a["held"], x["line"])).alias("held"),
            F.lit(True).alias("any"),
            F.when(full, F.concat(a["out"], F.array(_block(a["kind"], _trimmed(a["held"]))))).otherwise(a["out"]).alias("out"),
        )

    end = lambda a: F.when(_trimmed(a["held"]) != "", F.concat(a["out"], F.array(_block(a["kind"], _trimmed(a["held"]))))).otherwise(a["out"])
    return F.aggregate(facts, state, step, end)


def noise(block: Column) -> Column:
    """Empty blocks, experiences that hold contact data alone or nothing but a heading, and lone years."""
    own = _lines(block["text"])
    other = F.filter(own, lambda x: ~heading_kind(x).eqNullSafe(F.lit("experience")) & ~x.rlike(CONTACT) & ~x.rlike(ADDRESS))
    contact = (block["kind"] == "experience") & block["text"].rlike(CONTACT) & (F.size(other) == 0)
    heading = (block["kind"] == "experience") & heading_kind(block["text"]).eqNullSafe(F.lit("experience"))
    return (F.size(own) == 0) | contact | heading | _trimmed(block["text"]).rlike("^[0-9]{4}$")


def repaired(blocks: Column) -> Column:
    """Blocks without noise; an education block that begins as an experience is one; a header of an experience waits for the body that follows it."""
    state = F.struct(_nothing().alias("wait"), _none().alias("out"))
    flushed = lambda a: F.when(a["wait"].isNotNull(), F.concat(a["out"], F.array(a["wait"]))).otherwise(a["out"])

    def known(b: Column) -> Column:
        lines = _lines(b["text"])
        turned = (b["kind"] == "education") & F.coalesce(experience_start(F.get(lines, F.lit(0))), F.lit(False))
        # Only of experiences it matters whether they start one, and only of those that do whether they have a body.
        starts = lambda kind: F.struct(kind.alias("kind"), F.when(kind == "experience", F.exists(lines, experience_start)).otherwise(False).alias("starts"))
        full = lambda k: F.struct(k["kind"].alias("kind"), b["text"].alias("text"), k["starts"].alias("starts"), F.when(k["starts"], b["text"].rlike(BODY)).otherwise(False).alias("body"))
        return bound(F.when(turned, "experience").otherwise(b["kind"]), lambda kind: bound(starts(kind), full))

    def step(a: Column, b: Column) -> Column:
        own = _block(b["kind"], b["text"])
        experience = b["kind"] == "experience"
        waits, joins = experience & b["starts"] & ~b["body"], experience & ~b["starts"] & a["wait"].isNotNull()
        joined = _block(a["wait"]["kind"], F.concat(F.rtrim(a["wait"]["text"], F.lit(BLANK)), F.lit("\n"), F.ltrim(b["text"], F.lit(BLANK))))
        return F.struct(
            F.when(waits, own).when(joins, joined).otherwise(_nothing()).alias("wait"),
            F.when(waits, flushed(a)).when(joins, a["out"]).otherwise(F.concat(flushed(a), F.array(own))).alias("out"),
        )

    return F.aggregate(F.transform(F.filter(blocks, lambda b: ~noise(b)), known), state, step, flushed)


def sized(blocks: Column, target: int = TARGET_CHARS) -> Column:
    """Blocks of whole lines of at most ``target`` characters, unless one line is longer."""

    def parts(b: Column) -> Column:
        state = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            both = F.concat_ws("\n", a["held"], x)
            over = a["held"].isNotNull() & (F.length(_trimmed(both)) > target)
            return F.struct(F.when(over, x).otherwise(both).alias("held"), F.when(over, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]).alias("out"))

        cut_up = F.aggregate(F.split(b["text"], "\n"), state, step, lambda a: F.concat(a["out"], F.array(a["held"])))
        return F.when(F.length(b["text"]) <= target, F.array(_block(b["kind"], b["text"]))).otherwise(F.transform(cut_up, lambda x: _block(b["kind"], _trimmed(x))))

    return F.flatten(F.transform(blocks, parts))


def heading_only(block: Column) -> Column:
    """A single line that is a heading in capitals."""
    own = _lines(block["text"])
    line = F.get(own, F.lit(0))
    shown = without_accents(line)
    return (F.size(own) == 1) & (F.length(line) <= HEADING_CHARS) & heading_kind(line).isNotNull() & (shown == F.upper(shown)) & shown.rlike(r"\p{L}")


def with_headings(blocks: Column) -> Column:
    """Blocks that are headings alone end the block with content before them, or open the one after; without any they go."""
    state = F.struct(F.lit(None).cast("string").alias("wait"), _none().alias("out"))
    known = F.transform(blocks, lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), heading_only(b).alias("alone")))

    def step(a: Column, b: Column) -> Column:
        n = F.size(a["out"])
        last = F.element_at(a["out"], F.greatest(n, F.lit(1)))
        ended = F.concat(F.slice(a["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(_block(last["kind"], F.concat(F.rtrim(last["text"], F.lit(BLANK)), F.lit("\n"), _trimmed(b["text"]), F.lit("\n")))))
        first = F.when(a["wait"].isNotNull(), F.concat(a["wait"], F.lit("\n"), F.ltrim(b["text"], F.lit(BLANK)))).otherwise(b["text"])
        keeps = b["alone"] & (n == 0)
        return F.struct(
            F.when(keeps, F.coalesce(a["wait"], _trimmed(b["text"]))).alias("wait"),
            F.when(keeps, a["out"]).when(b["alone"], ended).otherwise(F.concat(a["out"], F.array(_block(b["kind"], first)))).alias("out"),
        )

    return F.aggregate(known, state, step, lambda a: a["out"])


def with_crumbs(blocks: Column) -> Column:
    """A short side block with a numbered heading of the skills opens the skills block that follows it."""
    state = F.struct(_nothing().alias("held"), _none().alias("out"))

    def crumb(b: Column, following: Column) -> Column:
        n = fidelity(b["text"])
        numbered = n.rlike(BRIDGE) | b["text"].rlike(r"\b[0-9]+\.[0-9]+\b") & n.rlike(r"\b[0-9]+\.[0-9]+\b")
        skills = (following["kind"] == "skills") | fidelity(following["text"]).contains("competences techniques")
        return (_trimmed(b["text"]) != "") & (F.length(_trimmed(b["text"])) <= CRUMB_CHARS) & b["kind"].isin(*SIDE) & numbered & skills

    def step(a: Column, b: Column) -> Column:
        own = _block(b["kind"], b["text"])
        joins = a["held"].isNotNull() & crumb(a["held"], b)
        joined = _block(b["kind"], F.concat(F.rtrim(a["held"]["text"], F.lit(BLANK)), F.lit("\n"), F.ltrim(b["text"], F.lit(BLANK))))
        done = F.when(a["held"].isNotNull(), F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"])
        return F.struct(F.when(joins, _nothing()).otherwise(own).alias("held"), F.when(joins, F.concat(a["out"], F.array(joined))).otherwise(done).alias("out"))

    return F.aggregate(blocks, state, step, lambda a: F.when(a["held"].isNotNull(), F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET_CHARS) -> DataFrame:
    """key, ord (from 1), kind, block of every row; a text that is null or empty gives no row.

    Each step reads the array of the one before once, so however the steps are collapsed, a fold runs once per row.
    """
    d = docs.select(key, cut(F.col(text)).alias("b"))
    for step in (repaired, lambda b: sized(b, target), repaired, with_headings, with_crumbs):
        d = d.select(key, step(F.col("b")).alias("b"))
    # The outer form has no filter on the array's size, which would run every step a second time.
    return d.select(key, F.posexplode_outer("b").alias("ord", "x")).where("ord is not null").select(key, (F.col("ord") + 1).alias("ord"), "x.kind", F.col("x.text").alias("block"))


def assembled(parts: DataFrame, key: str, first_name: Column | None = None) -> DataFrame:
    """One structured document per key of rows (key, ord, name, title, description, formations, skills, experiences).

    The first name, title and descriptions that aren't empty, the latter distinct and in order; lists one after the other.
    """
    some = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col("ord"))
    lists = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])).alias(c) for c in ("formations", "skills", "experiences")]  # noqa: B023
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(some("description").isNotNull(), F.struct("ord", "description")))), lambda x: F.trim(x["description"])))
    g = parts.groupBy(key).agg(F.trim(F.min_by("name", some("name"))).alias("name"), F.trim(F.min_by("title", some("title"))).alias("title"), F.array_join(texts, "\n").alias("description"), *lists)
    name = F.coalesce(*([first_name] if first_name is not None else []), F.col("name"), F.lit("CANDIDAT"))
    return g.withColumn("name", name).withColumn("title", F.coalesce("title", F.lit("Consultant IT")))
