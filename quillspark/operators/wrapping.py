"""Lists of skills in blocks that can be read: items cut at their separators, blocks of limited number and length, continuations named. Nothing is dropped or rewritten."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import renderable, text_of
from quillspark.operators.skills import SKILLS, STRINGS

# Most characters of an item, most items and characters of a block, the mark of a continuation.
ITEM_CHARS, BLOCK_ITEMS, BLOCK_CHARS = 125, 8, 470
CONTINUED = " (suite)"


def wrapped(item: Column, most: int = ITEM_CHARS) -> Column:
    """An item in parts of at most ``most`` characters between its commas and semicolons, joined by commas; whole if it's short or has fewer than two of them.

    A part that is longer by itself stays whole. An empty item has none.
    """

    def of(x: Column) -> Column:
        pieces = F.filter(F.transform(F.split(x, r"\s*[;,]\s*"), lambda p: F.regexp_replace(p, r"^[ \t\n;,•]+|[ \t\n;,•]+$", "")), lambda p: p != "")
        marks = F.length(x) - F.length(F.translate(x, ",;", ""))
        start = F.struct(F.lit("").alias("held"), F.array().cast(STRINGS).alias("out"))

        def step(a: Column, p: Column) -> Column:
            joined = F.when(a["held"] == "", p).otherwise(F.concat_ws(", ", a["held"], p))
            full = (a["held"] != "") & (F.length(joined) > most)
            return F.struct(F.when(full, p).otherwise(joined).alias("held"), F.when(full, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]).alias("out"))

        parts = F.aggregate(pieces, start, step, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))
        whole = (F.length(x) <= most) | (marks < 2)
        return F.when(x == "", F.array().cast(STRINGS)).when(whole, F.array(x)).otherwise(bound(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(x))))

    return bound(F.regexp_replace(renderable(item), r"^\s+|\s+$", ""), of)


def blocks(items: Column, most: int = BLOCK_ITEMS, chars: int = BLOCK_CHARS) -> Column:
    """Array of arrays: neighbours in blocks. One closes before an item that would make it too long, or if it's full and more than one item is left.

    A fold with two capacities. Two characters count between items.
    """
    start = F.struct(F.array().cast(STRINGS).alias("held"), F.lit(0).alias("used"), F.lit(0).alias("seen"), F.array().cast(f"array<{STRINGS}>").alias("out"))

    def of(every: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            n = F.size(a["held"])
            left = F.size(every) - a["seen"] - 1
            closes = (n > 0) & (((n >= most) & (left > 0)) | (a["used"] + F.length(x) + 2 > chars))
            return F.struct(
                F.when(closes, F.array(x)).otherwise(F.concat(a["held"], F.array(x))).alias("held"),
                F.when(closes | (n == 0), F.length(x)).otherwise(a["used"] + F.length(x) + 2).alias("used"),
                (a["seen"] + 1).alias("seen"),
                F.when(closes, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]).alias("out"),
            )

        return F.aggregate(every, start, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))

    return bound(items, of)


def readable(skills: Column, item_chars: int = ITEM_CHARS, most: int = BLOCK_ITEMS, chars: int = BLOCK_CHARS) -> Column:
    """Skills in readable blocks: the first of a category has its name, the others are its continuations.

    A category without items is one empty block; nothing without name and items is left. Null arrays are empty.
    """

    def of(s: Column) -> Column:
        name = F.trim(text_of(s["category"]))
        every = F.flatten(F.transform(F.coalesce(s["items"], F.array().cast(STRINGS)), lambda x: wrapped(x, item_chars)))
        dealt = bound(every, lambda e: F.transform(blocks(e, most, chars), lambda b, i: F.struct(F.when(i == 0, name).otherwise(F.concat(name, F.lit(CONTINUED))).alias("category"), b.alias("items"))))
        empty = F.when(name == "", F.array().cast(SKILLS)).otherwise(F.array(F.struct(name.alias("category"), F.array().cast(STRINGS).alias("items"))).cast(SKILLS))
        return F.when(F.size(every) == 0, empty).otherwise(dealt.cast(SKILLS))

    return F.flatten(F.transform(F.coalesce(skills, F.array().cast(SKILLS)), of))
