"""Proposed layout plans: JSON parsed tolerantly, and held against the blocks of their document; every fault is a row's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import unused
from quillspark.functions.scalars import bound
from quillspark.functions.text import text_of
from quillspark.operators.blocks import unsafe_rationale

# Keys of a plan, its strategies, zones and densities, and the longest rationale.
KEYS = ("page_assignments", "rationale", "strategy", "variant_density")
STRATEGIES = ("natural", "compact", "sidebar_heavy", "experience_first", "deterministic_content_preserving")
ZONES = ("header", "main", "right_sidebar", "left_sidebar", "footer")
DENSITIES = ("comfortable", "normal", "compact")
LONGEST_RATIONALE = 280

FAULT = "array<struct<code:string,subject:string>>"


def unfenced(raw: Column) -> Column:
    """A text without the fence of a code block around it."""
    x = F.trim(F.regexp_replace(text_of(raw), r"^\s+|\s+$", ""))
    inside = F.regexp_replace(F.regexp_replace(x, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)\s*```\s*$", "")
    return F.when(x.startswith("```"), F.regexp_replace(inside, r"^\s+|\s+$", "")).otherwise(x)


def _kind(plan: Column, path: str) -> Column:
    """The type of what stands at a path of a variant: OBJECT<...>, ARRAY<...>, STRING and so on; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(plan, path, "variant"))


def parsed(plans: DataFrame, raw: str = "raw") -> DataFrame:
    """``plans`` with strategy, density, rationale, zones (array of zone, ids), and parse_faults (array of code, subject).

    What can't be read is null and has a fault: invalid_json, not_an_object, missing_key, invalid_strategy, assignments_not_an_object,
    unauthorized_zone, ids_not_a_list, invalid_density, rationale_not_a_string. A null text is invalid.
    """
    body, plan = unused(plans, "body", "plan")
    d = plans.withColumn(body, unfenced(F.col(raw))).withColumn(plan, F.try_parse_json(body))
    p = F.col(plan)
    whole = F.schema_of_variant(p).startswith("OBJECT")
    text = lambda path: F.when(_kind(p, path) == "STRING", F.try_variant_get(p, path, "string"))
    assigned = _kind(p, "$.page_assignments").startswith("OBJECT")
    # Values as they stand in the JSON, so that one that is no list is seen as such.
    values = F.when(assigned, F.from_json(F.to_json(F.struct(F.try_variant_get(p, "$.page_assignments", "map<string,variant>").alias("m"))), "m map<string,string>")["m"])
    entries = F.coalesce(F.array_sort(F.map_entries(values)), F.array().cast("array<struct<key:string,value:string>>"))
    zones = F.transform(entries, lambda e: F.struct(e["key"].alias("zone"), F.when(e["value"].startswith("["), F.from_json(e["value"], "array<string>")).alias("ids")))
    d = d.withColumns({"strategy": text("$.strategy"), "density": text("$.variant_density"), "rationale": F.trim(text("$.rationale")), "zones": zones})
    fault = lambda when, code, subject=None: F.when(when, F.struct(F.lit(code).alias("code"), (F.lit("") if subject is None else subject).alias("subject")))
    has = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    missing = F.transform(F.filter(F.array(*map(F.lit, KEYS)), lambda k: ~F.array_contains(has, k)), lambda k: F.struct(F.lit("missing_key").alias("code"), k.alias("subject")))
    given = lambda k: F.array_contains(has, k)
    unknown_zones = F.transform(F.filter("zones", lambda z: ~z["zone"].isin(*ZONES)), lambda z: F.struct(F.lit("unauthorized_zone").alias("code"), z["zone"].alias("subject")))
    no_lists = F.transform(F.filter("zones", lambda z: z["ids"].isNull()), lambda z: F.struct(F.lit("ids_not_a_list").alias("code"), z["zone"].alias("subject")))
    single = F.array_compact(F.array(
        fault(given("strategy") & ~F.coalesce(F.col("strategy").isin(*STRATEGIES), F.lit(False)), "invalid_strategy", text_of(F.col("strategy"))),
        fault(given("page_assignments") & ~F.coalesce(assigned, F.lit(False)), "assignments_not_an_object"),
        fault(given("variant_density") & ~F.coalesce(F.col("density").isin(*DENSITIES), F.lit(False)), "invalid_density", text_of(F.col("density"))),
        fault(given("rationale") & F.col("rationale").isNull(), "rationale_not_a_string"),
    ))
    unread = F.when(p.isNull(), F.array(fault(F.lit(True), "invalid_json"))).when(~whole, F.array(fault(F.lit(True), "not_an_object")))
    every = F.coalesce(unread.cast(FAULT), F.concat(missing.cast(FAULT), single.cast(FAULT), unknown_zones.cast(FAULT), no_lists.cast(FAULT)))
    return d.withColumn("parse_faults", every).drop(body, plan)


def checked(plans: DataFrame, blocks: DataFrame, key: str = "doc_id", raw: str = "raw") -> DataFrame:
    """``plans`` parsed, with ``faults`` (those of the parser and of the contract, sorted) and ``accepted`` (none).

    Blocks are (key, block_id, required). Contract: every id is one of the document's (unknown_block), stands once (doubled_block), and the required
    ones are there (missing_block); the rationale is short and holds neither contacts nor a name. A document without blocks knows no id.
    """
    ids, required = unused(plans, "ids", "required")
    known = blocks.groupBy(key).agg(F.array_sort(F.collect_set("block_id")).alias(ids), F.array_sort(F.collect_set(F.when(F.col("required"), F.col("block_id")))).alias(required))
    d = parsed(plans, raw).join(known, key, "left")
    none = F.array().cast("array<string>")
    used = F.flatten(F.transform("zones", lambda z: F.coalesce(z["ids"], none)))
    doubled = lambda u: F.filter(F.array_distinct(u), lambda i: F.size(F.filter(u, lambda j: j.eqNullSafe(i))) > 1)
    faults = lambda code, subjects: F.transform(subjects, lambda s: F.struct(F.lit(code).alias("code"), text_of(s).alias("subject"))).cast(FAULT)
    rationale = F.array_compact(F.array(F.when(F.length("rationale") > LONGEST_RATIONALE, F.lit("rationale_too_long")), F.when(unsafe_rationale(F.col("rationale")), F.lit("unsafe_rationale"))))
    readable = ~F.exists("parse_faults", lambda f: f["code"].isin("invalid_json", "not_an_object"))
    # The ids used are read for each of them, so they're bound: else they'd be taken from the JSON again for each.
    contract = F.concat(
        bound(used, lambda u: F.concat(faults("unknown_block", F.array_except(F.array_distinct(u), F.coalesce(F.col(ids), none))), faults("doubled_block", doubled(u)), faults("missing_block", F.array_except(F.coalesce(F.col(required), none), u)))),
        F.transform(rationale, lambda c: F.struct(c.alias("code"), F.lit("").alias("subject"))).cast(FAULT),
    )
    every = F.array_sort(F.concat(F.col("parse_faults"), F.when(readable, contract).otherwise(F.array().cast(FAULT))))
    return d.withColumn("faults", every).withColumn("accepted", F.size("faults") == 0).drop("parse_faults", ids, required)
