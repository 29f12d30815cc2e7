"""Queries of skills, languages and families. The part table stands in: a brand is a document, its parts in the order of their keys are items, types are categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import gating, plans, skills, visual, wrapping
from quillspark.operators.skills import LANGUAGES, SKILLS
from quillspark.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _put(number, cases: dict[int, str], otherwise):
    """Texts put in place of some items, by a number of theirs."""
    out = otherwise
    for k, v in cases.items():
        out = F.when(number == k, v).otherwise(out)
    return out


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and items (in the order of ``ord``) of rows (keys, ord, item)."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("x"))
    return g.select(*keys, F.transform("x", lambda x: x["item"]).alias("items"))


def _skills(rows: DataFrame, key: str) -> DataFrame:
    """key and skills of rows (key, category, ord, item), categories in the order of their names."""
    g = _listed(rows, key, "category").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("category", "items"))).cast(SKILLS).alias("skills"))
    return g


def _unfolded(d: DataFrame, key: str, column: str = "skills") -> DataFrame:
    """key, rank, category, items (joined) of skills."""
    return d.select(key, F.posexplode(column).alias("rank", "s")).select(key, "rank", F.col("s.category").alias("category"), F.array_join("s.items", ";").alias("items"))


LANGUAGE_ITEMS = {0: "anglais", 1: "Lu, parlé", 3: "Espagnol : B2 ", 4: " C1", 7: "Allemand", 8: "-"}


def _language_items(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_brand", F.col("p_partkey").alias("ord"), _put(F.col("p_partkey") % 11, LANGUAGE_ITEMS, F.col("p_name")).alias("item"))


@query
def hoisted_languages(spark, d):
    """Items left and languages found of each brand."""
    h = _listed(_language_items(spark, d), "p_brand").select("p_brand", skills.hoisted(F.col("items")).alias("h"))
    spoken = F.transform("h.languages", lambda x: F.concat_ws(":", x["name"], x["level"]))
    return h.select("p_brand", F.array_join("h.remaining", ";").alias("remaining"), F.array_join(spoken, ";").alias("languages"), F.size(skills.merged(F.col("h.languages"))).cast("long").alias("n_languages"))


DISPLAY_ITEMS = {0: "AWS", 1: "docker-compose", 2: "Docker  Compose.", 3: "SQLserver", 4: "Outils: vim, gulp / Redis", 5: "Bootstrap JavaScript: Node.js, nodejs", 6: " ,"}
DISPLAY_TYPES = {"ECONOMY": "Autres", "STANDARD": "Cloud / DevOps", "PROMO": "Data — suite 2"}


def _display_rows(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.col("p_type")
    for k, v in DISPLAY_TYPES.items():
        kind = F.when(F.col("p_type") == k, v).otherwise(kind)
    return p.select("p_brand", kind.alias("category"), F.col("p_partkey").alias("ord"), _put(F.col("p_partkey") % 23, DISPLAY_ITEMS, F.col("p_name")).alias("item"))


@query
def display_skills(spark, d):
    """One label per key over all categories of a brand, in the order of its categories and parts."""
    return _unfolded(_skills(_display_rows(spark, d), "p_brand").withColumn("skills", skills.displayed(F.col("skills"))), "p_brand")


SECTION = "COMPÉTENCES\nCloud: AWS, AZURE\n➢\nData bases: MySQL, SQLserver,\nPostegreSQL\n➢ TOGAF, C4\nJardinage\n➢ Windows\nAnglais\nLu, parlé\nFORMATIONS\nOracle"


@query
def merged_skills(spark, d):
    """Skills of a brand merged with those of a source: each third brand's source has a skills section, after its parts' names."""
    own = _skills(_display_rows(spark, d).where("ord % 5 = 0"), "p_brand")
    source = F.concat(F.lit("Profil\n"), F.col("p_brand"), F.when(F.substring("p_brand", 7, 9).cast("int") % 3 == 0, F.concat(F.lit("\n"), F.lit(SECTION))).otherwise(""))
    docs = own.withColumn("source", source).withColumn("languages", F.array(F.struct(F.lit("anglais").alias("name"), F.lit("").alias("level"))).cast(LANGUAGES))
    m = skills.with_skills(docs)
    level = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["name"], x["level"])), ";")
    return _unfolded(m, "p_brand").join(m.select("p_brand", level.alias("languages")), "p_brand")


FAMILY_ITEMS = {0: "Java", 1: "Spring, React", 2: "PostgreSQL", 3: "git|gitlab ci", 4: "Kubernetes; Helm", 5: "Javanais", 6: ".NET core", 7: "Cybersécurité", 8: "cyber"}


@query
def skill_families(spark, d):
    """Long and generic categories of a brand dealt to families in parts of six; one category is a source's own, one holds certifications."""
    kind = F.when(F.col("p_type") == "ECONOMY", "Compétences techniques").when(F.col("p_type") == "PROMO", "Processus métiers").when(F.col("p_type") == "SMALL", "Certifications").when(F.col("p_type") == "LARGE", "Projets").otherwise(F.col("p_type"))
    item = F.when(F.col("p_partkey") % 19 < 9, _put(F.col("p_partkey") % 19, FAMILY_ITEMS, F.lit(""))).otherwise(F.concat_ws(" ", "p_name", F.col("p_size") % 4))
    rows = table(spark, d, "part").where("p_type != 'STANDARD' or p_partkey % 7 = 0").select("p_brand", kind.alias("category"), F.col("p_partkey").alias("ord"), item.alias("item"))
    return _unfolded(_skills(rows, "p_brand").withColumn("skills", skills.grouped_long(F.col("skills"))), "p_brand")


@query
def grouped_certifications(spark, d):
    """Orders as documents, their line items as formations: those of some parts are certifications."""
    n = F.col("l_partkey")
    degree = F.when(n % 2 == 0, F.concat(F.lit("Scrum "), n)).when(n % 3 == 0, "Master AWS").when(n % 5 == 0, "ITIL").otherwise("Licence")
    f = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(n % 7 > 0, F.year("l_shipdate").cast("string")).alias("date"), degree.alias("degree"), F.when(n % 4 > 0, F.concat(F.lit("S"), F.col("l_suppkey") % 3)).alias("school"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(f)).alias("x"))
    own = F.transform("x", lambda x: F.struct(x["date"].alias("date"), x["degree"].alias("degree"), x["school"].alias("school")))
    g = lists.select("l_orderkey", F.posexplode(skills.grouped_certifications(own, 3)).alias("rank", "f"))
    return g.select("l_orderkey", "rank", F.coalesce("f.date", F.lit("")).alias("date"), "f.degree", F.coalesce("f.school", F.lit("")).alias("school"))


RESCUE_ITEMS = {0: "Arabe 5 Français 4 Java17", 1: "Anglais — courant", 2: "anglais COURANT", 3: "turc hindi 2"}
CERTIFICATE_ITEMS = {0: "Oracle Certified", 1: "oracle  certified", 2: "PMP", 3: "Moto"}


@query
def rescued_skills(spark, d):
    """Languages and certifications that stand among the skills of a brand, and what is left; one part in ten is listed under each."""
    p = table(spark, d, "part").where("p_partkey % 10 < 4")
    kind = F.when(F.col("p_type") == "SMALL", "Langues").when(F.col("p_type") == "STANDARD", "Certifications").when(F.col("p_type") == "PROMO", "Langages").when(F.col("p_type") == "ECONOMY", "Backend").otherwise(F.col("p_type"))
    n = F.col("p_partkey") % 10
    item = F.when(kind == "Langues", F.when(F.col("p_partkey") % 3 > 0, _put(n, RESCUE_ITEMS, F.lit(""))).otherwise(F.col("p_name"))).when(kind == "Certifications", _put(n, CERTIFICATE_ITEMS, F.lit(""))).otherwise(F.col("p_name"))
    own = _skills(p.select("p_brand", kind.alias("category"), F.col("p_partkey").alias("ord"), item.alias("item")), "p_brand")
    docs = own.withColumn("languages", F.array(F.struct(F.lit("Turc").alias("name"), F.lit("").alias("level"))).cast(LANGUAGES)).withColumn("certifications", F.array(F.lit("pmp")))
    r = skills.rescued(docs)
    spoken = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["name"], x["level"])), ";")
    return _unfolded(r, "p_brand").join(r.select("p_brand", spoken.alias("languages"), F.array_join("certifications", ";").alias("certifications")), "p_brand")


@query
def environment_families(spark, d):
    """Technical terms of a supplier's parts, by family."""
    sold = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber").join(table(spark, d, "part"), "p_partkey")
    item = _put(F.col("p_partkey") % 17, {0: "React, Java | java / Docker", 1: "Sécurité, SQL Server", 2: " , "}, F.concat_ws("/", "p_name", F.lower("p_type")))
    lists = _listed(sold.select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "p_partkey").alias("ord"), item.alias("item")), "l_suppkey")
    return lists.select("l_suppkey", skills.technical_terms(F.col("items")).alias("terms"))


@query
def readable_skill_blocks(spark, d):
    """Skills of a brand in readable blocks; some parts are long lists of others' names."""
    p = table(spark, d, "part")
    long = F.concat_ws(", ", "p_name", F.repeat(F.concat(F.col("p_name"), F.lit("; ")), (F.col("p_size") % 20).cast("int")), "p_brand")
    rows = p.select("p_brand", F.col("p_type").alias("category"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 6 == 0, long).when(F.col("p_partkey") % 6 == 1, F.repeat("p_brand", (F.col("p_size") % 25).cast("int"))).otherwise(F.col("p_name")).alias("item"))
    return _unfolded(_skills(rows, "p_brand").withColumn("skills", wrapping.readable(F.col("skills"))), "p_brand")


BLOCK_TEXTS = {0: "Compétences Java", 1: "Mainframe", 2: "Front-end\nReact, Vue (a, b)", 3: "3 / 6", 4: "Base De Données", 5: "Maintenance applicative", 6: "Technologies"}


@query
def visual_skills(spark, d):
    """Suppliers as documents, the items that they sold as text blocks at places made of quantity, discount and tax."""
    t = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    n = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 211
    text = F.when((n == 210) & (F.col("l_linenumber") > 1), "Langues").otherwise(_put(n % 13, BLOCK_TEXTS, F.concat_ws(", ", "p_name", F.col("l_partkey") % 50)))
    b = t.select("l_suppkey", F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("y0"), (F.col("l_discount") * 100).alias("x0"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("ord"), text.alias("text"))
    s = visual.skills(b, "l_suppkey")
    return s.select("l_suppkey", "confidence", F.array_join("warnings", ",").alias("warnings"), F.size("skills").cast("long").alias("categories"), F.md5(F.array_join(F.transform("skills", lambda x: F.concat_ws("=", x["category"], F.array_join(x["items"], ";"))), "|")).alias("skills"))


@query
def overridden_skills(spark, d):
    """Which suppliers' skills the visual ones replace."""
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.array(F.struct(F.lit("Backend").alias("category"), F.array(F.col("s_name")).alias("items"))).cast(SKILLS).alias("skills"))
    li = table(spark, d, "lineitem")
    n = F.col("l_partkey") % 9
    text = _put(n, {0: "Compétences", 1: "Java", 2: "Ops", 3: "Data"}, F.concat(F.lit("item "), F.col("l_partkey") % 30))
    b = li.where("l_suppkey % 4 > 0").select("l_suppkey", F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("y0"), F.lit(0.0).alias("x0"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("ord"), text.alias("text"))
    out = visual.overridden(t, visual.skills(b, "l_suppkey"), "l_suppkey")
    return out.select("l_suppkey", F.coalesce("source_override.confidence", F.lit(0.0)).alias("confidence"), F.array_join(F.transform("skills", lambda s: s["category"]), ",").alias("categories"))


@query
def plan_contract(spark, d):
    """Orders as documents, their lines as blocks (returned ones are required), and a plan for each in JSON with faults put in."""
    li = table(spark, d, "lineitem")
    block = F.concat(F.lit("b"), F.col("l_linenumber"))
    b = li.select(F.col("l_orderkey").alias("doc_id"), block.alias("block_id"), (F.col("l_returnflag") == "R").alias("required"))
    k = F.col("doc_id")
    ids = b.groupBy("doc_id").agg(F.array_sort(F.collect_list("block_id")).alias("ids"))
    ids = ids.withColumn("ids", F.when(k % 7 == 0, F.concat("ids", F.array(F.lit("b99")))).when(k % 7 == 1, F.slice("ids", 2, 99)).otherwise(F.col("ids")))
    zone, strategy = F.when(k % 11 == 0, "margin").otherwise("main"), F.when(k % 13 == 0, "odd").otherwise("compact")
    plan = F.struct(strategy.alias("strategy"), F.create_map(zone, F.col("ids")).alias("page_assignments"), F.when(k % 5 == 0, "dense").otherwise("normal").alias("variant_density"), F.when(k % 17 == 0, "see https://a.example").when(k % 19 > 0, "short").alias("rationale"))
    raw = F.when(k % 23 == 0, "{broken").when(k % 3 == 0, F.concat(F.lit("```json\n"), F.to_json(plan), F.lit("\n```"))).otherwise(F.to_json(plan))
    checked = plans.checked(ids.select("doc_id", raw.alias("raw")), b)
    codes = F.array_join(F.transform("faults", lambda f: F.concat_ws(":", f["code"], f["subject"])), ",")
    return checked.select("doc_id", "accepted", codes.alias("faults"))


@query
def syntheses(spark, d):
    """Orders as documents, their lines as experiences; modes and leave by the order's priority."""
    li = table(spark, d, "lineitem")
    n = F.col("l_partkey")
    sections = F.array(F.struct(F.lit("Missions").alias("heading"), F.transform(F.sequence(F.lit(1), n % 4), lambda i: F.when(n % 4 > 0, F.concat(F.lit("m"), i)).otherwise("")).alias("content")), F.struct(F.lit("Stack").alias("heading"), F.array(F.when(n % 3 == 0, "Java, React").otherwise(" ")).alias("content")))
    e = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_suppkey").cast("string").alias("date"), sections.alias("sections")).alias("e"))
    docs = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"]).alias("experiences")).join(table(spark, d, "orders"), "o_orderkey")
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "Urgent").when(F.col("o_orderpriority") == "2-HIGH", " standard").when(F.col("o_orderpriority") == "3-MEDIUM", "fidele").when(F.col("o_orderpriority") == "5-LOW", "odd")
    docs = docs.select("o_orderkey", mode.alias("mode"), (F.col("o_orderkey") % 4 > 0).alias("allow_condensation"), "experiences", F.array().cast(SKILLS).alias("skills"), F.array().cast(skills.FORMATIONS).alias("formations"))
    out = gating.synthesised(docs)
    section = lambda s: F.concat_ws("=", s["heading"], F.array_join(s["content"], ";"))
    every = F.array_join(F.transform("experiences", lambda x: F.array_join(F.transform(x["sections"], section), "/")), "|")
    return out.select("o_orderkey", "synthesis_mode", F.md5(every).alias("experiences"))


@query
def covered_skills(spark, d):
    """Whether the skills of a brand's parts of some sizes cover those of others, for two names of a section and one that is none."""
    p = table(spark, d, "part")
    lists = lambda when: F.collect_list(F.when(when, F.concat_ws(" ", "p_name", F.col("p_size") % 3)))
    g = p.groupBy("p_brand").agg(lists(F.col("p_partkey") % 40 == 0).alias("want"), lists(F.col("p_partkey") % 7 < 4).alias("have"))
    of = lambda c: skills.keys(F.array(F.struct(F.lit("x").alias("category"), F.col(c).alias("items"))).cast(SKILLS))
    section = F.when(F.substring("p_brand", 7, 9).cast("int") % 4 == 0, "Projets").when(F.substring("p_brand", 7, 9).cast("int") % 4 == 1, "COMPÉTENCES").otherwise("Compétences et outils :")
    return g.select("p_brand", skills.covered(section, of("want"), of("have")).alias("covered"))
