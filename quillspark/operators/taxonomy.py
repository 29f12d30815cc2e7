"""Skill terms: splitting, keys, categories, de-duplication, grouping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import folded_label, skill_key, squeezed, text_of

# Keywords of the categories, in the order in which they are tried.
KEYWORDS = (
    ("Architecture & Conception", ("architecture", "urbanisation", "referentiel", "soa", "eda", "eip", "paas", "iaas", "caas", "stream-processing", "asynchrone", "conception")),
    ("Cloud & DevOps", ("aws", "azure", "gcp", "docker", "kubernetes", "openshift", "jenkins", "gitlab", "nexus", "devops", "ci/cd", "cicd", "terraform", "svn", "github", "bitbucket", "webpack", "gulp", "bower", "lambda", "apigateway", "api gateway", "cloudfront")),
    ("Observabilité", ("dynatrace", "elastic", "logstash", "kibana", "grafana", "graphana", "beats", "apm", "sla", "slo")),
    ("Sécurité", ("jwt", "oauth", "jaas", "loginmodule", "ldap", "x509", "openssl", "pkcs", "owasp", "authentification", "signature", "non-repudiation", "non repudiation")),
    ("Bases de données", ("sql", "mysql", "postgres", "oracle", "mongodb", "sybase", "db2", "mariadb", "hibernate", "dynamodb", "redis")),
    ("Langages & Frameworks", ("java", "spring", "php", "c#", "node", "typescript", "jni", "jdbc", "groovy", "angular", "html5", "websocket", "react", "vue", "next", "symfony", "drupal", "ezpublish", "zend", "doctrine", "sass", "less", "bootstrap", "jquery", "redux", "requirejs", "javascript", "es6", "css3")),
    ("Méthodologies", ("togaf", "c4", "ddd", "safe", "scrum", "agile", "roadmap", "audit", "directeur", "direction d'equipe", "jira", "confluence", "redmine", "mantis", "code review")),
    ("Systèmes & Environnements", ("linux", "rhel", "aix", "centos", "ubuntu", "windows", "apache", "nginx", "phpstorm", "sublime", "postman", "assembla", "akamai", "algolia", "auth0", "cognito")),
)
GROUP_SIZE = 6


def category_of_folded(t: Column) -> Column:
    """The first category of which a folded value holds a keyword; null without. One pattern per category."""
    out = F.lit(None).cast("string")
    for name, words in reversed(KEYWORDS):
        out = F.when(t.rlike("|".join(map(re.escape, words))), name).otherwise(out)
    return out


def category(value: Column) -> Column:
    """The first category with a keyword in the value, which is folded once; null without."""
    return bound(folded_label(value), category_of_folded)


def split_values(c: Column) -> Column:
    """Values between commas, semicolons and spaced slashes, squeezed, without repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[,;]|\s/\s"), squeezed), lambda x: x != ""))


def top_level_commas(c: Column) -> Column:
    """Parts between commas at depth 0 of parentheses, squeezed, without ``,;:•`` at their ends; empty ones are left out.

    Depth is counted from piece to piece between commas: a closing parenthesis at depth 0 counts nothing. A null text has none.
    """
    cut = lambda x: F.regexp_replace(squeezed(x), r"^[ ,;:•]+|[ ,;:•]+$", "")

    def depth(before: Column, piece: Column) -> Column:
        marks = F.filter(F.split(F.regexp_replace(piece, "[^()]", ""), ""), lambda m: m != "")
        return F.aggregate(marks, before, lambda d, m: F.greatest(d + F.when(m == "(", 1).otherwise(-1), F.lit(0)))

    def step(a: Column, piece: Column) -> Column:
        held = F.when(a["depth"] > 0, F.concat_ws(",", a["held"], piece)).otherwise(piece)
        done = F.when((a["depth"] == 0) & a["held"].isNotNull(), F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"])
        return F.struct(held.alias("held"), depth(a["depth"], piece).alias("depth"), done.alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("held"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    found = F.aggregate(F.split(text_of(c), ","), start, step, lambda a: F.concat(a["out"], F.array(a["held"])))
    return F.filter(F.transform(found, cut), lambda x: x != "")


def deduplicated(items: DataFrame, key: str) -> DataFrame:
    """key, skill_key, value, category, ord: the first of each skill key by ``ord`` of rows (key, ord, value, category)."""
    d = items.withColumn("skill_key", skill_key(F.col("value")))
    return d.groupBy(key, "skill_key").agg(F.min_by(F.struct("value", "category", "ord"), "ord").alias("x")).select(key, "skill_key", "x.*")


def grouped(items: DataFrame, key: str, size: int = GROUP_SIZE) -> DataFrame:
    """key, category, part, values: the values of a category in parts of at most ``size``, by ``ord``; parts count from 1."""
    n = F.row_number().over(W.partitionBy(key, "category").orderBy("ord")) - 1
    d = items.withColumn("part", (F.floor(n / size) + 1).cast("int"))
    parts = d.groupBy(key, "category", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("x"))
    return parts.select(key, "category", "part", F.transform("x", lambda v: v["value"]).alias("values"))


def merged_languages(rows: DataFrame, key: str) -> DataFrame:
    """key, name, level: one per folded name; the first spelling, and the first level that isn't empty."""
    some = F.trim(F.coalesce("level", F.lit(""))) != ""
    g = rows.groupBy(key, F.lower(F.trim("name")).alias("_k")).agg(F.min_by("name", "ord").alias("name"), F.coalesce(F.min_by("level", F.when(some, F.col("ord"))), F.lit("")).alias("level"))
    return g.drop("_k")
