"""Facts that stand in a text only inside or across its words."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import coverage, fidelity

FACTS = [("Projets", "Refonte du site — : • Langues : Anglais courant et lu"), ("Autres", "Page 1 sur 3 projet de migration")]


def test_facts_inside_and_across_words(spark):
    facts = {1: "house", 2: "data base", 3: "database", 4: "sql", 5: "a b", 6: "nowhere at all", 7: "green hou", 8: "x"}
    texts = {10: "Two green houses", 11: "the DATABASE", 12: "a data base; SQL", 13: None, 14: "house"}
    f, t = spark.createDataFrame(list(facts.items()), "f int, t string"), spark.createDataFrame(list(texts.items()), "d int, x string")

    def holds(fact, hay):
        hay = (hay or "").lower().replace(";", "")
        return fact in hay or all(w in hay or w in hay.replace(" ", "") for w in fact.split() if len(w) >= 3)

    want = sorted((i, j) for i, a in facts.items() for j, b in texts.items() if holds(a, b))
    assert {(1, 10), (2, 11), (3, 12), (4, 12), (5, 13), (7, 10)} <= set(want)
    assert sorted(tuple(r) for r in coverage.facts_found(f, t, "f", "t", "d", "x").collect()) == want


def test_both_ways_give_the_same(spark):
    """Patterns of all tokens, and the join on runs beyond the limit; tokens that begin others, cross word borders, or are absent."""
    facts = [(1, "java javascript"), (2, "script"), (3, "a b"), (4, ""), (5, "red widget c++"), (6, "jav"), (7, "zzz java"), (8, None)]
    texts = [(10, "JavaScript and java"), (11, "we sc ript all"), (12, "red wid get, C++!"), (13, None), (14, "jav")]
    f, t = spark.createDataFrame(facts, "k int, v string"), spark.createDataFrame(texts, "k int, v string")
    found = [sorted(map(tuple, coverage.facts_found(f, t, "k", "v", "k", "v", most).collect())) for most in (10**6, 0)]
    assert found[0] == found[1]
    assert [p for p in found[0] if p[0] != 3] == [(1, 10), (2, 10), (2, 11), (5, 12), (6, 10), (6, 14)]
    assert [p for p in found[0] if p[0] == 3] == [(3, k) for k in range(10, 15)]
    nothing = spark.createDataFrame([], "k int, v string")
    assert coverage.facts_found(nothing, t, "k", "v", "k", "v").count() == 0 == coverage.facts_found(f, nothing, "k", "v", "k", "v").count()


@pytest.mark.parametrize(("found", "most"), [(fidelity.business_facts, 80), (fidelity.experience_items, 60)])
def test_each_array_of_lines_is_made_once(spark, found, most):
    """What is cut or folded line by line is bound: written out for every use (148 and 104 patterns), it is computed for every use."""
    plan = spark.createDataFrame([(1, "a")], "i int, text string").select(found(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= most


def test_lines_with_odd_blanks_and_marks_give_the_same_facts(spark):
    text = "Projets :\n•  Refonte\tdu   site —\n: \f• Langues : Anglais courant et lu\nAutres\nPage 1 sur 3 projet de migration\n✓ 2 rue X\nMissions\nConcevoir les\t\tinterfaces de paiement."
    row = spark.createDataFrame([(1, text)], "i int, text string").select(fidelity.business_facts(F.col("text")), fidelity.experience_items(F.col("text"))).first()
    assert [tuple(x) for x in row[0]] == FACTS
    assert [tuple(x) for x in row[1]] == [("Missions", "Concevoir les interfaces de paiement.")]


def test_each_text_is_walked_once(spark):
    """A filter on the tokens found would walk through each text a second time."""
    f, t = spark.createDataFrame([(1, "data base"), (2, "house")], "f int, t string"), spark.createDataFrame([(10, "database"), (11, "houses")], "d int, x string")
    found = coverage.facts_found(f, t, "f", "t", "d", "x")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_extract_all" in x]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 10), (2, 11)]


def test_lines_outside_of_experiences_and_long_rules(spark):
    """A section's name behind a long rule ends an experience as the SQL has it; so do page marks beside it, and a sentence may end before blanks."""
    item = "Concevoir les interfaces"
    text = f"{item} de rien\nMissions :\n• {item} de paiement.\t-\nPuis une phrase entière ici\n{'=' * 90} Projets\n{item} perdues\nLivrables clés\n{item} page 1 sur 3 rue X\n{item} a\n{'page 1 sur 3 ' * 9}Langues\n{item} perdues\nMissions\n•\n* {item} b"
    found = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(fidelity.experience_items(F.col("t"))).collect()
    assert [tuple(x) for x in found[0][0]] == [("Missions", f"{item} de paiement."), ("Missions", "Puis une phrase entière ici"), ("Livrables clés", f"{item} a"), ("Missions", f"{item} b")]
    assert found[1][0] == found[2][0] == []


def test_only_lines_that_may_hold_contacts_get_to_their_pattern(spark):
    lines = {"a@b": True, "LinkedIn": True, "LİNKEDIN": True, "lıNKEDIN": True, "GitHub.com/x": True, "HTTPS://x": True, "+33": True, "06 12 34 56 78": True, "12, Rue X": True, "AVENUE": True, "impaſſe": True, "Allée": True, "ALLEE": True, "75001": True, "": True, " ": True}
    lines |= {"CV envoyé par HelloWork": True, "Données personnelles": True, "allo": False, "http": False, "quelques": False, "1234": False, "github": False, "personnelles": False}
    found = spark.createDataFrame(list(lines.items()), "t string, x boolean").select("t", "x", fidelity.excluded(F.col("t")).alias("e"), F.expr("trim(t) = ''") | F.col("t").rlike(fidelity.EXCLUDED)).collect()
    assert [r for r in found if r["x"] != r["e"] or r["e"] != r[3]] == []
