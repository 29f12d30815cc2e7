from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import splitter

LONG = """
Jean Dupont
Architecte Solution

PROFIL
Profil senior cloud et data.

COMPÉTENCES
Python
AWS

FORMATIONS
2015 - Master informatique

EXPÉRIENCES PROFESSIONNELLES
2022 - Aujourd'hui Architecte chez ACME
Missions: cadrage architecture
Environnement technique: AWS, Python

2019 - 2022 Tech Lead chez BETA
Missions: développement backend
Environnement technique: Java, Kubernetes
"""


def blocks(spark, *texts, target=7000):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [[] for _ in texts]
    for r in splitter.split(d, target=target).orderBy("doc_id", "ord").collect():
        out[r["doc_id"]].append((r["kind"], r["block"]))
    return out


def test_blocks_keep_order_and_content(spark):
    found, none, empty = blocks(spark, LONG, None, " \n ")
    assert [k for k, _ in found] == ["header", "profile", "skills", "education", "experience", "experience"]
    assert "Jean Dupont" in found[0][1] and "Master informatique" in found[3][1] and "ACME" in found[4][1] and "BETA" in found[5][1]
    assert "\n".join(b for _, b in found).count("Environnement technique") == 2
    assert none == [] and empty == []


def test_lone_headings_join_neighbours(spark):
    text = "Jean Dupont\nArchitecte\n\nPROFIL\nProfil cloud data\n\nCOMPÉTENCES\n\nFORMATIONS\n\nEXPÉRIENCES PROFESSIONNELLES\n2022 - Aujourd'hui Architecte chez ACME\nMissions: cadrage architecture cloud\n\nCERTIFICATIONS\n\n2021 - 2022 Tech Lead chez BETA\nMissions: backend\n"
    first = "COMPÉTENCES\n\nPROFIL\nDix ans de cloud et de data\n"
    found, opened = blocks(spark, text, first)
    flat = "\n".join(b for _, b in found)
    assert all(x in flat for x in ("ACME", "BETA", "Profil cloud data", "COMPÉTENCES", "CERTIFICATIONS"))
    assert not any(b.strip() in ("COMPÉTENCES", "FORMATIONS", "CERTIFICATIONS") for _, b in found)
    assert opened == [("profile", "COMPÉTENCES\nPROFIL\nDix ans de cloud et de data")]


def test_repairs(spark):
    text = "FORMATION\n2019 - 2021 CONSULTANT JAVA chez ACME\nMissions\nRéalisation du projet\n\nCOMPÉTENCES\nJava\n2019\n\nEXPÉRIENCES\njane@doe.org\n12 rue de Paris 75001\n"
    found = blocks(spark, text)[0]
    assert found == [("experience", "FORMATION\n2019 - 2021 CONSULTANT JAVA chez ACME\nMissions\nRéalisation du projet"), ("skills", "COMPÉTENCES\nJava\n2019")]
    b = spark.sql("select array(named_struct('kind', 'education', 'text', '2019 - 2021 Consultant chez ACME'), named_struct('kind', 'experience', 'text', 'Missions\n- API de paiement pour tous les clients'), named_struct('kind', 'header', 'text', '2019'), named_struct('kind', 'experience', 'text', 'Expériences'), named_struct('kind', 'skills', 'text', 'Java')) b")
    got = b.select(splitter.repaired(F.col("b"))).first()[0]
    assert [(r["kind"], r["text"]) for r in got] == [("experience", "2019 - 2021 Consultant chez ACME\nMissions\n- API de paiement pour tous les clients"), ("skills", "Java")]


def test_sizes_and_crumbs(spark):
    lines = "\n".join(["COMPÉTENCES", *(f"ligne {i} " + "x" * 30 for i in range(20))])
    found = blocks(spark, lines, target=200)[0]
    assert len(found) > 3 and all(len(b) <= 200 for _, b in found) and "\n".join(b for _, b in found) == lines
    b = spark.sql("select array(named_struct('kind', 'education', 'text', 'Certifications\nAWS\n4 Compétences\n4.1'), named_struct('kind', 'skills', 'text', 'Compétences techniques\nJava')) b")
    got = b.select(splitter.with_crumbs(F.col("b"))).first()[0]
    assert [(r["kind"], r["text"]) for r in got] == [("skills", "Certifications\nAWS\n4 Compétences\n4.1\nCompétences techniques\nJava")]


def test_assembled(spark):
    rows = [(1, 2, "JEAN", None, "b", ["f2"], ["s"], []), (1, 1, " ", "Lead", "a", ["f1"], [], ["e"]), (1, 3, "X", "Y", "a", [], [], []), (2, 1, None, None, None, [], [], [])]
    d = spark.createDataFrame(rows, "doc_id int, ord int, name string, title string, description string, formations array<string>, skills array<string>, experiences array<string>")
    got = {r["doc_id"]: tuple(r)[1:] for r in splitter.assembled(d, "doc_id").collect()}
    assert got[1] == ("JEAN", "Lead", "a\nb", ["f1", "f2"], ["s"], ["e"]) and got[2][:3] == ("CANDIDAT", "Consultant IT", "")


def test_steps_run_once(spark):
    """A filter on the size of the blocks would run all steps a second time before the rows are made."""
    d = spark.createDataFrame([(1, "PROFIL\ntexte"), (2, None)], "doc_id int, text string")
    plan = splitter.split(d)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "aggregate" in x]
    assert [(r["doc_id"], r["ord"], r["kind"]) for r in splitter.split(d).collect()] == [(1, 1, "profile")]
