"""Skills and languages of structured documents, visual skills, readable blocks, plans, gates and syntheses."""

from __future__ import annotations

import time

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import gating, plans, skills, taxonomy, visual, wrapping
from quillspark.operators.skills import FORMATIONS, LANGUAGES, SKILLS

SOURCE = """Jean
COMPÉTENCES
Architecte logiciel / Direction technique
➢
Architecture logicielle : Conception de solution, Urbanisation,
PaaS, SOA
➢
Cloud: AWS, AZURE
➢ Sécurité: JWT, OAuth2
➢
Data bases: MySQL, SQLserver, PostegreSQL, Graphana Java
➢
TOGAF, C4
➢
Système : Linux RHEL, UBUNTU, Windows
Anglais
Lu, parlé, écrit
FORMATIONS
Ingénieur, Espagnol
"""


def one(spark, value, kind, f):
    """What a function of a column gives for one value."""
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


def pairs(found):
    return [(s["category"], list(s["items"])) for s in found]


def test_items_of_a_section(spark):
    items = lambda lines: one(spark, lines, "array<string>", skills.skill_items)
    assert items(["Architecte / Direction", "➢", "Cloud: AWS", "➢", "DevOps : Jenkins,", "Docker"]) == ["Architecte / Direction", "Cloud: AWS", "DevOps : Jenkins, Docker"]
    assert items(["➢ Linux, Windows", "Anglais Lu, parlé, écrit"]) == ["Linux, Windows", "Anglais Lu, parlé, écrit"]
    assert items(["Anglais courant"]) == ["Anglais courant"]
    assert items([]) == [] and items(["➢", "", " - "]) == []


def test_languages_are_hoisted_with_their_levels(spark):
    def hoisted(items):
        x = one(spark, items, "array<string>", skills.hoisted)
        return x["remaining"], [(n["name"], n["level"]) for n in x["languages"]]

    assert hoisted(["Java", "anglais", "Lu, parlé,", "écrit", "SQL"]) == (["Java", "SQL"], [("Anglais", "Lu, parlé écrit")])  # marks at the ends of a part go
    assert hoisted(["ANGLAIS (C1)", "Espagnol : notions", "Docker", "courant"]) == (["Docker", "courant"], [("Anglais", "C1"), ("Espagnol", "notions")])
    assert hoisted(["Allemand", "-", "b2"]) == (["-", "b2"], [("Allemand", "")])
    assert hoisted(["Grecque antique", None, ""]) == (["Grecque antique", "", ""], [])
    assert hoisted([]) == ([], []) and hoisted(None) == ([], [])
    both = [("Anglais", ""), ("anglais ", "C1"), ("ANGLAIS", "B2"), ("", "x"), ("Turc", None)]
    assert [tuple(x) for x in one(spark, both, LANGUAGES, skills.merged)] == [("Anglais", "C1"), ("Turc", "")]


def test_skills_of_a_source(spark):
    found = one(spark, SOURCE, "string", skills.source_skills)
    assert pairs(found["skills"]) == [
        ("Outils & Environnements", ["Architecte logiciel", "Direction technique"]),
        ("Architecture & Conception", ["Conception de solution", "Urbanisation", "PaaS", "SOA"]),
        ("Cloud & DevOps", ["AWS", "Azure"]),
        ("Sécurité", ["JWT", "OAuth2"]),
        ("Bases de données", ["MySQL", "SQL Server", "PostgreSQL", "Graphana Java"]),
        ("Méthodologies", ["TOGAF", "C4"]),
        ("Systèmes & Environnements", ["Linux RHEL", "Ubuntu", "Windows"]),
    ]
    assert [tuple(x) for x in found["languages"]] == [("Anglais", "Lu, parlé, écrit")]
    for text in (None, "", "no such section"):
        assert one(spark, text, "string", skills.source_skills) == ([], [])
    assert one(spark, "Bootstrap JavaScript: Node.js web: x", "string", skills.pieces) == ["Bootstrap", "JavaScript: Node.js", "web: x"]


def test_display_keeps_the_first_of_each_key(spark):
    raw = [("Cloud / DevOps", ["AWS", "Docker", "Kubernetes"]), ("Autres", ["Docker", "docker-compose", "SQLserver", "Jardinage", None]), ("Bases de données — suite 2", ["SQL Server", "Graphana", "grafana."]), ("", ["Outils: vim, SVN"]), ("X", None)]
    assert pairs(one(spark, raw, SKILLS, skills.displayed)) == [
        ("Cloud & DevOps", ["AWS", "Docker", "Kubernetes", "Docker Compose"]), ("Bases de données", ["SQL Server", "Grafana"]), ("Autres", ["Jardinage"]), ("Outils & Environnements", ["vim", "SVN"]),
    ]
    assert one(spark, None, SKILLS, skills.displayed) == []


def test_model_and_source_are_merged(spark):
    rows = [(1, SOURCE, [("Autres", ["AWS", "Docker", "SQLserver", "Anglais"]), ("Cloud / DevOps", ["AWS", "Kubernetes"])], [("anglais", "")], "own"), (2, None, None, None, "own")]
    d = spark.createDataFrame(rows, f"id int, source string, skills {SKILLS}, languages {LANGUAGES}, _found string")
    first, second = skills.with_skills(d).orderBy("id").collect()
    flat = [x for _, items in pairs(first["skills"]) for x in items]
    assert flat.count("AWS") == 1 and flat[:4] == ["AWS", "Docker", "Kubernetes", "Azure"] and "Anglais" not in flat
    assert [tuple(x) for x in first["languages"]] == [("anglais", "Lu, parlé, écrit")] and first["_found"] == "own"
    assert second["skills"] == [] and second["languages"] == []


def test_covered_by_keys(spark):
    """Keys of whole items, not tokens; false where either side is empty."""
    d = spark.createDataFrame([("Compétences", ["powerbi", "sqlserver"], ["powerquery", "bi", "server"]), ("Compétences", [], ["x"]), ("Projets", ["a"], ["a"]), ("competences techniques", ["a", "b", "c"], ["a", "b", "d"]), ("Compétences et outils", list("abcdefghij"), list("abcdefg"))], "s string, w array<string>, h array<string>")
    assert [r[0] for r in d.select(skills.covered(F.col("s"), F.col("w"), F.col("h"))).collect()] == [False, False, False, False, True]


def test_commas_by_depth(spark):
    f = lambda v: one(spark, v, "string", taxonomy.top_level_commas)
    assert f("A ((b), c (d), e), f") == ["A ((b), c (d), e)", "f"]
    assert f("a), b, ;(c, d") == ["a)", "b", "(c, d"]
    assert f("") == [] and f(None) == []


def test_families_of_long_lists(spark):
    long = ["Java", "Spring, React", "PostgreSQL", "Docker", "git", "Cuisine", "java", "AWS", "Azure", "GCP", "Terraform", "Jenkins", "Helm", "Ansible", "Javanais", ".NET core"]
    found = pairs(one(spark, [("Compétences", long), ("Backend", ["a", "A", "b|c"]), (None, None), ("Certifications AWS", list("abcdefgh"))], SKILLS, skills.grouped_long))
    assert found == [
        ("Backend", ["Java", "Spring", ".NET core"]), ("Frontend", ["React"]), ("Cloud / DevOps", ["Docker", "AWS", "Azure", "GCP", "Terraform", "Jenkins"]), ("Cloud / DevOps — suite", ["Helm", "Ansible"]), ("Data", ["PostgreSQL"]),
        ("Outils & méthodes", ["git"]), ("Autres", ["Cuisine", "Javanais"]), ("Backend", ["a", "b", "c"]), ("Certifications AWS", list("abcdefgh")),
    ]
    kept = [("Mainframe", ["COBOL, DB2", "DL1", "GSAM", "JCL", "IMS", "DB2BATCH", "IMSBATCH"]), ("Processus métiers", ["ERP, GMAO", "Achats, Ventes", *"abcdef"])]
    assert pairs(one(spark, kept, SKILLS, skills.grouped_long)) == kept


def test_long_certifications_are_one_entry(spark):
    few = [("2020", "AWS certified", "X"), ("2010", "Master", "Y")]
    assert [tuple(x) for x in one(spark, few, FORMATIONS, skills.grouped_certifications)] == few
    many = [(f"20{i}", f"Scrum {i}", "Org" if i % 2 else "") for i in range(10, 17)] + [("2001", "Master", None), (None, "ITIL", "Other")]
    found = [tuple(x) for x in one(spark, many, FORMATIONS, skills.grouped_certifications)]
    assert found[0] == ("2001", "Master", None)
    assert found[1] == ("Certifications", "; ".join([*(f"20{i} — Scrum {i}" for i in range(10, 17)), "ITIL"]), "Org, Other")


def test_rescued_languages_and_certifications(spark):
    def rescued(given, languages=None, certifications=None):
        x = skills.rescued(spark.createDataFrame([(given, languages, certifications, 1)], f"skills {SKILLS}, languages {LANGUAGES}, certifications array<string>, _fold int")).first()
        return pairs(x["skills"]), [tuple(y) for y in x["languages"]], x["certifications"]

    assert rescued([("Certifications", ["Oracle Certified Associate Java SE 8", "Oracle Certi\ufb01ed Associate Java SE 8", "Moto", "aws" + " x" * 90]), ("Langues", ["Arabe 5 Français 4 Anglais Junit UML"])]) == (
        [("Stack principale", ["Junit UML"])], [("Arabe", "5"), ("Français", "4"), ("Anglais", "")], ["Oracle Certified Associate Java SE 8"],
    )
    found = rescued([("Backend", ["Python"]), ("Langues", ["Français — courant", "Anglais — technique", "Java 17", "Python"])], [("français", "Courant")], ["PMP", "pmp"])
    assert found == ([("Backend", ["Python", "Java 17"])], [("français", "Courant"), ("Anglais", "technique")], ["PMP"])
    assert rescued([("Backend", ["Java"])]) == ([("Backend", ["Java"])], [], [])
    assert rescued(None) == ([], [], [])
    assert one(spark, "JUnit 5, Docker", "string", skills.spoken_in) == ([], "JUnit 5, Docker")
    like = spark.createDataFrame([("AWS Solutions Architect",), ("Professional Scrum Master I",), ("Anglais — courant",), ("Spring Boot",), ("",), (None,)], "v string").select(skills.certificate_like(F.col("v")))
    assert [r[0] for r in like.collect()] == [True, True, False, False, False, False]


def test_technical_terms_by_family(spark):
    assert one(spark, ["React, Java | java / Docker", "Foo,SQL", " "], "array<string>", skills.technical_terms) == "Frontend: React | Backend: Java | DevOps: Docker | Data: SQL | Autres: Foo"
    assert one(spark, [], "array<string>", skills.technical_terms) == ""


def test_readable_blocks(spark):
    dense = ", ".join(f"Technologie {i}" for i in range(30))
    found = pairs(one(spark, [("Stack", [dense]), ("Outils", ["x" * 220]), ("Vide", None), ("", [])], SKILLS, wrapping.readable))
    assert ", ".join(x for c, items in found if c.startswith("Stack") for x in items) == dense and all(len(x) <= 125 for c, items in found if c.startswith("Stack") for x in items)
    assert found[-2:] == [("Outils", ["x" * 220]), ("Vide", [])]
    found = pairs(one(spark, [("C", [f"item {i}" for i in range(25)])], SKILLS, wrapping.readable))
    assert [(c, len(x)) for c, x in found] == [("C", 8), ("C (suite)", 8), ("C (suite)", 9)]  # one item left doesn't open a block
    found = pairs(one(spark, [("C", ["y" * 120] * 7)], SKILLS, wrapping.readable))
    assert [len(x) for _, x in found] == [3, 3, 1]


BLOCK = "doc_id int, page int, x0 double, y0 double, ord int, text string"


def test_visual_skills(spark):
    texts = ["Jean", "Compétences :  Java\nSpring, JPA (a, b)", "3 / 6", "• Mainframe\nCOBOL\nJCL, DB2\rDB2", "Maintenance applicative et évolutive", "Base De Données", "Oracle, PostgreSQL,", "Une phrase assez longue pour être une phrase entière.", "Front-end", "React", "Langues", "Java", "nothing"]
    rows = [(1, 0, 10.0, float(i), i, t) for i, t in enumerate(texts)] + [(2, 0, 1.0, 1.0, 1, "no section"), (3, 1, 1.0, 2.0, 1, "Java\nx, y"), (3, 0, 1.0, 2.04, 2, "Technologies"), (4, 0, 1.0, 1.0, 1, None)]
    found = {r["doc_id"]: (pairs(r["skills"]), r["confidence"], r["warnings"]) for r in visual.skills(spark.createDataFrame(rows, BLOCK).repartition(3)).collect()}
    assert found[1] == ([("Java", ["Spring", "JPA (a, b)"]), ("Mainframe", ["COBOL", "JCL", "DB2"]), ("Base De Données", ["Oracle", "PostgreSQL"]), ("Front-end", ["React"])], 0.9, [])
    assert found[2] == ([], 0.0, ["skills_heading_not_found"]) and 4 not in found
    assert found[3] == ([("Java", ["x", "y"])], 0.4, ["too_few_visual_skills"])
    docs = spark.createDataFrame([(1, [("Backend", ["bad"])], "own"), (3, [("Backend", ["Java"])], "own"), (9, None, "own")], f"doc_id int, skills {SKILLS}, warnings string")
    out = {r["doc_id"]: r for r in visual.overridden(docs, visual.skills(spark.createDataFrame(rows, BLOCK))).collect()}
    assert pairs(out[1]["skills"]) == found[1][0] and out[1]["source_override"]["confidence"] == 0.9 and out[1]["warnings"] == "own"
    assert pairs(out[3]["skills"]) == [("Backend", ["Java"])] and out[3]["source_override"] is None and out[9]["skills"] is None


def test_plan_contract(spark):
    good = {"strategy": "natural", "page_assignments": {"main": ["a", "b"], "header": ["c"]}, "variant_density": "normal", "rationale": " short "}
    cases = {
        1: (json.dumps(good), []),
        2: ("```json\n" + json.dumps(good, indent=1) + "\n```", []),
        3: ("{broken", ["invalid_json:"]),
        4: ("[1]", ["not_an_object:"]),
        5: (json.dumps({"strategy": "x", "variant_density": 3, "rationale": 4}), ["invalid_density:", "invalid_strategy:x", "missing_block:a", "missing_block:b", "missing_key:page_assignments", "rationale_not_a_string:"]),
        6: (json.dumps(good | {"page_assignments": {"main": ["a", "a", "z"], "margin": ["b"], "footer": "b"}}), ["doubled_block:a", "ids_not_a_list:footer", "unauthorized_zone:margin", "unknown_block:z"]),
        7: (json.dumps(good | {"page_assignments": ["a"], "rationale": "x" * 281}), ["assignments_not_an_object:", "missing_block:a", "missing_block:b", "rationale_too_long:"]),
        8: (json.dumps(good | {"rationale": "write to a@b.example.org"}), ["unsafe_rationale:"]),
        9: (None, ["invalid_json:"]),
    }
    p = spark.createDataFrame([(1, k, raw, "own") for k, (raw, _) in cases.items()] + [(2, 99, json.dumps(good), "own")], "doc_id int, id int, raw string, _plan string")
    b = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "c", False)], "doc_id int, block_id string, required boolean")
    out = {r["id"]: r for r in plans.checked(p, b).collect()}
    for k, (_, faults) in cases.items():
        assert [f"{f['code']}:{f['subject']}" for f in out[k]["faults"]] == faults, k
        assert out[k]["accepted"] == (not faults) and out[k]["_plan"] == "own"
    assert out[1]["rationale"] == "short" and {z["zone"]: z["ids"] for z in out[2]["zones"]} == good["page_assignments"]
    assert not out[99]["accepted"]


def test_gates_in_their_order(spark):
    source = "Processus métiers :\n✓Gestion de projets informatiques\nCompétences et outils :\n✓Management d'équipe\nExemples de réalisations professionnelles\n:\n✓Gestion d'un SI d'une usine pharmaceutique (+500 employés)\nLoisirs :\n✓Moto\n✓Cuisine\n#Gestion de portefeuille projets"
    model = [("Mots-clés", ["#Gestion de portefeuille projets"]), ("Processus métiers", ["Gestion de projets informatiques"]), ("Compétences et outils", ["Management d'équipe", "Kubernetes"]), ("Autres", ["Gestion d'un SI d'une usine pharmaceutique (+500 employés)", "Moto"])]
    rows = [(1, source, model, None, None), (2, "", [("A", ["x"])], None, None), (3, SOURCE, [("Cloud & DevOps", ["AWS", "Docker"]), ("Autres", ["JWT", "Inconnu"])], [], [])]
    out = gating.gated(spark.createDataFrame(rows, f"id int, source string, skills {SKILLS}, languages {LANGUAGES}, certifications array<string>")).orderBy("id").collect()
    assert pairs(out[0]["skills"]) == [("Processus métiers", ["Gestion de projets informatiques"]), ("Compétences et outils", ["Management d'équipe"]), ("Exemples de réalisations professionnelles", ["Gestion d'un SI d'une usine pharmaceutique (+500 employés"])]
    assert pairs(out[1]["skills"]) == [("A", ["x"])]
    flat = [x for _, items in pairs(out[2]["skills"]) for x in items]
    assert "Docker" not in flat and "Inconnu" not in flat and flat.count("JWT") == 1 and [tuple(x) for x in out[2]["languages"]] == [("Anglais", "Lu, parlé, écrit")]


def test_syntheses(spark):
    experience = lambda k: (f"20{k}", "Lead", [("Missions clés", ["m1", "m2", "m3"]), ("Environnement technique", ["Java, React"])])
    five = [experience(k) for k in range(5)]
    rows = [(1, "standard", False, five), (2, "standard", True, five), (3, "Urgent", True, five[:2]), (4, "urgent", True, five[:3]), (5, None, True, five), (6, "odd", True, five), (7, "standard", True, [*five[:4], ("2000", "Old", None)])]
    kind = "array<struct<date:string,role:string,sections:array<struct<heading:string,content:array<string>>>>>"
    d = spark.createDataFrame([(*r, [("Autres", ["x"])], [("2020", "Master", "Y")]) for r in rows], f"id int, mode string, allow_condensation boolean, experiences {kind}, skills {SKILLS}, formations {FORMATIONS}")
    out = {r["id"]: r for r in gating.synthesised(d, brand="Q").collect()}
    assert [out[i]["synthesis_mode"] for i in range(1, 8)] == ["complete", "standard", "urgent", "urgent", "complete", None, "standard"]
    for i in (1, 3, 5, 6):
        assert out[i]["experiences"] == [r for r in d.where(F.col("id") == i).first()["experiences"]]
    old = out[2]["experiences"][3]["sections"]
    assert [s["heading"] for s in old] == ["Synthèse mission", "Environnement technique"] and old[1]["content"] == ["Frontend: React | Backend: Java"]
    assert old[0]["content"][:2] == ["m1", "m2"] and old[0]["content"][2].startswith("Synthèse Q: 1 élément(s)")
    assert out[2]["experiences"][:3] == out[1]["experiences"][:3] and len(out[4]["experiences"][1]["sections"][0]["content"]) == 2
    assert out[7]["experiences"][4]["sections"][0]["content"][0].startswith("Mission ancienne")


def test_a_long_list_is_hoisted_in_proportion_to_its_length(spark):
    """A fold that copies its result item by item needs minutes for so many items."""
    n = 150_000
    item = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 5 == 0, "anglais").when(i % 5 == 1, "lu, parlé").when(i % 5 == 2, " B2 ").when(i % 5 == 3, "Jardin").otherwise("courant"))
    start = time.monotonic()
    h = spark.range(1).select(skills.hoisted(item).alias("h")).select(F.size("h.remaining"), F.size("h.languages"), F.array_distinct("h.remaining"), F.array_distinct(F.transform("h.languages", lambda x: F.concat_ws(":", x["name"], x["level"])))).first()
    assert tuple(h) == (2 * n // 5, n // 5, ["Jardin", "courant"], ["Anglais:lu, parlé B2"])
    assert time.monotonic() - start < 60


def test_visual_lines_are_walked_once(spark):
    """Headings, items and whether a section opens come of one walk: the windows over a document's lines stand in the plan once, and nothing is joined to itself."""
    plan = visual.skills(spark.createDataFrame([(1, 0, 1.0, 1.0, 1, "x")], BLOCK))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and sum("row_number" in x and "Window" in x for x in plan.split("\n")) == 1
    rows = [(1, 0, 1.0, float(i), i, t) for i, t in enumerate(["Compétences\f :", " \t•  Java  : ", " 3  / 6 ", "a,\ta ; , b\r•b.,", "CV  créé sur", "Mainframe", "Ops", "x (1,  2), y", "cobol", "Langues", "z"])]
    found = visual.skills(spark.createDataFrame(rows, BLOCK).repartition(3)).first()
    assert pairs(found["skills"]) == [("Java", ["a", "b", "b."]), ("Ops", ["x (1, 2)", "y", "cobol"])] and found["confidence"] == 0.4


def test_the_ids_of_a_plan_are_taken_once(spark):
    """Written out for every use, they'd be flattened for each id of the plan."""
    plan = plans.checked(spark.createDataFrame([(1, "{}")], "doc_id int, raw string"), spark.createDataFrame([(1, "a", True)], "doc_id int, block_id string, required boolean"))
    assert plan._jdf.queryExecution().analyzed().toString().count("flatten(") == 1
