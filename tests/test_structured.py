from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import layout, structured


def document(i, title="Dev", skills=(), experiences=(), source="", formations=()):
    return (i, "JANE", title, list(formations), [(c, list(x)) for c, x in skills], [(d, r, [(h, list(c)) for h, c in s]) for d, r, s in experiences], source)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), f"doc_id int, {structured.DOCUMENT}, source string")


def test_contacts_have_paths_but_no_values(spark):
    d = frame(spark, document(1, skills=[("Web", ["Java", "voir github.com/abc"])], experiences=[("2020", "x", [("h", ["a@b.org", "ok"])])]), document(2), (3, None, None, None, None, None, None))
    got = structured.contacts_in(d).collect()
    assert [tuple(r) for r in got] == [(1, ["email", "github_profile"], ["experiences[0].sections[0].content[0]", "skills[0].items[1]"])]


def test_gates(spark):
    d = frame(spark, document(1, skills=[("A", ["Java", "Cobol"]), ("B", ["Rust"])], experiences=[("2020", "x", [("h", ["gain de 30%", "bonne humeur", "Java SQL"]), ("e", ["AWS"])])], source="Java et SQL"), document(2, skills=[("A", ["Any"])]))
    skills = {r["doc_id"]: [(s["category"], s["items"]) for s in r["skills"]] for r in structured.gated_skills(d).collect()}
    assert skills == {1: [("A", ["Java"])], 2: [("A", ["Any"])]}
    kept = structured.gated_experiences(d).where("doc_id = 1").first()["experiences"][0]["sections"]
    assert [(s["heading"], s["content"]) for s in kept] == [("h", ["bonne humeur", "Java SQL"])]


def test_terms(spark):
    d = spark.createDataFrame([("Jane Doe-Smith est DOE", ["Doe", "Doe-Smith"]), ("rien", []), ("a.b (c)", ["(c)"])], "t string, x array<string>")
    assert [r[0] for r in d.select(structured.without_terms(F.col("t"), F.col("x"))).collect()] == ["Jane est", "rien", "a.b"]
    assert spark.sql("select 'a b c' n, array('b c', '') y, array('b d') z").select(structured.holds_term(F.col("n"), F.col("y")), structured.holds_term(F.col("n"), F.col("z"))).first() == (True, False)


def test_entities_and_places(spark):
    d = spark.createDataFrame([("chez IBM | Banque Nationale Paris, ok • Missions suite\nLieu : Lyon (69)",), (None,)], "t string")
    got = d.select(structured.entities(F.col("t")).alias("e"), structured.locations(F.col("t")).alias("l")).collect()
    assert got[0]["e"] == ["chez IBM", "Banque Nationale Paris"] and got[0]["l"] == ["Lyon (69)"] and got[1]["e"] == [] and got[1]["l"] == []
    assert spark.sql("select 'Chef de projet chez SNCF | a' r").select(structured.role_fragments(F.col("r"))).first()[0] == ["Chef de projet", "SNCF"]


def test_integrity(spark):
    d = frame(
        spark,
        document(1, formations=[("2019 - 2021", "Consultant Java", "ACME"), ("2018", " ", None), ("2015 - 2017", "Master", "Consultant école")]),
        document(2, experiences=[("", "", [("Missions", [])]), ("2020", "Lead", [("", [])]), ("2021", None, []), (None, "Projets académiques", [])]),
        document(3, experiences=[("2020", "Lead", [])]),
    )
    want = [(1, "empty_formation_stub", "2"), (1, "experience_misclassified_as_formation", "1"), (2, "empty_experience_date_stub", "3"), (2, "experience_header_without_body", "2"), (2, "experience_header_without_body", "3"), (2, "headerless_experience_sections", "1")]
    assert sorted(tuple(r) for r in structured.integrity_issues(d).collect()) == want


def test_contacts_are_taken_out(spark):
    want = {
        "React.NET et API.NET": "React.NET et API.NET", "voir example.com/me ici": "voir ici", "Contact : a.b@c.fr": "Contact", "Email: a@b.fr, Java": "Java", "Projet Th@Bot": "Projet Th@Bot",
        "Dev (linkedin.com/in/x)": "Dev", "tel 06 12 34 56 78": "", "": "",
    }
    d = spark.createDataFrame([(k,) for k in want], "t string").select("t", structured.without_contacts(F.col("t")).alias("x"), structured.contact_category(F.col("t")).alias("c"))
    got = {r["t"]: (r["x"], r["c"]) for r in d.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["React.NET et API.NET"][1] is None and got["voir example.com/me ici"][1] == "url" and got["tel 06 12 34 56 78"][1] == "phone_fr"
    d = frame(spark, document(1, title="a@b.fr", skills=[("A", ["x@y.fr", "Java"]), ("", ["z@y.fr"])], experiences=[("2020", "Lead 0612345678", [("h", ["b@c.fr", "ok"])])]))
    r = structured.sanitised_document(d).first()
    assert r["title"] == "" and [(s["category"], s["items"]) for s in r["skills"]] == [("A", ["Java"])] and r["experiences"][0]["role"] == "Lead" and r["experiences"][0]["sections"][0]["content"] == ["ok"]
    r = structured.without_identity(d.withColumn("title", F.lit("Jane BARO, Lead")).withColumn("forbidden", F.array(F.lit("Baro")))).first()
    assert r["title"] == "Jane, Lead"


def test_lines_and_items(spark):
    text = "Profil\nx\nCOMPÉTENCES\nLangages : Java\n➢\nDocker\net Kubernetes\n➢ Git\nExpériences\nfin"
    d = spark.createDataFrame([(text,), (None,)], "t string").select(structured.skills_lines(F.col("t")).alias("l"))
    got = d.select("l", structured.arrow_items(F.col("l")).alias("i")).collect()
    assert got[0]["l"] == ["Langages : Java", "➢", "Docker", "et Kubernetes", "➢ Git"] and got[1]["l"] == []
    assert got[0]["i"] == ["Langages : Java", "Docker et Kubernetes", "Git"]
    category, rest = structured.prefixed(F.col("v"), {"web|front(?:end)?": "Frontend", "outils?": "Outils"})
    d = spark.createDataFrame([("Outils : Git",), ("Webby: x",), ("rien",)], "v string")
    assert [tuple(r) for r in d.select(category, rest).collect()] == [("Outils", "Git"), (None, "Webby: x"), (None, "rien")]


def test_headings(spark):
    want = {"COMPÉTENCES :": "skills", "Profil senior orienté résultats et équipes": None, "Environnement technique: AWS": None, "Formations": "education", "• Expériences professionnelles": "experience", "": None}
    d = spark.createDataFrame([(k,) for k in want], "t string").select("t", structured.heading_kind(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in d.collect()} == want
    want = {"2019 - 2021 Développeur Java": True, "2019": False, "Janvier 2020 SNCF": True, "2018 texte simple": False}
    d = spark.createDataFrame([(k,) for k in want], "t string").select("t", structured.experience_start(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in d.collect()} == want


def test_reading_order(spark):
    left = [(1, 1, 100.0, 5.0, 10.0 * i, 30.0, f"l{i}") for i in range(4)]
    main = [(1, 1, 100.0, 40.0, 10.0 * i + 5, 90.0, f"m{i}") for i in range(6)]
    d = spark.createDataFrame([*left, *main, (1, 1, 100.0, 5.0, 0.0, 95.0, "head")], "doc_id int, page int, width double, x0 double, y0 double, x1 double, text string")
    got = [r["text"] for r in layout.reading_order(d).orderBy("ord").collect()]
    assert got == ["head", *(f"m{i}" for i in range(6)), *(f"l{i}" for i in range(4))]
    assert [r["text"] for r in layout.reading_order(d.where("text like 'l%' or text = 'm0'")).orderBy("ord").collect()] == ["l0", "m0", "l1", "l2", "l3"]


def test_overflow_zones_and_retries(spark):
    d = spark.createDataFrame([(1, 22.0, 30.0, 100.0, 100.0, 100.0, 200.0), (2, 23.0, 30.0, 70.0, 100.0, 100.0, 200.0)], "id int, x0 double, y0 double, x1 double, y1 double, width double, height double")
    assert [(r["id"], r["side"]) for r in layout.overflow(d).collect()] == [(1, "left"), (1, "right")]
    b = spark.createDataFrame([(1, 2, "b", "skills", 14, True), (1, 1, "a", "experience", 3, True), (1, 3, "c", "skills", 15, True), (1, 4, "d", "skills", 1, False)], "doc_id int, ord int, block_id string, type string, estimated_lines int, required boolean")
    assert {r["zone"]: r["block_ids"] for r in layout.zones(b).collect()} == {"main": ["a", "c"], "right_sidebar": ["b"]}
    missing, unknown = layout.plan_faults(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("z")), F.array(F.lit("a"), F.lit("b")))
    assert tuple(spark.range(1).select(missing, unknown).first()) == (["a"], ["z"])
    o = spark.sql("select array('page_too_dense', 'page_too_sparse') a, array('page_too_dense') b, array('other') c").select(*[layout.retry_options(F.col(x)) for x in "abc"]).first()
    assert o[0]["allow_grouping"] and o[1]["force_new_page"] and o[2] is None
    v = spark.sql("select 1 k, i ord, named_struct('x', i div 2) options from values 0, 1, 2, 3, 4 t(i)")
    assert sorted((r["ord"], r["options"]["x"]) for r in layout.attempts(v, "k").collect()) == [(0, 0), (2, 1)]
    assert tuple(spark.sql("select named_struct('a', 1) x, named_struct('a', 2) y").select(layout.unchanged(F.col("x"), F.col("x")), layout.unchanged(F.col("x"), F.col("y"))).first()) == (True, False)


def test_dense_skills_and_regressions(spark):
    b = spark.createDataFrame([(1, 1, 1, "a" * 700, True), (1, 1, 2, ";" * 30, True), (1, 2, 1, "," * 18, True), (1, 3, 1, "," * 40, False)], "doc_id int, page int, ord int, text string, in_skills boolean")
    assert sorted((r["page"], r["code"]) for r in layout.dense_skills(b).collect()) == [(1, "skill_block_too_long"), (1, "skills_too_dense"), (2, "skills_too_dense")]
    r = spark.range(1).select(layout.regressed(F.lit(True), F.lit(2), F.lit(3), F.array(F.lit("x"))), layout.regressed(F.lit(True), F.lit(2), F.lit(2), F.array(F.lit("page_too_sparse"))), layout.regressed(F.lit(False), F.lit(2), F.lit(3), F.array(F.lit("x")))).first()
    assert tuple(r) == (True, True, False)
