from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import fidelity, skills

SCHEMA = (
    "doc_id int, name string, title string, formations array<struct<date:string,degree:string,school:string>>, skills array<struct<category:string,items:array<string>>>,"
    " experiences array<struct<date:string,role:string,company_highlight:string,sections:array<struct<heading:string,content:array<string>>>>>, source string, rendered string, forbidden array<string>"
)
SOURCE = """Jane Baro
Développeuse Java
Réalisations professionnelles
✓ Migration complète du système de paie
vers le cloud
✓ court
Langues: Anglais professionnel courant
Loisirs
Cuisine italienne du dimanche soir
Expériences
2019 - 2021 Développeur Java chez ACME
Lieu : Lyon (69)
Missions clés
- Conception des interfaces de paiement.
Rédaction des tests de non régression
et suivi des livraisons
"""


def row(i, name="JANE", title="Développeuse Java", formations=(), experiences=(), skills=(), source=SOURCE, rendered="", forbidden=()):
    return (i, name, title, list(formations), list(skills), list(experiences), source, rendered, list(forbidden))


FULL = [("2019 - 2021", "Développeur Java chez ACME", "ACME", [("Missions clés", ["Conception des interfaces de paiement.", "Rédaction des tests de non régression et suivi des livraisons"]), ("Lieu", ["Lyon (69)"])])]
SKILLS = [("Réalisations", ["Migration complète du système de paie vers le cloud"]), ("Langues", ["Anglais professionnel courant"])]


def test_facts_of_a_source(spark):
    d = spark.createDataFrame([(SOURCE,), (None,)], "t string").select(fidelity.business_facts(F.col("t")).alias("b"), fidelity.experience_items(F.col("t")).alias("e")).collect()
    assert [tuple(x) for x in d[0]["b"]] == [("Réalisations professionnelles", "Migration complète du système de paie vers le cloud"), ("Langues", "Anglais professionnel courant")]
    assert [tuple(x) for x in d[0]["e"]] == [("Missions clés", "Conception des interfaces de paiement."), ("Missions clés", "Rédaction des tests de non régression et suivi des livraisons")]
    assert d[1]["b"] == [] and d[1]["e"] == []


def test_issues_and_severities(spark):
    bad = [("2018", "Architecte Cloud Azure", "Globex", [("Environnement technique", ["Kubernetes en production"]), ("Missions", ["Pilotage des équipes offshore"])])]
    d = spark.createDataFrame(
        [
            row(1, experiences=FULL, skills=SKILLS),
            row(2, name="Jane Baro", title="Directrice Marketing", experiences=bad, skills=[("x", ["Mme Baro", "Analyse des besoins 1", "Analyse des besoins 2", "Analyse des besoins 3", "Synthèse Acme"])], forbidden=["Baro"]),
            row(3, title=None, source=""),
        ],
        SCHEMA,
    )
    found = fidelity.issues(d, forbidden="forbidden", brand="ACME").cache()
    by = {i: sorted({r["code"] for r in found.where(f"doc_id = {i}").collect()}) for i in (1, 2, 3)}
    assert by[1] == [] and by[3] == []
    assert by[2] == sorted(
        [
            "full_name_display", "title_absent_from_source", "unexpected_synthesis_section", "experience_location_missing_from_json", "source_coverage_missing_section", "source_coverage_missing_experience_item",
            "company_highlight_absent_from_source", "experience_date_absent_from_source", "experience_role_fact_absent_from_source", "synthetic_technical_environment", "experience_content_rewritten_or_absent_from_source",
            "candidate_identity_term_exposed", "numbered_placeholder_repetition",
        ]
    )
    hard = {r["code"] for r in found.where("severity = 'hard'").collect()}
    assert hard == {"full_name_display", "unexpected_synthesis_section", "candidate_identity_term_exposed", "numbered_placeholder_repetition"}
    s = fidelity.summary(found).first()
    assert s["hard_count"] >= 4 and s["message"].startswith("fidelity_issues=[candidate_identity_term_exposed,")
    assert not {"source_coverage_missing_section", "unexpected_synthesis_section"} & {r["code"] for r in fidelity.issues(d, synthesis=True).collect()}


def test_rendered(spark):
    d = spark.createDataFrame([row(1, experiences=FULL, rendered="Développeuse ACME 2019 - 2021 | IBM France"), row(2, experiences=FULL, skills=SKILLS, rendered=SOURCE)], SCHEMA)
    got = {(r["doc_id"], r["code"]) for r in fidelity.rendered_issues(d).collect()}
    assert got == {(1, "json_fact_missing_from_pdf"), (1, "source_experience_location_missing_from_pdf"), (1, "source_coverage_missing_section"), (1, "pdf_fact_absent_from_source")}


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    keys = lambda *x: F.array(*[F.lit(k) for k in x])
    assert one(skills.covered(F.lit("Compétences"), keys("javaspring", "sql"), keys("java", "spring"))) is False and one(skills.covered(F.lit("Compétences"), keys("java", "sql"), keys("java", "sql"))) is True
    assert one(fidelity.full_name(F.lit("Jane Doe"))) is True and one(fidelity.full_name(F.lit("Jane"))) is False and one(fidelity.full_name(F.lit(None).cast("string"))) is False
    facts = F.array(F.struct(F.lit("Projets").alias("section"), F.lit("Migration complète du système").alias("fact")))
    assert one(fidelity.section_of(facts, F.lit("migration complete du systeme"))) == "Projets" and one(fidelity.section_of(facts, F.lit("court"))) is None


def test_folding_is_that_of_unicode(spark):
    samples = ["Čapek ﬁn", "Łódź ŻÓŁĆ", "Ｆｕｌｌ width №5 ½", "naïve façade", "été", "Ĳssel ŉ ǆ", "Škoda İstanbul", "plain"]
    samples += ["".join(chr(c) for c in range(a, a + 64)) for a in (0xC0, 0x100, 0x140, 0x1E00, 0x1EA0, 0xFB00, 0xFF00, 0x2100, 0x2460, 0x3300)]
    want = ["".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)) for s in samples]
    d = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    assert [r[0] for r in d.orderBy("i").select(text.without_accents(F.col("t"))).collect()] == want
    assert spark.range(1).select(text.fidelity(F.lit("Čapek ﬁn"))).first()[0] == "capek fin"
    assert spark.range(1).select(text.skill_key(F.lit("Graphana"))).first()[0] == "grafana"
