"""Names at the head of a source, and what is forbidden then."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import identity

CASES = [
    # source, given first name, inferred first name, inferred terms, forbidden
    ("Compétences\n" * 46 + "FLORIAN HODARD\nTitre professionnel", "", "FLORIAN", ["HODARD"], ["HODARD"]),
    ("Jean Dupont\nDéveloppeur\n2024 Expérience", "", "Jean", ["Dupont"], ["Dupont"]),
    ("Mr. Jean DUPONT\nTitre", "", "Jean", ["DUPONT"], ["DUPONT"]),
    ("Mme. Jean DUPONT\nTitre", None, "Jean", ["DUPONT"], ["DUPONT"]),
    ("M. Jean DUPONT\nTitre", "", "Jean", ["DUPONT"], ["DUPONT"]),
    ("Jean-Philippe DUPONT\nTitre", "", "Jean-Philippe", ["DUPONT"], ["DUPONT"]),
    ("Compétences techniques :\nSQL Server, Python, AWS\nExpériences :\n2022 - 2024 Développeur chez ACME\nMissions :\nConcevoir les API REST.\nFormation :\nMaster Informatique", "", None, [], []),
    ("INGÉNIEUR DEVOPS\nFlorian HODARD", "", "Florian", ["HODARD"], ["HODARD"]),
    ("Jean\nDUPONT\nTitre professionnel", "", "Jean", ["DUPONT"], []),
    ("INGÉNIEUR DE PRODUCTION GESTION FLUX", "", None, [], []),
    ("Programmation / Langages C#, SQL Server", "", None, [], []),
    ("Jean Dupont <jean@example.com>", "", None, [], []),
    ("", "", None, [], []),
    ("   ", None, None, [], []),
    (None, None, None, [], []),
    ("Charles de GAULLE", "", "Charles", ["GAULLE"], ["GAULLE"]),
    ("Marie CURIE-SKLODOWSKA\nTitre", "", "Marie", ["CURIE-SKLODOWSKA"], ["CURIE-SKLODOWSKA"]),
    ("FLORIAN\nDéveloppeur", "", None, [], []),
    ("JAVA SPRING DEVELOPER", "", None, [], []),
    ("\nNicolas GONZALEZ est DATA Analyst basé à Lyon.\nSQL Server\nCompétences\nGestion de bases de données\n", "Nicolas", None, [], ["GONZALEZ"]),
    ("Nicolas GONZALEZ\nResponsable applicatif", "Nicolas", "Nicolas", ["GONZALEZ"], ["GONZALEZ"]),
    ("Rachid AGOUARANE\nConsultant Esker", "Rachid", "Rachid", ["AGOUARANE"], ["AGOUARANE"]),
    ("Jean Page\nDéveloppeur", "Jean", None, [], ["Page"]),
    ("CV | Jean Dupont | Page 1", "jean", None, [], ["Dupont"]),
    ("CV | Jean Page | Page 1\nautre texte", "Jean Dupont", None, [], ["Page"]),
    ("\nProduction et gestion des flux de données et de fichiers :\nMalik BESSAADIA\nGestion de bases de données (SQL)\n", None, "Malik", ["BESSAADIA"], ["BESSAADIA"]),
    ("\nProduction et gestion des flux de données et de fichiers :\nÀ la suite de l’expansion considérable de son activité, le groupe pour lequel je travaille\n", None, None, [], []),
    ("une ligne\n" * 14 + "Jean DUPONT", "", None, [], []),  # between the depths: too low for a head, too high for a foot
    ("Anne Marie DUPONT MARTIN", "Anne", "Anne", ["Marie", "DUPONT", "MARTIN"], ["Marie", "DUPONT"]),
]


def test_names_and_forbidden_terms(spark):
    rows = [(i, s, g) for i, (s, g, *_) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "id int, source string, candidate_first_name string").selectExpr("*", "'own' AS _lines", "'own' AS _facts", "'own' AS _found")
    out = identity.identified(identity.inferred(d))
    assert {"_lines", "_facts", "_found"} <= set(out.columns)
    for r in out.orderBy("id").collect():
        source, _, name, terms, forbidden = CASES[r["id"]]
        assert r["_lines"] == r["_facts"] == r["_found"] == "own"
        assert (r["inferred_first_name"], r["inferred_terms"]) == (name, terms), source
        assert r["forbidden"] == forbidden, source


def test_a_sharp_s_is_one_capital_as_in_sql(spark):
    """Names in upper case keep their number of characters, as the SQL of ``forbidden_identities`` has them."""
    rows = [(0, "Einßlichö Gechsch", ""), (1, "Text\nWEIẞ Meier", "weiß"), (2, "ŉord ﬁn", "ﬁn")]
    out = identity.identified(spark.createDataFrame(rows, "id int, source string, candidate_first_name string")).orderBy("id").collect()
    names = [r["first_name"] for r in out]
    sql = [duckdb.execute("SELECT upper(?)", [x]).fetchone()[0] for x in ("Einßlichö", "weiß", "ﬁn")]
    assert names == sql == ["EINẞLICHÖ", "WEIẞ", "ﬁN"]
    assert [r["forbidden"] for r in out] == [["Gechsch"], ["Meier"], []]


def test_upper_case_of_every_character_is_that_of_sql(spark):
    every = [chr(i) for i in (*range(0x20, 0xD800), *range(0xE000, 0x10000)) if len(chr(i).upper()) > 1] + list("aéÿœǆ")
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(every)], "i int, c string").orderBy("i").select(text.upper(F.col("c"))).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [c]).fetchone()[0] for c in every]
