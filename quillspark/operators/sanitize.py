"""Removal of contact data and job-board noise, line by line, with counters that hold no removed value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound
from quillspark.functions.text import START, STOP, text_of, word

# Patterns of contact data and of lines to drop.
CONTACTS = {
    "email": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "phone": r"(?<![0-9])(?:0[67][ .-]?(?:[0-9]{2}[ .-]?){3}[0-9]{2}|\+33[ .-]?[67][ .-]?(?:[0-9]{2}[ .-]?){3}[0-9]{2})(?![0-9])",
    "linkedin": r"(?i)(?:https?://)?(?:www\.)?(?:fr\.)?linkedin\.com/in/\S+|(?:https?://)?lnkd\.in/\S+",
    "github": r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9-]+\b/?",
    "url": r"(?i)https?://\S+|www\.\S+|(?<![\p{L}\p{N}_])(?:[a-z0-9-]+\.)+(?:dev|io|app|fr|com|net|org|co|ai|me|xyz|eu|uk|de|es|it|be|ca|ch)(?:/[^\s)]*)?(?![\p{L}\p{N}_])",
}
LABEL = r"(?iu)^(?:coordonn[ée]es?|contact|t[ée]l(?:[ée]phone)?|mobile|email|mail|e-mail|linkedin|github|portfolio|site\s+web)\s*:?\s*$"
NOISE = r"cv\s+t[ée]l[ée]charg[ée]|t[ée]l[ée]charg[ée]\s+depuis|profil\s+consult[ée]|voir\s+le\s+profil|mettre\s+[àa]\s+jour\s+mon\s+cv|candidature|disponibilit[ée]|dispo\s*:|tjm|salaire\s+souhait[ée]|pr[ée]tentions?|pr[ée]tention\s+salariale|permis|mobilit[ée]|type\s+de\s+contrat|contrat\s+souhait[ée]|m[ée]tier\s+recherch[ée]|poste\s+recherch[ée]|d[ée]but|pr[ée]avis"
BOARD, BOARD_WITH = "hellowork", ("cv", "profil", "candidat", "télécharg", "telecharg")
CITY = r"\b[0-9]{5}\s+[A-ZÀ-ÖØ-Þa-zà-öø-ÿ][A-ZÀ-ÖØ-Þa-zà-öø-ÿ' -]{2,}(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
STREET = r"(?iu)^\s*[0-9]{1,4}\s+(?:rue|avenue|av\.?|boulevard|bd\.?|chemin|impasse|all[ée]e|route|place|quai|cours)(?![\p{L}\p{N}_])"
ADDRESS = r"(?iu)^\s*(?:adresse|domicile|domicili[ée]|habite)(?![\p{L}\p{N}_])"
BUSINESS = "mission|chez|client|exp[ée]rience|projet|remote|full-stack"
PUNCTUATION = r"^[\s,;:|/\\•\-–—()\[\].]+$"
HEADER_LINES, LEAST_CHARS, SHRUNK = 25, 400, 0.55
#: A line without this holds no contact of the kind.
NEEDS = {"email": "@", "phone": r"0[67]|\+33", "linkedin": r"(?i)linkedin\.com|lnkd\.in", "github": r"(?i)github\.com", "url": r"(?i)://|www\.|\.[a-z]{2}"}
#: A line without this holds no contact at all.
ANY_CONTACT = r"(?i)@|0[67]|\+33|linkedin|lnkd|github|://|www\.|\.[a-z]{2}"
RESIDUE = (
    (r"(?iu)\(\s*(?:lien|site|url|portfolio|linkedin|github|contact)\s*:?\s*\)", ""),
    (r"(?iu)\b(?:lien|url)\s*:\s*(?=$|[),.;])", ""),
    (r"\(\s*\)", ""),
    (r"\s+([,;:])", "$1"),
    (r"\s+\.(?!\s*(?:NET|Net|net)\b)", "."),
    (r"(?:\s*[-–—|•]\s*){2,}", " - "),
    (r"^[\s,;:|•\-–—]+|[\s,;:|•\-–—]+$", ""),
    (r"[ \t]+", " "),
)


def redacted(rows: DataFrame, text: str, kinds: dict[str, str] = CONTACTS) -> DataFrame:
    """``text`` without contacts, removed kind by kind, and n_<kind>: matches on the text that earlier kinds left."""
    for kind, pattern in kinds.items():
        some = F.coalesce(F.col(text).rlike(NEEDS[kind]), F.lit(False))
        rows = rows.withColumn(f"n_{kind}", F.when(some, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long"))
        rows = rows.withColumn(text, F.when(F.col(f"n_{kind}") > 0, F.regexp_replace(text, pattern, "")).otherwise(F.col(text)))
    return rows


def tidied(text: Column) -> Column:
    for pattern, to in RESIDUE:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


#: A first letter is compared before the border before it, which is slow to tell: those of the phrases of noise, and of the board's name.
NOISE_LINE, BOARD_LINE = (rf"(?iu)(?=[{letters}]){START}(?:{words}){STOP}" for letters, words in (("ctpvmds", NOISE), ("h", BOARD)))


def noise_line(line: Column) -> Column:
    low = F.lower(line)
    mention = F.lit(False)
    for w in BOARD_WITH:
        mention |= low.contains(w)
    return line.rlike(NOISE_LINE) | (line.rlike(BOARD_LINE) & mention)


def _stripped(text: Column, kinds: tuple[str, ...]) -> Column:
    """Struct of the text without contacts, removed kind by kind, and the number of each."""
    if not kinds:
        return F.struct(text.alias("x"))
    kind, pattern = kinds[0], CONTACTS[kinds[0]]
    return bound(F.struct(F.regexp_count(text, F.lit(pattern)).alias("n"), F.regexp_replace(text, pattern, "").alias("x")), lambda a: _joined(kind, a["n"], _stripped(a["x"], kinds[1:]), kinds[1:]))


def _joined(kind: str, n: Column, rest: Column, kinds: tuple[str, ...]) -> Column:
    return bound(rest, lambda r: F.struct(r["x"].alias("x"), n.cast("long").alias(f"n_{kind}"), *[r[f"n_{k}"].alias(f"n_{k}") for k in kinds]))


def line_facts(text: Column) -> Column:
    """Of each line of a text a struct: line, fate (blank, noise, label, address, empty, kept), cleaned (null but for the last two), n_<kind>.

    A line's address test may ask whether the line before it was a dropped street or address line. That depends on
    the raw line alone, so a look at the neighbour within the row's own array is enough: no window, no shuffle.
    """
    blank = lambda c: c.rlike(r"(?U)\s")
    trimmed = lambda x: F.when(blank(F.substring(x, 1, 1)) | blank(F.substring(x, -1, 1)), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)
    lines = F.transform(F.split(F.regexp_replace(text_of(text), "\r\n?", "\n"), "\n"), trimmed)
    bare = lambda c: F.regexp_replace(c, r"(?U)^[^\w]+", "")
    counts = [f"n_{k}" for k in CONTACTS]

    def raw(x: Column, i: Column) -> Column:
        plain = F.when(x == "", "blank").when(noise_line(x), "noise").when(x.rlike(LABEL), "label")
        prefix, street = bare(x).rlike(ADDRESS), (i < HEADER_LINES) & bare(x).rlike(STREET)
        return F.struct(x.alias("line"), plain.alias("fate"), (prefix | street).alias("address"), (plain.isNull() & (prefix | street) & (x.rlike(STREET) | x.rlike(ADDRESS))).alias("opens"))

    def done(line: Column, fate: Column) -> Column:
        hold = F.when(fate.isNull() & (line.rlike(ANY_CONTACT)), _stripped(line, tuple(CONTACTS))).when(fate.isNull(), F.struct(line.alias("x"), *[F.lit(0).cast("long").alias(c) for c in counts]))
        tidy = lambda a: F.struct(tidied(a["x"]).alias("x"), *[F.coalesce(a[c], F.lit(0)).cast("long").alias(c) for c in counts])
        gone = lambda c: (c == "") | c.rlike(PUNCTUATION) | c.rlike(LABEL)
        end = lambda a: F.struct(line.alias("line"), F.coalesce(fate, F.when(gone(a["x"]), "empty").otherwise("kept")).alias("fate"), a["x"].alias("cleaned"), *[a[c].alias(c) for c in counts])
        return bound(bound(hold, tidy), end)

    def each(known: Column) -> Column:
        def one(y: Column, i: Column) -> Column:
            before = F.coalesce(F.get(known, i - 1)["opens"], F.lit(False))
            city = (i < HEADER_LINES) & y["line"].rlike(CITY) & (before | ~bare(y["line"]).rlike(word(BUSINESS)))
            return bound(F.coalesce(y["fate"], F.when(y["address"] | city, "address")), lambda fate: done(y["line"], fate))

        return F.transform(known, one)

    return bound(F.transform(lines, raw), each)


def sanitised_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, line, fate, cleaned, n_<kind> of every line of every row; see ``line_facts``."""
    return docs.select(key, F.posexplode(line_facts(F.col(text))).alias("ord", "x")).select(key, "ord", "x.*")


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, clean_text, raw_chars, clean_chars, counters, warnings and too_short of every row, whatever its key; a null text is empty.

    Kept lines are joined again in order, runs of blank lines as one. All of it is a row's own: nothing is shuffled.
    """
    d = docs.select(key, F.length(text_of(F.col(text))).cast("long").alias("raw_chars"), line_facts(F.col(text)).alias("_f"))
    kept = F.transform(F.filter("_f", lambda x: x["fate"].isin("kept", "blank")), lambda x: F.when(x["fate"] == "kept", x["cleaned"]).otherwise(""))
    clean = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")
    sums = [F.aggregate("_f", F.lit(0).cast("long"), lambda a, x: a + x[f"n_{k}"]).alias(f"n_{k}") for k in CONTACTS]  # noqa: B023
    fates = [F.size(F.filter("_f", lambda x: x["fate"] == f)).cast("long").alias(f"n_{f}") for f in ("noise", "label", "address", "empty")]  # noqa: B023
    d = d.select(key, "raw_chars", clean.alias("clean_text"), *sums, *fates).withColumn("clean_chars", F.length("clean_text").cast("long"))
    shrunk = (F.col("raw_chars") > 0) & (F.col("clean_chars") < F.greatest(F.lit(1), F.floor(F.col("raw_chars") * SHRUNK)))
    warnings = F.array_compact(F.array(F.when(shrunk, "sanitized_text_shrunk_unusually"), F.when(F.col("n_noise") > 0, "hellowork_boilerplate_removed")))
    return d.withColumn("warnings", warnings).withColumn("too_short", F.col("clean_chars") < LEAST_CHARS)


def bad_glyphs(text: Column) -> Column:
    return text.contains("�") | text.contains("\x00")


def looks_like_contact(text: Column) -> Column:
    """For guards of reports: an e-mail, a French number, or a web address."""
    return text.rlike(r"(?i)(?:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})|(?:\+33|\b0[67])(?:[ .-]?[0-9]{2}){4}\b|(?:linkedin\.com/|github\.com/|https?://|www\.)")


def asserted_redacted(report: DataFrame) -> DataFrame:
    """The report; reading it fails if any row holds a contact."""
    whole = F.to_json(F.struct(*report.columns))
    return report.where(F.when(looks_like_contact(whole), F.raise_error(F.lit("the report holds a contact"))).otherwise(F.lit(True)).cast("boolean"))
