import pytest
from pyspark.sql import functions as F

from scholargraph.functions import segment
from scholargraph.functions import text as X


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "kind"), [
    ("* Corresponding author. E-mail: a@b.org", "EXPLICIT_ROLE"), ("Correspondence to: A. Person", "EXPLICIT_ROLE"), ("E-mail: a@b.org", "CONTACT_ONLY"),
    ("* a.b@c.edu", "ROLE_MARKER"), ("✉ e-mail: a@b.org", "ROLE_MARKER"), ("Editorial office: x@y.com", "NOISE"), ("Department of Chemistry", "NONE"), ("", "NONE"),
])
def test_roles(spark, text, kind):
    assert one(spark, X.role_kind, text).kind == kind


def test_emails_and_dois(spark):
    assert one(spark, X.emails, "Write to A@B.org. Or a@b.org, c.d@e.co.uk).") == ["a@b.org", "c.d@e.co.uk"]
    assert one(spark, X.doi, "see DOI 10.1000/AbC(1).") == "10.1000/abc(1"
    assert one(spark, X.resolver_doi, "https://doi.org/10.1/X)") == "10.1/x"
    assert one(spark, X.doi, "none") is None
    assert one(spark, X.doi_list, "10.1000/A, 10.1000/a; 10.2000/b.") == ["10.1000/a", "10.2000/b"]


def test_folding(spark):
    assert one(spark, X.fold_alnum, "Straße — Énergie²") == "strasse energie2"
    assert one(spark, X.casefold, "  Straße  X") == "strasse x"
    assert one(spark, X.search_text, "José  Müller 東") == "jose muller 東"
    row = spark.createDataFrame([("Jean-Luc", "Dupré")], "a string, b string").select(X.name_features("a", "b").alias("f")).first().f
    assert (row.family, row.given, row.initials, row.search_form) == ("dupré", "jean-luc", "jl", "jean-luc dupre")


def test_segments():
    text = "\n".join(f"[{i}] Author {i}, Title, 200{i}." for i in range(1, 6))
    entries, method, sure = segment.segment(text)
    assert [n for n, _ in entries] == [1, 2, 3, 4, 5] and method == "numbered-punctuated" and sure == "HIGH"
    noisy = "[2] a\n[20] page\n[3] b\n[4] c\n[90] x\n[5] d"
    assert [n for n, _ in segment.segment(noisy)[0]] == [2, 3, 4, 5]
    assert segment.segment("[20] a\n[26] b\n[27] c\n[28] d\n[29] e\n[30] f")[0] == []
    assert [n for n, _ in segment.segment("(7) a\n(8) b\n(9) c")[0]] == [7, 8, 9]
    assert segment.segment("Doe 1999. Roe 2001. Poe 2005.")[1:] == ("raw-author-year-or-unsegmented", "MEDIUM")
    assert segment.segment(None)[1:] == ("raw-unsegmented", "LOW")


def test_document_role(spark):
    assert one(spark, X.document_role, "/a/b/paper_SI.pdf").role == "SUPPLEMENTARY"
    assert one(spark, X.document_role, "C:\\x\\paper.pdf").role == "PRIMARY_ARTICLE"
    assert one(spark, X.document_role, None).role == "UNKNOWN"


def test_year_of_a_cited_reference_is_not_in_its_author(spark):
    rows = [("Supplier 1977, 2001, J PART 2, V56, P1977", "Supplier 1977", 2001, "J PART 2"), ("Group 1850, 1999", "Group 1850", 1999, None), ("Doe J 1998 J CHEM, V1", "Doe J 1998 J CHEM", 1998, "J CHEM"), ("2001, J CHEM, V12", "2001", 2001, "J CHEM"), ("Doe J, J CHEM", "Doe J", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "raw string, author string, year int, source string")
    got = df.select(X.cited_reference(F.col("raw")).alias("r")).select("r.author", "r.year", "r.source").collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]
