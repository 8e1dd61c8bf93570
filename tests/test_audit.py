"""Audit rules: every flag fires where it should, and none where the document is not read so far."""

from scholargraph.operators import audit

TITLE = "a long enough title of words"
GOOD = f"{TITLE} by smith and jones with enough front matter to be read by anyone at all, surely"


def made(spark, texts, spans, documents=None, papers=None, mapped=()):
    n = len(texts)
    papers = papers or [(i, TITLE, None) for i in range(n)]
    documents = documents if documents is not None else [(i, i, "PRIMARY_ARTICLE", 0.6) for i in range(n)]
    mentions = [(i, f) for i in range(n) for f in ("Smith", "Jones")]
    rows = audit.wide_rows(
        spark.createDataFrame(papers, "paper long, title string, doi string"), spark.createDataFrame(mentions, "paper long, family string"),
        spark.createDataFrame(documents, "paper long, document long, role string, confidence double"),
        spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "document long, pages long, error string, front string, has_references boolean"),
        spark.createDataFrame(spans, "document long, kind string, text string"), spark.createDataFrame(list(mapped), "paper long, mention long"))
    return {r.paper: r for r in audit.audit(rows).collect()}


def test_every_flag(spark):
    texts = [
        (9, None, GOOD, True), (9, None, GOOD, False), (9, None, "short", True), (9, None, "nothing of it " * 9, True), (9, None, GOOD + " doi 10.1000/other", True),
        (9, "broken", None, None), (9, None, GOOD, True), (9, None, GOOD, True), (9, None, GOOD, True), (9, None, GOOD, True), (9, None, GOOD, True), (3, None, GOOD, False)]
    spans = [(6, "ROLE", "Corresponding author: a@b.org, c@d.org"), (7, "ROLE", "Corresponding author"), (8, "CONTACT", "e-mail: a@b.org"), (9, "MARKER", "*")]
    documents = [(i, i, "PRIMARY_ARTICLE", 0.6) for i in range(10)] + [(10, 10, "SUPPLEMENTARY", 0.9), (11, 11, "PRIMARY_ARTICLE", 0.6), (11, 12, "PRIMARY_ARTICLE", 0.5)]
    papers = [(i, TITLE, "10.1000/own" if i == 4 else None) for i in range(13)]
    got = made(spark, texts, spans, documents, papers, [(6, 1)])
    want = {
        0: [], 1: ["NO_REFERENCE_SECTION"], 2: ["LOW_SOURCE_AUTHOR_HEADER_COVERAGE", "LOW_TITLE_FRONT_MATTER_OVERLAP", "NO_USABLE_FRONT_MATTER_TEXT"],
        3: ["LOW_SOURCE_AUTHOR_HEADER_COVERAGE"], 4: ["FRONT_MATTER_DOI_CONFLICT"], 5: ["PDF_PARSE_ERROR"], 6: ["ROLE_EMAIL_AUTHOR_COUNT_MISMATCH"],
        7: ["ROLE_SIGNAL_UNMAPPED_TO_SOURCE_AUTHOR", "ROLE_SIGNAL_WITHOUT_EMAIL"], 8: ["CONTACT_WITHOUT_ROLE_SIGNAL"], 9: ["AUTHOR_MARKER_WITHOUT_ROLE_SIGNAL"],
        10: ["SELECTED_SUPPLEMENTARY_DOCUMENT"], 11: ["MULTIPLE_PRIMARY_CANDIDATES"], 12: ["NO_AVAILABLE_PRIMARY_PDF"]}
    assert {k: list(r.flags) for k, r in got.items()} == want
    assert {f for v in want.values() for f in v} == {name for name, _, _ in audit.RULES}
    assert [got[i].severity for i in (0, 4, 11, 12)] == ["P3", "P0", "P1", "P0"] and not got[12].requires_review


def test_empty(spark):
    assert made(spark, [], [], [], papers=[(1, None, None)])[1].flags == ["NO_AVAILABLE_PRIMARY_PDF"]
