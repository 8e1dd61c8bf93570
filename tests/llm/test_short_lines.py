"""Lines of one or two words, and of scripts without spaces, in the pipeline's line stage."""

import corpus_pipeline


def test_short_lines_on_many_sites(spark):
    rows = [(i, f"Menu\n\n \n版权所有，保留一切权利。\nown{i} text", f"s{i}", 0) for i in range(9)]
    rows += [(20 + i, f"few\nother{i}", f"s{i % 7}", 0) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    want = {d: t for d, t, _, _ in rows} | {i: f"\n \nown{i} text" for i in range(1, 9)}
    assert got == want
