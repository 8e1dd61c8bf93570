"""The run-length index against counting every stretch of bytes."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scholargraph.llm import queries, run_index



def plain(texts, size):
    """(n_bytes, n_removed, n_spans, kept) of each text, by counting all stretches of `size` bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


def drawn(rng, n):
    """Texts of shared passages, periods, copies, awkward characters, empty ones and nulls."""
    passages = ["".join(rng.choice(list("abcdeé \n"), rng.integers(100, 1500))) for _ in range(5)]
    out = [None, "", "x" * 1200, passages[0], passages[0], "ab" * 450]
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            p = passages[rng.integers(len(passages))]
            parts.append(p[rng.integers(0, len(p) // 3) : rng.integers(len(p) // 2, len(p) + 1)] if rng.random() < 0.6 else "".join(rng.choice(list("pqrstu "), rng.integers(1, 300))))
        out.append("".join(parts))
    return out


def test_index_against_counting():
    rng = np.random.default_rng(3)
    for _ in range(8):
        texts = [(t or "").encode() for t in drawn(rng, 8)]
        seen = Counter(t[i : i + run_index.MATCH] for t in texts for i in range(len(t) - run_index.MATCH + 1))
        got = run_index.RunIndex(texts).matched(np.arange(len(texts)))
        distinct = list(dict.fromkeys(texts))
        twice = dict(zip(distinct, run_index.RunIndex(distinct, [min(2, texts.count(t)) for t in distinct]).matched(np.arange(len(distinct)))))
        for t, starts in zip(texts, got):
            assert starts.tolist() == twice[t].tolist() == [i for i in range(len(t) - run_index.MATCH + 1) if seen[t[i : i + run_index.MATCH]] > 1]


@pytest.mark.parametrize("hot", [2000, 1])
def test_removed_bytes(spark, hot):
    """All steps, with ordinary anchors and with every anchor hot (its matches told apart first)."""
    texts = drawn(np.random.default_rng(hot), 40)
    ids = [None, *range(1, len(texts) - 1), 1]  # a null and a repeated doc_id
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n_bytes string")
    got = run_index.remove_matches(docs, bucket_bytes=3000, shard_text=4000, most=hot).collect()
    want = Counter((i, *row) for i, row in zip(ids, plain(texts, run_index.MATCH)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert sum(r.n_spans for r in got) > 20


def test_query_and_empty_table(spark, tmp_path):
    texts = drawn(np.random.default_rng(9), 20)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_run_index(spark, str(tmp_path)).collect()}
    for i, (n, removed, spans, kept) in enumerate(plain(texts, run_index.MATCH)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    assert run_index.remove_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_a_bucket_in_another_order():
    """A shuffle that is read again may give its rows in another order; the bytes asked for are found all the same."""
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcde "), 500))
    texts = ["".join(rng.choice(list("pqrs "), 900)).encode() for _ in range(6)]
    texts = [t[:300] + passage.encode() + t[300:] if i in (1, 3) else t for i, t in enumerate(texts)]
    docs = pa.table({"p": [0] * 6, "doc_id": range(6), "k1": range(6), "k2": range(6), "text": pa.array(texts, pa.binary())})
    side = pa.table({"p": [0] * 6, "k1": range(6), "k2": range(6), "n": [1] * 6})
    anchors = run_index._recurring(run_index._anchors(docs, side), 1)
    sent = run_index._stretches(docs, pa.concat_tables([side, anchors], promote_options="default"), 1)
    asked = pa.concat_tables([side, run_index._recurring_matches(sent)], promote_options="default")
    for order in (range(6), range(5, -1, -1), [3, 1, 5, 0, 2, 4]):
        got = run_index._match_bytes(docs.take(pa.array(order)), asked, 1)
        assert passage.encode() in b"".join(got.column("text").to_pylist())
