"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from scholargraph.llm import near_copies


def texts():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b  c d e"]
    for _ in range(25):
        base = words(rng.randrange(20, 150))
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 18 + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    line = words(12)
    out += [" ".join(line + words(rng.randrange(1, 30))) for _ in range(40)]
    rng.shuffle(out)
    return out


def brute(rows):
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("limit", [64, 3, 1])
def test_all_pairs(spark, limit):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute(rows)
    assert sorted(tuple(r) for r in near_copies.cluster(docs, limit).select("doc_id", "component_id").collect()) == want
    if limit == 64:
        assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {c for _, c in want}


def test_nothing_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert near_copies.cluster(spark.createDataFrame([], kind), 64).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other words")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, kind), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c d e f"), (2, "other words")]


def test_boilerplate_with_own_words(spark):
    """Many texts of one passage with own words, of one size and of several: none is similar to another but the planted
    ones, and entries of the common bucket that cannot match do not meet."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [" ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(8)]) for _ in range(6000)]
    rows += [" ".join(passage + [f"o{i}x{k}" for k in range(14)]) for i in range(300)] + [rows[5] + " and", rows[17] + " or"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.cluster(docs, near_copies.PAIR_LIMIT).select("doc_id", "component_id").collect()}
    assert {d: c for d, c in got.items() if d != c} == {6300: 5, 6301: 17}


def test_fingerprints_come_first(spark, monkeypatch):
    """The generalised pigeonhole over fingerprints links near copies before any prefix is looked at, and only those
    whose sets are similar; bitmaps never turn down a similar pair."""
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:200], "inside", *base[200:]])]
    sets = near_copies.shingle_sets(rows, near_copies.Powers(least=1 << 20))
    bits = [(sum(int(h) >> j & 1 for h in s), j, len(s)) for s in sets[:2] for j in range(64)]
    assert [near_copies.fingerprint(s) % (1 << 64) for s in sets[:2]] == [sum(1 << j for n, j, size in bits[k : k + 64] if 2 * n > size) for k in (0, 64)]
    for a in sets[:6]:
        for b in sets[:6]:
            x, y = (np.unpackbits(near_copies.bits_of(s).view(np.uint8)).astype(bool) for s in (a, b))
            assert (x & ~y).sum() <= len(np.setdiff1d(a, b))
    monkeypatch.setattr(near_copies, "_linked", lambda pairs, docs, classes, repeated, known: known)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.cluster(docs).select("doc_id", "component_id").collect()}
    near = lambda a, b: bin((near_copies.fingerprint(sets[a]) ^ near_copies.fingerprint(sets[b])) % (1 << 64)).count("1") <= near_copies.DISTANCE
    for k in range(0, len(rows), 3):
        assert all(got[i] == k for i in (k + 1, k + 2) if near(k, i)) and {got[i] // 3 for i in range(k, k + 3)} == {k // 3}
    assert sum(d != c for d, c in got.items()) >= 12
