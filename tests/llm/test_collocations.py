"""Grown collocations against counting all phrases."""

import re
from collections import Counter

import numpy as np
import pytest

from scholargraph.llm import bitmaps, collocations


def plain(rows, top, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    often = {p: c for p, c in f.items() if c >= least}
    out = {}
    for p, a in often.items():
        lang, words = p[0], p[1:]
        if len(words) < 2:
            continue
        score, k = min((2000000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        inside = lambda q: any(q[i : i + len(words)] == words for i in range(len(q) - len(words) + 1))
        if not any(100 * c >= 80 * a for q, c in often.items() if q[0] == lang and len(q) > len(p) and inside(q[1:])):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


def drawn(rng, n):
    vocabulary = ["the", "of", "Und", *(f"w{i}" for i in range(40)), "é", "naïve"]
    weights = np.array([12, 8, 6, *(3 / (i + 1) for i in range(40)), 0.5, 0.5])
    fixed = ["strong tea leaves today", "new york city", "w1 w2 w3 w4 w5", "the of the"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 30)):
            parts.append(str(rng.choice(fixed)) if rng.random() < 0.2 else " ".join(rng.choice(vocabulary, rng.integers(1, 7), p=weights / weights.sum())))
        rows.append((rng.choice(["en", "de", None], p=[0.6, 0.3, 0.1]), "".join(p + str(rng.choice([". ", ", ", " ", "\n", "\t", "!"])) for p in parts)))
    return [(None if x is None else str(x), t) for x, t in rows] + [("en", None), ("en", ""), ("xx", "alone")]


@pytest.mark.parametrize("top, least", [(5, 3), (40, 4), (10_000, 3)])
def test_against_counting(spark, top, least):
    """A few phrases (floors bound the growth, ties at the end), more of them, and all."""
    rows = drawn(np.random.default_rng(top), 60)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, phrase string")
    got = {tuple(r) for r in collocations.collocations(docs, top, least).collect()}
    assert got == plain(rows, top, least)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_bitmaps_and_words(spark):
    """A bit is found again for every hash, negative ones too; equal words of a language are equal, pieces divide them."""
    rng = np.random.default_rng(0)
    some = rng.integers(-(2**63), 2**63 - 1, 500)
    found = bitmaps.bitmap(spark.createDataFrame([(int(x),) for x in some], "h long"), 1 << 12)
    assert bitmaps.has(found, some.view(np.uint64)).all() and bitmaps.has(found, rng.integers(0, 2**63, 4000).astype(np.uint64)).mean() < 0.2
    rows = spark.createDataFrame([(int(x),) for x in some[:50]], "x long")
    assert rows.filter(bitmaps.may_be_in(spark.createDataFrame([(int(x),) for x in some[:10]], "h long"), rows["x"], 1 << 20)).count() >= 10
    a = collocations.Words([b"One two, three", b"x ONE two"], np.array([1, 1], np.uint64))
    assert a.value[0] == a.value[4] and a.value[1] == a.value[5] and a.joined.tolist() == [True, False, False, True, True]
