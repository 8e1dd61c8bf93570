"""What the operators promise for nulls, clashing names, repeated rows, ties, long texts and empty tables."""

import hashlib
import itertools
import os
import random
import sys
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from scholargraph.llm import decontaminate, host_rules, licences, line_spread, quality_fm, sharding, simhash, substring, toxicity  # noqa: E402

KIND = "doc_id long, text string"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# Substrings


def test_substrings_of_shared_and_null_ids(spark):
    p, q, r = (" ".join(words(i, 40, 10**6)) for i in (1, 2, 3))
    rows = [(None, p), (3, f"{p} tail"), (3, f"{p} tail"), (4, q), (4, r), (5, f"a {q} b {r}"), (None, r), (6, None), (7, ""), (None, p)]
    df = spark.createDataFrame(rows, KIND).withColumn("p", F.lit("clash")).withColumn("k1", F.lit("clash")).withColumn("kept", F.lit(1))
    got = sorted(((x.doc_id, x.n_words, x.n_removed) for x in substring.remove_repeats(df, 200).collect()), key=str)
    # Rows of one doc_id and text are one place; a null doc_id comes after all others, and equal texts under it are one.
    want = [(None, 40, 40), (None, 40, 40), (None, 40, 40), (3, 41, 0), (3, 41, 0), (4, 40, 0), (4, 40, 0), (5, 82, 80), (6, 0, 0), (7, 0, 0)]
    assert got == sorted(want, key=str)


# SimHash


def test_keep_one_tells_rows_by_id_and_text(spark):
    a, b, c = (" ".join(words(i, 60, 10**6)) for i in (1, 2, 3))
    rows = [(None, a), (None, b), (5, c), (5, "quite another text of its own"), (6, c), (7, c), (7, c), (None, None), (8, "")]
    df = spark.createDataFrame(rows, KIND).withColumn("keep_id", F.lit(1)).withColumn("__keep", F.lit(2)).withColumn("T1", F.lit(3)).withColumn("root", F.lit(4))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, a), (None, b), (5, c), (5, "quite another text of its own"), (8, "")], key=str)
    twice = simhash.keep_one(spark.createDataFrame([(1, a), (1, a), (None, b), (None, b)], KIND))
    assert sorted(((r.doc_id, r.text) for r in twice.collect()), key=str) == sorted([(1, a), (None, b)], key=str)


# Lines


def test_lines_with_clashing_columns(spark):
    rows = [(i, f"everywhere it stands\nown {i}", f"s{i}") for i in range(9)] + [(None, "everywhere it stands", "s99"), (3, "everywhere it stands\nown 3", "s3")]
    df = spark.createDataFrame(rows, f"{KIND}, source string")
    for name in ("n_lines", "key", "id", "row", "drop", "__drop", "l", "site"):
        df = df.withColumn(name, F.lit("clash"))
    with pytest.raises(ValueError):
        line_spread.remove_spread_lines(df)
    out = line_spread.remove_spread_lines(df, 8, counts=("lines_then", "lines_gone"))
    assert out.columns == [*df.columns, "lines_then", "lines_gone"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.lines_gone) for r in out.collect()), key=str)
    # The null doc_id is the first place; repeated rows are treated alike.
    want = [(None, "everywhere it stands", "clash", 0), *[(i, f"own {i}", "clash", 1) for i in range(9)], (3, "own 3", "clash", 1)]
    assert got == sorted(want, key=str)


def test_long_text_of_a_hot_line(spark):
    long = "\n".join(["this line is hot", *(f"line {i} of its own" for i in range(20_000)), "this line is hot"])
    rows = [(1, long, "a"), *[(i, "this line is hot\nrest", f"b{i}") for i in range(2, 12)]]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_spread.remove_spread_lines(spark.createDataFrame(rows, f"{KIND}, source string")).collect()}
    assert got == {1: (20_002, 1), **{i: (2, 1) for i in range(2, 12)}}


# Toxicity


def model(texts):
    """The character model of texts, counted plainly."""
    counts = {}
    for t in texts:
        for w in t.split():
            s = [0, 0, *(toxicity.code_of(c) for c in w), 0]
            for a, b, c in zip(s, s[1:], s[2:]):
                key = a << 42 | b << 21 | c
                counts[key] = counts.get(key, 0) + 1
    return toxicity.CharacterModel(np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))


VOCABULARY = "you stupid idiot person table garden window letter market summer people little number follow ass".split()


def cheapest(m, token):
    """The best reading over every path of the lattice."""
    best = None
    for path in itertools.product(*toxicity.Decoder(m).lattice(token)):
        text, z = "".join(a for a, _ in path), sum(c for _, c in path)
        x = y = 0
        for c in text:
            k = toxicity.code_of(c)
            z += m.cost(x << 42 | y << 21 | k)
            x, y = (0, 0) if k == 0 else (y, k)
        z += m.cost(x << 42 | y << 21)
        best = min(best or (z, text), (z, text))
    return best[0]


def cost_of(m, token, reading):
    return min(
        sum(c for _, c in path) for path in itertools.product(*toxicity.Decoder(m).lattice(token))
        if " ".join("".join(a for a, _ in path).replace("^", " ").split()) == reading)


@pytest.mark.parametrize("token", ["1d10t", "id.i-ot", "s.t.u.p.1.d", "i d i o t", "$tup!d", "l3tt3r", "t4bl3", "ooo1", "a*s", "x_1_2"])
def test_decoding_is_the_best_of_all_paths(token):
    m = model(VOCABULARY * 5)
    reading = toxicity.Decoder(m).decode(token)
    z, x, y = 0.0, 0, 0
    for c in reading.replace(" ", "^"):
        k = toxicity.code_of(c)
        z += m.cost(x << 42 | y << 21 | k)
        x, y = (0, 0) if k == 0 else (y, k)
    z += m.cost(x << 42 | y << 21)
    assert z + cost_of(m, token, reading) == pytest.approx(cheapest(m, token), abs=1e-9)


def test_disguises_of_any_length():
    reader = toxicity.Reader(model(VOCABULARY * 20))
    for token, word in [("1d10t", "idiot"), ("idi" + "o" * 70 + "t", "idiot"), ("i" + "." * 70 + "diot", "idiot"), ("$$$tupid", "stupid"), ("***$tupid", "stupid"),
                        ("4$$", "ass"), ("-".join("stupid" * 1), "stupid"), ("i-d-i-o-t_" * 40, "idiot")]:
        assert word in reader.token(token), token
    assert reader.token("455") == ("455",) and reader.token("1,455.00") == ("1,455.00",) and reader.token("garden") == ("garden",) and reader.token("...") == ()
    run = " ".join("stupidperson" * 60)
    got = reader.words(f"see {run} end")
    assert got["see"] == 1 and sum(n for w, n in got.items() if "stupid" in w or "person" in w) >= 60
    assert reader.words(None) == {} == reader.words("  ")


def test_trigrams_of_all_scripts(spark):
    texts = ["Table, table!", "стол стол", "東京", None, "", "a^b", "x1"]
    got = {r.t: r.n for r in toxicity.count_trigrams(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    m = model([w for w in "table table стол стол 東京 a~b x1".split()])
    assert got == m.three
    assert toxicity.count_trigrams(spark.createDataFrame([], "text string")).count() == 0


# Licences


def plain_scan(m, rows):
    out, weights = [], dict(zip(m.vocabulary, m.weights))
    for d, text in rows:
        found = []
        for line in (text or "").split("\n"):
            w = [x for x in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if x]
            g = ({*w} | {f"{a} {b}" for a, b in zip(w, w[1:])}) & set(weights)
            if not g:
                continue
            z = np.array(m.intercepts) + sum(np.array(weights[x]) for x in g)
            p = np.exp(z - z.max())
            p /= p.sum()
            k = int(p.argmax())
            if k == len(m.names) - 1:
                continue
            share = max((len(g & set(t)) / len(t) for t in m.templates[k]), default=0) if k < len(m.templates) else 0
            sure = k < len(m.templates) and p[k] >= m.threshold and share >= 0.5
            found.append((m.names[k] if sure else "unknown", sure, p[k]))
        sures = [f for f in found if f[1]]
        out.append((d, len(found), len(sures), ",".join(sorted({f[0] for f in found})), sures[0][0] if sures else "unknown" if found else "none", round(float(max((f[2] for f in sures), default=0)), 4)))
    return sorted(out, key=str)


def test_licences_against_a_plain_scan(spark):
    rng = random.Random(3)
    filler = [" ".join(words(i, 12)) for i in range(60)]
    said = [way.format(c) for name in ("MIT", "GPL", "CC-BY-NC", "unknown") for c in licences.CALLED[name] for way in licences.WAYS[:4]] + ["See the license for details", "Licensed under"]
    texts = [f"{rng.choice(filler)}\n{rng.choice(said)}.\n{rng.choice(filler)}\n{rng.choice(said)}" for _ in range(40)] + filler + [None, "", "   \n", " ".join(words(9, 3000)) + " Released under the MIT License"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, said[0])]
    df = spark.createDataFrame(rows, KIND).withColumn("row", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("words", F.lit(2)).withColumn("licence", F.lit("x"))
    m = licences.fit(df)
    assert 0.5 <= m.threshold <= 0.95
    got = sorted(((r.doc_id, r.n_licence, r.n_confirmed, r.families, r.licence, r.probability) for r in licences.scan(df, m).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in plain_scan(m, rows)]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in plain_scan(m, rows)], abs=2e-4)


# The others


def test_contamination_digest_and_null_items(spark):
    rows = [(1, " ".join(words(1, 30))), (1, " ".join(words(1, 30))), (2, "nothing of it"), (None, " ".join(words(2, 12)))]
    items = [(7, " ".join(words(1, 14))), (70, " ".join(words(1, 30)[10:24])), (None, " ".join(words(2, 12)))]
    docs = spark.createDataFrame(rows, KIND).withColumn("items", F.lit(0)).withColumn("matches", F.lit(1))
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_hit, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect()), key=str)
    # A null item_id stands as an empty id.
    want = sorted(((d, h, s) for d, _, h, _, s, _ in brute.contamination(rows, [("" if i is None else i, t) for i, t in items])), key=str)
    assert got == want


def test_shards_of_null_ids_and_one_huge_text(spark):
    rows = [(None, "a"), (None, "b"), (1, "x" * 5000), (2, ""), (3, None), (4, "y")]
    got = sharding.assign_shards(spark.createDataFrame(rows, KIND).withColumn("block", F.lit(1)), 4).collect()
    order = sorted(((d is not None, d or 0, zlib.crc32((t or "").encode()), len(t or "") + 16) for d, t in rows))
    total, at, want, slots = sum(s for *_, s in order), 0, [], {}
    for known, d, crc, size in order:
        k = min(3, at * 4 // total)
        want.append((d if known else None, size, crc, k, slots.get(k, 0)))
        slots[k], at = slots.get(k, 0) + 1, at + size
    assert sorted([(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got], key=str) == sorted(want, key=str)


def test_host_rules_of_long_and_repeated_rows(spark):
    long = " ".join(words(4, 30_000, 10**6))
    rows = [(1, long, "h"), (1, long, "h"), (2, "same words again " * 40, "h"), (None, long, None)]
    df = spark.createDataFrame(rows, f"{KIND}, source string").withColumn("host", F.lit("clash")).withColumn("kept", F.lit(0))
    got = sorted(((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in host_rules.judge_documents(df).collect()), key=str)
    assert got == sorted([(1, 30_000, 0, False, True), (1, 30_000, 0, False, True), (2, 120, 120, True, False), (None, 30_000, 0, False, True)], key=str)


def test_quality_scores_are_the_pair_sums(spark):
    """Scores of the operator against the machine's definition, pair by pair; long texts, ties and clashing columns."""
    texts = [None, "", "one two three", "one two three", "| $$ ## 12 A", " ".join(words(5, 5000))]
    rng = np.random.default_rng(1)
    m = quality_fm.Machine()
    m.w, m.bias = rng.normal(0, 0.3, len(m.w)).astype(np.float32), -0.2
    df = spark.createDataFrame(list(enumerate(texts)), KIND).withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))
    got = {r.doc_id: r.score for r in quality_fm.score(df, m).collect()}
    for d, t in enumerate(texts):
        ids, x = quality_fm.features(t, None if t is None else len(t), {})
        z = m.bias + sum(float(m.w[i]) * v for i, v in zip(ids, x))
        v = m.v[ids].astype(float) * x[:, None]
        z += sum(float(v[i] @ v[i + 1 :].sum(axis=0)) for i in range(len(ids) - 1))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert got[2] == got[3]
