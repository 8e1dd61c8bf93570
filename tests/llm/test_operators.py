"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from scholargraph.llm import (  # noqa: E402
    decontaminate,
    host_rules,
    licences,
    line_spread,
    packing,
    quality_fm,
    sharding,
    simhash,
    substring,
    toxicity,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def table(spark, texts, sources=None, **extra):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    # Columns whose names an operator might use inside.
    for name in ("row", "pos", "key", "fp", "component_id", "shard", "slot", "block", "bin", "words", "n", "size", "score", "label", "kept", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def texts_with_everything():
    passage = " ".join(words(1, 30))
    base = " ".join(words(2, 200))
    near = base.replace(base.split()[100], "changed", 1)
    return [
        None, "", "   \n\t ", "one", "one two", base, base, base + " x", near, passage + " tail a b", "head c " + passage, passage + " " + passage,
        " ".join(words(3, 6000)), "Ünïcödé 東京 é ß words here to see", "a  b\n\nc", base, "dots... and <|endoftext|> marks", passage,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts_with_everything()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, ["x"]).limit(0)


def plain(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows.select(*columns).collect()), key=str)


def test_shards(spark, docs, nothing):
    got = sharding.assign_shards(docs, 5)
    want = brute.shards([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert plain(got, "doc_id", "size", "text_crc32", "shard", "slot") == sorted(want, key=str)
    assert sharding.assign_shards(nothing, 5).count() == 0
    twice = docs.unionByName(docs)
    slots = sharding.assign_shards(twice, 5).groupBy("shard").agg(F.count("slot").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()
    assert all(r.n == r.d == r.m + 1 for r in slots) and sum(r.n for r in slots) == 2 * docs.count()


def test_host_rules(spark, nothing):
    good, bad = " ".join(words(5, 80)), "same same same same"
    texts = [good, None, "", bad, good + "\nline x\nline x", "a b c " * 30] + [bad] * 30 + [good] + [good] * 20
    sources = ["fine"] * 6 + ["junk"] * 31 + ["fine"] * 20
    df = table(spark, texts, sources)
    got = {r.doc_id: r for r in host_rules.judge_documents(df).collect()}
    assert got[0].kept and not got[0].base_failed and got[0].n_words == 80
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[3].n_repeat_words == 4
    assert got[4].n_dup_lines == 1 and got[5].n_repeat_words == 90 and got[5].base_failed
    assert not got[36].base_failed and not got[36].kept and got[36].host_rate > 0.5
    assert host_rules.judge_documents(nothing).count() == 0
    no_host = df.withColumn("source", F.lit(None).cast("string"))
    assert all(r.kept == (not r.base_failed) and r.host_rate is None for r in host_rules.judge_documents(no_host).collect())


def test_line_spread(spark, nothing):
    common, rare = "This line is everywhere", "Only here it stands"
    texts = [f"{common}\nown text {i} is kept\nshort" for i in range(12)] + [None, "", rare + "\n" + rare]
    df = table(spark, texts, [f"site{i}" for i in range(15)])
    got = {r.doc_id: r for r in line_spread.remove_spread_lines(df, 8).collect()}
    assert got[0].text.startswith(common) and got[0].n_removed == 0
    assert all(got[i].text == f"own text {i} is kept\nshort" and got[i].n_removed == 1 and got[i].n_chars == len(got[i].text) for i in range(1, 12))
    assert got[12].text is None and got[12].n_lines == 0 and got[13].text == "" and got[14].n_removed == 0
    assert line_spread.remove_spread_lines(nothing).count() == 0
    one_site = df.withColumn("source", F.lit("same"))
    assert line_spread.remove_spread_lines(one_site, 2).agg(F.sum("n_removed")).first()[0] == 0


def test_decontamination(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(7, " ".join(words(1, 14))), (8, "one TWO"), (9, None), (10, ""), (70, " ".join(words(2, 200)[50:62])), (7, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = sorted(((d, n, h, k, c) for d, n, h, k, _, c in brute.contamination(rows, items)), key=str)
    for block in (decontaminate.BLOCK_BYTES, 60):
        got = decontaminate.contamination(docs, bench, block).withColumn("n_items", F.size("items"))
        assert plain(got, "doc_id", "n_words", "n_hit", "n_items", "contaminated") == want
    clean = {d for d, *_, c in want if not c}
    left = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == clean and left.columns == docs.columns
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_simhash(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(brute.components(rows), key=str)
    for limit in (64, 1):  # 1: every shared bucket is linked without pairs
        got = simhash.cluster(docs, limit).select("doc_id", simhash.hex_of(F.col("fp")).alias("f"), "component_id")
        assert plain(got, "doc_id", "f", "component_id") == want
    assert simhash.cluster(nothing).count() == 0
    kept = simhash.keep_one(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want}) and kept.columns == docs.columns


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    fps = {int(x) for x in centres}
    for c in centres[:20].astype(np.uint64):
        for _ in range(15):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.add(int((c ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))).view(np.int64)))
    a = np.array(sorted(fps), np.int64)
    near = {(int(x), int(y)) for i, x in enumerate(a) for y in a[i + 1 :] if int(np.bitwise_count(np.uint64(x.view(np.uint64) ^ y.view(np.uint64)))) <= 2}
    df = spark.createDataFrame([(int(x),) for x in a], "fp long")
    for plan in (simhash.plan_partitions(a, len(a)), [(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(0, 21)), 0), (list(range(21, 42)), 0), (list(range(42, 64)), 0)]):
        got = {tuple(sorted((r.a, r.b))) for r in simhash.link_fingerprints(df, plan, 1000).collect()}
        assert got == near


def test_threshold_allocation():
    assert simhash.allocate([[0, 5, 9], [0, 1, 100], [0, 2, 3]], 0) == (4, [-1, 0, 1])
    assert simhash.allocate([[0, 5, 90], [0, 1, 100], [0, 2, 30]], 0) == (8, [0, 0, 0])
    assert simhash.allocate([[0, 5, 90], [0, 1, 100], [0, 2, 30]], 3) == (220, [1, 1, 1])


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    got = packing.pack(docs, BPE, capacity=256, block=8).collect()
    by, bins = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for d, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids[d])
        assert len(pieces) == -(-len(ids[d]) // 256) and all(p.length == 256 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][p.start : p.start + p.length], "<u4").tobytes())
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))] and sum(r.length for r in rows) <= 256
    assert len(bins) <= -(-sum(map(len, ids.values())) // 256) + 2
    assert packing.pack(nothing, BPE).count() == 0


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "x\n\ny", "don't 's it's", "a\tb c", "12,34 5.", "\n", "\n a", "a \nb", "x\r\ny", "a　b c", "ab\x1cc d", ".,! a", "word,'s", "<|endoftext|>"])
def test_encoder_is_exact(text):
    encoder = packing.Encoder(BPE)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.ids(text)


def test_encoder_forgets_exactly():
    """Words that left the memory, or moved between its generations, are encoded as before."""
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(BPE), packing.Encoder(BPE, 20)
    texts = ["\n".join(" ".join(words(k + j, 9, 60)) for j in range(3)) for k in range(30)] + ["x <|endoftext|> y", "<|endoftext|>"]
    for a in range(0, len(texts), 4):
        got = encoder.encode(texts[a : a + 4])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts[a : a + 4]]
    assert np.frombuffer(encoder.encode(["x <|endoftext|> y"])[0], "<u4").tolist() == [87, 220, 50256, 331]


def test_genetic_steps():
    """Every step keeps the items and the capacity; evolution saves bins over its random seeds, and elites are kept."""
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(100, 900, 400)]
    a, b = (packing.shuffled_fit(sizes, 2048, rng) for _ in range(2))
    island, other = packing.evolve(sizes, [], 2048, 1), packing.evolve(sizes, [], 2048, 2)
    last = packing.evolve(sizes, [island, other], 2048, 3)
    for s in (a, b, packing.crossover(a, b, sizes, 2048, rng), packing.mutate(a, sizes, 2048, rng), island, other, last):
        assert sorted(i for x in s for i in x) == list(range(400)) and all(sum(sizes[i] for i in x) <= 2048 for x in s)
    plain = len(packing.best_fit(list(range(400)), sizes, [], 2048))
    assert len(island) < len(a) and len(island) < len(b) and len(last) <= min(len(island), len(other), plain) and island != other
    assert packing.evolve([], [], 2048, 0) == [] and packing.evolve([5], [], 2048, 0) == [[0]]


@pytest.mark.parametrize("seed", [16, 21, 22])
def test_genetic_search_beats_plain_best_fit(spark, seed):
    """Sizes on which the plain best fit stays one bin above the bound: islands, with migration, meet it."""
    sizes = np.clip(np.random.default_rng(seed).lognormal(6, 0.9, 500), 20, 2000).astype(int).tolist()
    least, plain = -(-sum(sizes) // 2048), packing.best_fit(list(range(500)), sorted(sizes), [], 2048)
    got = packing.pack_items(spark.createDataFrame(list(enumerate(sizes)), "pid long, length long"), 500, 2048)
    fills = got.groupBy("block", "bin").agg(F.sum("length").alias("n")).collect()
    assert len(plain) == least + 1 and len(fills) == least and max(r.n for r in fills) <= 2048
    assert sorted((r.pid, r.length) for r in got.collect()) == list(enumerate(sizes))


def test_refill_only_fills():
    """Exchanges keep every item once, never overfill, and never empty a bin's gain."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 700, 120).tolist()
        bins = packing.best_fit(list(range(80)), sizes, [], 2048)
        before = sorted(sum(sizes[i] for i in b) for b in bins)
        got = packing.refill([list(b) for b in bins], list(range(80, 120)), sizes, 2048)
        assert sorted(i for b in got for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 2048 for b in got)
        assert all(a <= b for a, b in zip(before, sorted((sum(sizes[i] for i in b) for b in got), reverse=True)[: len(before)][::-1]))


def test_packing_across_blocks_saves_bins(spark):
    """On items of about a third of a bin each block alone leaves bins half full; rounds across blocks save them."""
    rng = random.Random(2)
    items = spark.createDataFrame([(i, rng.randrange(500, 900)) for i in range(600)], "pid long, length long")
    total = -(-items.agg(F.sum("length")).first()[0] // 2048)
    got = packing.pack_items(items, 600, 2048, 100)
    assert got.select("pid").distinct().count() == got.count() == 600
    before, after = got.select("block", "bin").distinct().count(), packing.pack_items(items, 600, 2048, 600).select("block", "bin").distinct().count()
    assert total <= after <= before
    assert got.groupBy("block", "bin").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_substrings(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(brute.substrings(rows))
    assert substring.remove_repeats(nothing).count() == 0


def test_substrings_of_random_texts(spark):
    rng = random.Random(9)
    pool = [words(100 + i, 60, 50) for i in range(6)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(pool)
            a = rng.randrange(0, 40)
            t += p[a : a + rng.randrange(5, 50)] + words(rng.random(), rng.randrange(0, 15), 30)
        texts.append(" ".join(t))
    df = table(spark, texts)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(df).collect()]
    assert sorted(got) == sorted(brute.substrings(list(enumerate(texts))))


def labelled(spark, good, bad, column):
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, int((i < len(good)) == (column == "quality"))) for i, _ in rows], f"doc_id long, {column} int")
    return docs, labels


def test_quality(spark, nothing):
    good = [" ".join(words(i, 60)) + "." for i in range(120)]
    bad = [" ".join(w + "$$$" for w in words(i, 60)) for i in range(120)]
    docs, labels = labelled(spark, good, bad, "quality")
    extra = docs.unionByName(spark.createDataFrame([(900, None, None), (901, "", 0), (901, "", 0)], "doc_id long, text string, n_chars long"))
    got = quality_fm.judge(extra, labels).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.doc_id < 120) for r in got if r.doc_id < 240)
    assert {r.held_out for r in got} == {True, False}
    assert quality_fm.judge(nothing, labels).count() == 0
    assert all(r.score == pytest.approx(0.5, abs=0.2) for r in quality_fm.judge(docs, labels.limit(0)).collect())
    kept = quality_fm.keep_good(extra, labels)
    assert {r.doc_id for r in kept.filter("doc_id < 900").collect()} == set(range(120)) and kept.columns == extra.columns


def test_factor_identity():
    m = quality_fm.Machine()
    ids, values = np.array([3, 9, 27], np.int32), np.array([0.5, 1.0, 2.0], np.float32)
    pairs = sum(float(m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(zip(ids, values)) for b, y in list(zip(ids, values))[i + 1 :])
    assert float(m.margins(ids, values, np.array([0]))[0]) == pytest.approx(pairs, abs=1e-5)


def test_toxicity(spark, nothing):
    rng = random.Random(1)
    vocabulary = ["table", "garden", "window", "letter", "market", "summer", "people", "little", "number", "follow"]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(40))
    good, bad = [text() for _ in range(150)], [text() + f" you {w} person" for w in ["idiot", "moron", "stupid"] * 50]
    docs, labels = labelled(spark, good, bad, "toxic")
    tests = [text() + x for x in (" you 1d10t", " you i d i o t person", " you id.i-ot", " you idiooooot", " you $tup1d", "")] + [None, ""]
    extra = docs.unionByName(spark.createDataFrame([(1000 + i, t, 0) for i, t in enumerate(tests)], "doc_id long, text string, n_chars long"))
    got = {r.doc_id: r for r in toxicity.judge(extra, labels).collect()}
    assert all(got[i].predicted == (i >= 150) for i in range(300))
    assert [got[1000 + i].predicted for i in range(8)] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert toxicity.judge(nothing, labels).count() == 0
    assert all(r.score == 0.5 for r in toxicity.judge(docs, labels.limit(0)).collect())


def test_licences(spark, nothing):
    filler = [" ".join(words(i, 12)) for i in range(60)]
    texts = [f"{filler[0]}\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under CC BY-NC 4.0.", "All rights reserved. Use is subject to license terms.", None, "", *filler]
    got = {r.doc_id: r for r in licences.scan(table(spark, texts)).collect()}
    assert [got[i].licence for i in range(4)] == ["Apache-2.0", "MIT", "GPL", "CC-BY-NC"] and got[4].licence == "unknown"
    assert all(got[i].licence == "none" and got[i].n_licence == 0 for i in range(5, len(texts)))
    assert licences.scan(nothing).count() == 0
