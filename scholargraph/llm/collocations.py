"""Phrase collocations: best-first growth of phrases from their prefixes, bounded by what a prefix's count allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.llm.bitmaps import bitmap, has
from scholargraph.llm.substring import SHARD_BYTES, Powers, _mix
from scholargraph.operators.lineage import staged

#: Least count and most words of a phrase, phrases reported of a language, and per cent that make a longer phrase cover it.
LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Bits of the bitmaps that tell a task which phrases to count: all frequent pairs, and the phrases of one round.
PAIR_BITS, ROUND_BITS = 1 << 25, 1 << 22
#: Bytes of text whose pairs are counted in one task, and distinct pairs that a task holds.
BUCKET_BYTES, HELD = 16 << 20, 3_000_000

_POWERS = Powers()
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_BREAK[[0x20, 0x09]] = 1
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Words:
    """The words of several texts: `value` tells a word of a language, `joined[i]` whether word i + 1 is in its piece."""

    def __init__(self, texts: list[bytes | None], langs: np.ndarray):
        parts = [t or b"" for t in texts]
        self.bytes = b"\n".join([*parts, b""]).translate(_LOWER)
        raw = np.frombuffer(self.bytes, np.uint8)
        kind = _BREAK[raw]
        space = kind > 0
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _POWERS.to(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        self.doc = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), self.start, "right")
        self.value = _mix(_mix((total[self.end] - total[self.start]) * down[self.start]) ^ langs[self.doc])
        breaks = np.cumsum(kind == 2)
        piece = breaks[self.start]
        self.joined = piece[1:] == piece[:-1]

    def word(self, i: int) -> str:
        return self.bytes[self.start[i] : self.end[i]].decode("utf-8", "replace")

    def chains(self, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 2, 3, ... words: (places at which so many stand in one piece, the hashes of these phrases)."""
        at, h, out = np.arange(len(self.value)), self.value, []
        for m in range(1, longest):
            if len(at):
                fits = at + m < len(self.value)
                fits[fits] = self.joined[at[fits] + m - 1]
                at, h = at[fits], h[fits]
                h = _mix(h * _STEP + self.value[at + m])
            out.append((at, h))
        return out


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """Words of the texts of a batch, and the language of each text."""
    texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
    marks = batch.column("mark").to_numpy().view(np.uint64)
    a = used = 0
    for i, t in enumerate(texts):
        used += len(t or b"")
        if used >= SHARD_BYTES or i + 1 == len(texts):
            yield Words(texts[a : i + 1], marks[a : i + 1]), langs[a : i + 1]
            a, used = i + 1, 0


class Tally:
    """Counts of hashes, merged when as many new ones wait as there are."""

    def __init__(self):
        self.h, self.n, self.waiting, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, h: np.ndarray) -> None:
        self.waiting.append(h)
        self.size += len(h)
        if self.size > max(len(self.h), HELD // 2):
            self.merge()

    def merge(self) -> None:
        h = np.concatenate([self.h, *self.waiting])
        n = np.concatenate([self.n, np.ones(self.size, np.int64)])
        by = np.argsort(h)
        h, n = h[by], n[by]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        self.h, self.n = h[new], np.add.reduceat(n, new) if len(h) else n
        self.waiting, self.size = [], 0


_TALLIED = "r long, lang string, h array<long>, n array<long>, word array<string>"


def _rows(r: np.ndarray, lang: list, h: list, n: list, word: list) -> pa.RecordBatch:
    of = lambda lists, kind: pa.array(lists, pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(lang, pa.string()), of(h, pa.int64()), of(n, pa.int64()), of(word, pa.string())], names=["r", "lang", "h", "n", "word"])


def _dealt(tally: Tally, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(r, places in the tally): the hashes of each shard."""
    to = (tally.h % np.uint64(shards)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1])) if len(by) else by
    for x, y in zip(edge, np.append(edge[1:], len(by))):
        yield int(to[by[x]]), by[x:y]


def _pairs_out(pairs: Tally, shards: int) -> Iterator[pa.RecordBatch]:
    pairs.merge()
    for r, at in _dealt(pairs, shards):
        yield _rows([r], [None], [pairs.h[at].view(np.int64)], [pairs.n[at]], [None])


def _tallies(shards: int) -> Callable:
    """Of a partition: the words of each language with their counts, and the counts of the hashes of its pairs."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, names = Tally(), Tally(), {}
        known = np.empty(0, np.uint64)
        total: dict[str, int] = {}
        for batch in batches:
            for shard, langs in _shards(batch):
                words.add(shard.value)
                pairs.add(shard.chains(2)[0][1])
                for d, n in zip(*[x.tolist() for x in np.unique(shard.doc, return_counts=True)]):
                    total[langs[d]] = total.get(langs[d], 0) + n
                value, first = np.unique(shard.value, return_index=True)
                new = ~np.isin(value, known, assume_unique=True)
                for v, i in zip(value[new].tolist(), first[new].tolist()):
                    names[v] = (langs[shard.doc[i]], shard.word(i))
                known = np.union1d(known, value[new])
                if len(pairs.h) > HELD:
                    yield from _pairs_out(pairs, shards)
                    pairs = Tally()
        yield from _pairs_out(pairs, shards)
        words.merge()
        for r, at in _dealt(words, shards):
            of: dict[str, list[tuple]] = {}
            for v, h, n in zip(words.h[at].tolist(), words.h[at].view(np.int64).tolist(), words.n[at].tolist()):
                lang, word = names[v]
                of.setdefault(lang, []).append((h, n, word))
            for lang, found in of.items():
                yield _rows([r], [lang], *[[list(x)] for x in zip(*found)])
        for lang, n in total.items():
            yield _rows([0], [lang], [None], [[n]], [None])

    return tally


def _frequent(table: pa.Table, least: int) -> pa.Table:
    """(kind, h, lang, word, n) of a shard: words (1) and hashes of pairs (2) of at least `least` places, and the
    numbers of words of a language (0)."""
    out: dict[str, list] = {c: [] for c in ("kind", "h", "lang", "word", "n")}
    pairs, counts, words = [], [], {}
    total: dict[str, int] = {}
    for lang, h, n, word in zip(table.column("lang").to_pylist(), table.column("h"), table.column("n"), table.column("word")):
        if not h.is_valid:
            total[lang] = total.get(lang, 0) + n.as_py()[0]
        elif lang is None:
            pairs.append(h.values.to_numpy())
            counts.append(n.values.to_numpy())
        else:
            for v, c, w in zip(h.as_py(), n.as_py(), word.as_py()):
                words[v] = (lang, w, words[v][2] + c if v in words else c)
    h, which = np.unique(np.concatenate(pairs) if pairs else np.empty(0, np.int64), return_inverse=True)
    n = np.bincount(which, np.concatenate(counts) if counts else None, len(h)).astype(np.int64)
    often = n >= least
    rows = [(0, None, x, None, c) for x, c in total.items()] + [(1, v, x, w, c) for v, (x, w, c) in words.items() if c >= least]
    rows += [(2, v, None, None, c) for v, c in zip(h[often].tolist(), n[often].tolist())]
    for row in rows:
        for c, v in zip(out.values(), row):
            c.append(v)
    return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()))})


_PHRASE = ["w1", "w2", "w3", "w4"]


def _phrases(bitmaps: dict[str, np.ndarray]) -> Callable:
    """Counts of a partition's phrases that the bitmaps ask for: `pairs` themselves, phrases that continue one in `grow`
    (by number of words), or that put a word before one in `left`. A phrase of three words or more is counted only if
    all its pairs are frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = [{"rows": [], "n": 0} for _ in range(LONGEST + 1)]

        def merged(m: int) -> tuple[np.ndarray, np.ndarray]:
            rows, n = zip(*held[m]["rows"])
            rows, n = np.concatenate(rows), np.concatenate(n)
            by = np.lexsort(rows.T)
            rows, n = rows[by], n[by]
            new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
            return rows[new], np.add.reduceat(n, new)

        def out(m: int) -> Iterator[pa.RecordBatch]:
            if held[m]["rows"]:
                rows, n = merged(m)
                columns = [pa.array(rows[:, j].view(np.int64)) if j < m else pa.nulls(len(n), pa.int64()) for j in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*_PHRASE, "a"])
                held[m].update(rows=[], n=0)

        for batch in batches:
            for shard, _ in _shards(batch):
                chains = shard.chains(max(m for m in range(2, LONGEST + 1) if any(k[1:] in (str(m), str(m - 1)) for k in bitmaps)))
                pair_at, pair_h = chains[0]
                if "p2" in bitmaps:
                    frequent = np.zeros(len(shard.value) + LONGEST, bool)
                    frequent[pair_at[has(bitmaps["p2"], pair_h)]] = True
                for m, (at, h) in enumerate(chains, 2):
                    if m == 2:
                        wanted = at[frequent[at]] if "c2" in bitmaps else at[:0]
                    else:
                        short = np.zeros(len(shard.value) + LONGEST, np.uint64)
                        short[chains[m - 3][0]] = chains[m - 3][1]
                        ok = reduce(np.logical_and, [frequent[at + j] for j in range(m - 1)])
                        at = at[ok]
                        asked = np.zeros(len(at), bool)
                        if f"g{m - 1}" in bitmaps:
                            asked |= has(bitmaps[f"g{m - 1}"], short[at])
                        if f"l{m - 1}" in bitmaps:
                            asked |= has(bitmaps[f"l{m - 1}"], short[at + 1])
                        wanted = at[asked]
                    if len(wanted):
                        held[m]["rows"].append((np.stack([shard.value[wanted + j] for j in range(m)], axis=1), np.ones(len(wanted), np.int64)))
                        held[m]["n"] += len(wanted)
                        if held[m]["n"] > HELD // 2:
                            held[m]["rows"] = [merged(m)]
                            held[m]["n"] = len(held[m]["rows"][0][1])
                            if held[m]["n"] > HELD // 3:
                                yield from out(m)
        for m in range(2, LONGEST + 1):
            yield from out(m)

    return count


def _ratio(a: str, below: str) -> Column:
    return F.expr(f"(CAST({a} AS DECIMAL(30, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div CAST({below} AS DECIMAL(30, 0))")


class Growth:
    """The state of a search: documents as tasks read them, counts of words and pairs, and what has been counted since."""

    def __init__(self, docs: DataFrame, least: int):
        text = F.coalesce("text", F.lit(""))
        lang = F.coalesce("lang", F.lit("und"))
        self.least = least
        self.docs = docs.select(text.cast("binary").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("mark"))
        total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        shards = max(1, -(-total // BUCKET_BYTES))
        tallied = self.docs.mapInArrow(_tallies(shards), _TALLIED)
        counted = staged(tallied.groupBy("r").applyInArrow(lambda t: _frequent(t, least), "kind int, h long, lang string, word string, n long"), "phrases-counted")
        self.words = counted.filter("kind = 1").select(F.col("h").alias("w"), "lang", "word", F.col("n").alias("f"))
        self.total = counted.filter("kind = 0").groupBy("lang").agg(F.sum("n").alias("n"))
        self.frequent = bitmap(counted.filter("kind = 2").select("h"), PAIR_BITS)
        self.pairs = self.counted({"c2": None}, "pairs")

    def counted(self, bitmaps: dict[str, np.ndarray | None], label: str) -> DataFrame:
        """w1 to w4 and a: the phrases that the bitmaps ask for, with at least the least count."""
        sent = self.docs.sparkSession.sparkContext.broadcast({"p2": self.frequent, **bitmaps})
        found = self.docs.mapInArrow(lambda batches: _phrases(sent.value)(batches), "w1 long, w2 long, w3 long, w4 long, a long")
        return staged(found.groupBy(*_PHRASE).agg(F.sum("a").alias("a")).filter(F.col("a") >= self.least), f"phrases-{label}")

    def scored(self, phrases: DataFrame, parts: DataFrame) -> DataFrame:
        """`phrases` with lang, the lowest-scoring cut (score, l, r) and the bound of all that begin with the phrase.

        A phrase that continues P has at most P's count a and at least that many places of its rest, so cut after the
        first word its score is at most that of a against f(first word) + a. Phrases of which a part was not counted
        are below the bound of that part's search, and are left out.
        """
        none = F.lit(None).cast("long")
        cuts = []
        for m in range(2, LONGEST + 1):
            for k in range(1, m):
                left, right = _PHRASE[:k], _PHRASE[k:m]
                pad = lambda names: [F.col(c) for c in names] + [none] * (3 - len(names))
                cuts.append(F.when(F.size("ws") == m, F.struct(F.lit(k).alias("k"), *[c.alias(f"x{i}") for i, c in enumerate(pad(left))], *[c.alias(f"y{i}") for i, c in enumerate(pad(right))])))
        phrases = phrases.withColumn("ws", F.filter(F.array(*_PHRASE), lambda w: w.isNotNull()))
        split = phrases.withColumn("cut", F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull()))).select(*_PHRASE, "a", F.size("ws").alias("m"), "cut.*")
        for side, name in (("x", "l"), ("y", "r")):
            key = [F.coalesce(F.col(f"{side}{i}"), F.lit(0)).alias(f"{side}{i}") for i in range(3)]
            split = split.select(*[c for c in split.columns if not c.startswith(side)], *key)
            table = parts.select(*[F.coalesce(F.col(c), F.lit(0)).alias(f"{side}{i}") for i, c in enumerate(_PHRASE[:3])], F.col("a").alias(name))
            split = split.join(table, [f"{side}{i}" for i in range(3)]).drop(*[f"{side}{i}" for i in range(3)])
        best = split.withColumn("below", F.col("l") + F.col("r")).withColumn("score", _ratio("a", "below"))
        best = best.groupBy(*_PHRASE, "a", "m").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.count("*").alias("cuts")).filter("cuts = m - 1")
        named = best.join(self.words.select(F.col("w").alias("w1"), "lang", "f"), "w1").withColumn("below", F.col("f") + F.col("a"))
        return named.select("lang", *_PHRASE, "m", "a", F.col("low.score").alias("score"), F.col("low.l").alias("l"), F.col("low.r").alias("r"), _ratio("a", "below").alias("bound"))


def _hash_of(phrases: DataFrame, names: list[str]) -> DataFrame:
    """h: the hashes of the phrases of these columns, as `Words.chains` makes them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for j in range(1, len(names)):
                h = _mix(h * _STEP + b.column(j).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return phrases.select(*names).mapInArrow(hashed, "h long")


def _floors(pairs: DataFrame, target: int) -> DataFrame:
    """(lang, floor): a score that at least `target` pairs of the language reach, in steps of a thousand; 0 if none is."""
    bins = pairs.groupBy("lang", F.expr("score div 1000").alias("bin")).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bin")))
    reached = bins.withColumn("ahead", ahead).withColumn("bin", F.when(F.col("ahead") >= target, F.col("bin")))
    return reached.groupBy("lang").agg(F.coalesce(F.max("bin") * 1000, F.lit(0)).cast("long").alias("floor"))


def _covered(longer: DataFrame) -> DataFrame:
    """(w1 to w4, most): of each phrase the largest count of those that add one word before or after it.

    A phrase that is longer by more words holds one of these, which is at least as frequent; so these decide.
    """
    none = F.lit(None).cast("long")
    sides = []
    for m in (3, 4):
        of = longer.filter(F.col("w4").isNull() if m == 3 else F.col("w4").isNotNull())
        for names in (_PHRASE[: m - 1], _PHRASE[1:m]):
            padded = [F.col(c).alias(t) for c, t in zip(names, _PHRASE)] + [none.alias(t) for t in _PHRASE[len(names) :]]
            sides.append(of.select(*padded, "a"))
    return reduce(DataFrame.unionByName, sides).groupBy(*_PHRASE).agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by score, a and phrase.

    Phrases of 2 to LONGEST words inside a piece, of at least `least` places, score their count against those of the
    two parts of their worst cut; what a longer phrase covers to COVER per cent of its places is left out.

    Phrases grow from their prefixes, best first. The first step counts words and pairs, whose prefixes bound nothing.
    Then a floor is set for each language, below the score of twice `top` pairs; all prefixes whose bound reaches it are
    grown, by one word a pass, and every phrase that reaches it is also continued to the left, so that what covers it is
    known. What was not grown cannot reach the floor. If fewer than `top` phrases survive at or above a language's
    floor, more pairs lower it and growth goes on; at 0 nothing is left to grow.

    Each pass reads the documents once and sends counts added up by task. Tasks learn what to count from bitmaps of
    fixed size, which may ask for too much but never for too little; counts are of the words themselves (64-bit hashes
    of words and language), never of bits. Null texts are empty, null languages `und`; tables without words give no
    rows. Only text and lang are read, whatever else the table holds.
    """
    search = Growth(docs, least)
    none = F.lit(None).cast("long")
    single = search.words.select(F.col("w").alias("w1"), *[none.alias(c) for c in _PHRASE[1:]], F.col("f").alias("a"))
    pairs = staged(search.scored(search.pairs, single), "phrases-pairs-scored")
    known = single.unionByName(search.pairs)
    factor = 2
    while True:
        floors = staged(_floors(pairs, top * factor), "phrases-floors")
        at_floor = lambda df, c: df.join(floors, "lang").filter(F.col(c) >= F.col("floor"))
        bits = lambda df, names: bitmap(_hash_of(df, names), ROUND_BITS)
        first = search.counted({"g2": bits(at_floor(pairs, "bound"), _PHRASE[:2]), "l2": bits(at_floor(pairs, "score"), _PHRASE[:2])}, "triples")
        triples = staged(search.scored(first, known), "phrases-triples-scored")
        grown = at_floor(triples, "bound")
        more = search.counted({"g3": bits(grown, _PHRASE[:3]), "l3": bits(at_floor(triples, "score"), _PHRASE[:3]), "g2": bits(grown, _PHRASE[1:3])}, "longest")
        longer = first.unionByName(more).distinct()
        fours = search.scored(more.filter("w4 IS NOT NULL"), known.unionByName(longer.filter("w4 IS NULL")))
        reached = at_floor(reduce(DataFrame.unionByName, (pairs, triples, fours)), "score")
        same = [F.col(f"q.{c}").eqNullSafe(F.col(f"c.{c}")) for c in _PHRASE]
        survive = reached.alias("q").join(_covered(longer).alias("c"), same, "left").filter(
            f"most IS NULL OR CAST(most AS DECIMAL(30, 0)) * 100 < CAST(a AS DECIMAL(30, 0)) * {COVER}").select("q.*")
        survive = staged(survive, "phrases-left")
        left = floors.filter("floor > 0").join(survive.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").filter(F.coalesce("n", F.lit(0)) < top)
        if left.isEmpty():
            break
        factor *= 4
    named = survive
    for c in _PHRASE:
        named = named.join(search.words.select(F.col("w").alias(c), F.col("word").alias(f"{c}_")), c, "left")
    named = named.withColumn("phrase", F.concat_ws(" ", *[f"{c}_" for c in _PHRASE]))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(search.total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
