"""Substring dedup: recurring phrases are compiled into Aho-Corasick automata, and every passage met before goes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a passage, and of the phrases that stand for it.
PASSAGE, PHRASE = 20, 10
#: Bytes of text in a bucket of documents (on average), and that are hashed at a time.
BUCKET_BYTES, SHARD_BYTES = 4 << 20, 2 << 20
#: Words are written in digits of this base, so that no node of an automaton has more branches to look through.
DIGITS = 64

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(29)
    return x


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self, base: int = _BASE, least: int = SHARD_BYTES + (SHARD_BYTES >> 2)):
        self.base, self.least = base, least
        self.up = self.down = np.empty(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, self.least)
            inverse = pow(self.base, -1, 1 << 64)
            ones = np.ones(size, np.uint64)
            ones[1:] = np.uint64(self.base)
            self.up = np.cumprod(ones)
            ones[1:] = np.uint64(inverse)
            self.down = np.cumprod(ones)
        return self.up[:n], self.down[:n]


class Shard:
    """The words of several texts as numbers: equal words have equal values, and `first[d]` is the place of the
    first word of text d in the row of all words. A word is a run of anything but space and 0x09-0x0D, unchanged."""

    def __init__(self, texts: list[str | None], powers: Powers):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        up, down = powers.to(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        self.values = _mix((total[end] - total[start]) * down[start])
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.first = np.concatenate([[0], np.searchsorted(start, ends, "left")])
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        #: Whether a passage starts at each word.
        self.whole = np.arange(len(self.values)) + PASSAGE <= self.first[1:][self.doc]

    def rolling(self, size: int, factor: int) -> np.ndarray:
        """Hashes of `size` words from each place, over the ends of texts too; one for each place of a word."""
        n = len(self.values)
        padded = np.concatenate([self.values, np.zeros(size, np.uint64)])
        out = np.zeros(n, np.uint64)
        f = np.uint64(factor)
        for j in range(size):
            out *= f
            out += padded[j : j + n]
        return _mix(out)

    def representatives(self) -> tuple[np.ndarray, np.ndarray]:
        """(rep, h): for each place the place of the phrase that stands for the passage starting there, and the hashes
        of the phrases at all places. It is the smallest phrase of the passage, the first of equal ones.

        Equal passages choose equal phrases, wherever they stand, so a passage that recurs has a phrase that recurs.
        """
        h = self.rolling(PHRASE, _M1)
        n = len(h)
        padded = np.concatenate([h, np.full(PASSAGE, np.iinfo(np.uint64).max)])
        low, at = h.copy(), np.zeros(n, np.int64)
        for j in range(1, PASSAGE - PHRASE + 1):
            other = padded[j : j + n]
            less = other < low
            np.copyto(low, other, where=less)
            at[less] = j
        return at + np.arange(n), h

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases that stand for the passages."""
        rep, h = self.representatives()
        places = np.unique(rep[self.whole])
        return places, h[places]


class Texts:
    """The words themselves of several texts, in one row: `first[d]` is the place of the first word of text d."""

    def __init__(self, texts: list[str | None]):
        of = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.words = list(chain.from_iterable(of))
        self.n = np.array([len(w) for w in of], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(of)), self.n)
        #: Whether a passage starts at each word.
        self.whole = np.arange(len(self.words)) + PASSAGE <= self.first[1:][self.doc]


class Automaton:
    """An Aho-Corasick automaton over words: each distinct word of the phrases is a row of digits, as many as their
    number needs; first digits are characters of their own, so that a match begins at a word."""

    def __init__(self, phrases: list[bytes]):
        split = [p.split(b" ") for p in sorted(phrases)]
        self.codes: dict[bytes, str] = dict.fromkeys(w for words in split for w in words)
        self.width, most = 1, DIGITS
        while most < len(self.codes):
            self.width, most = self.width + 1, most * DIGITS
        for i, w in enumerate(self.codes):
            code = [chr(0x100 + i % DIGITS)]
            for _ in range(self.width - 1):
                i //= DIGITS
                code.append(chr(0x200 + i % DIGITS))
            self.codes[w] = "".join(code)
        self.run = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for words in split:
            self.run.add_word("".join([self.codes[w] for w in words]))
        if split:
            self.run.make_automaton()

    def places(self, texts: Texts) -> np.ndarray:
        """Places at which a phrase stands inside one text, by running the automaton over all the words."""
        if not self.codes:
            return np.empty(0, np.int64)
        line = "".join(map(self.codes.get, texts.words, repeat("~" * self.width)))  # "~": a word of no phrase
        at = (np.fromiter((e for e, _ in self.run.iter(line)), np.int64) + 1) // self.width - PHRASE
        return at[at + PHRASE <= texts.first[1:][texts.doc[at]]]


def _shards(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = used = 0
    for i, t in enumerate(texts):
        used += len(t or "")
        if used >= SHARD_BYTES:
            yield a, i + 1
            a, used = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


#: Powers that a Python worker keeps from one group to the next.
_POWERS = Powers()


def _list(table: pa.Table, column: str) -> list:
    return table.column(column).to_pylist()


class Bucket:
    """The documents of a bucket, each once, in the order that decides which place is earlier: by doc_id, null ones
    last, then by a hash of the text. `firsts` holds the (doc_id, k1) of the first documents of their texts."""

    def __init__(self, docs: pa.Table, firsts: set[tuple]):
        keys, at = list(zip(_list(docs, "doc_id"), _list(docs, "k1"))), {}
        for i, key in enumerate(keys):
            at.setdefault(key, i)
        self.keys = sorted(at, key=lambda x: (x[0] is None, x[0], x[1]))
        texts, rank = _list(docs, "text"), {key: n for n, key in enumerate(self.keys)}
        self.rows = [rank[key] for key in keys]
        self.texts = [texts[at[key]] for key in self.keys]
        self.first = np.array([key in firsts for key in self.keys], bool)

    def only_firsts(self) -> list[int]:
        return np.flatnonzero(self.first).tolist()

    def candidates(self, automaton: Automaton, x: int, y: int, chosen: list[int]) -> tuple:
        """Of texts chosen[x:y]: their words, the places at which a passage starts whose phrase the automaton finds,
        the places of these phrases, and the (h, w) that tell the passages."""
        texts = [self.texts[i] for i in chosen[x:y]]
        row, shard = Texts(texts), Shard(texts, _POWERS)
        hit = np.zeros(len(row.words) + 1, bool)
        hit[automaton.places(row)] = True
        rep, h = shard.representatives()
        at = np.flatnonzero(row.whole & hit[rep])
        w = (shard.rolling(PASSAGE, _M2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return row, at, rep[at], h[rep[at]], w


def _first_keys(side: pa.Table) -> set[tuple]:
    return {(d, k) for d, k in zip(_list(side, "doc_id"), _list(side, "k1")) if k is not None}


def _phrase_hashes(docs: pa.Table, firsts: pa.Table) -> pa.Table:
    """(p, h, n): the phrases of the first documents of a bucket, each once, with the number of their places."""
    bucket, found = Bucket(docs, _first_keys(firsts)), []
    texts = [bucket.texts[i] for i in bucket.only_firsts()]
    for x, y in _shards(texts):
        found.append(Shard(texts[x:y], _POWERS).phrases()[1])
    h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
    p = docs.column("p")[0].as_py() if len(docs) else 0
    return pa.table({"p": pa.array(np.full(len(h), p, np.int64)), "h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _phrase_words(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """(h, words): the words of the wanted phrases, as they stand in the bucket."""
    want = set(_list(wanted, "h"))
    texts, words = Bucket(docs, set()).texts, {}
    for x, y in _shards(texts):
        if not want:
            break
        places, h = Shard(texts[x:y], _POWERS).phrases()
        row = Texts(texts[x:y]).words
        for at, k in zip(places.tolist(), h.view(np.int64).tolist()):
            if k in want:
                want.discard(k)
                words[k] = b" ".join(row[at : at + PHRASE])
    return pa.table({"h": pa.array(list(words), pa.int64()), "words": pa.array(list(words.values()), pa.binary())})


def _passages(docs: pa.Table, side: pa.Table) -> pa.Table:
    """(h, p, doc_id, k, start, w): the passages of the first documents of a bucket that the automaton finds.

    A row holds the consecutive passages that one place of a phrase stands for: `start` is the first one's, `w` tells
    them apart. Of rows that are equal in h and w the earliest stays.
    """
    bucket = Bucket(docs, _first_keys(side))
    automaton, chosen = Automaton([w for w in _list(side, "words") if w is not None]), bucket.only_firsts()
    p = docs.column("p")[0].as_py() if len(docs) else 0
    base, words_before = [], 0
    for n, i in enumerate(chosen):
        same = n and bucket.keys[i][0] is not None and bucket.keys[chosen[n - 1]][0] == bucket.keys[i][0]
        words_before = words_before + len((bucket.texts[chosen[n - 1]] or "").split()) if same else 0
        base.append(words_before)
    base = np.array(base, np.int64)
    parts = []
    for x, y in _shards([bucket.texts[i] for i in chosen]):
        row, at, rep, h, w = bucket.candidates(automaton, x, y, chosen)
        if len(at):
            begin = np.flatnonzero(np.append(True, (rep[1:] != rep[:-1]) | (at[1:] != at[:-1] + 1)))
            doc = row.doc[at[begin]]
            parts.append((h[begin], x + doc, at[begin] - row.first[doc] + base[x + doc], np.diff(np.append(begin, len(at))), w))
    h, doc, start, size, w = (np.concatenate([part[i] for part in parts]) if parts else np.empty(0, kind) for i, kind in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int32)))
    begin = np.cumsum(size) - size
    if len(h):
        place = np.arange(len(w)) - np.repeat(begin, size)
        sign = np.add.reduceat(_mix(w.view(np.uint32).astype(np.uint64) + place.astype(np.uint64) * np.uint64(_BASE)), begin)
        by = np.lexsort((np.arange(len(h)), size, sign, h))
        new = np.append(True, (h[by][1:] != h[by][:-1]) | (sign[by][1:] != sign[by][:-1]) | (size[by][1:] != size[by][:-1]))
        keep = np.sort(by[new])
        inside = np.repeat(np.isin(np.arange(len(h)), keep), size)
        h, doc, start, size, w = h[keep], doc[keep], start[keep], size[keep], w[inside]
    of = [bucket.keys[chosen[i]] for i in doc.tolist()]
    return pa.table({
        "h": pa.array(h.view(np.int64)), "p": pa.array(np.full(len(h), p, np.int64)), "doc_id": pa.array([d for d, _ in of], docs.schema.field("doc_id").type),
        "k": pa.array([k if d is None else None for d, k in of], pa.int64()), "start": pa.array(start),
        "w": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(w))})


def _removed(docs: pa.Table, side: pa.Table) -> pa.Table:
    """doc_id, n_words, n_removed, kept of a bucket. `side` holds the words of its phrases, the (h, w) of passages
    that start earlier in another bucket, and the first documents of their texts."""
    bucket = Bucket(docs, _first_keys(side))
    automaton, chosen = Automaton([w for w in _list(side, "words") if w is not None]), bucket.only_firsts()
    shards = [(x, y, *bucket.candidates(automaton, x, y, chosen)) for x, y in _shards([bucket.texts[i] for i in chosen])]
    lost = side.filter(pc.is_valid(side.column("h")))
    h = np.concatenate([s[5] for s in shards] + [lost.column("h").to_numpy().view(np.uint64)])
    w = np.concatenate([s[6] for s in shards] + [lost.column("w").to_numpy().astype(np.int32)])
    # Passages of one kind side by side: those lost elsewhere before the bucket's own, these in their order.
    own = np.arange(len(h)) < len(h) - len(lost)
    by = np.lexsort((np.arange(len(h)), own, w, h))
    new = np.append(True, (h[by][1:] != h[by][:-1]) | (w[by][1:] != w[by][:-1])) if len(h) else np.empty(0, bool)
    stays = np.zeros(len(h), bool)
    stays[by[new]] = True
    done, offset = {}, 0
    for x, y, row, at, *_ in shards:
        mark = np.zeros(len(row.words) + PASSAGE + 1, np.int32)
        drop = at[~stays[offset : offset + len(at)]]
        offset += len(at)
        mark[drop] += 1
        mark[drop + PASSAGE] -= 1
        cover = np.cumsum(mark)[: len(row.words)] > 0
        gone = np.diff(np.concatenate([[0], np.cumsum(cover)])[row.first])
        for i, (a, b) in enumerate(zip(row.first[:-1].tolist(), row.first[1:].tolist())):
            words = row.words[a:b]
            done[chosen[x + i]] = (b - a, int(gone[i]), b" ".join(compress(words, (~cover[a:b]).tolist()) if gone[i] else words))
    for i in np.flatnonzero(~bucket.first).tolist():  # copies: each of their passages starts earlier, in the first document
        words = (bucket.texts[i] or "").encode("utf-8", "surrogatepass").split()
        whole = len(words) >= PASSAGE
        done[i] = (len(words), len(words) if whole else 0, b"" if whole else b" ".join(words))
    out = [done[i] for i in bucket.rows]
    return pa.table({
        "doc_id": docs.column("doc_id"), "n_words": pa.array([n for n, _, _ in out], pa.int64()), "n_removed": pa.array([n for _, n, _ in out], pa.int64()),
        "kept": pa.array([t.decode("utf-8", "surrogatepass") for _, _, t in out], pa.string())})


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left, joined by one space.

    A word goes if a passage (PASSAGE consecutive words) that covers it also starts earlier: in a document of
    smaller doc_id, or before in the same one. Passages are judged on the input.

    1. Documents are dealt by hash into buckets of about `bucket_bytes`. Of documents with one text (by a 128-bit key)
       the first stands for all. Each bucket reports the hashes of its phrases (see Shard.representatives) with their
       numbers. Phrases that stand in two places or more recur; a hot phrase has one row a bucket, however many
       documents hold it.
    2. Of each recurring phrase one bucket gives the words; these go to the buckets that reported it. So the phrases
       are sharded over the buckets, and no automaton has to hold, or document to meet, those of all the corpus.
    3. Each bucket compiles its phrases' words into an Aho-Corasick automaton and streams its documents through it.
       A passage whose phrase is hit is told by that phrase's hash and 32 bits of its own (96 bits in all), and the
       earliest place of each is found over all buckets, which send each kind of passage once.
    4. Each bucket streams its documents through its automaton again: of the passages whose phrase is hit, all that
       start earlier in another bucket, or before in this one, go.

    Hashes choose the phrases and compare the passages; which passages may go is decided by the automata's hits on
    words. Documents are shuffled once, by bucket: all steps read that shuffle. Null and empty texts have no words and
    stay as they are (kept is empty). Null doc_ids are later than all others, in the order of a hash of their texts.
    Rows of one doc_id are one document: equal texts are treated alike, different ones follow each other in the order
    of a hash of theirs. An empty table gives no rows. Only doc_id and text are read, whatever else the table holds.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = F.lit(max(1, -(-total // bucket_bytes)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    k1, d = F.xxhash64("text"), F.col("doc_id")
    p = F.pmod(F.when(d.isNull(), k1).otherwise(F.xxhash64(d)), buckets)
    dealt = docs.select(p.alias("p"), "doc_id", k1.alias("k1"), "text").groupBy("p")
    keyed = docs.select(p.alias("p"), "doc_id", k1.alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    firsts = keyed.groupBy("k1", "k2").agg(F.min(F.struct(d.isNull().alias("late"), "doc_id", "p")).alias("f")).select("f.p", "f.doc_id", "k1")
    every = Window.partitionBy("h")
    phrases = dealt.cogroup(firsts.groupBy("p")).applyInArrow(_phrase_hashes, "p long, h long, n long")
    routed = phrases.withColumn("total", F.sum("n").over(every)).withColumn("owner", F.min("p").over(every)).filter("total > 1").select("p", "h", "owner")
    words = dealt.cogroup(routed.filter("p = owner").groupBy("p")).applyInArrow(_phrase_words, "h long, words binary")
    sent = routed.select("p", "h").join(words, "h").select("p", "words").unionByName(firsts, allowMissingColumns=True)
    passages = dealt.cogroup(sent.groupBy("p")).applyInArrow(_passages, f"h long, p long, doc_id {kind}, k long, start long, w array<int>").repartition("h")
    single = passages.select("h", "p", "doc_id", "k", "start", F.posexplode("w").alias("j", "w"))
    place = F.struct(d.isNull().alias("late"), "doc_id", "k", (F.col("start") + F.col("j")).alias("at"), "p")
    lost = single.withColumn("first", F.min(place).over(Window.partitionBy("h", "w"))).filter("p <> first.p").select("p", "h", "w")
    side = lost.unionByName(sent, allowMissingColumns=True)
    return dealt.cogroup(side.groupBy("p")).applyInArrow(_removed, f"doc_id {kind}, n_words long, n_removed long, kept string")
