"""Benchmark decontamination: suffix arrays over the training texts, searched for every suffix of the benchmark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.worker import kept

WINDOW = 10
#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 32 << 20
#: Bytes of training text under one suffix array.
SHARD_BYTES = 6 << 20

_KEEP = bytes(c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class Suffixes:
    """Every benchmark suffix that starts a window, as a search key of its first WINDOW words."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids: dict[bytes, int] = {}
        low, high, owner, start, length = [], [], [], [], []
        self.items: list[str] = []
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if not own:
                continue
            size = min(WINDOW, len(own))
            for s in range(len(own) - size + 1):
                key = np.array(own[s : s + size], ">u4").tobytes()
                low.append(key.ljust(4 * WINDOW, b"\x00"))
                high.append(key.ljust(4 * WINDOW, b"\xff"))
                owner.append(len(self.items))
                start.append(s)
                length.append(size)
            self.items.append(item)
        kind = f"V{4 * WINDOW}"
        self.low, self.high = _sortable(np.frombuffer(b"".join(low), kind)), _sortable(np.frombuffer(b"".join(high), kind))
        self.owner, self.start, self.length = np.array(owner, np.int64), np.array(start, np.int64), np.array(length, np.int64)
        self.shortest = int(self.length.min()) if len(length) else 0


def _sortable(keys: np.ndarray) -> np.ndarray:
    """Fixed-width big-endian keys as byte strings: numpy orders these like the words' numbers."""
    return np.frombuffer(keys.tobytes(), f"S{4 * WINDOW}") if len(keys) else np.empty(0, f"S{4 * WINDOW}")


def _runs(known: np.ndarray) -> np.ndarray:
    """For each place, how many known words follow without a gap, itself included."""
    n = len(known)
    gaps = np.where(known, n, np.arange(n))
    return np.minimum.accumulate(gaps[::-1])[::-1] - np.arange(n)


def search(texts: list[str | None], test: Suffixes) -> tuple[np.ndarray, list[list[tuple[int, int, str]]]]:
    """Word counts, and for each text its longest verbatim matches (first word, word after the last, item).

    The suffix array holds the places of one shard from which at least the shortest window could match (words that
    the benchmark does not have end a suffix), ordered by the suffixes' first WINDOW words. Each benchmark suffix
    is located by two binary searches; windows that continue one another on both sides join to the longest match.
    """
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not test.shortest or not sizes.sum():
        return sizes, out
    parts, starts, at = [], np.zeros(len(words), np.int64), 0
    for i, own in enumerate(words):
        starts[i] = at
        ids = np.zeros(len(own) + 1, np.int64)  # a gap ends every text
        ids[:-1] = np.fromiter(map(test.ids.get, own, repeat(0)), np.int64, len(own))
        parts.append(ids)
        at += len(own) + 1
    text = np.concatenate(parts)
    places = np.flatnonzero(_runs(text > 0) >= test.shortest)
    if not len(places):
        return sizes, out
    padded = np.concatenate([text, np.zeros(WINDOW, np.int64)]).astype(">u4")
    keys = np.frombuffer(padded[places[:, None] + np.arange(WINDOW)].tobytes(), f"S{4 * WINDOW}")
    order = np.argsort(keys, kind="stable")
    array, keys = places[order], keys[order]
    first, last = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    found = np.flatnonzero(last > first)
    if not len(found):
        return sizes, out
    n = last[found] - first[found]
    which = np.repeat(found, n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = array[np.repeat(first[found], n) + offset]
    # Join windows of one item along one diagonal.
    diagonal = place - test.start[which]
    by = np.lexsort((place, diagonal, test.owner[which]))
    place, diagonal, owner, size = place[by], diagonal[by], test.owner[which][by], test.length[which][by]
    new = np.ones(len(place), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(place)) - 1
    doc = np.searchsorted(starts, place[heads], "right") - 1
    for d, a, b, o in zip(doc.tolist(), place[heads].tolist(), (place[tails] + size[tails]).tolist(), owner[heads].tolist()):
        out[d].append((a - int(starts[d]), b - int(starts[d]), test.items[o]))
    return sizes, out


def _shards(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = used = 0
    for i, t in enumerate(texts):
        used += len(t or "")
        if used >= SHARD_BYTES:
            yield a, i + 1
            a, used = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of bounded size, each read to the driver by itself."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).toArrow()
        yield sorted(zip(part.column("item").to_pylist(), part.column("text").to_pylist()), key=lambda x: (x[0], x[1] or ""))


def find_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, matches: array of (start, end, item), the longest verbatim matches of WINDOW words or more
    (of a shorter item: of its whole text), in words of the document.

    The documents are mapped once for each block of the benchmark (one, unless it is over `block_bytes`) and never
    shuffled. Null or empty texts have no words and no matches; items without a word match nothing; repeated rows
    of either table give repeated rows or add nothing; a null item_id is an empty one. An empty table of documents gives no rows, an empty benchmark
    no matches. Other columns are ignored, whatever their names.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, text string, n_words long, matches array<struct<start:int,end:int,item:string>>"
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<start:int,end:int,item:string>>").alias("matches"))
    for n, block in enumerate(_blocks(benchmark, block_bytes)):
        shared, version = sc.broadcast(block), hashlib.sha256(repr(block).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], shared=shared, version=version, n=n) -> Iterator[pa.RecordBatch]:
            test = kept(f"suffixes{n}", version, lambda: Suffixes(shared.value))
            for b in batches:
                texts = b.column("text").to_pylist()
                for x, y in _shards(texts):
                    sizes, found = search(texts[x:y], test)
                    before = b.column("matches").slice(x, y - x).to_pylist()
                    merged = [[*(old or []), *({"start": s, "end": e, "item": i} for s, e, i in new)] for old, new in zip(before, found)]
                    own = b.slice(x, y - x)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text"), pa.array(sizes, pa.int64()), pa.array(merged, _SPAN)], names=["doc_id", "text", "n_words", "matches"])

        out = out.mapInArrow(run, shape)
    return out.drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """find_matches() with n_hit (words in a match), items (distinct, sorted as strings) and contaminated."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, m: F.struct(
            (a["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(m["s"], a["to"]))).cast("long").alias("n"),
            F.greatest(a["to"], m["e"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    return find_matches(docs, benchmark, block_bytes).select(
        "doc_id", "n_words", covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))).alias("items"),
        (F.size("matches") > 0).alias("contaminated"), "matches",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no window of the benchmark."""
    sc = docs.sparkSession.sparkContext
    for n, block in enumerate(_blocks(benchmark, block_bytes)):
        shared, version = sc.broadcast(block), hashlib.sha256(repr(block).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], shared=shared, version=version, n=n) -> Iterator[pa.RecordBatch]:
            test = kept(f"suffixes{n}", version, lambda: Suffixes(shared.value))
            for b in batches:
                texts = b.column("text").to_pylist()
                for x, y in _shards(texts):
                    _, found = search(texts[x:y], test)
                    yield b.slice(x, y - x).filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
