"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.worker import kept
from scholargraph.operators.lineage import checkpointed

CAPACITY = 2048
#: Pieces that one island packs at a time, islands on each such block, individuals on an island, generations between two
#: migrations, and how often islands evolve.
BLOCK, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2048, 4, 4, 20, 3
#: Bins filled less than this are opened again and packed across blocks.
WELL_FILLED = 0.98
#: Share of the opened bins that a round has to save for another one to follow.
LEAST_SAVED = 0.002
#: Encoded words of each of the two generations that a Python worker remembers.
REMEMBERED = 600_000
#: Bytes of text that are encoded at a time, and one text more.
AT_ONCE = 4 << 20

_GAP = re.compile(r"\s\s")
_RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TAIL = ",.;:!?\"$%&*#)]}|-"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The byte-level pattern never joins a word to what precedes its space or follows a single line break, so a text
    without doubled white space is the sequence of its words, each encoded once and remembered. A word of letters
    with a tail of signs is its letters' ids followed by its tail's. Any other text, and one that names a special
    token, is encoded in one piece.

    Two generations of words are remembered: when the young one is full it becomes the old one, and old words that are
    met again move up. So memory is bounded, and frequent words are never forgotten.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.remembered = Tokenizer.from_file(path), remembered
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        size = self.tok.get_vocab_size()
        self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.break_id = self.ids("\n")[0]
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.line_break = self.bytes("\n")
        self.space = self.bytes(" ")

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def bytes(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()

    def _encode_many(self, words: list[str], glue: str) -> list[bytes]:
        """Encodes words behind a space each (glue " "), or bare (glue line break), many at a time."""
        out: list[bytes] = []
        groups = [words[a : a + 200] for a in range(0, len(words), 200)]
        texts = ["".join(f" {w}" for w in g) if glue == " " else "\n".join(g) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            if glue == " ":
                cuts = np.flatnonzero(self.spaced[ids])
                ends = np.append(cuts[1:], len(ids))
            else:
                at = np.flatnonzero(ids == self.break_id)
                cuts, ends = np.append(0, at + 1), np.append(at, len(ids))
            if len(cuts) != len(g):
                out += [self.bytes(f" {w}" if glue == " " else w) for w in g]
            else:
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), ends.tolist())]
        return out

    def _learn(self, after: set[str], start: set[str]) -> None:
        """Adds the words to what is known."""
        if len(self.after_space) + len(self.at_start) > self.remembered:
            self.older = (self.after_space, self.at_start)
            self.after_space, self.at_start = {}, {}
        for words, known, old, glue in ((after, self.after_space, self.older[0], " "), (start, self.at_start, self.older[1], "\n")):
            split, whole = [], set()
            for w in words:
                if (got := old.get(w)) is not None:
                    known[w] = got
                elif w not in known:
                    core = w.rstrip(_TAIL)
                    if core != w and core.isalpha():
                        split.append((w, core, w[len(core) :]))
                        if core not in known:
                            whole.add(core)
                    else:
                        whole.add(w)
            order = list(whole)
            known.update(zip(order, self._encode_many(order, glue)))
            for w, core, tail in split:
                if (end := self.at_start.get(tail)) is None:
                    end = self.at_start[tail] = self.bytes(tail)
                known[w] = known[core] + end

    def _parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(parts, which, ends): the ids of the distinct parts of these texts, for each place in them its part, and
        where each text ends among the places.

        Arrow tells the parts apart, so that only distinct ones are looked up: a word behind its space, or a line break
        and the word that it precedes. A text's first word is a part of its own.
        """
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        told = lists.values.dictionary_encode()
        words, which = told.dictionary.to_numpy(zero_copy_only=False).tolist(), told.indices.to_numpy().astype(np.int64)
        edges = lists.offsets.to_numpy()
        first = edges[:-1]
        heads = [words[k] for k in which[first].tolist()]
        which[first] = len(words) + np.arange(len(heads))
        inside = np.bincount(which, minlength=len(words))[: len(words)] > 0
        found = list(map(self.after_space.get, words))
        todo = [i for i in np.flatnonzero(inside).tolist() if found[i] is None]
        new = [words[i] for i in todo]
        begin = [w for w in new if w[:1] == "\n"]
        self._learn({w for w in new if w[:1] != "\n"} - {""}, {*heads, *(w[1:] for w in begin)} - {""})
        young, begun = self.after_space, self.at_start
        young[""], begun[""] = self.space, b""
        young.update([(w, self.line_break + begun[w[1:]]) for w in begin])
        for i, w in zip(todo, new):
            found[i] = young[w]
        found += [begun[w] for w in heads]
        return pa.array(found, pa.large_binary()), which, edges[1:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if ("  " in t or "\n\n" in t or " \n" in t or "\n " in t or _RARE_SPACE.search(t)) and _GAP.search(t) or self.special.search(t):
                out[i] = self.bytes(t)
            else:
                plain.append(i)
        if plain:
            parts, which, ends = self._parts([texts[i] for i in plain])
            placed = parts.take(pa.array(which))
            at = placed.buffers()[1]
            edges = np.frombuffer(at, np.int64, len(placed) + 1, 8 * placed.offset)
            raw, begin = memoryview(placed.buffers()[2] or b""), int(edges[0])
            for i, end in zip(plain, edges[ends].tolist()):
                out[i] = bytes(raw[begin:end])
                begin = end
        return out


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. One map over the documents; ids stay in the task.

    A document is its ids followed by id 0; only one longer than `capacity` is cut, and what does not fill a whole
    piece is its first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("encoder", path, lambda: Encoder(path))
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = end = 0
            while end < len(b):
                a, end = end, int(np.searchsorted(upto, (upto[end - 1] if end else 0) + AT_ONCE)) + 1
                own = b.slice(a, end - a)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(own.column("text").to_pylist())):
                    ids += b"\x00\x00\x00\x00"
                    n = len(ids) // 4
                    at, k, size = 0, 0, n if n <= capacity else n % capacity or capacity
                    while at < n:
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at, k, size = at + size, k + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# A solution is a list of bins, a bin a list of item numbers.


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Adds the items, largest first, each to the bin that it leaves least room in, or to a new one."""
    stride = len(bins) + len(items) + 1
    free = sorted((capacity - sum(sizes[i] for i in b)) * stride + k for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(free, sizes[i] * stride)
        if at == len(free):
            bins.append([i])
            bisect.insort(free, (capacity - sizes[i]) * stride + len(bins) - 1)
        else:
            room, k = divmod(free.pop(at), stride)
            bins[k].append(i)
            bisect.insort(free, (room - sizes[i]) * stride + k)
    return bins


def _fill(b: list[int], sizes: list[int]) -> int:
    return sum(sizes[i] for i in b)


def refill(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Fills the bins better from loose items, then places what is left by best fit.

    In turn each bin gets the largest loose item that it has room for, or gives one item, or two, for one loose item that
    fills it more. What it gives is loose for the next bins. Bins only get fuller, so the loose items get smaller, and a
    bin fewer may do for them.
    """
    order = sorted((sizes[i], i) for i in loose)
    rooms = [capacity - _fill(b, sizes) for b in bins]
    for n in sorted(range(len(bins)), key=rooms.__getitem__):
        b, room = bins[n], rooms[n]
        while room and order:
            k = bisect.bisect_right(order, (room, len(sizes))) - 1
            if k >= 0:  # a loose item fits as it is
                size, j = order.pop(k)
                b.append(j)
                room -= size
                continue
            best = None
            for x, i in enumerate(b):
                for y in range(x, len(b)):
                    gives = sizes[i] + (sizes[b[y]] if y > x else 0)
                    k = bisect.bisect_right(order, (gives + room, len(sizes))) - 1
                    if k >= 0 and (gain := order[k][0] - gives) > 0 and (best is None or gain > best[0]):
                        best = (gain, x, y, k)
                        if gain == room:
                            break
                if best is not None and best[0] == room:
                    break
            if best is None:
                break
            gain, x, y, k = best
            _, j = order.pop(k)
            for at in sorted({x, y}, reverse=True):
                i = b.pop(at)
                bisect.insort(order, (sizes[i], i))
            b.append(j)
            room -= gain
    return best_fit([i for _, i in order], sizes, bins, capacity) if order else bins


def quality(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (their squares add up to more). Smaller is better."""
    return len(bins), -sum((_fill(b, sizes) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Injects whole well-filled bins of `b` into `a`; bins of `a` that hold any of their items go, and the other
    items of those are exchanged into the rest (`refill`) and placed by best fit."""
    full = sorted(range(len(b)), key=lambda k: -_fill(b[k], sizes))[: max(1, len(b) // 2)]
    inject = [b[k] for k in full if rng.random() < 0.5] or [b[full[0]]]
    inside = {i for x in inject for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    return refill(kept + [list(x) for x in inject], displaced, sizes, capacity)


def mutate(a: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Opens the emptiest bins and a few others, and exchanges their items into the rest."""
    order = sorted(range(len(a)), key=lambda k: _fill(a[k], sizes))
    out = {*order[: max(2, len(a) // 50)], *rng.integers(0, len(a), max(1, len(a) // 25)).tolist()}
    return refill([list(a[k]) for k in range(len(a)) if k not in out], [i for k in out for i in a[k]], sizes, capacity)


def shuffled_fit(sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A best fit of the items in a random order: whatever comes goes to the fullest bin that has room for it."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in rng.permutation(len(sizes)).tolist():
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            room, k = capacity, len(bins) - 1
        else:
            room, k = free.pop(at)
            bins[k].append(i)
        bisect.insort(free, (room - sizes[i], k))
    return bins


def evolve(sizes: list[int], elites: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS) -> list[list[int]]:
    """The best solution of one island, after `generations` or where the bins' number meets its lower bound.

    Without elites the island begins with best fits of its own random orders; with them, these are its population, and
    the plain best fit by size joins them, so that no island ends with more bins than that.
    """
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    everyone = [*elites] or [shuffled_fit(sizes, capacity, rng) for _ in range(POPULATION)]
    if elites:
        everyone.append(best_fit(list(range(len(sizes))), sizes, [], capacity))
    score = lambda s: quality(s, sizes, capacity)
    ranked = sorted(((score(s), s) for s in everyone), key=lambda x: x[0])
    while len(ranked) < POPULATION:
        child = mutate(ranked[0][1], sizes, capacity, rng)
        ranked.append((score(child), child))
    for _ in range(generations):
        if ranked[0][0][0] <= least or len(sizes) < 3:
            break
        i, j = 0, int(rng.integers(1, len(ranked)))
        if rng.random() < 0.5:
            i, j = j, i
        child = mutate(crossover(ranked[i][1], ranked[j][1], sizes, capacity, rng), sizes, capacity, rng)
        if (value := score(child)) < ranked[-1][0]:
            ranked[-1] = (value, child)
            ranked.sort(key=lambda x: x[0])
    return ranked[0][1]


def _as_bins(of: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1)] if len(of) else []
    for i, k in enumerate(of.tolist()):
        bins[k].append(i)
    return bins


def pack_items(items: DataFrame, rows: int, capacity: int = CAPACITY, block: int = BLOCK, level: int = 0) -> DataFrame:
    """(pid, length) -> (pid, length, block, bin, offset).

    Items are dealt by a hash of pid and `level` into blocks of about `block`. Where the plain best fit of a block meets
    the lower bound there is nothing to search; on all other blocks ISLANDS islands evolve apart from random orders of
    their own, send their elite to the next island, and evolve again, EPOCHS times in all; the best solution of a block
    stays. A block is the only thing that ever meets in one task.
    """
    blocks = max(1, -(-rows // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(blocks)))
    problems = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "pid"))).alias("items")).select(
        "block", F.col("items.pid").alias("pids"), F.col("items.length").alias("sizes"))
    shape = "block long, island int, pids array<long>, sizes array<long>, bins array<int>"

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                best = best_fit(list(range(len(sizes))), sizes, [], capacity)
                if len(best) > -(-sum(sizes) // capacity):
                    elites = [_as_bins(np.asarray(e)) for e in (r.elites if r.elites is not None else [])]
                    best = evolve(sizes, elites, capacity, (int(r.block) * 31 + int(r.island)) * 8 + len(elites) + 2 * int(r.epoch))
                of = np.empty(len(sizes), np.int32)
                for k, b in enumerate(best):
                    of[b] = k
                out.append((r.block, r.island, r.pids, r.sizes, of))
            yield pd.DataFrame(out, columns=["block", "island", "pids", "sizes", "bins"])

    now = problems.select(
        "block", F.explode(F.lit(list(range(ISLANDS)))).alias("island"), "pids", "sizes", F.lit(None).cast("array<array<int>>").alias("elites")
    ).repartition("block", "island").withColumn("epoch", F.lit(0)).mapInPandas(settle, shape)
    for epoch in range(1, EPOCHS):
        met = now.select(
            "block", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"), "pids", "sizes", "bins"
        ).groupBy("block", "island").agg(F.first("pids").alias("pids"), F.first("sizes").alias("sizes"), F.array_sort(F.collect_list("bins")).alias("elites"))
        now = met.select("block", "island", "pids", "sizes", "elites", F.lit(epoch).alias("epoch")).mapInPandas(settle, shape)
    best = now.groupBy("block").agg(F.min_by(F.struct("pids", "sizes", "bins"), F.struct(F.array_max("bins"), "island")).alias("s"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples(index=False):
                bins, sizes = np.asarray(r.bins, np.int32), np.asarray(r.sizes, np.int64)
                by = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[by])
                begin = ends - sizes[by]
                head = np.flatnonzero(np.append(True, bins[by][1:] != bins[by][:-1]))
                base = np.repeat(begin[head], np.diff(np.append(head, len(by))))
                yield pd.DataFrame({"pid": np.asarray(r.pids)[by], "length": sizes[by], "block": int(r.block), "bin": bins[by], "offset": begin - base})

    return best.select("block", "s.*").mapInPandas(place, "pid long, length long, block long, bin int, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document in sequences of `capacity` ids.

    Whole pieces are sequences of their own; the rest are packed block by block, then the poorly filled bins of all
    blocks are opened and packed again with one another, until one block holds all that is left over or a round saves
    hardly any bin. Null and empty texts are the single id 0. Repeated rows are packed once each. An empty table gives no rows. Only doc_id and
    text are read, whatever else the table holds.
    """
    pieces = checkpointed(tokenise(docs, path, capacity).withColumn("pid", F.monotonically_increasing_id()))
    whole = pieces.filter(F.col("length") == capacity).select("pid", (F.lit(1 << 62) + F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, level, done = pieces.filter(F.col("length") < capacity).select("pid", "length"), 0, [whole]
    rows, before = todo.count(), None
    while rows:
        packed = checkpointed(pack_items(todo, rows, capacity, block, level))
        packed = packed.withColumn("sequence_id", F.lit(level << 56) + F.shiftleft("block", 20) + F.col("bin"))
        fills = checkpointed(packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")))
        bins = fills.count()
        # The last block has met in one place; a round that saves hardly any bin would not do better the next time.
        if rows <= block or before is not None and before - bins < LEAST_SAVED * before:
            done.append(packed.select("pid", "sequence_id", "offset"))
            break
        opened = fills.filter(F.col("fill") < int(WELL_FILLED * capacity)).select("sequence_id")
        before = opened.count()
        todo = checkpointed(packed.join(opened, "sequence_id", "left_semi").select("pid", "length"))
        done.append(packed.join(opened, "sequence_id", "left_anti").select("pid", "sequence_id", "offset"))
        rows, level = todo.count(), level + 1
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return pieces.join(placed, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
