"""Substring dedup by a run-length index: bytes of long matches go, wherever in the corpus the other place is."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.substring import Powers, _mix

#: Bytes of a match that is removed, of the grams that serve as anchors, and grams of which one is an anchor.
MATCH, GRAM, WIDTH = 400, 128, 91
#: Bytes of text in a bucket of documents (on average), of those that are hashed at a time, that one index shard has to
#: its share (on average), and in one index.
BUCKET_BYTES, SHARD_BYTES, SHARD_TEXT, BLOCK_BYTES = 4 << 20, 3 << 18, 1 << 20, 1 << 19
#: Matches of a stretch that is sent for hot anchors, at most.
LONG = 1 << 14
#: Places of an anchor above which its matches are told apart before any text is sent.
HOT = 2000

_END = 0xFF  # never a byte of UTF-8
_OTHER = 0x9E3779B185EBCA87
_POWERS, _OTHER_POWERS = Powers(least=SHARD_BYTES + (SHARD_BYTES >> 2)), Powers(_OTHER, SHARD_BYTES + (SHARD_BYTES >> 2))


class Texts:
    """Several texts in one row of bytes, each closed by a byte that no text holds; `first[d]` is where text d begins."""

    def __init__(self, texts: list[bytes | None]):
        parts = [t or b"" for t in texts]
        self.raw = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        self.doc = np.repeat(np.arange(len(parts)), self.size + 1)
        self.total, self.down = self._cumulated(_POWERS)

    def _cumulated(self, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers.to(len(self.raw))
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        return total, down

    def _lowest(self, ranked: np.ndarray, width: int) -> np.ndarray:
        """The lowest of each `width` consecutive ranks."""
        rows = -(-len(ranked) // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max)
        padded[: len(ranked)] = ranked
        padded = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        n = max(len(ranked) - width + 1, 0)
        return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])

    def _ranked(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Hashes of all grams, and these with the gram's place as last bits: equal grams rank by place."""
        if not hasattr(self, "grams"):
            n = max(len(self.raw) - GRAM + 1, 0)
            h = _mix((self.total[GRAM : GRAM + n] - self.total[:n]) * self.down[:n])
            bits = np.uint64(max(22, len(self.raw).bit_length()))
            self.grams = (h, (h >> bits << bits) | np.arange(n, dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1))
        return self.grams

    def _whole(self, n: int, size: int) -> np.ndarray:
        """Whether `size` bytes from each of the first n places are inside one text."""
        return np.arange(n) - self.first[self.doc[:n]] + size <= self.size[self.doc[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place): the anchors. Of WIDTH consecutive grams the one of smallest hash, the first of equal ones, is
        an anchor; so equal stretches of bytes have equal anchors, at equal places inside."""
        h, ranked, mask = self._ranked()
        low = self._lowest(ranked, WIDTH)
        at = (low[self._whole(len(low), WIDTH + GRAM - 1)] & mask).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        return h[at], at

    def runs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, n): runs of n consecutive starts of matches, of which all anchors are `known`, by the smallest
        anchor of the match. Where another place holds the same bytes, it has the same anchors; so all matches that have
        another place are in these runs if `known` are the anchors of two places or more."""
        h, ranked, mask = self._ranked()
        low = self._lowest(ranked, WIDTH)
        inside, starts = MATCH - GRAM - WIDTH + 2, len(ranked) - (MATCH - GRAM)
        if starts <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        strange = ~np.isin(h[(low[first] & mask).astype(np.int64)], known)
        bad = np.concatenate([[0], np.cumsum(np.repeat(strange, np.diff(np.append(first, len(low)))))])
        s = np.flatnonzero(self._whole(starts, MATCH) & (bad[inside : inside + starts] == bad[:starts]))
        if not len(s):
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = (self._lowest(low, inside)[s] & mask).astype(np.int64)
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)))
        return h[at[new]], s[new], np.diff(np.append(new, len(s)))

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        """The first half of the 128 bits that tell the matches at `starts`."""
        return _mix((self.total[starts + MATCH] - self.total[starts]) * self.down[starts])

    def second(self, starts: np.ndarray) -> np.ndarray:
        """Their other half."""
        if not hasattr(self, "other"):
            self.other = self._cumulated(_OTHER_POWERS)
        total, down = self.other
        return _mix((total[starts + MATCH] - total[starts]) * down[starts])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... up to sizes[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of several texts.

    Kept are, for each run of equal symbols: its first and last row, the row to which its first row leads one step
    back in the text, and, sampled at both run ends, the lengths that the rows there have in common with the row
    beyond. Inside a run a step back lengthens a match with either neighbour by one, so the matching statistics of all
    texts follow from the samples alone; the suffix array itself is let go.

    A text may be in the index twice (`copies`). The suffixes of its two copies are neighbours with the same symbol
    before them, so they only make runs longer: the array of single texts is sorted, and its rows are counted so often.
    """

    def __init__(self, texts: list[bytes], copies: list[int] | None = None):
        raw = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        n = len(raw)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        words = np.zeros(n, np.uint64)
        for j in range(8):
            words = (words << np.uint64(8)) | padded[j : j + n]
        order, rank = self._sorted(padded, n)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        times = np.ones(n, np.int64) if copies is None else np.repeat(np.array(copies, np.int64), self.sizes + 1)[order]
        rows = np.concatenate([[0], np.cumsum(times)])  # of the single rows, where their copies begin
        before = raw[order - 1]
        single = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        ends = np.append(single[1:], n)
        self.start, self.end = rows[single], rows[ends] - 1
        by = np.argsort(before[single], kind="stable")
        back, once = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        size = ends - single
        once[by] = np.cumsum(size[by]) - size[by]
        size_of = rows[ends] - rows[single]
        back[by] = np.cumsum(size_of[by]) - size_of[by]
        self.back = back
        self.above = self._common(words, order, once, n)
        self.below = self._common(words, order, once + size, n)
        self.last = rows[rank[np.cumsum(self.sizes + 1) - 1]]

    @staticmethod
    def _sorted(padded: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and its inverse, by doubling: only suffixes that are still tied are ordered again.

        Ranks and the place share one number, so that a plain sort orders the places too; first come five bytes.
        """
        bits = np.uint64(max(n + 1, 2).bit_length())
        if bits > 21:
            raise ValueError(f"an index of {n} bytes is too large")
        place, mask = np.arange(n, dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1)
        key = np.zeros(n, np.uint64)
        for j in range(5):
            key = (key << np.uint64(8)) | padded[j : j + n]
        key = np.sort((key << bits) | place)
        order = (key & mask).astype(np.int64)
        key >>= bits
        tied = key[1:] == key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(np.append(True, ~tied), np.arange(n, dtype=np.int32), 0))
        step = 5
        while True:
            rows = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
            if not len(rows):
                return order, rank
            at = order[rows]
            far = at + step
            next_ = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0).astype(np.uint64)
            key = np.sort((((rank[at].astype(np.uint64) << bits) | next_) << bits) | at.astype(np.uint64))
            order[rows] = (key & mask).astype(np.int64)
            key >>= bits
            equal = np.append(False, key[1:] == key[:-1])
            rank[order[rows]] = rows[np.maximum.accumulate(np.where(equal, 0, np.arange(len(rows))))]
            tied = np.zeros(n - 1, bool)
            tied[rows[equal] - 1] = True
            step *= 2

    @staticmethod
    def _common(words: np.ndarray, order: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The bytes that the suffixes of each row and the one above have in common, MATCH at most."""
        out = np.zeros(len(rows), np.int64)
        live = np.flatnonzero((rows > 0) & (rows < n))
        a, b = order[rows[live]], order[rows[live] - 1]
        for step in range(0, MATCH, 8):
            inside = np.maximum(a, b) + step < n
            live, a, b = live[inside], a[inside], b[inside]
            differ = words[a + step] ^ words[b + step]
            open_ = differ == 0
            lead = np.zeros(len(differ), np.int64)
            for j in range(1, 8):
                lead += differ < (np.uint64(1) << np.uint64(64 - 8 * j))
            out[live] = step + np.where(open_, 8, lead)
            live, a, b = live[open_], a[open_], b[open_]
            if not len(live):
                break
        return np.minimum(out, MATCH)

    def matched(self, texts: np.ndarray) -> list[np.ndarray]:
        """For each of the texts (by number) the starts of the MATCH bytes that stand elsewhere in the index too.

        All texts are streamed from their ends at once; `up` and `down` are the matching statistics against the rows
        on both sides, and the row itself is the text's own suffix, so what it matches is another place.
        """
        by = np.argsort(-self.sizes[texts], kind="stable")
        sizes, row = self.sizes[texts][by], self.last[texts][by]
        up, down = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = len(by)
        for t in range(1, int(sizes[0]) + 1 if len(by) else 0):
            while sizes[live - 1] < t:
                live -= 1
            row, up, down = row[:live], up[:live], down[:live]
            run = np.searchsorted(self.start, row, "right") - 1
            up = np.where(row == self.start[run], self.above[run], up + 1)
            down = np.where(row == self.end[run], self.below[run], down + 1)
            row = self.back[run] + row - self.start[run]
            if t >= MATCH:
                hit = np.flatnonzero(np.maximum(up, down) >= MATCH)
                if len(hit):
                    found.append((hit, sizes[hit] - t))
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(by)
        if found:
            which, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            sort = np.lexsort((at, which))
            which, at = which[sort], at[sort]
            edge = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            for x, y in zip(edge, np.append(edge[1:], len(which))):
                out[by[which[x]]] = at[x:y]
        return out


def _shards(texts: list[bytes]) -> Iterator[tuple[int, Texts]]:
    """(number of the first text, Texts) of at most SHARD_BYTES and one text more."""
    a = used = 0
    for i, t in enumerate(texts):
        used += len(t)
        if used >= SHARD_BYTES:
            yield a, Texts(texts[a : i + 1])
            a, used = i + 1, 0
    if a < len(texts):
        yield a, Texts(texts[a:])


def _long(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def _having(side: pa.Table, column: str) -> pa.Table:
    return side.filter(pc.is_valid(side.column(column)))


def _key(table: pa.Table, a: str, b: str) -> list[tuple[int, int]]:
    return list(zip(table.column(a).to_pylist(), table.column(b).to_pylist()))


class Bucket:
    """The texts of a bucket, each once, with the number of their copies in the corpus: two at most, and none in all
    buckets but the first that holds the text. They are numbered by their hashes: rows of a shuffle come in another
    order each time that it is read."""

    def __init__(self, docs: pa.Table, side: pa.Table):
        firsts = _having(side, "n")
        copies = dict(zip(_key(firsts, "k1", "k2"), firsts.column("n").to_pylist()))
        at: dict[tuple, int] = {}
        for i, key in enumerate(_key(docs, "k1", "k2")):
            if key in copies:
                at.setdefault(key, i)
        self.p = docs.column("p")[0].as_py() if len(docs) else 0
        self.keys = sorted(at)
        self.texts = docs.column("text").take(pa.array([at[k] for k in self.keys], pa.int64())).to_pylist() if at else []
        self.copies = np.minimum(np.array([copies[k] for k in self.keys], np.int64), 2)


def _cat(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _anchors(docs: pa.Table, side: pa.Table) -> pa.Table:
    """(p, h, n): the anchors of a bucket, each once, with their places; a text with copies counts twice, in its first
    bucket."""
    bucket, found, weights = Bucket(docs, side), [], []
    for x, texts in _shards(bucket.texts):
        h, at = texts.anchors()
        found.append(h)
        weights.append(bucket.copies[x + texts.doc[at]])
    h, which = np.unique(_cat(found, np.uint64), return_inverse=True)
    n = np.bincount(which, _cat(weights, np.int64), len(h)).astype(np.int64)
    return pa.table({"p": pa.array(np.full(len(h), bucket.p, np.int64)), "h": pa.array(h.view(np.int64)), "n": pa.array(n)})


def _recurring(table: pa.Table, most: int) -> pa.Table:
    """(p, h, hot): the anchors that have two places or more, for each bucket that holds them."""
    h, which = np.unique(_long(table, "h"), return_inverse=True)
    total = np.bincount(which, _long(table, "n"), len(h))[which]
    again = total > 1
    return pa.table({"p": pa.array(_long(table, "p")[again]), "h": pa.array(_long(table, "h")[again]), "hot": pa.array(total[again] > most)})


def _known(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that recur, and the hot ones of them."""
    routed = _having(side, "h")
    h = _long(routed, "h").view(np.uint64)
    return np.unique(h), np.unique(h[routed.column("hot").to_numpy(zero_copy_only=False).astype(bool)])


def _among(h: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Places in `h` of any of the few hashes: by a table of their last bits first."""
    table = np.zeros(1 << 20, bool)
    table[(few & np.uint64(0xFFFFF)).astype(np.int64)] = True
    near = np.flatnonzero(table[(h & np.uint64(0xFFFFF)).astype(np.int64)])
    return near[np.isin(h[near], few)]


def _all_starts(texts: Texts) -> np.ndarray:
    n = len(texts.raw) - MATCH + 1
    return np.flatnonzero(texts._whole(n, MATCH)) if n > 0 else np.empty(0, np.int64)


def _of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of 64 bits as one sortable array."""
    out = np.empty(len(a), [("a", np.int64), ("b", np.int64)])
    out["a"], out["b"] = a.view(np.int64), b.view(np.int64)
    return out


_STRETCH = "r long, p long, h long, k1 long, k2 long, start long, n long, text binary, w1 array<long>, w2 array<long>, wn array<long>, wk array<long>"


def _stretches(docs: pa.Table, side: pa.Table, shards: int) -> pa.Table:
    """The stretches of bytes around recurring anchors; of hot anchors, hashes of their matches instead, each once with
    its places (wn) and the number of the first text that holds it (wk)."""
    bucket, (known, hot) = Bucket(docs, side), _known(side)
    rows: dict[str, list] = {c: [] for c in ("r", "h", "k1", "k2", "start", "n", "text", "w1", "w2", "wn", "wk")}
    w1, w2, wn, wk = [], [], [], []
    for x, texts in _shards(bucket.texts if len(known) else []):
        h, s, n = texts.runs(known)
        is_hot, doc = np.isin(h, hot), x + texts.doc[s]
        raw = texts.raw.tobytes()
        for i in np.flatnonzero(~is_hot & (bucket.copies[doc] > 0)).tolist():
            a, d = int(s[i]), int(doc[i])
            values = (int(h[i] % np.uint64(shards)), int(h[i].view(np.int64)), *bucket.keys[d], a - int(texts.first[d - x]), int(bucket.copies[d]), raw[a : a + int(n[i]) + MATCH - 1], None, None, None, None)
            for c, v in zip(rows.values(), values):
                c.append(v)
        starts = spread(s[is_hot], n[is_hot])
        if len(starts):
            w1.append(texts.hashes(starts))
            w2.append(texts.second(starts))
            wk.append(x + texts.doc[starts])
            wn.append(bucket.copies[wk[-1]])
    if w1:
        pairs, first, which = np.unique(_of_pairs(_cat(w1, np.uint64), _cat(w2, np.uint64)), return_index=True, return_inverse=True)
        n = np.bincount(which, _cat(wn, np.int64), len(pairs)).astype(np.int64)
        of = _cat(wk, np.int64)[first]
        to = (pairs["a"].view(np.uint64) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        edge = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1]))
        for x, y in zip(edge, np.append(edge[1:], len(by))):
            part = by[x:y]
            for c, v in zip(rows.values(), (int(to[part[0]]), *[None] * 6, pairs["a"][part], pairs["b"][part], n[part], of[part])):
                c.append(v)
    kinds = dict(text=pa.binary(), **{c: pa.list_(pa.int64()) for c in ("w1", "w2", "wn", "wk")})
    out = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()}
    return pa.table({"r": out.pop("r"), "p": pa.array(np.full(len(rows["r"]), bucket.p, np.int64)), **out})


def _recurring_matches(table: pa.Table) -> pa.Table:
    """(p, w1, w2, k, owner): of the hot anchors' matches those that have two places or more, for each bucket that holds
    them, with the number of a text there; the first of these buckets sends the bytes."""
    rows = _having(table, "w1")
    lists = [np.concatenate([x.values.to_numpy() for x in rows.column(c)]) if len(rows) else np.empty(0, np.int64) for c in ("w1", "w2", "wn", "wk")]
    size = np.array([len(x) for x in rows.column("w1")], np.int64)
    p = np.repeat(_long(rows, "p"), size)
    pairs, which = np.unique(_of_pairs(lists[0], lists[1]), return_inverse=True)
    total = np.bincount(which, lists[2], len(pairs))
    first = np.full(len(pairs), np.iinfo(np.int64).max)
    np.minimum.at(first, which, p)
    again = total[which] > 1
    return pa.table({"p": pa.array(p[again]), "w1": pa.array(lists[0][again]), "w2": pa.array(lists[1][again]), "k": pa.array(lists[3][again]), "owner": pa.array((first[which] == p)[again])})


def _match_bytes(docs: pa.Table, side: pa.Table, shards: int) -> pa.Table:
    """(r, text): the bytes of the matches that the bucket is asked for; consecutive ones come as one stretch."""
    asked, out = _having(side, "w1"), []
    if len(asked):
        bucket = Bucket(docs, side)
        left = set(_key(asked, "w1", "w2"))
        for _, texts in _shards([bucket.texts[k] for k in np.unique(_long(asked, "k")).tolist()]):
            starts = _all_starts(texts)
            a, take = texts.hashes(starts), []
            near = _among(a, _long(asked, "w1").view(np.uint64))
            for i, key in zip(near.tolist(), zip(a[near].view(np.int64).tolist(), texts.second(starts[near]).view(np.int64).tolist())):
                if key in left:
                    left.discard(key)
                    take.append(i)
            raw, take = texts.raw.tobytes(), np.array(take, np.int64)
            at = starts[take]
            edge = np.flatnonzero(np.append(True, np.diff(at) != 1)) if len(take) else take
            for x, y in zip(edge, np.append(edge[1:], len(take))):
                for z in range(x, y, LONG):  # a long run comes in pieces, each with all of its own matches
                    out.append((int(a[take[z]] % np.uint64(shards)), raw[int(at[z]) : int(at[z]) + min(int(y - z), LONG) + MATCH - 1]))
    return pa.table({"r": pa.array([r for r, _ in out], pa.int64()), "text": pa.array([t for _, t in out], pa.binary())})


def _blocks(groups: list[list[bytes]]) -> Iterator[list[bytes]]:
    """The groups in blocks of about BLOCK_BYTES. A group has at most HOT places and its texts under 2 * MATCH bytes."""
    block, size = [], 0
    for group in groups:
        own = sum(map(len, group))
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block += group
        size += own
    if block:
        yield block


def _matches(table: pa.Table, hot: pa.Table) -> pa.Table:
    """(a, b, hot, spans): what the index finds to stand elsewhere: spans of bytes of the text of key (a, b), or the
    match of a hot anchor with the hashes (a, b).

    Equal stretches of bytes are in the index twice, however many places they have, and are streamed once.
    """
    cold = _having(table, "text")
    places: dict[bytes, list[tuple]] = {}
    weight: dict[bytes, int] = {}
    groups: dict[int, list[bytes]] = {}
    for h, k1, k2, start, n, text in zip(*[cold.column(c).to_pylist() for c in ("h", "k1", "k2", "start", "n", "text")]):
        if text not in places:
            places[text], weight[text] = [], 0
            groups.setdefault(h, []).append(text)
        places[text].append((k1, k2, start))
        weight[text] += n
    alone = [g for g in groups.values() if len(g) > 1 or weight[g[0]] > 1]
    once = dict.fromkeys(hot.column("text").to_pylist())
    spans: dict[tuple, list[int]] = {}
    confirmed: list[tuple] = []
    for block in _blocks(alone + [[t] for t in once]):
        copies = [1 if t in places and weight[t] < 2 else 2 for t in block]
        for t, starts in zip(block, RunIndex(block, copies).matched(np.arange(len(block)))):
            if not len(starts):
                continue
            if t in once:
                one = Texts([t])
                confirmed += zip(one.hashes(starts).view(np.int64).tolist(), one.second(starts).view(np.int64).tolist())
            cut = np.flatnonzero(np.diff(starts) != 1)
            begin, end = starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()
            for k1, k2, at in places.get(t, ()):
                spans.setdefault((k1, k2), []).extend(v for x, y in zip(begin, end) for v in (at + x, at + y + MATCH))
    rows = [(*k, False, v) for k, v in spans.items()] + [(*k, True, None) for k in confirmed]
    return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_()), ("spans", pa.list_(pa.int64()))))})


def _kept(docs: pa.Table, side: pa.Table) -> pa.Table:
    """doc_id, n_bytes, n_removed, n_spans, kept of a bucket's documents."""
    marks = _having(side, "spans")
    spans: dict[tuple, list[int]] = {}
    for key, found in zip(_key(marks, "k1", "k2"), marks.column("spans").to_pylist()):
        for part in found:
            spans.setdefault(key, []).extend(part)
    keys, at = _key(docs, "k1", "k2"), {}
    for i, key in enumerate(keys):
        at.setdefault(key, i)
    texts = docs.column("text").take(pa.array(list(at.values()), pa.int64())).to_pylist() if at else []
    found = _having(side, "w1")
    if len(found):
        confirmed = set(_key(found, "w1", "w2"))
        ones, order = np.unique(_long(found, "w1")).view(np.uint64), list(at)
        for x, shard in _shards(texts):
            starts = _all_starts(shard)
            a = shard.hashes(starts)
            near = _among(a, ones)
            if len(near):
                near = near[[key in confirmed for key in zip(a[near].view(np.int64).tolist(), shard.second(starts[near]).view(np.int64).tolist())]]
            doc = shard.doc[starts[near]]
            for s, d in zip((starts[near] - shard.first[doc]).tolist(), doc.tolist()):
                spans.setdefault(order[x + d], []).extend((s, s + MATCH))
    done = {}
    for key, text in zip(at, texts):
        mark = np.zeros(len(text) + 1, np.int64)
        ends = np.array(spans.get(key, []), np.int64).reshape(-1, 2)
        np.add.at(mark, ends[:, 0], 1)
        np.add.at(mark, ends[:, 1], -1)
        cover = np.cumsum(mark)[:-1] > 0
        rest = np.frombuffer(text, np.uint8)[~cover].tobytes()
        done[key] = (len(text), len(text) - len(rest), int(np.count_nonzero(np.diff(np.concatenate([[False], cover]).astype(np.int8)) == 1)), rest)
    out = [done[key] for key in keys]
    return pa.table({"doc_id": docs.column("doc_id"), **{c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())))}})


def remove_matches(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, shard_text: int = SHARD_TEXT, most: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: a cut may divide a character): the bytes that are left.

    A byte goes if MATCH bytes that cover it also stand somewhere else, in any document or in the same one, overlapping
    or not; both places lose it. Matches are judged on the input and never cross documents.

    1. Documents are dealt by hash into buckets of about `bucket_bytes`. Each MATCH bytes hold anchors (`anchors`);
       equal bytes hold equal ones, so only stretches whose anchors all have two places or more can match.
    2. Those stretches meet in shards, by their smallest anchor. Each shard builds a run-length index of the distinct ones, two of
       those that stand in several places, and streams their matching statistics: what reaches MATCH is marked.
    3. An anchor of over `most` places would fill a shard with its surroundings. Of these, the matches (MATCH bytes) are
       told apart by 128-bit hashes, added up a bucket before they are sent; of those that stand twice one bucket sends
       the bytes, and the index confirms them. So no shard grows with the number of places of a passage.
    4. Spans go back to all buckets that hold the text. Copies of a text are one text here: the index sees it once or
       twice, and its spans hold for all of its rows.

    Documents are shuffled once; all steps read that shuffle. Null texts are empty. Texts of fewer than MATCH bytes
    stay. Null and repeated doc_ids are as good as others: nothing depends on them; rows equal in doc_id and text share
    a bucket. An empty table gives no rows. Only doc_id and text are read, whatever else the table holds.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets, shards = max(1, -(-total // bucket_bytes)), max(1, -(-total // shard_text))
    kind, text = docs.schema["doc_id"].dataType.simpleString(), F.coalesce("text", F.lit(""))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    p = F.pmod(F.xxhash64("doc_id", text), F.lit(buckets)).alias("p")
    dealt = docs.select(p, "doc_id", k1.alias("k1"), k2.alias("k2"), text.cast("binary").alias("text")).groupBy("p")
    keyed = docs.select(p, k1.alias("k1"), k2.alias("k2"))
    copies = keyed.groupBy("k1", "k2").agg(F.min("p").alias("first"), F.count("*").alias("copies"))
    held = keyed.distinct().join(copies, ["k1", "k2"]).select("p", "k1", "k2", F.when(F.col("p") == F.col("first"), F.col("copies")).otherwise(0).alias("n"))

    def together(*frames: DataFrame) -> DataFrame:
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)

    anchors = dealt.cogroup(held.groupBy("p")).applyInArrow(_anchors, "p long, h long, n long")
    routed = anchors.groupBy(F.pmod("h", F.lit(shards)).alias("r")).applyInArrow(lambda t: _recurring(t, most), "p long, h long, hot boolean")
    known = together(held, routed)
    sent = dealt.cogroup(known.groupBy("p")).applyInArrow(lambda d, s: _stretches(d, s, shards), _STRETCH)
    matches = sent.groupBy("r").applyInArrow(_recurring_matches, "p long, w1 long, w2 long, k long, owner boolean")
    asked = together(held, matches.filter("owner").select("p", "w1", "w2", "k"))
    hot = dealt.cogroup(asked.groupBy("p")).applyInArrow(lambda d, s: _match_bytes(d, s, shards), "r long, text binary")
    found = sent.groupBy("r").cogroup(hot.groupBy("r")).applyInArrow(_matches, "a long, b long, hot boolean, spans array<long>")
    marks = found.groupBy("a", "b", "hot").agg(F.collect_list("spans").alias("spans"))
    holders = held.select("p", F.col("k1").alias("a"), F.col("k2").alias("b"), F.lit(False).alias("hot")).unionByName(
        matches.select("p", F.col("w1").alias("a"), F.col("w2").alias("b"), F.lit(True).alias("hot")))
    own = holders.join(marks, ["a", "b", "hot"]).select(
        "p", *[F.when(~F.col("hot"), F.col(c)).alias(k) for c, k in (("a", "k1"), ("b", "k2"), ("spans", "spans"))], *[F.when(F.col("hot"), F.col(c)).alias(k) for c, k in (("a", "w1"), ("b", "w2"))])
    return dealt.cogroup(own.groupBy("p")).applyInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
