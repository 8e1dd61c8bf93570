"""Plain versions of the contracts, for small inputs only."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
BENCH = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def contamination(docs, items):
    windows = []
    for item, text in items:
        w = BENCH.findall(lower_az(text))
        n = min(10, len(w))
        windows += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if w else []
    by = {}
    for item, w in windows:
        by.setdefault(w, set()).add(item)
    sizes = {len(w) for w in by}
    out = []
    for d, text in docs:
        w = BENCH.findall(lower_az(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = by.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    w = WORD.findall(lower_az(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, distance=2):
    fps = {}
    for d, t in docs:
        fps.setdefault(fingerprint(t), []).append(d)
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    import numpy as np

    a = np.array(keys, np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance):
            root[find(keys[i + 1 + j])] = find(k)
    low = {}
    for k in keys:
        low[find(k)] = min(low.get(find(k), min(fps[k])), min(fps[k]))
    return [(d, f"{k:016x}", low[find(k)]) for k in keys for d in fps[k]]


def substrings(docs, size=20):
    """docs in ascending doc_id; every window of `size` words seen before marks its words."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shards(docs, n=40):
    sized = sorted((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t in docs)
    total, at, out, slots = sum(s for _, _, s in sized), 0, [], {}
    for d, crc, s in sized:
        k = min(n - 1, at * n // total)
        out.append((d, s, crc, k, slots.get(k, 0)))
        slots[k] = slots.get(k, 0) + 1
        at += s
    return out
