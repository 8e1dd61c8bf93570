"""The trie of conversations against nested loops."""

import hashlib
import re
import zlib

import numpy as np

from scholargraph.llm import conversation_trie, queries


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in nodes}
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        inner = {q[:-1] for q in nodes if q}
        ends = sorted(c for c in members if len(built[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in under), sum(q not in inner for q in under),
            sum((len(nodes[q]) - 1) * words[q] for q in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(rng, n):
    rows = []
    for c in rng.choice(400, n, replace=False).tolist() + [20, 40]:
        first = int(rng.integers(0, 3))
        for t in range(int(rng.integers(1, 7))):
            text = f"hi  there {first}" if t == 0 else str(rng.choice(["yes", "no", "", "a b\tc"]))
            rows.append((c, t if rng.random() < 0.95 else None, str(rng.choice(["user", "assistant"])) if rng.random() < 0.3 else None, text if rng.random() < 0.9 else None))
    return rows + [(None, 0, "user", "lost"), rows[0], rows[0]]


def test_against_loops(spark):
    rows = drawn(np.random.default_rng(1), 60)
    made = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    want = plain(rows)
    assert sorted(map(tuple, conversation_trie.prefix_trie(made).collect()), key=str) == want


def test_blocks_meet(spark):
    """Nodes that many blocks share: equal conversations in all of them."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + [(c, 3, "user", f"own {c % 5}") for c in range(300)]
    want = plain(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = conversation_trie.grown(conversation_trie.rebuilt(conversation_trie.ordered_turns(frame)))
        assert nodes.select("block").distinct().count() > 1
        assert sorted(map(tuple, conversation_trie.prefix_trie(frame).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_small_blocks():
    """One block and many give the same members of each node."""
    rng = np.random.default_rng(4)
    ids = list(range(0, 90, 3))
    turns = [[(bytes([int(k)]), 1) for k in rng.integers(0, 2, rng.integers(0, 6))] for _ in ids]
    whole = {r[2]: (r[4], r[5], r[8]) for r in conversation_trie.trie_of(ids, turns)}
    parts = {}
    for x in range(0, len(ids), 7):
        for r in conversation_trie.trie_of(ids[x : x + 7], turns[x : x + 7]):
            low, n, ends = parts.get(r[2], (r[4], 0, []))
            parts[r[2]] = (min(low, r[4]), n + r[5], ends + r[8])
    assert whole == parts


def test_empty_and_long(spark, tmp_path):
    kind = "conv_id long, turn long, role string, text string"
    assert conversation_trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    rows = [(7, t, "user", f"word {t}") for t in range(3000)]  # deeper than any recursion
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_trie(spark, str(tmp_path)).orderBy("depth").collect()
    h = zlib.crc32(b"7") % 4
    assert [r.depth for r in got] == list(range(3000 - h + 1)) and got[-1].ends_sha256 == hashlib.sha256(b"7").hexdigest()
    assert {r.n_leaves for r in got} == {1} and {r.saved_tokens for r in got} == {0}
