"""Prefix trie of conversations: vertical bitmaps of turns, intersected depth first in blocks, merged by node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.operators.lineage import staged

#: A block ends at so many conversations (the bits of a bitmap) or turns (the number of bitmaps), whichever comes first.
BLOCK_CONVERSATIONS, BLOCK_TURNS = 4096, 100_000
#: Every so many conversations begin with turns of the first of them.
FAMILY = 20
WORD = r"[^\x20\x09-\x0D]+"

_NODES = "block long, i int, parent int, key binary, depth int, low long, n long, words long, inner boolean, ends array<long>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (key, words) in order of the turns, null first; turns of one number by key.

    A key is 128 bits of the SHA-256 of role and text, null ones empty; words is the number of words of the text. Rows
    without a conv_id belong to no conversation. The texts themselves are not shuffled: 24 bytes a turn are.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turn = F.struct("turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    found = conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return found.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(ordered: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of the family's first conversation, then the own ones after the h-th;
    h is crc32 of the decimal conv_id modulo 4. A family without a first conversation gives none."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")
    heads = ordered.filter(c % FAMILY == 0).select(c.alias("head"), F.slice("turns", 1, 3).alias("first"))
    joined = ordered.withColumn("head", c - c % FAMILY).join(heads, "head", "left")
    empty = F.slice("turns", 1, 0)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("first", empty), F.lit(1), h), own).alias("turns"))


def _bits(x: int) -> list[int]:
    """Places of the set bits, ascending."""
    if x.bit_count() > 16:
        return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()
    out = []
    while x:
        out.append((x & -x).bit_length() - 1)
        x &= x - 1
    return out


def trie_of(ids: list[int], turns: list[list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """(i, parent, key, depth, low, n, words, inner, ends) of the nodes of some conversations, ids ascending.

    The index holds, for each depth, a bitmap of conversations for each turn that stands there and one for those that
    end there. A child is the parent's bitmap intersected with that of the turn which the parent's lowest remaining
    member has next, so each child costs one intersection, and no turn is tried in vain.
    """
    postings: list[dict[bytes, int]] = []
    over: dict[int, int] = {}
    for c, row in enumerate(turns):
        bit = 1 << c
        over[len(row)] = over.get(len(row), 0) | bit
        while len(postings) < len(row):
            postings.append({})
        for at, (key, _) in zip(postings, row):
            at[key] = at.get(key, 0) | bit
    stack, i = [((1 << len(ids)) - 1, 0, -1, b"\0" * 16, 0)], 0
    while stack:
        members, depth, parent, key, words = stack.pop()
        ends = members & over.get(depth, 0)
        rest = members ^ ends
        yield i, parent, key, depth, ids[(members & -members).bit_length() - 1], members.bit_count(), words, bool(rest), [ids[c] for c in _bits(ends)]
        while rest:
            turn, n = turns[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth][turn]
            rest ^= child
            stack.append((child, depth + 1, i, hashlib.blake2b(key + turn, digest_size=16).digest(), n))
        i += 1


def _block_rows(block: int, ids: list[int], turns: list) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    names = ["i", "parent", "key", "depth", "low", "n", "words", "inner", "ends"]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block, np.int64)), *columns], names=["block", *names])

    for row in trie_of(ids, turns):
        rows.append(row)
        if len(rows) == 20_000:
            yield batch()
            rows = []
    if rows:
        yield batch()


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of the blocks of a partition, whose conversations come in order of conv_id."""
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids: list[int] = []
    turns: list[list] = []
    size = 0
    for b in batches:
        keys, words, offsets = b.column("keys"), b.column("words"), b.column("keys").offsets.to_pylist()
        key, count = keys.values.to_pylist(), words.values.to_pylist()
        shift = words.offsets[0].as_py() - offsets[0]
        for c, x, y in zip(b.column("conv_id").to_pylist(), offsets, offsets[1:]):
            ids.append(c)
            turns.append(list(zip(key[x:y], count[x + shift : y + shift])))
            size += y - x
            if len(ids) >= BLOCK_CONVERSATIONS or size >= BLOCK_TURNS:
                yield from _block_rows(block, ids, turns)
                block, ids, turns, size = block + 1, [], [], 0
    if ids:
        yield from _block_rows(block, ids, turns)


def _sums(table: pa.Table) -> pa.Table:
    """Of the nodes of a block: the parent's conv_id, and sums over those of the block's subtrees that it is the first
    block to hold, so that over all blocks every node counts once."""
    table = table.sort_by("i")
    parent = table.column("parent").to_numpy().astype(np.int64)
    first = table.column("first_block").to_numpy() == table.column("block").to_numpy()
    inner = table.column("inner").to_numpy(zero_copy_only=False).astype(bool)
    low = table.column("conv_id").to_numpy()
    children = np.bincount(parent[1:][first[1:]], minlength=len(parent))
    leaves = (first & ~inner).astype(np.int64).tolist()
    saved = np.where(first, (table.column("n_convs").to_numpy() - 1) * table.column("words").to_numpy(), 0).tolist()
    for i in range(len(parent) - 1, 0, -1):
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    return pa.table({
        "key": table.column("key"), "depth": table.column("depth").cast(pa.int64()), "conv_id": table.column("conv_id"), "n_convs": table.column("n_convs"),
        "parent_conv_id": pa.array(low[np.maximum(parent, 0)], mask=parent < 0), "n_children": pa.array(children.astype(np.int64)),
        "n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows (key, ends) in order of key and block: ids are hashed as they come, one row at a time."""
    now, run, done = None, None, []
    for b in batches:
        for key, ends in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            text = ",".join(map(str, ends)).encode()
            if key == now:
                run.update(b"," + text)
            else:
                if now is not None:
                    done.append((now, run.hexdigest()))
                now, run = key, hashlib.sha256(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["key", "ends_sha256"])
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([run.hexdigest()])], names=["key", "ends_sha256"])


def grown(sequences: DataFrame) -> DataFrame:
    """The nodes of each block of `sequences` (conv_id, turns), written to shared storage.

    Conversations are dealt by ranges of conv_id, so that the ids of a block all follow those of the one before. A node
    has one row a block, however many conversations begin with it: a hot first turn is split as its conversations are.
    """
    flat = sequences.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))
    return staged(flat.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(_grow, _NODES), "trie-nodes")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations (see `rebuilt`), the empty one too: conv_id (the
    smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, and
    ends_sha256 over the ids of the conversations that end there.

    1. Each block of conversations grows its own trie from bitmaps (`trie_of`); a node's key is a chain of hashes.
    2. Nodes meet by key: members add up, the smallest conv_id and the first block that holds the node are found.
    3. Each block adds up its subtrees, children first, from the nodes that it is the first to hold, whatever their
       depth; these sums add up by key. No level of the trie needs a job of its own.
    4. The ids that end at a node come in order of blocks and are hashed as a stream, since a digest has no parts.

    Null roles and texts are empty; null turns come first, turns of one number in order of their keys; repeated rows
    are repeated turns; rows without conv_id are left out; an empty table has no nodes. One conversation's turns, at
    24 bytes each, have to fit into a task, being one path of the trie.
    """
    nodes = grown(rebuilt(ordered_turns(conversations)))
    whole = nodes.groupBy("key").agg(F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("inner").alias("inner"), F.min("block").alias("first_block"))
    met = nodes.select("block", "i", "parent", "key", "depth", "words").join(whole, "key")
    kind = "key binary, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    parts = met.groupBy("block").applyInArrow(_sums, kind)
    sums = parts.groupBy("key", "depth", "conv_id", "n_convs", "parent_conv_id").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    ends = nodes.filter(F.size("ends") > 0).select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block")
    hashed = ends.select("key", "ends").mapInArrow(_digests, "key binary, ends_sha256 string")
    return sums.join(hashed, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
