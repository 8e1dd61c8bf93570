"""SimHash near-duplicates: fingerprints of word shingles, linked by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.bitmaps import TEXT_BITS, may_be_in
from scholargraph.operators.components import connected_components
from scholargraph.operators.lineage import checkpointed, fresh

BITS, SHINGLE, SEED, MAX_DISTANCE = 64, 3, 42, 2
#: Fingerprints that the partitions and thresholds are fitted on, at most.
FIT_ROWS = 2000
#: Entries of a bucket whose pairs are compared one by one; larger buckets are linked without pairs.
PAIR_LIMIT = 64


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text; texts without a word (or null) have 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())]
    total, n = np.zeros(BITS, np.int64), len(hashes)
    h = np.array(hashes, "<u8")
    for a in range(0, n, 1 << 16):
        part = h[a : a + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (a 128-bit hash of the text), fp: one map over the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            out = [fingerprint(t) for a in range(0, len(b), 512) for t in texts.slice(a, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "t1", "t2")), pa.array(out, pa.int64())], names=["doc_id", "t1", "t2", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *(h.alias(n) for n, h in zip(("t1", "t2"), text_hashes(docs))), "text").mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, fp long")


def text_hashes(docs: DataFrame) -> tuple[Column, Column]:
    return F.xxhash64(docs["text"]), F.xxhash64(F.lit("second"), docs["text"])


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Splits the bit positions into `parts` groups of nearly equal size, correlated bits together.

    Each group grows from the free bit with the least skew by the free bit most correlated with its members.
    """
    width = bits.shape[1]
    spread = bits.std(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits, rowvar=False)), nan=0.0) if len(bits) > 2 else np.zeros((width, width))
    free, groups = set(range(width)), []
    for k in range(parts):
        size = width // parts + (k < width % parts)
        own = [max(free, key=lambda b: (spread[b], -b))]
        free.discard(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def estimated_candidates(bits: np.ndarray, group: list[int], rows: int, top: int) -> list[float]:
    """For thresholds -1 to `top`: probe keys plus candidate pairs that a group is expected to give for `rows` rows.

    The share of sampled pairs within the distance is counted; under the sample's resolution, the share that
    independent bits of the same skew would give is taken.
    """
    out, w = [0.0], len(group)
    own = bits[:, group].astype(np.float32)
    n = len(own)
    agree = own.mean(axis=0) ** 2 + (1 - own.mean(axis=0)) ** 2 if n else np.full(w, 0.5)
    # Distribution of the number of differing bits of two random rows.
    differ = np.zeros(top + 2)
    differ[0] = 1.0
    for p in agree:
        differ[1:] = differ[1:] * p + differ[:-1] * (1 - p)
        differ[0] *= p
    pairs = n * (n - 1) / 2
    if pairs:
        dist = w - (own @ own.T + (1 - own) @ (1 - own).T)
        near = dist[np.triu_indices(n, 1)]
    for t in range(top + 1):
        share = float(differ[: t + 1].sum())
        if pairs and (seen := float((near <= t).sum())) >= 10:
            share = max(share, seen / pairs)
        keys = 1 + (sum(math.comb(w, i) for i in range(t + 1)) if t else 0)
        out.append(rows * keys + rows * rows / 2 * share)
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1) of least summed cost whose sum is `total`, by dynamic programming over the groups."""
    best = {0: (0.0, [])}
    for c in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for i, x in enumerate(c):
                key, value = used + i - 1, cost + x
                if key not in after or value < after[key][0]:
                    after[key] = (value, [*chosen, i - 1])
        best = after
    return best[total]


def plan_partitions(sample: np.ndarray, rows: int, distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """(bit positions, threshold) by group: the cheapest plan over two to four groups.

    If the thresholds of m groups sum to distance - m + 1, two fingerprints within the distance are within the
    threshold of at least one group.
    """
    bits = (sample.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    best = None
    for m in (2, 3, 4):
        groups = group_bits(bits, m)
        cost, chosen = allocate([estimated_candidates(bits, g, rows, 1) for g in groups], distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, chosen)))
    return best[1]


def _gather(fp: Column, positions: list[int]) -> Column:
    key = F.lit(0).cast("long")
    for j, b in enumerate(positions):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), j))
    return key


def link_fingerprints(fps: DataFrame, plan: list[tuple[list[int], int]], limit: int = PAIR_LIMIT, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links between fingerprints within `distance` of one another; for a distance of 2, as in `cluster`, they
    connect exactly the distinct fingerprints that are so near.

    Each fingerprint is entered in the buckets of its groups and, for groups of threshold 1, probes the buckets one
    bit away. In buckets of up to `limit` entries, pairs are compared and verified. Members of larger buckets are
    linked without pairs: each is sent to itself and to the 64 values one bit away, and those that meet at a value
    are within two bits; all of them are linked to the smallest. Two fingerprints within two bits always meet so. For
    distances over 2, members of larger buckets are linked within two bits only: more is for a search that follows.
    """
    entries = []
    for i, (positions, threshold) in enumerate(plan):
        if threshold < 0:
            continue
        key = _gather(F.col("fp"), positions)
        own = F.array(F.struct(F.lit(i).alias("part"), key.alias("key"), F.lit(True).alias("own")))
        entries.append(own)
        if threshold > 0:
            flipped = [key.bitwiseXOR(F.lit(1 << j).cast("long")) for j in range(len(positions))]
            entries.append(F.array(*[F.struct(F.lit(i).alias("part"), k.alias("key"), F.lit(False).alias("own")) for k in flipped]))
    if not entries:
        raise ValueError("a plan needs at least one group of threshold 0 or more")
    rows = checkpointed(fps.select("fp", F.explode(F.flatten(F.array(*entries))).alias("e")).select("fp", "e.part", "e.key", "e.own"))
    buckets = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owned")).filter("n > 1 and owned > 0")
    shared = checkpointed(rows.join(buckets, ["part", "key"]).select("fp", "part", "key", "own", "n"))
    small = shared.filter(F.col("n") <= limit)
    a, b = small.filter("own").alias("a"), small.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    pairs = a.join(
        b, (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp"))
        & (~F.col("b.own") | (F.col("a.fp") < F.col("b.fp"))) & near
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowd = shared.filter(F.col("n") > limit).select("fp").distinct()
    flips = [0, *[(1 << i) - (1 << 64 if i == 63 else 0) for i in range(BITS)]]
    meetings = crowd.select("fp", F.explode(F.lit(flips).cast("array<bigint>")).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    centres = meetings.groupBy("at").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = meetings.join(centres, "at").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return pairs.unionByName(met)


def cluster(docs: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, t1, t2 (hash of the text), fp, root (a fingerprint of the component), component_id (smallest doc_id
    reachable over links, itself included).

    Exact copies share a fingerprint and are merged before anything is compared, so a group of copies of any size
    costs one entry. Texts without a word (and null) share fingerprint 0 and are linked like any other. Null doc_ids
    are kept and never become a component's id unless it has no other. Repeated rows get a row each. An empty table
    gives no rows. Only doc_id and text are read, whatever else the table holds.
    """
    marked = checkpointed(fingerprints(docs))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rows = classes.count()
    # The sample only shapes the plan (which buckets there are), never which links are found.
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(FIT_ROWS).toArrow().column("fp").to_numpy()
    plan = plan_partitions(np.asarray(sample, np.int64), max(rows, 1))
    links = link_fingerprints(classes.select("fp"), plan, limit)
    parts = checkpointed(connected_components(links, "a", "b"))
    rooted = classes.join(parts.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "t1", "t2", "fp", "root", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, limit: int = PAIR_LIMIT, clusters: Callable[[DataFrame, int], DataFrame] = cluster) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their components in `clusters` (doc_id, t1, t2,
    root): of each, the row of smallest doc_id (null ones last) and, of several texts under that one, of smallest hash.

    A row is told by its doc_id and text, so unlike texts under one doc_id, or under none, are documents of their own
    and all stay. Of rows equal in both, one stays.
    """
    found = checkpointed(clusters(docs, limit).select("doc_id", "t1", "t2", "root"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2")).alias("b")).select("b.doc_id", "b.t1", "b.t2")
    own = fresh(docs, "keep_id", "keep_t1", "keep_t2")
    chosen = best.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "t1", "t2"), own)))
    t1, t2 = text_hashes(docs)
    same = docs["doc_id"].eqNullSafe(F.col(own[0])) & (t1 == F.col(own[1])) & (t2 == F.col(own[2]))
    # Rows whose text no dropped row has stay without a join, so that their texts are not shuffled.
    dropped = found.join(best, found["doc_id"].eqNullSafe(best["doc_id"]) & (found["t1"] == best["t1"]) & (found["t2"] == best["t2"]), "left_anti")
    doubtful = may_be_in(dropped.select(F.xxhash64("t1", "t2").alias("h")), F.xxhash64(t1, t2), TEXT_BITS)
    out = docs.filter(~doubtful).unionByName(docs.filter(doubtful).join(chosen, same, "left_semi"))
    repeated = found.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])
