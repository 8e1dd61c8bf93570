"""Near copies: fingerprints by the generalised pigeonhole first, then, by prefix filtering, every pair of texts whose
shingle sets are similar enough; one text a component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm import simhash
from scholargraph.llm.bitmaps import TEXT_BITS, bitmap, has, may_be_in
from scholargraph.llm.substring import Powers, Shard, _M1
from scholargraph.llm.worker import let_go, release, small_batches
from scholargraph.operators.components import connected_components
from scholargraph.operators.lineage import checkpointed, staged

#: Words of a shingle, and the least Jaccard similarity of near copies as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bits in which fingerprints of near copies differ at most where they are linked by these.
DISTANCE = 3
#: Texts that common shingles are looked for in, and common shingles that are known, at most.
SAMPLE_ROWS, COMMON = 4000, 100_000
#: Counters of a set's sketch: shingles by a part of their hash, which bound from above what two sets can share.
COUNTERS = 64
#: Entries of a bucket whose pairs are all candidates at once; larger buckets are linked to their first entry before.
PAIR_LIMIT = 4
#: Bits of the bitmap of recurring prefix shingles; hashes that a task holds.
SHINGLE_BITS, HELD = 1 << 25, 500_000
#: Bytes of text whose shingles are made at a time, and texts that are sent to a worker at once.
SHARD, TEXTS = 1 << 20, 1000
#: Sizes within this ratio are a block of a large bucket.
SIZE_STEP = 1.06


def shingle_sets(texts: list[str | None], powers: Powers) -> list[np.ndarray]:
    """The sorted distinct hashes (64 bits) of the shingles of each text, A-Z taken as a-z. A text of fewer words than
    a shingle has one, of all its words; texts without a word (or null) share one set."""
    shard = Shard([t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if t else t for t in texts], powers)
    h, out = shard.rolling(SHINGLE, _M1), []
    for a, b in zip(shard.first[:-1].tolist(), shard.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(shard.values[a:b].tobytes(), b - a)], np.uint64))
    return out


def _signed(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def fingerprint(one: np.ndarray) -> int:
    """The signed SimHash of a set: a bit is 1 if set in over half of the hashes."""
    total = np.zeros(simhash.BITS, np.int64)
    for a in range(0, len(one), 1 << 16):
        part = one[a : a + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(one)).astype(np.uint8), bitorder="little").view("<i8")[0])


def bits_of(one: np.ndarray) -> np.ndarray:
    """A set as a bitmap of two to four bits a shingle, a power of two of them: sets of like sizes have it as long, or
    one twice as long, which folds into its first half."""
    size = 1 << max(6, (2 * len(one) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[((one >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def _key(one: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(one.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
    """(batch, x, y, sets of its texts x to y), SHARD bytes at a time; only so much text is taken out of a batch at once."""
    let_go(__name__)
    powers = Powers(least=SHARD + (SHARD >> 2))
    for b in batches:
        texts = b.column("text")
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        x = 0
        while x < len(size):
            y = int(np.searchsorted(size, (size[x - 1] if x else 0) + SHARD)) + 1
            yield b, x, min(y, len(size)), shingle_sets(texts.slice(x, y - x).to_pylist(), powers)
            x = y
        b = texts = size = None
    powers = None
    release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, x, y, sets in _by_shard(batches):
        yield pa.RecordBatch.from_arrays([b.column("c").slice(x, y - x), _signed(sets)], names=["c", "shingles"])


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that stand in several texts of a sample, and how many. They shape the buckets only,
    never which pairs are found."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.lit(0).alias("c"), "text")
    n = some.mapInArrow(_sets, "c int, shingles array<long>").select(F.explode("shingles").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    got = n.filter("n > 2").orderBy(F.desc("n"), "t").limit(COMMON).toArrow()
    t, n = got.column("t").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(t)
    return t[order], n[order]


def similar_enough(shared, n, m):
    """Whether sets of n and m shingles that share `shared` have the least similarity, in whole numbers."""
    p, q = SIMILAR
    return shared * (p + q) >= p * (n + m)


def _most(a: str, b: str):
    """What two sets share at most: the sum of the smaller counters of their sketches; null where one has none."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)


def _small(counts):
    """A sketch in one byte a counter; sets that are too large for it have none."""
    return F.when(F.array_max(counts) < 128, counts.cast("array<tinyint>"))


def _folded(bits, other):
    """A bitmap as long as the other one, if that is as long or half as long."""
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y))).otherwise(F.col(bits))


def _lacking(a, b):
    """Bits of one bitmap that another lacks: as many shingles at least are in the one set only. Null for bitmaps of
    unlike lengths, whose sets are too unlike in size."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps let them be similar enough."""
    a, b = (classes.select(F.col("c").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_n", "b_n", _folded("a_bits", "b_bits").alias("x"), _folded("b_bits", "a_bits").alias("y"))
    most = F.least(F.col("a_n") - _lacking("x", "y"), F.col("b_n") - _lacking("y", "x"))
    return both.filter(F.size("x") == F.size("y")).filter(similar_enough(most, F.col("a_n"), F.col("b_n"))).select("a", "b")


def _held(asked: DataFrame, needed: DataFrame) -> DataFrame:
    """(c, text): the texts asked for of the classes in `needed` (c, row).

    The join shuffles however small `needed` is: with a broadcast, the filter that has asked and the map that follows
    would be steps of one task, with a Python worker each, and executors keep all workers that they once had."""
    return asked.withColumn("row", F.struct("doc_id", "t1", "t2")).join(needed.hint("merge"), "row").select("c", "text")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, counted over the whole sets.

    Only texts that a pair needs are shuffled: a bitmap of their hashes lets most others pass before the join."""
    pairs = checkpointed(_possible(pairs, classes))
    ids = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    needed = staged(classes.join(ids, "c").select("c", F.struct("first.doc_id", "first.t1", "first.t2").alias("row")), "needed")
    asked = docs.filter(may_be_in(needed.select(F.xxhash64("row.t1", "row.t2").alias("h")), F.xxhash64("t1", "t2"), TEXT_BITS))
    sets = _held(asked, needed).mapInArrow(_sets, "c long, shingles array<long>")
    sets = staged(sets.dropDuplicates(["c"]) if repeated else sets, "shingles")
    left, right = (sets.select(F.col("c").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return checkpointed(both.filter(similar_enough(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set"), F.size("b_set"))).select("a", "b"))


def _alike(classes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints the generalised pigeonhole links; classes of one fingerprint each with
    the first of them."""
    lows = checkpointed(classes.groupBy("fp").agg(F.min("c").alias("low")))
    sample = lows.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(simhash.FIT_ROWS).toArrow().column("fp").to_numpy()
    plan = simhash.plan_partitions(np.asarray(sample, np.int64), max(lows.count(), 1), DISTANCE)
    links = simhash.link_fingerprints(lows.select("fp"), plan, max(limit, simhash.PAIR_LIMIT), DISTANCE)
    x, y = (lows.select(F.col("fp").alias(k), F.col("low").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    far = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return far.unionByName(classes.select("fp", "c").join(lows, "fp").filter("c <> low").select(F.col("low").alias("a"), F.col("c").alias("b")))


def _apart(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that the links have not put into one component, and links (a, b) that connect what these do: each
    member of a component with its smallest one. They are fewer, and need not settle again where they are used on."""
    parts = checkpointed(connected_components(links, "a", "b"))
    a, b = (parts.select(F.col("id").alias(x), F.col("component").alias(f"{x}_part")) for x in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    stars = parts.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    return checkpointed(both.filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select(pairs.columns)), stars


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool, known: DataFrame) -> DataFrame:
    """Links (a, b) that connect all that the known ones and the similar ones of the candidate pairs (a, b; one row for
    each shared entry) connect.

    Each class is first held against the one that shares most entries with it. Pairs that links have put into one
    component need no look; only the others' sets are sent too."""
    pairs, known = _apart(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), known)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("a")).select("a", "b")
    links = known.unionByName(_verified(best, docs, classes, repeated))
    rest, links = _apart(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), links)
    return links if rest.isEmpty() else links.unionByName(_verified(rest, docs, classes, repeated))


def _block(size):
    return F.floor(F.log(size) / float(np.log(SIZE_STEP))).cast("int")


def _partners(n, pos):
    """Blocks of the sizes up to n that can be similar to a set of n which shares its first entry at `pos`: at least
    n p / q, and so few that what is left behind `pos` suffices; null if there are none."""
    p, q = SIMILAR
    low = F.ceil(n * p / q)
    high = F.least(n, F.floor(((n - pos) * (p + q) - n * p) / p))
    return F.when(high >= low, F.sequence(_block(low), _block(high)))


def _may_match(a: str, b: str):
    """Whether two entries of a bucket may belong to similar sets: sizes, and what is left behind their places. A pair
    that is turned down here has an earlier shingle in common, whose bucket it also shares, or is not similar."""
    p, q = SIMILAR
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = 1 + F.least(n - F.col(f"{a}.pos") - 1, m - F.col(f"{b}.pos") - 1)
    return (q * F.least(n, m) >= p * F.greatest(n, m)) & similar_enough(left, n, m)


def cluster(docs: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, t1, t2, root, component_id: components (smallest doc_id) over all pairs of texts with 5-word Jaccard of 0.8 or more.

    Fingerprints (SimHash) of the sets within DISTANCE bits are found by the generalised pigeonhole of `simhash`, and
    the pairs are verified on their whole sets. What these links have brought together is decided; the rest of the pairs
    can be any number of bits apart, so an exact search completes them:

    in one order of all shingles, the first fifth (and one) of the shingles of two similar sets have one in common: it
    is the pigeonhole principle, so no pair is missed, whatever the order. Rare shingles come first. Texts with one set
    are a class and are merged before; classes that share a prefix shingle are candidates and are verified on their
    whole sets. Buckets of over `limit` entries are first linked to their smallest entry; then only pairs of entries
    that are not in one component yet are candidates. Shingles are compared by 64-bit hashes.
    """
    with small_batches(docs.sparkSession, TEXTS):  # every step over texts has run when this returns
        return _cluster(docs, limit)


def _cluster(docs: DataFrame, limit: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, y, sets in _by_shard(batches):
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(x, y - x) for c in ("doc_id", "t1", "t2")), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()), pa.array([np.bincount((s >> np.uint64(40)).astype(np.int64) % COUNTERS, minlength=COUNTERS) for s in sets], pa.list_(pa.int32())),
                 pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([bits_of(s) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "t1", "t2", "k1", "k2", "n", "counts", "fp", "bits"])

    def first_part(s: np.ndarray) -> tuple[np.ndarray, int]:
        """The prefix of a set, rare shingles first, and how many of them are not known to be common."""
        (hot, often), (p, q) = shared.value, SIMILAR
        size = len(s) - -(-len(s) * p // q) + 1
        if not len(hot):
            return s[:size], size
        k = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rank = np.where(hot[k] == s, often[k], 0)
        return s[np.argsort(rank, kind="stable")][:size], min(size, int((rank == 0).sum()))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(r, h, n): the prefix shingles of a partition, each once, by shards."""
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            to = (h % np.uint64(shards)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1]))
            parts = np.split(by, edge[1:])
            counts = pa.ListArray.from_arrays(pa.array(np.append(edge, len(by)).astype(np.int32)), pa.array((n[by] > 1)))
            yield pa.RecordBatch.from_arrays([pa.array(to[by[edge]], pa.int64()), _signed([h[x] for x in parts]), counts], names=["r", "h", "more"])

        for _, _, _, sets in _by_shard(batches):
            held += [first_part(s)[0] for s in sets]
            size += sum(map(len, held[-len(sets) :]))
            if size > HELD:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()
        held = []
        release()

    def again(table: pa.Table) -> pa.Table:
        """h: the shingles of a shard that stand in several texts."""
        lists = [(x.values.to_numpy(), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(table.column("h"), table.column("more"))]
        h, which, n = np.unique(np.concatenate([x for x, _ in lists]), return_inverse=True, return_counts=True)
        more = np.zeros(len(h), bool)
        more[which[np.concatenate([y for _, y in lists])]] = True
        return pa.table({"h": pa.array(h[(n > 1) | more])})

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, sets in _by_shard(batches):
            rows = []
            for s in sets:
                prefix, rare = first_part(s)
                at = np.flatnonzero(has(recurring.value, prefix))
                if len(at):
                    rows.append((*_key(s), len(s), rare, at.astype(np.int32), prefix[at]))
            if rows:
                k1, k2, n, rare, at, prefix = zip(*rows)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(rare, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(at))), _signed(list(prefix))],
                    names=["k1", "k2", "n", "rare", "at", "prefix"])

    marked = staged(docs.mapInArrow(mark, f"doc_id {kind}, t1 long, t2 long, k1 long, k2 long, n int, counts array<int>, fp long, bits array<long>"), "sets")
    repeated = not marked.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty()
    classes = staged(marked.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2")).alias("first"), *(F.first(c).alias(c) for c in ("n", "counts", "fp", "bits"))
    ).withColumn("c", F.monotonically_increasing_id()), "classes")
    # Prefix shingles are counted by themselves before any entry is sent: those of one text can make no pair, and they
    # are most of all. Copies count as several texts here; their entries merge below.
    shards = max(1, -(-(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // (16 << 20)))
    tallied = docs.select("text").mapInArrow(tally, "r long, h array<long>, more array<boolean>")
    recurring = docs.sparkSession.sparkContext.broadcast(bitmap(tallied.groupBy("r").applyInArrow(again, "h long"), SHINGLE_BITS))
    # One shuffle of the prefixes merges the copies, one of their entries brings equal shingles together. An entry
    # names its class by half of the key; classes that share that half would just have more candidates.
    listed = docs.select("text").mapInArrow(begin, "k1 long, k2 long, n int, rare int, at array<int>, prefix array<long>").groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("n", "rare", "at", "prefix")))
    entries = staged(listed.select("k1", "n", "rare", F.explode(F.arrays_zip("at", "prefix")).alias("e")).select("k1", "n", F.col("e.at").alias("pos"), F.col("e.prefix").alias("t"), (F.col("e.at") >= F.col("rare")).alias("hot")), "entries")
    # Shingles known to be common are not counted; the others are, added up by task before they meet.
    counted = entries.filter("NOT hot").groupBy("t").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shares = entries.filter("NOT hot").join(counted, "t").unionByName(entries.filter("hot").withColumn("m", F.lit(limit + 1).cast("long")))
    met = staged(shares.join(classes.select("k1", "c"), "k1").select("t", "c", "n", "pos", "m"), "met")
    small, large = met.filter(F.col("m") <= limit), met.filter(F.col("m") > limit)
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.c") < F.col("b.c")) & _may_match("a", "b")).select(F.col("a.c").alias("a"), F.col("b.c").alias("b"))
    lows = checkpointed(large.groupBy("t").agg(F.min(F.struct("n", "c", "pos")).alias("low")))
    stars = large.join(lows, "t").filter("c <> low.c").select(F.struct("c", "n", "pos").alias("a"), F.col("low").alias("b")).filter(_may_match("a", "b")).select(
        F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b"))
    known = _verified(_alike(classes, limit), docs, classes, repeated)
    links = _linked(pairs.unionByName(stars), docs, classes, repeated, known)
    parts = checkpointed(connected_components(links, "a", "b"))
    # Entries of large buckets whose components still differ. Of each bucket, all that are not in its largest component
    # meet all others: members of one large component are never compared, and pairs are turned down where they meet.
    placed = large.join(parts.withColumnRenamed("id", "c"), "c", "left").withColumn("part", F.coalesce("component", "c"))
    placed = checkpointed(placed.join(classes.select("c", "counts"), "c").select("t", "c", "n", "pos", "part", _small(F.col("counts")).alias("counts")))
    sizes = placed.groupBy("t", "part").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("t").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = checkpointed(placed.join(largest, "t").select("t", "c", "n", "pos", "part", "counts", (F.col("part") != F.col("largest")).alias("minor")))
    # The larger set of a pair asks the blocks of sizes that can match it, so that entries which only share a common
    # shingle do not meet; where many do, their block is split as any skewed join is.
    asking = mixed.withColumn("block", F.explode(_partners(F.col("n"), F.col("pos")))).alias("b")
    asked = mixed.withColumn("block", _block(F.col("n"))).alias("a")
    ordered = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.c") < F.col("b.c"))
    differ = (F.col("a.part") != F.col("b.part")) & (F.col("a.minor") | F.col("b.minor"))
    late = asking.join(asked, (F.col("a.t") == F.col("b.t")) & (F.col("a.block") == F.col("b.block")) & ordered & differ & _may_match("a", "b") & F.coalesce(similar_enough(_most("a.counts", "b.counts"), F.col("a.n"), F.col("b.n")), F.lit(True)))
    late = checkpointed(late.select(F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b")))
    if not late.isEmpty():
        links = _linked(late, docs, classes, repeated, links)
        parts = checkpointed(connected_components(links, "a", "b"))
    rooted = classes.join(parts.withColumnRenamed("id", "c"), "c", "left").select("k1", "k2", "least", F.coalesce("component", "c").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("k1", "k2", "root", "component_id")
    return marked.select("doc_id", "t1", "t2", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "t1", "t2", "root", "component_id")
