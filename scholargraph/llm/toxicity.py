"""Toxicity: noisy-channel decoding of disguised words, then a linear score of the restored text."""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.bitmaps import TEXT_BITS, may_be_in
from scholargraph.llm.labelled import fold
from scholargraph.llm.worker import kept
from scholargraph.operators.lineage import checkpointed, staged

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Features that the scorer may keep; steps of its fit, their rate, and the decay of weights.
VOCABULARY = 20_000
STEPS, RATE, DECAY = 60, 0.5, 1e-4

# What a character may stand for, besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "*": "aeiou",
}
SEPARATORS = ".-_*~'/,"
#: Trigrams that the broadcast model holds, at most: the most frequent; others are costed from pairs and single letters.
MODEL_ROWS = 1 << 18
#: Codes of the model that are no letters: the end of a word, and whatever in it is no letter.
BOUNDARY, OTHER = 0, 1
EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "…«»“”‘’"
DISGUISED = re.compile(r"[0-9@$!|+€£(¡*.\-_~'/,]|(.)\1\1")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
#: A number is its own reading, with at most one currency or per-cent sign at each end.
NUMBER = re.compile(r"[$€£+\-(]?\d[\d.,:/\-]*[%$€£)]?[.,;:!?)\"']*")

# Channel costs in nats.
COST_SWAP, COST_KEEP_SIGN, COST_DROP, COST_KEEP_SEPARATOR, COST_SHORTEN, COST_KEEP_RUN, COST_BREAK = 1.0, 7.0, 0.7, 6.0, 0.5, 4.0, 1.5


def _codes() -> np.ndarray:
    """The model's code of every character: letters of all scripts stand for themselves."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    table = np.where(letters, np.arange(0x110000), OTHER)
    table[ord("^")] = BOUNDARY
    return table


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(t, n): counts of the character trigrams over the words of all documents, each word between two boundaries.

    A trigram is its three codes, 21 bits each. The table has a row for each trigram that occurs, in whatever script,
    so it grows with what the corpus holds. Every partition reports the trigrams it has, and Spark adds them up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept("codes", "", _codes)
        for b in batches:
            texts = b.column("text")
            for a in range(0, len(b), 4096):
                words: Counter = Counter()
                for t in texts.slice(a, 4096).to_pylist():
                    if t:
                        words.update(t.lower().split())
                known = [(x.replace("^", "~"), n) for w, n in words.items() if (x := w.strip(EDGES))]
                if not known:
                    continue
                codes = table[np.frombuffer("".join([f"^^{x}^" for x, _ in known]).encode("utf-32-le", "replace"), np.uint32)]
                weight = np.repeat(np.fromiter((n for _, n in known), np.int64, len(known)), [len(x) + 3 for x, _ in known])[2:]
                tri = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
                inside = (codes[1:-1] != BOUNDARY) | (codes[2:] != BOUNDARY)  # not over the gap between two words
                inside &= (codes[:-2] == BOUNDARY) | (codes[1:-1] != BOUNDARY)
                order = np.argsort(tri[inside], kind="stable")
                tri, weight = tri[inside][order], weight[inside][order]
                first = np.flatnonzero(np.append(True, tri[1:] != tri[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(tri[first]), pa.array(np.add.reduceat(weight, first))], names=["t", "n"])

    return docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Interpolated trigram costs (nats) from the counts n of trigrams t."""

    def __init__(self, t: np.ndarray, n: np.ndarray):
        self.three = dict(zip(t.tolist(), n.tolist()))
        self.heads, self.pairs, self.ones, self.singles = Counter(), Counter(), Counter(), Counter()
        for k, v in self.three.items():
            self.heads[k >> 21] += v
            self.pairs[k & ((1 << 42) - 1)] += v
            self.ones[(k >> 21) & 0x1FFFFF] += v
            self.singles[k & 0x1FFFFF] += v
        self.total, self.known = sum(self.singles.values()), {}

    def cost(self, key: int) -> float:
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            p = (self.singles[key & 0x1FFFFF] + 1) / (self.total + len(self.singles) + 1)
            p = (self.pairs[key & ((1 << 42) - 1)] + 20 * p) / (self.ones[(key >> 21) & 0x1FFFFF] + 20)
            p = (self.three.get(key, 0) + 10 * p) / (self.heads[key >> 21] + 10)
            got = self.known[key] = -math.log(p)
        return got


def code_of(c: str) -> int:
    return BOUNDARY if c == "^" else ord(c) if c.isalpha() else OTHER


class Decoder:
    """Viterbi over the lattice of readings of one token; states are the last two letters."""

    def __init__(self, model: CharacterModel):
        self.cost = model.cost

    def lattice(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """For each step, (text to append, channel cost) choices. Runs of one character are a single step, from three
        on where each of them may stand for a letter."""
        i = 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            if c.isspace():
                yield [("", 0.0), ("^", COST_BREAK)]
            elif c in STANDS_FOR:
                readings = [(r, COST_SWAP + (0.6 if len(STANDS_FOR[c]) > 1 else 0.0)) for r in STANDS_FOR[c]]
                readings.append((c, COST_KEEP_SIGN))
                if c in SEPARATORS:
                    readings.append(("", COST_DROP))
                for _ in range(1 if j - i > 2 else j - i):
                    yield readings
            elif c in SEPARATORS:
                yield [("", COST_DROP), ("^", COST_BREAK), (c, COST_KEEP_SEPARATOR)]
            elif j - i >= 3:
                yield [(c, COST_SHORTEN), (c * 2, COST_SHORTEN + 0.5), (c * (j - i), COST_KEEP_RUN)]
            else:
                yield [(c * (j - i), 0.0)]
            i = j

    def decode(self, token: str) -> str:
        """The cheapest reading; words that the reading breaks apart are joined by one space.

        Tokens of any length are decoded whole: what all surviving readings begin with is put aside as they go on.
        """
        cost, done = self.cost, []
        best: dict[tuple[int, int], tuple[float, str]] = {(BOUNDARY, BOUNDARY): (0.0, "")}
        for n, choices in enumerate(self.lattice(token.replace("^", "~")), 1):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (so_far, text) in best.items():
                for add, channel in choices:
                    x, y, z = a, b, so_far + channel
                    for c in add:
                        k = code_of(c)
                        z += cost(x << 42 | y << 21 | k)
                        x, y = (BOUNDARY, BOUNDARY) if k == BOUNDARY else (y, k)
                    old = after.get((x, y))
                    if old is None or z < old[0]:
                        after[(x, y)] = (z, text + add)
            best = after
            if n % 64 == 0 and (shared := os.path.commonprefix([text for _, text in best.values()])):
                done.append(shared)
                best = {k: (z, text[len(shared) :]) for k, (z, text) in best.items()}
        ends = ((z + cost(a << 42 | b << 21 | BOUNDARY), text) for (a, b), (z, text) in best.items())
        return " ".join("".join([*done, min(ends)[1]]).replace("^", " ").split())


class Reader:
    """Restores texts to their words. Short tokens and runs are remembered, a bounded number at a time."""

    def __init__(self, model: CharacterModel):
        self.decoder, self.seen = Decoder(model), {}

    def token(self, w: str) -> tuple[str, ...]:
        """The words of one lower-case token. A lattice with a single path is its own reading, and so is a number."""
        got = self.seen.get(w)
        if got is None:
            core = w.strip(EDGES)
            clear = not DISGUISED.search(core)
            if core and clear and not (w[0] in STANDS_FOR or w[-1] in STANDS_FOR) or NUMBER.fullmatch(w):
                got = (core,) if core else ()
            else:
                # A sign at an edge may be a letter or just punctuation: both readings are kept.
                whole = self.decoder.decode(w.strip(".,;:?\"'"))
                got = tuple(dict.fromkeys([*([core] if core and clear else []), *whole.split()]))
            self._remember(w, got)
        return got

    def spaced(self, run: str) -> tuple[str, ...]:
        """The words of a run of single characters, decoded as one lattice."""
        got = self.seen.get(run)
        if got is None:
            got = () if run.replace(" ", "").replace("\t", "").isdigit() else tuple(self.decoder.decode(run).split())
            self._remember(run, got)
        return got

    def _remember(self, w: str, got: tuple[str, ...]) -> None:
        if len(w) <= 200:
            if len(self.seen) > 400_000:
                self.seen.clear()
            self.seen[w] = got

    def words(self, text: str | None) -> Counter:
        """Counts of the restored words of a whole text; null has none."""
        out: Counter = Counter()
        if not text:
            return out
        low = text.lower()
        tokens = low.split()
        seen = self.seen.get
        for w, n in Counter(tokens).items():
            got = seen(w)
            for r in self.token(w) if got is None else got:
                out[r] = out.get(r, 0) + n
        if sum(len(w) == 1 for w in tokens) > 2:
            for m in SPACED.finditer(low):
                for r in self.spaced(m.group()):
                    out[r] += 1
        return out


def names_of(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    out = ["w" + word]
    for k in (3, 4, 5, 6, 7, 8):
        if len(word) >= k:
            out.append(f"p{word[:k]}")
    return out


class Scorer:
    """Logistic regression over restored words: weights by feature, of log(1 + count)."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def score(self, words: Counter, cache: dict) -> float:
        counts: dict[str, int] = {}
        for w, n in words.items():
            got = cache.get(w)
            if got is None:
                if len(cache) > 300_000:
                    cache.clear()
                got = cache[w] = tuple(f for f in names_of(w) if f in self.weights)
            for f in got:
                counts[f] = counts.get(f, 0) + n
        z = self.bias + sum(self.weights[f] * math.log1p(n) for f, n in counts.items())
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def select_features(counts: DataFrame, pos: int, neg: int) -> list[str]:
    """The features of counts(feature, a toxic rows, b others) that are significantly (log-likelihood ratio of 15 or
    more, p < 1e-4) and three times more frequent in toxic texts: at most VOCABULARY, the most telling first."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    p = (a + b) / F.lit(float(pos + neg))
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    ratio = 2 * (part(a, pos * p) + part(pos - a, pos * (1 - p)) + part(b, neg * p) + part(neg - b, neg * (1 - p)))
    found = counts.filter(a / pos > 3 * b / neg).withColumn("gain", F.round(ratio, 6)).filter("gain >= 15")
    return [r["feature"] for r in found.orderBy(F.desc("gain"), "feature").limit(VOCABULARY).select("feature").collect()]


def _gradient(rows: DataFrame, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient of the mean logistic loss of rows(label, ids, n) at weights of `size` features and a bias. Each partition
    adds up its own; the driver gets one vector a partition, whatever the number of rows."""
    sc, total = rows.sparkSession.sparkContext, rows.count()

    def at(x: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(x)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, grad = sent.value, np.zeros(size + 1)
            for b in batches:
                y = b.column("label").to_numpy().astype(np.float64)
                of = np.repeat(np.arange(len(y)), pc.list_value_length(b.column("ids")).to_numpy())
                ids, vals = b.column("ids").flatten().to_numpy(), np.log1p(b.column("n").flatten().to_numpy().astype(np.float64))
                z = w[size] + np.bincount(of, w[ids] * vals, len(y))
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                grad[:size] += np.bincount(ids, err[of] * vals, size)
                grad[size] += err.sum()
            yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()], pa.binary())], names=["grad"])

        parts = sorted(bytes(r["grad"]) for r in rows.mapInArrow(part, "grad binary").collect())
        sent.destroy()
        grad = sum((np.frombuffer(p) for p in parts), np.zeros(size + 1)) / total
        grad[:size] += DECAY * x[:size]
        return grad

    return at


def train(rows: DataFrame, features: list[str], pos: int, neg: int) -> Scorer:
    """Evidence only adds up: weights of zero or more on all rows(label, ids, n), `pos` of them toxic and `neg` not, by Adagrad
    on the whole gradient."""
    size = len(features)
    w, g, gradient = np.append(np.zeros(size), math.log(pos / neg)), np.full(size + 1, 1e-12), _gradient(rows, size)
    for _ in range(STEPS if size else 0):
        d = gradient(w)
        g += d * d
        w -= RATE * d / np.sqrt(g)
        w[:size] = np.maximum(w[:size], 0)
    return Scorer(float(w[size]), {f: float(w[i]) for i, f in enumerate(features) if w[i] > 0})


def _features(words: Counter, names: dict) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        got = names.get(w)
        if got is None:
            if len(names) > 300_000:
                names.clear()
            got = names[w] = names_of(w)
        for f in got:
            out[f] += n
    return out


def _version(costs: tuple[np.ndarray, np.ndarray]) -> str:
    return hashlib.sha256(costs[0].tobytes() + costs[1].tobytes()).hexdigest()


def _reader(shared, version: str) -> Reader:
    return kept("reader", version, lambda: Reader(CharacterModel(*shared.value)))


def _words(b: pa.RecordBatch) -> Iterator[Counter]:
    for words, n in zip(b.column("words").to_pylist(), b.column("n").to_pylist()):
        yield Counter(dict(zip(words.split("\n"), np.frombuffer(n, np.int32).tolist()))) if words else Counter()


def restored(docs: DataFrame) -> DataFrame:
    """doc_id, words, n: the restored words of each document, once each (lines), and their numbers (int32), as a stored table.
    The character model is that of all documents; texts are decoded once, for the fit and for the scores."""
    top = count_trigrams(docs).orderBy(F.desc("n"), "t").limit(MODEL_ROWS).toArrow()
    costs = (top.column("t").to_numpy(), top.column("n").to_numpy())
    shared, version = docs.sparkSession.sparkContext.broadcast(costs), _version(costs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared, version)
        for b in batches:
            words, n = [], []
            for a in range(0, len(b), 512):
                for t in b.column("text").slice(a, 512).to_pylist():
                    found = reader.words(t)
                    words.append("\n".join(found))
                    n.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.string()), pa.array(n, pa.binary())], names=["doc_id", "words", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, words string, n binary"), "restored")


def fit(texts: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer fitted on all labelled rows of texts (`restored`) outside the held-out fold; several labels of one document
    count as its largest.

    Features are counted by Spark; the driver gets the chosen ones and, for each step, one vector a partition.
    """
    sc = texts.sparkSession.sparkContext
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    own, h = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")), F.xxhash64(F.col("doc_id").cast("string"))
    asked = texts.filter(may_be_in(own.select(h.alias("h")), h, TEXT_BITS))  # the words of the others are not shuffled
    chosen = staged(asked.join(own, "doc_id").select("label", "words", "n"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            both = [0, 0]
            for y, words in zip(b.column("label").to_pylist(), _words(b)):
                y = int(y > 0)
                both[y] += 1
                seen[y].update(_features(words, names).keys())
            every = sorted({*seen[0], *seen[1]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(["", *every], pa.string()), pa.array([both[1], *(seen[1][f] for f in every)], pa.int64()), pa.array([both[0], *(seen[0][f] for f in every)], pa.int64())],
                names=["feature", "a", "b"],
            )

    counts = checkpointed(chosen.mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a > 0 or feature = ''"))
    total = counts.filter("feature = ''").first()  # the rows themselves
    if total is None or not total["a"] or not total["b"]:
        return Scorer(0.0, {})
    features = select_features(counts.filter("feature <> ''"), total["a"], total["b"])
    numbers = sc.broadcast({f: i for i, f in enumerate(features)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at = {}, numbers.value
        for b in batches:
            made = [sorted((at[f], n) for f, n in _features(words, names).items() if f in at) for words in _words(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("label").cast(pa.int32()), pa.array([[i for i, _ in m] for m in made], pa.list_(pa.int32())), pa.array([[n for _, n in m] for m in made], pa.list_(pa.int32()))],
                names=["label", "ids", "n"],
            )

    encoded = chosen.mapInArrow(encode, "label int, ids array<int>, n array<int>").withColumn("label", (F.col("label") > 0).cast("int"))
    return train(staged(encoded, "encoded"), features, total["a"], total["b"])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5).

    Every token whose lattice has more than one path (signs that stand for letters, separators inside, letters
    repeated three times or more, letters set apart) is decoded whole under the character model, whatever its length;
    the restored words of the whole text are scored. Numbers are their own readings. Null and empty texts have no
    words: the bias alone scores them. Repeated rows, and ties, get the same score each. An empty table gives no rows.
    Only doc_id and text are read, whatever else the table holds.
    """
    texts = restored(docs)
    scorer = fit(texts, labels)
    weights, own_version = docs.sparkSession.sparkContext.broadcast((scorer.bias, scorer.weights)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = kept("scorer", own_version, lambda: (Scorer(*weights.value), {}))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.score(words, cache) for words in _words(b)], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
