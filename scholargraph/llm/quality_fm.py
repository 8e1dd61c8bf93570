"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.labelled import fold, training_rows
from scholargraph.llm.worker import let_go, release

WORD_BUCKETS = 1 << 15
BINS = 10
FACTORS = 8
#: Labelled rows that the machine is fitted on, at most.
TRAIN_ROWS = 6000
STATS = 16
DIMENSION = WORD_BUCKETS + (STATS + 2) * BINS
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def _bin(ratio: float) -> int:
    """0 for none, then by powers of two up to 1."""
    return 0 if ratio <= 0 else max(1, BINS - 1 - int(-math.log2(min(ratio, 1.0)) + 1e-9))


def _magnitude(n: float) -> int:
    return min(BINS - 1, int(math.log2(n + 1) / 2))


def features(text: str | None, n_chars: int | None, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text. Null counts as empty; the whole text is read, whatever its length."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    upper = int(by[65:91].sum())
    letters = max(1, upper + int(by[97:123].sum()))
    counts = Counter(text.lower().split())
    lines = [x for x in text.split("\n") if x]
    symbols = int(by[[35, 37, 38, 36, 42, 124, 60, 62]].sum())
    top = max(counts.values(), default=0)
    stats = [
        _magnitude(len(words)), _bin(len(counts) / n), _bin(top / n if len(words) > 9 else 0), _bin(upper / letters),
        _bin(int(by[48:58].sum()) / size), _bin(symbols / size), _bin(int(by[33]) / size), _bin(int(by[124]) / size),
        _bin((int(by[46]) + int(by[44])) / n), _bin(len(lines) / n), _bin(1 - len(set(lines)) / max(1, len(lines))),
        _bin(int(by[128:].sum()) / size), _magnitude(4 * size / n), _bin((int(by[91]) + int(by[123]) + int(by[64])) / size),
        _bin(int(by[46]) / n), _bin(int(by[[36, 37, 38, 35]].sum()) / n),
        _magnitude(16 if n_chars is None else n_chars), 0 if n_chars is None or n_chars == len(text) else 1,
    ]
    ids = np.empty(len(counts), np.int32)
    for i, w in enumerate(counts):
        h = cache.get(w)
        if h is None:
            if len(cache) > 400_000:
                cache.clear()
            h = cache[w] = zlib.crc32(w.encode("utf-8", "replace")) & (WORD_BUCKETS - 1)
        ids[i] = h
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    values /= max(1e-6, float(np.sqrt((values * values).sum())))
    at = WORD_BUCKETS + np.arange(len(stats), dtype=np.int32) * BINS + np.array(stats, np.int32)
    return np.concatenate([ids, at]), np.concatenate([values, np.full(len(stats), 0.5, np.float32)])


class Machine:
    """w0 + <w, x> + half the sum over factors of (sum v x)^2 - sum (v x)^2."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(DIMENSION, np.float32)
        self.v = rng.normal(0, 0.02, (DIMENSION, FACTORS)).astype(np.float32)

    @classmethod
    def of(cls, bias: float, w: np.ndarray, v: np.ndarray) -> Machine:
        """A machine of known weights."""
        m = cls.__new__(cls)
        m.bias, m.w, m.v = bias, w, v
        return m

    def scores(self, texts: list[str | None], lengths: list[int | None], cache: dict) -> np.ndarray:
        """The scores (0 to 1) of texts with their lengths, 256 at a time."""
        out = [np.empty(0, np.float64)]
        for a in range(0, len(texts), 256):
            made = [features(t, n, cache) for t, n in zip(texts[a : a + 256], lengths[a : a + 256])]
            starts = np.concatenate([[0], np.cumsum([len(x[0]) for x in made])[:-1]])
            z = self.margins(np.concatenate([x[0] for x in made]), np.concatenate([x[1] for x in made]), starts)
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        return np.concatenate(out)

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One margin a row; rows are never empty, since every text has its statistics."""
        linear = np.add.reduceat(self.w[ids] * values, starts)
        xv = self.v[ids] * values[:, None]
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat(xv * xv, starts, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 128, rate: float = 0.05, decay: float = 1e-5) -> Machine:
        """Logistic loss, Adagrad, rows in a fixed shuffled order; no rows leave an untrained machine (score 0.5)."""
        if not rows:
            return self
        rng = np.random.default_rng(11)
        mean = min(max(sum(r[0] for r in rows) / len(rows), 0.01), 0.99)
        self.bias = math.log(mean / (1 - mean))
        gw, gv = np.full(DIMENSION, 1e-6, np.float32), np.full((DIMENSION, FACTORS), 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                part = [rows[i] for i in order[a : a + batch]]
                ids, values = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
                sizes = np.array([len(r[1]) for r in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                p = 1 / (1 + np.exp(-np.clip(self.margins(ids, values, starts), -30, 30)))
                err = ((p - np.array([r[0] for r in part])) / len(part)).astype(np.float32)
                each = np.repeat(err, sizes) * values
                sums = np.repeat(np.add.reduceat(self.v[ids] * values[:, None], starts, axis=0), sizes, axis=0)
                dv = each[:, None] * (sums - self.v[ids] * values[:, None])
                by = np.argsort(ids, kind="stable")
                u, first = np.unique(ids[by], return_index=True)
                sw = np.add.reduceat(each[by], first) + decay * self.w[u]
                sv = np.add.reduceat(dv[by], first, axis=0) + decay * self.v[u]
                gw[u] += sw * sw
                gv[u] += sv * sv
                self.w[u] -= rate * sw / np.sqrt(gw[u])
                self.v[u] -= rate * sv / np.sqrt(gv[u])
                self.bias -= rate * float(err.sum())
        return self


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most `rows` labelled documents; features are made on the executors."""
    docs = _with_length(docs)
    chosen = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, rows, ["text", "n_chars"])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            made = [features(t, n, cache) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("label").cast(pa.int32()), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))],
                names=["label", "ids", "vals"],
            )

    made = trained_rows(chosen.mapInArrow(featurise, "label int, ids array<int>, vals array<float>").toArrow())
    machine = Machine().fit(made)
    made = None
    release()  # the driver has other steps to come
    return machine


def trained_rows(got: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, ids, values) of each row in a fixed order. The arrays are cut from the table's own buffers: as Python's
    numbers they would take ten times as much of the driver's memory."""
    made = []
    for b in got.to_batches():
        ids, values = b.column("ids"), b.column("vals")
        edges, start = ids.offsets.to_numpy(), ids.offsets[0].as_py() if len(b) else 0
        ids, values = ids.flatten().to_numpy(), values.flatten().to_numpy()
        made += [(y, ids[x - start : z - start], values[x - start : z - start]) for y, x, z in zip(b.column("label").to_pylist(), edges[:-1].tolist(), edges[1:].tolist())]
    made.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return made


def _with_length(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select("doc_id", "text", n.alias("n_chars"))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score in 0 to 1: one map over the documents, nothing shuffled.

    Null and empty texts are scored from their (empty) statistics. Repeated rows get the same score each. An empty
    table gives no rows. Only doc_id, text and n_chars are read, whatever else the table holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(__name__)
        m, cache = Machine.of(*shared.value), {}
        for b in batches:
            out = m.scores(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])
        release()

    docs = _with_length(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.7) of every row; see score() for nulls, empty texts,
    repeated rows, empty tables and other columns. Equal rows get equal scores. A document without labels is scored
    like any other; without any label at all every score is 0.5."""
    return score(docs, fit(docs, labels, rows)).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs`, with all their columns and whatever their names, that the machine does not reject: those
    whose score is 0.7 or more. Null and empty texts are judged by their statistics, rows by themselves; an empty
    table gives no rows."""
    machine = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(__name__)
        m, cache = Machine.of(*shared.value), {}
        for b in batches:
            texts = b.column("text").to_pylist()
            lengths = b.column("n_chars").to_pylist() if counted else [None if t is None else len(t) for t in texts]
            yield b.filter(pa.array(m.scores(texts, lengths, cache) >= THRESHOLD))
        release()

    return docs.mapInArrow(run, docs.schema)
