"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network with calibrated probabilities.

Words here are maximal runs of one kind of bytes, letters and digits (and all beyond ASCII) or punctuation. Each is hashed to one of
BUCKETS; each bucket has a fixed sparse random index vector. A word's vector is the sum of the index vectors of its neighbours over the whole
corpus, one pass with sums by bucket: its size is fixed by BUCKETS and DIMS, whatever the input. A document is pooled to the mean and
the deviation of its words' unit vectors, how far neighbours agree, and the logarithm of its number of words; the features
are written once. The network learns from at most SAMPLE labelled rows, chosen by hash, a fifth of which set the temperature.

Defined cases: null and empty texts pool to zero and are scored like any other; rows without a label are not learned from; repeated
labels count each; without any labels all score 0.5; repeated documents are scored each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batches, materialize, table
from .folds import bounded, held_out
from .suffix_dedup import Names

BUCKETS = 1 << 13
DIMS = 32
ENTRIES = 4
SAMPLE = 20_000
CHUNK = 1_000_000
KINDS = np.array([0 if c <= 32 else 1 if chr(c).isalnum() or c >= 128 else 2 for c in range(256)], np.uint8)
FEATURES = 2 * DIMS + 4


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's entries."""
    rng = np.random.default_rng(11)
    return np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :ENTRIES].astype(np.int64), rng.choice([-1, 1], (BUCKETS, ENTRIES)).astype(np.int8)


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word of a buffer, and its bucket."""
    kind = KINDS[buf]
    cut = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(buf) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(buf)].astype(np.int64)
    real = kind[cut] > 0 if len(buf) else np.zeros(0, bool)
    start, end = cut[real], end[real]
    return start, (Names(buf).of(start, end) >> np.uint64(51)).astype(np.int64)


def _pieces(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of words, their document's number, and whether the next word is of the same document; long texts come in several pieces, cut between words."""
    held, ids, total = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            cut = len(t) if len(t) - at <= size else max(t.rfind(b" ", at + 1, at + size), t.rfind(b"\n", at + 1, at + size))
            cut = cut if cut > at else min(len(t), at + size)
            held.append(t[at:cut] + b"\n")
            ids.append(i)
            total += cut - at
            at = cut
            if total >= size:
                yield _piece(held, ids)
                held, ids, total = [], [], 0
            if not len(t):
                break
    if held:
        yield _piece(held, ids)


def _piece(held: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, bucket = words(np.frombuffer(b"".join(held), np.uint8))
    doc = np.array(ids)[np.searchsorted(np.cumsum([len(h) for h in held]), start, "right")]
    return bucket, doc, doc[:-1] == doc[1:]


def _texts(b: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in b.column(column).cast(pa.binary()).to_pylist()]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    sums = np.zeros(BUCKETS * DIMS)
    seen = 0
    for b in batches:
        for bucket, _, same in _pieces(_texts(b, 0)):
            left, right = bucket[:-1][same], bucket[1:][same]
            seen += len(bucket)
            for k in range(ENTRIES):
                sums += np.bincount(left * DIMS + place[right, k], sign[right, k], BUCKETS * DIMS)
                sums += np.bincount(right * DIMS + place[left, k], sign[left, k], BUCKETS * DIMS)
    if seen:
        m = sums.astype(np.int64).reshape(BUCKETS, DIMS)
        used = np.flatnonzero(m.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(m[used, d]) for d in range(DIMS)]], names=["bucket", *[f"v{d}" for d in range(DIMS)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from all documents."""
    arrow_batches(docs.sparkSession)
    names = [f"v{d}" for d in range(DIMS)]
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_contexts, "bucket long, " + ", ".join(f"{n} long" for n in names))
    t = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    v = np.zeros((BUCKETS, DIMS), np.float32)
    if t.num_rows:
        m = np.column_stack([t[n].to_numpy() for n in names]).astype(np.float64)
        v[t["bucket"].to_numpy()] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return v


def _pooled(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, 1)
            n = len(texts)
            count, mean, square = np.zeros(n), np.zeros((n, DIMS)), np.zeros((n, DIMS))
            pairs, agree, equal = np.zeros(n), np.zeros(n), np.zeros(n)
            for bucket, doc, same in _pieces(texts):
                for a in range(0, len(bucket), 1 << 16):
                    w = vectors[bucket[a : a + (1 << 16)]]
                    d = doc[a : a + (1 << 16)]
                    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    mean[d[first]] += np.add.reduceat(w, first, axis=0)
                    square[d[first]] += np.add.reduceat(w * w, first, axis=0)
                    s = same[a : a + len(d) - 1]
                    count += np.bincount(d, minlength=n)
                    pairs += np.bincount(d[:-1][s], minlength=n)
                    agree += np.bincount(d[:-1][s], np.einsum("ij,ij->i", w[:-1], w[1:])[s], n)
                    c = bucket[a : a + len(d)]
                    equal += np.bincount(d[:-1][s], (c[1:] == c[:-1])[s], n)
            c, p = np.maximum(count, 1)[:, None], np.maximum(pairs, 1)
            mean /= c
            spread = np.sqrt(np.maximum(square / c - mean * mean, 0))
            f = np.column_stack([mean, spread, agree / p, equal / p, np.linalg.norm(mean, axis=1), np.log1p(count)]).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in f], pa.binary())], names=["doc_id", "features"])

    return run


def pool(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, features (little-endian float32)."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pooled(vectors), "doc_id long, features binary")


class Network:
    """Two layers; score() gives calibrated probabilities of label 1."""

    def __init__(self, hidden: int = 32, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.standard_normal((FEATURES, hidden)) / np.sqrt(FEATURES), np.zeros(hidden)
        self.w2, self.b2 = rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)
        self.mean, self.scale, self.temperature = np.zeros(FEATURES), np.ones(FEATURES), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.003, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        later, now = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[now].mean(axis=0), x[now].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        params = [self.w1, self.b1, self.w2, self.b2]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(now), max(1, len(now) // batch)):
                h = z[idx] @ self.w1 + self.b1
                a = np.maximum(h, 0)
                g = (1 / (1 + np.exp(-np.clip(a @ self.w2 + self.b2, -40, 40))) - y[idx]) / len(idx)
                back = np.outer(g, self.w2) * (h > 0)
                step += 1
                for p, d, m, v in zip(params, (z[idx].T @ back + 1e-4 * self.w1, back.sum(axis=0), a.T @ g, g.sum(keepdims=True)), first, second):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(later):
            out = self.logits(x[later])
            loss = {t: np.logaddexp(0, np.where(y[later] == 1, -out, out) / t).mean() for t in np.geomspace(0.3, 10, 60)}
            self.temperature = float(min(loss, key=loss.get))


def train(pooled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Of features and labels (doc_id, quality); None without any."""
    rows = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y"), F.lit(0).alias("all"))
    n = rows.count()
    if not n:
        return None
    picked = bounded(rows, "all", {0: n}, sample, F.col("_id"))
    joined = pooled.join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", "features", "y")
    # a doc_id may repeat any number of times: of the joined rows too, no more than the sample, by a hash of the row
    t = joined.orderBy(F.xxhash64("doc_id", "features", "y"), "doc_id", "y", "features").limit(sample).toArrow()
    if not t.num_rows:
        return None
    t = t.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("features", "ascending")])
    x = np.frombuffer(b"".join(t["features"].to_pylist()), "<f4").reshape(-1, FEATURES).astype(np.float64)
    model = Network()
    model.fit(x, t["y"].to_numpy().astype(np.float64))
    return model


def _scores(model: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f4").reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], names=["doc_id", "score"])

    return run


def score(pooled: DataFrame, model: Network | None) -> DataFrame:
    return pooled.mapInArrow(_scores(model), "doc_id long, score double")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pooled = materialize(pool(docs, word_vectors(docs)), "quality-features")
    model = train(pooled, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    rows = score(pooled, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
