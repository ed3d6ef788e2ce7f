"""Language identification by a convolutional network over bytes.

Filters of widths 2, 3 and 4 slide over fixed-length windows of a text's bytes; each filter's maximum over the window, cut at zero, goes
to a softmax over the languages. It is trained in numpy, with Adam, on windows of labelled texts. As inputs are bytes, a
filter is a table of weights by offset and byte; for inference, tables of byte pairs are added up, so a width costs two lookups at most.

Every window of a text is read: windows of `LENGTH` bytes side by side, the last one moved back to end with the text; a text below a
window's length is padded with zero bytes. A text's probabilities are the mean over its windows.

The training sample is bounded: about PER_LANGUAGE different texts a language and WINDOWS windows of each, chosen by hash of the text, twice as many in all
at most. It is the only thing that reaches the driver; the number of languages is taken to be small.

Defined cases: null text, or text without a letter, is `und` with score 0; rows without a language are not learned from; without any
labelled text all are `und`; repeated rows are predicted each; an empty table gives an empty result; other columns pass through,
but columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batches, table
from .folds import bounded, held_out

LENGTH = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_LANGUAGE = 600
WINDOWS = 3
LETTER = re.compile(r"[^\W\d_]")


def windows(text: bytes, length: int = LENGTH) -> np.ndarray:
    """All windows of a text, one a row."""
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    if n <= length:
        out = np.zeros((1, length), np.uint8)
        out[0, :n] = b
        return out
    full = n // length
    rows = b[: full * length].reshape(full, length)
    return rows if full * length == n else np.vstack([rows, b[n - length :]])


class ByteCNN:
    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.conv = [(rng.standard_normal((w, 256, FILTERS)) * 0.3 / np.sqrt(w)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = (rng.standard_normal((len(WIDTHS) * FILTERS, len(languages))) * 0.2).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _pairs(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """By width: the table of the first two bytes, and that of the rest, a byte or a pair."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return [(pair(c[0], c[1]), None if len(c) == 2 else c[2] if len(c) == 3 else pair(c[2], c[3])) for c in self.conv]

    def features(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Maxima of all filters over each window (rows of x)."""
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for k, (w, (head, tail)) in enumerate(zip(WIDTHS, tables)):
            n = x.shape[1] - w + 1
            h = head.take(two[:, :n], axis=0)
            if tail is not None:
                h += tail.take(two[:, 2 : 2 + n] if w == 4 else x[:, 2:], axis=0)
            out.append(np.maximum(h.max(axis=1) + self.bias[k], 0))
        return np.hstack(out)

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        parts = [self.features(x[i : i + 128], tables) for i in range(0, len(x), 128)]
        return _softmax(np.vstack(parts) @ self.out + self.out_bias)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                b, t = x[idx], y[idx]
                best, feats = [], []
                for k, w in enumerate(WIDTHS):
                    n = b.shape[1] - w + 1
                    h = sum(self.conv[k][j].take(b[:, j : j + n], axis=0) for j in range(w))
                    at = h.argmax(axis=1)
                    best.append(at)
                    feats.append(np.take_along_axis(h, at[:, None, :], 1)[:, 0] + self.bias[k])
                pooled = np.hstack(feats)
                active = np.maximum(pooled, 0)
                g = _softmax(active @ self.out + self.out_bias)
                g[np.arange(len(t)), t] -= 1
                g /= len(t)
                back = (g @ self.out.T) * (pooled > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    own, d = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(self.conv[k])
                    for j in range(w):
                        byte = np.take_along_axis(b, best[k] + j, 1)
                        np.add.at(d[j], (byte, np.arange(FILTERS)[None, :]), own)
                    grads.append(d)
                grads += [back.sum(axis=0).reshape(len(WIDTHS), FILTERS), active.T @ g, g.sum(axis=0)]
                step += 1
                for p, d, m, v in zip(params, grads, first, second):
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS windows of each text, by a hash of its bytes."""
    for b in batches:
        rows = []
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if LETTER.search(text):
                data = text.lower().encode()
                w = windows(data)
                rng = np.random.default_rng(len(data))
                rows += [(w[i].tobytes(), lang) for i in rng.permutation(len(w))[:WINDOWS]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["w", "lang"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCNN | None:
    """Of rows (doc_id, text, lang); None without any."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    arrow_batches(labelled.sparkSession)
    picked = bounded(rows, "lang", counts, per_language, F.col("text")).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    # texts are chosen by their own hash and count once, however often they repeat; the limit holds even if the shares don't
    once = picked.dropDuplicates(["text", "lang"]).mapInArrow(_sample, "w binary, lang string")
    t = once.orderBy(F.xxhash64("w", "lang"), "w", "lang").limit(2 * per_language * WINDOWS * len(counts)).toArrow()
    if not t.num_rows:
        return None
    order = sorted(range(t.num_rows), key=lambda i, w=t["w"].to_pylist(): w[i])  # the order of arrival doesn't count
    x = np.frombuffer(b"".join(t["w"].take(order).to_pylist()), np.uint8).reshape(-1, LENGTH)
    langs = t["lang"].take(order).to_pylist()
    model = ByteCNN(sorted(set(langs)))
    y = np.searchsorted(model.languages, langs)
    model.fit(x, y)
    return model


def _predict(model: ByteCNN | None, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model._pairs() if model else None
        for b in batches:
            texts = b.column(column).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if model and t is not None and LETTER.search(t)]
            a = 0
            while a < len(own):  # some megabytes of windows at a time; a long text in several
                parts, z, size = [], a, 0
                while z < len(own) and (z == a or size < 1 << 20):
                    parts.append(windows(texts[own[z]].lower().encode()))
                    size += parts[-1].size
                    z += 1
                p = model.probabilities(np.vstack(parts), tables)
                n = np.array([len(w) for w in parts])
                mean = np.add.reduceat(p, np.cumsum(n) - n, axis=0) / n[:, None]
                for i, m in zip(own[a:z], mean):
                    k = int(m.argmax())
                    lang[i], score[i] = model.languages[k], min(1.0, float(m[k]))
                a = z
            names = [x for x in b.schema.names]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names)) if i != column], pa.array(lang), pa.array(score)], names=[*[n for i, n in enumerate(names) if i != column], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """All columns but the text, with lang_pred and score."""
    arrow_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    rest = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "lang_pred string, score double"])
    return rows.mapInArrow(_predict(model, rows.columns.index("text")), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
