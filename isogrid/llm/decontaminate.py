"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are lower-cased runs of letters, digits and anything beyond ASCII. A pattern is a window of `window` consecutive words of a benchmark
item (an item of fewer words is one pattern), with one space around each word, so matches fall on whole words. Texts are
brought to the same form and searched in place:

    - the shift table, by a hash of the `block` bytes that end the current alignment, says how far no pattern can end: skip;
    - where the shift is zero, the patterns whose own first bytes end in that same block form a bucket;
    - those with the right first bytes are compared directly, byte by byte.

Many alignments advance at once, each over its own stretch of the text (numpy). Patterns are kept in blocks of a stated
number and like length, so that short ones don't shorten the shifts of long ones, and written to the shared folder: a worker holds one block
at a time, whatever the benchmark's size.

Defined cases: null text has no words and no hits; null items are named "null"; null or wordless item texts give no pattern;
repeated items count once by name; an empty benchmark hits nothing; an empty table gives an empty result; other columns are not
read by search() and pass through clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batches, scratch, table
from .warc import filesystem

WINDOW = 10
BLOCK = 6  # bytes that are hashed for a shift
TABLE_BITS = 21
STRETCH = 1024  # bytes that one alignment covers
CHUNK = 2_000_000
FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FORM).split()


def patterns_of(text: bytes, window: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def _patterns(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = sorted(patterns_of(text or b"", window))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found)), pa.array([len(x).bit_length() for x in found], pa.int32())], names=["pattern", "item", "class"])

    return run


def write_patterns(benchmark: DataFrame, window: int = WINDOW, per_block: int = 200_000) -> list[str]:
    """The blocks of patterns, as files in the shared folder."""
    path = scratch(benchmark.sparkSession, "patterns")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_patterns(window), "pattern binary, item string, class int").distinct()
    found.repartition("class").write.option("maxRecordsPerFile", per_block).partitionBy("class").parquet(path)
    system, local = filesystem(path)
    import pyarrow.fs as fs

    return sorted(f.path for f in system.get_file_info(fs.FileSelector(local, recursive=True)) if f.path.endswith(".parquet"))


class WuManber:
    """Tables for one block of patterns."""

    def __init__(self, patterns: list[bytes], items: list[str]):
        by: dict[bytes, list[str]] = {}
        for p, i in zip(patterns, items):
            by.setdefault(p, []).append(i)
        self.patterns, self.items = list(by), list(by.values())
        self.words = [p.count(b" ") - 1 for p in self.patterns]
        self.least = min(map(len, self.patterns))
        self.block = min(BLOCK, self.least)
        heads = np.frombuffer(b"".join(p[: self.least].rjust(self.least + 8, b"\0") for p in self.patterns), np.uint8).reshape(len(self.patterns), -1)
        self.shift = np.full(1 << TABLE_BITS, min(255, self.least - self.block + 1), np.uint8)
        for end in range(self.block, self.least + 1):  # nearer ends come later and win
            self.shift[self._slot(self._blocks(heads, 8 + end))] = min(255, self.least - end)
        suffix = self._blocks(heads, heads.shape[1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        lead = min(8, self.least)
        self.lead = np.uint64((1 << (8 * lead)) - 1)
        self.first = np.array([int.from_bytes(p[:lead], "little") for p in self.patterns], np.uint64)[self.order]

    def _blocks(self, heads: np.ndarray, end: int) -> np.ndarray:
        value = np.zeros(len(heads), np.uint64)
        for k in range(self.block):
            value |= heads[:, end - self.block + k].astype(np.uint64) << np.uint64(8 * k)
        return value

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return (value * MULTIPLIER) >> np.uint64(64 - TABLE_BITS)

    def search(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(position, pattern's number) of all occurrences."""
        n = len(text)
        if n < self.least:
            return
        padded = np.frombuffer(b"\0" * 8 + text + b"\0" * 8, np.uint8)
        eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 9, 8), (1, 1))
        eight = np.ndarray((n + 9,), "<u8", padded, 0, (1,)) if padded.flags.c_contiguous else eight
        up = np.uint64(64 - 8 * self.block)
        end = np.arange(0, n - self.least + 1, STRETCH) + self.least  # end of the alignment: text[end - least : end]
        stop = np.minimum(end + STRETCH, n + 1)
        hits, blocks = [], []
        while len(end):
            value = eight[end] >> up  # the bytes before end, as the padding in front is eight long
            shift = self.shift[self._slot(value)].astype(np.int64)
            zero = shift == 0
            if zero.any():
                hits.append(end[zero])
                blocks.append(value[zero])
            end = end + np.maximum(shift, 1)
            going = end < stop
            end, stop = end[going], stop[going]
        if not hits:
            return
        end, value = np.concatenate(hits), np.concatenate(blocks)
        a, b = np.searchsorted(self.suffix, value, "left"), np.searchsorted(self.suffix, value, "right")
        count = b - a
        for i in range(0, len(end), 50_000):
            c = count[i : i + 50_000]
            rep = np.repeat(np.arange(len(c)), c)
            k = np.repeat(a[i : i + 50_000], c) + np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c)
            start = end[i : i + 50_000][rep] - self.least
            same = (eight[start + 8] & self.lead) == self.first[k]
            for s, p in zip(start[same].tolist(), self.order[k[same]].tolist()):
                if text.startswith(self.patterns[p], s):
                    yield s, p


_loaded: dict[str, WuManber] = {}


def _tables(path: str, uri: str, only: bool) -> WuManber:
    if path not in _loaded:
        _loaded.clear() if not only else None
        t = pq.ParquetFile(filesystem(uri)[0].open_input_file(path)).read(columns=["pattern", "item"])
        _loaded[path] = WuManber(t["pattern"].to_pylist(), t["item"].to_pylist())
    return _loaded[path]


def _found(texts: list[bytes], blocks: list[str], uri: str) -> tuple[np.ndarray, list, list]:
    """Words of each text, its runs of hit words, and its items."""
    forms = [b" " + b" ".join(words_of(t)) + b" " for t in texts]
    text = b"".join(forms)
    off = np.r_[0, np.cumsum([len(f) for f in forms])]
    buf = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero((buf[:-1] == 32) & (buf[1:] != 32)) + 1 if len(buf) else np.zeros(0, int)
    first_word = np.searchsorted(starts, off)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for path in blocks:
        tables = _tables(path, uri, only=len(blocks) <= 8)
        for at, p in tables.search(text):
            d = int(np.searchsorted(off, at, "right")) - 1
            w = int(np.searchsorted(starts, at)) - int(first_word[d])
            spans.setdefault(d, []).append((w, w + tables.words[p]))
            items.setdefault(d, set()).update(tables.items[p])
    runs = []
    for d in range(len(texts)):
        own: list[list[int]] = []
        for s, e in sorted(spans.get(d, ())):
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        runs.append(own)
    return np.diff(first_word), runs, [sorted(items.get(d, ())) for d in range(len(texts))]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _search(blocks: list[str], uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for x, y in _groups(texts):
                n, runs, items = _found(texts[x:y], blocks, uri)
                hits = pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(n.astype(np.int64)), hits, pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "hits", "items"])

    return run


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words, from start to before end), items (names of the items with an occurring window, sorted)."""
    arrow_batches(docs.sparkSession)
    blocks = write_patterns(benchmark, window)
    uri = scratch(docs.sparkSession, "any")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(blocks, uri), "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>")


def _clean(blocks: list[str], uri: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(b.schema.names.index(column)).cast(pa.binary()).to_pylist()]
            free = [not r for x, y in _groups(texts) for r in _found(texts[x:y], blocks, uri)[1]]
            yield b.filter(pa.array(free, pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    arrow_batches(docs.sparkSession)
    blocks = write_patterns(benchmark, window)
    return docs.mapInArrow(_clean(blocks, scratch(docs.sparkSession, "any"), "text"), docs.schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
