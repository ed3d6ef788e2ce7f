"""Near-duplicates by exact Jaccard similarity of word shingles, through an inverted index of prefixes.

Two texts are linked if their sets of `WORDS`-word shingles have a Jaccard similarity of NUM / DEN = 0.8 or more. Such sets share a
shingle among the first n - ceil(0.8 n) + 1 of each, in any one order of all shingles. So only these are posted, no pair is missed; pairs
are tallied, and those that share enough there are verified on the whole sets. The order puts frequent shingles last, so that shared lines and
boilerplate seldom get into a prefix. Frequencies come from all documents: each task keeps a summary of COUNTERS counters (Misra and Gries: when it
overflows, all counters fall by the largest that has no room, so a count is short by at most the task's shingles / COUNTERS), and the summaries are
added up. The order alters the lists' lengths, never the result. Shingles are 64-bit hashes.

Candidates of another method, such as SimHash's links, can come first: those that pass the check on whole sets are links, and the index forms no
pair between texts that they connect.

Whole sets are made again only for texts in some pair, picked by a bitmap of fixed size, so texts aren't shuffled. Equal texts are one node.

Defined cases: words as for SimHash; a shorter text than a shingle is one shingle; null and wordless texts are equal; null doc_id
never becomes a component's id unless all its members' are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import arrow_batches, materialize
from .components import components

WORDS = 5
NUM, DEN = 4, 5
COUNTERS = 100_000  # of a task's summary of its shingles
FREQUENT = 50_000  # shingles at most that go last, the most frequent ones
BITS = 25  # of the bitmap


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted."""
    w = text.lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(w) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[x:y], 42) for x, y in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def _bytes(b: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in b.column(column).cast(pa.binary()).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches: shingles take some times the room of the text."""
    for b in batches:
        held = np.cumsum([len(t) for t in _bytes(b, b.num_columns - 1)]).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(held // size)) + 1, b.num_rows]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if y > x:
                yield b.slice(x, y - x)


class Summary:
    """Counts of frequent tokens in fixed space."""

    def __init__(self, counters: int):
        self.counters, self.tokens, self.counts = counters, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        token, count = np.unique(tokens, return_counts=True)
        every, at = np.unique(np.r_[self.tokens, token], return_inverse=True)
        total = np.bincount(at, np.r_[self.counts, count], len(every)).astype(np.int64)
        if len(every) > self.counters:
            total -= np.partition(total, len(every) - self.counters - 1)[len(every) - self.counters - 1]
        self.tokens, self.counts = every[total > 0], total[total > 0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    summary = Summary(COUNTERS)
    for b in _parts(batches):
        summary.add(np.concatenate([shingles(t) for t in set(_bytes(b, 0))]))
    yield pa.RecordBatch.from_arrays([pa.array(summary.tokens.view(np.int64)), pa.array(summary.counts)], names=["token", "n"])


def frequent(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles of all documents, of those that occur three times or more; the most frequent last."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2")
    return counts.orderBy(F.desc("n"), "token").limit(most).toArrow()["token"].to_numpy().view(np.uint64)[::-1].copy()


def prefix(tokens: np.ndarray, last: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first of a set's shingles in the common order; last is sorted, order has the places of its values."""
    n = len(tokens)
    size = n - (NUM * n + DEN - 1) // DEN + 1
    if len(last):
        at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
        hot = last[at] == tokens
        cold = tokens[~hot]
        tokens = cold if len(cold) >= size else np.r_[cold, tokens[hot][np.argsort(order[at[hot]])]]
    return tokens[:size]


def _prefixes(hot: np.ndarray):
    order = np.argsort(hot, kind="stable")
    last = hot[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            texts = _bytes(b, 1)
            whole = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)
            sets = [shingles(t) for t in texts]
            n = pa.array(np.array([len(s) for s in sets], np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole.view(np.int64)), n, _lists([prefix(s, last, order) for s in sets])], names=["doc_id", "text_hash", "n", "prefix"])

    return run


def _whole_sets(bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for b in _parts(batches):
            texts = {xxhash.xxh64_intdigest(t, 42): t for t in _bytes(b, 0)}
            h = np.array(list(texts), np.uint64)
            at = (h >> np.uint64(64 - BITS)).astype(np.int64)
            h = h[(bits[at >> 3] >> (at & 7)) & 1 == 1]
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _lists([shingles(texts[x]) for x in h.tolist()])], names=["node", "tokens"])

    return run


def _bitmap(nodes: DataFrame) -> bytes:
    """Of 2^BITS bits, those at the high bits of the nodes are 1."""
    at = F.shiftrightunsigned("node", 64 - BITS)
    byte = nodes.select(F.floor(at / 32768).alias("part"), (at % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(1 << (BITS - 3))
    for r in byte.toLocalIterator():
        out[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return bytes(out)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of texts' hashes whose whole sets have a similarity of 0.8 or more."""
    found = _bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sets = materialize(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_whole_sets(found), "node long, tokens array<long>").dropDuplicates(["node"]), "shingle-sets")
    first, second = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(first, "a").join(second, "b").filter(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def links(docs: DataFrame, rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between the hashes of all texts with a similarity of 0.8 or more; rows as from _prefixes.

    groups (node, root): texts that are connected already; pairs within a group are not formed."""
    distinct = rows.select(F.col("text_hash").alias("node"), "n", "prefix").dropDuplicates(["node"])
    distinct = distinct.withColumn("root", F.lit(None).cast("long")) if groups is None else distinct.join(groups, "node", "left")
    posted = distinct.select("node", "n", "root", F.explode("prefix").alias("token"))
    a, b = (posted.select("token", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
    like = (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")) & F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))
    shared = a.join(b, "token").filter("a < b").filter(like).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    # of the set whose prefix ends first, only what lies past its prefix can be shared without being counted
    beyond = F.ceil(F.greatest("n_a", "n_b") * F.lit(NUM) / F.lit(DEN)) - 1
    pairs = shared.filter(9 * (F.col("shared") + beyond) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    return verified(docs, materialize(pairs, "shingle-pairs"))


def near_duplicates(docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, root (one text's hash of the component) and component_id, the smallest doc_id that links reach.

    candidates (a, b): pairs of texts' hashes found in another way, as by SimHash. Those similar enough are links; the index then
    adds the links between the groups that they form, so the components are the same with any candidates."""
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(_prefixes(frequent(docs)), "doc_id long, text_hash long, n int, prefix array<long>"), "shingle-prefixes")
    groups = None
    if candidates is not None:
        near = materialize(verified(docs, candidates), "shingle-checked")
        groups = components(near, "shingle-groups")
    edges = links(docs, rows, groups)
    roots = components(edges if groups is None else edges.union(near), "shingle-components")
    by_text = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least"))
    member = by_text.join(roots, by_text.text_hash == roots.node, "left").select("text_hash", "least", F.coalesce("root", "text_hash").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = member.join(least, "root").select(F.col("text_hash").alias("_text"), "root", "component_id")
    return rows.select("doc_id", "text_hash").join(ids, rows.text_hash == F.col("_text")).drop("_text")
