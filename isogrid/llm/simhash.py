"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Fingerprints of 64 bits link at `most` = 3 or fewer differing bits. These lie in at most 3 of the 8 bytes, so linked fingerprints
share at least 5 bytes in place. Lists of single bytes would hold a 256th of all fingerprints each, and their pairs would grow with a 64th of the square of the
rows; so the index posts each fingerprint under every triple of positions with its three bytes, 56 lists. A pair that shares m positional bytes meets
in C(m, 3) of them. These meetings are tallied for each pair; pairs that reach C(5, 3) = 10, the guaranteed minimum, stay, those with fewer
(three or four shared bytes) go; what stays is verified on all bits.

Equal fingerprints are one node, so copies never form pairs. A list of more than `long_list` fingerprints is not paired, which would cost the square
of its length. Two fingerprints of which some common list is long are both `hot`, and their link is found in another way: each hot one posts, under each of 14
blocks of four positions with their bytes, all variants with up to 2 flips of the other 32 bits as `far`, with up to 1 as `near`. The blocks
are the Steiner quadruple system on 8 points: for any 3 positions that differ, some block holds none of them.
Two fingerprints are within 3 bits exactly if a far variant of one is a near variant of the other. All that hold a
variant link to its least near one, so hot fingerprints cost rows in proportion to their number, and components lose no link.

Defined cases: null and wordless texts have fingerprint zero and link like any other; shorter texts than a shingle are one
shingle; null doc_id never becomes a component's id unless all its members' are null; repeated rows are members like any other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import arrow_batches, materialize, table
from .components import components

MOST, BYTES = 3, 8
MINIMUM = comb(BYTES - MOST, 3)
#: Under which positional bytes a fingerprint is posted.
TRIPLES = list(combinations(range(BYTES), 3))
#: Quads of positions whose numbers, as 3-bit vectors, add up to zero: each triple of positions lies in one of them.
BLOCKS = [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
LONES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Of a text: bit i is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 255 * 256):  # blocks of 255, so that a byte can count
        s = slice(a, min(n, a + 255 * 256))
        e = ends[shingle - 1 :][s]
        h = np.array([digest(flat[x:y], seed) for x, y in zip(starts[s].tolist(), e.tolist())], np.uint64)
        pad = -len(h) % 255
        h = np.r_[h, np.zeros(pad, np.uint64)].reshape(-1, 255) if len(h) > 255 else h.reshape(1, -1)
        for bit in range(8):
            lanes = ((h >> np.uint64(bit)) & LONES).sum(axis=1, dtype=np.uint64)
            counts[bit::8] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(t or b"") for t in texts], np.uint64)
        whole = np.array([xxhash.xxh64_intdigest(t or b"", 42) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64)), pa.array(whole.view(np.int64))], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long), text_hash (as Spark's xxhash64 of the text, null as empty)."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def _byte(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, 8 * k).bitwiseAND(255)


def postings(prints: DataFrame, groups: list[tuple[int, ...]] = TRIPLES) -> DataFrame:
    """fp under each group of positions: key holds the group's number and its bytes."""
    keys = []
    for number, group in enumerate(groups):
        key = F.lit(number).cast("long")
        for k in group:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), k))
        keys.append(key)
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All values within 2 flips of the bytes outside the block; near says within 1."""
    flips = []
    for block in BLOCKS:
        bits = [np.uint64(1) << np.uint64(8 * k + i) for k in range(BYTES) if k not in block for i in range(8)]
        flips.append(np.array([0, *bits, *(x | y for x, y in combinations(bits, 2))], np.uint64))
    near = np.arange(len(flips[0])) <= 32
    for whole in batches:
        for i in range(0, whole.num_rows, 200):
            b = whole.slice(i, 200)
            fp, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            value = fp.view(np.uint64)[:, None] ^ np.stack([flips[k] for k in key >> 32])
            n = value.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, n)), pa.array(np.repeat(key, n)), pa.array(value.ravel().view(np.int64)), pa.array(np.tile(near, len(fp)))], names=["fp", "key", "value", "near"])


def links(prints: DataFrame, long_list: int = 512) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough for the components of all links within 3 bits."""
    sized = postings(prints).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    held = materialize(sized, "simhash-lists")
    short = held.filter(F.col("n") <= long_list)
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    tallied = a.join(b, "key").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= MINIMUM)
    pairs = tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST).select("a", "b")
    # Spark takes variants to be as few bytes as hot: it would make them in one task, and send them all through the driver for a broadcast
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = postings(held.filter(F.col("n") > long_list).select("fp").distinct(), BLOCKS).repartition(tasks)
    variants = hot.mapInArrow(_variants, "fp long, key long, value long, near boolean")
    centres = variants.groupBy("key", "value").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND a IS NOT NULL").select("key", "value", "a")
    stars = variants.join(centres.hint("merge"), ["key", "value"]).select("a", F.col("fp").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, long_list: int = 512) -> DataFrame:
    """doc_id, fp, text_hash, root (one fingerprint of the component) and component_id, the smallest doc_id that links reach."""
    rows = materialize(fingerprints(docs), "simhash-prints")
    by_print = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(by_print.select("fp"), long_list), "simhash-components")
    member = by_print.join(roots, by_print.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    # a frequent fingerprint's documents are split by adaptive skew joins
    ids = member.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(ids, rows.fp == F.col("_fp"), "left").drop("_fp")


def candidates(docs: DataFrame, long_list: int = 512) -> DataFrame:
    """Pairs (a, b) of text hashes, a < b: texts with equal or linked fingerprints, enough to connect them all. For an exact check that follows."""
    prints = materialize(fingerprints(docs).select("fp", "text_hash").distinct(), "simhash-texts")
    heads = prints.groupBy("fp").agg(F.min("text_hash").alias("head"))
    alike = prints.join(heads, "fp").select(F.col("head").alias("a"), F.col("text_hash").alias("b"))
    first, second = heads.select(F.col("fp").alias("a"), F.col("head").alias("of_a")), heads.select(F.col("fp").alias("b"), F.col("head").alias("of_b"))
    linked = links(heads.select("fp"), long_list).join(first, "a").join(second, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return materialize(alike.union(linked).filter("a < b").distinct(), "simhash-candidates")


def one_of_each(docs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One document of each component, that with the smallest doc_id (of several with it, that with the least hash of its text).

    members has doc_id, text_hash, root and component_id of all docs; as from near_duplicates unless given."""
    first = (near_duplicates(docs) if members is None else members).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("text_hash").alias("_hash"), F.first("doc_id").alias("_id"))
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", own.alias("_own")).withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), "_own"))
    first = first.withColumn("_first", F.xxhash64("_id", "_hash"))
    # joined by one key, which places equal rows together too, so texts are shuffled once; the rest is compared in a form that is no key
    same = (F.col("_own").bitwiseXOR(F.col("_hash")) == 0) & F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(F.col("_id")) == 0, F.col("doc_id").isNull() & F.col("_id").isNull())
    stay = rows.join(first.select("_id", "_hash", "_first"), (F.col("_key") == F.col("_first")) & same, "left_semi")
    return stay.dropDuplicates(["_key", "doc_id", "_own"]).select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
