"""Removal of repeated byte strings by prefix doubling over winnowed positions.

A byte is removed if a string of `threshold` bytes that covers it also starts earlier: in a document
with a smaller doc_id, or earlier in the same document. Strings are judged on the input.

Prefix doubling sorts pairs of ranks, (rank, rank at offset h), gives equal pairs a common rank, and doubles h, until a position is unique
or its string past the threshold. Over all positions that takes some 16 bytes a byte of input and round. So only winnowed positions enter: of the
gram starts inside each window of `threshold` bytes, that with the least hash. Equal windows choose the same place in them,
so no repeat is missed. A position stands for all the windows that chose it, an extent. As offsets are from positions to places that winnowing left out,
which have no rank, the second part of a pair is the name (a hash) of the bytes there. The rounds, for a threshold of 100:

    1. h = 25: the bytes at the position;
    2. h = 50: pairs (rank, the 25 bytes at offset 25), or at offset -25 for the windows that end before that;
    3. h = 100, cut to the bytes common to 8 windows: pairs (rank, the bytes around, up to 93 in all);
    4. h = 100: pairs (rank, the bytes that are left of a single window).

After each sort a position whose pair is unique leaves. A position whose whole extent, past the threshold, equals an earlier one's leaves too: its
windows are removed. The others get a rank: the number of their class in the sort, by task, and go on. Names are 64-bit
hashes; equality is always judged by two of them.

Hot names: each batch first reduces equal pairs to the earliest one, so a copied passage sends at most one row a
batch; a name with many different pairs in a batch is spread over partitions by the whole pair, a marker, sorted first, keeps its
group from looking unique, and its rank is the name itself, so that all partitions agree on it; the last round places all rows by the pair. Groups are only streamed over sorted rows, never collected.

The text itself is never shuffled. Extents go to one small file set for each partition of the input, in the shared
folder, and each pass over the text opens those of its own partition. So the input must yield the same rows in the same
partitions on every pass: true of a file scan; pass stable=False for anything else, and it is written to the shared
folder first. A fingerprint of each partition guards this.

Defined cases: null text is empty; empty or shorter texts lose nothing; null doc_id comes before all others; rows with
equal doc_id count in scan order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batches, materialize, scratch, table, tasks_for
from .warc import filesystem

ROW = "core long, ext long, doc long, place long, part int, mk int"
SCHEMA = pa.schema([("core", pa.int64()), ("ext", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("mk", pa.int32())])
LATER, OPEN, HOT, MARK, GUARD = 0, 1, 2, 3, 4  # kinds of rows, in the low bits of mk
PIECE = 8
COUNT = 14  # bits of an extent's number of windows, above the kind; above them, the position's offset from the first window
SLICE = 2_000_000  # bytes that are named at a time
EXTENTS = 10_000  # extents that are named at a time
HOT_CLASSES = 8
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)
LOW = np.uint64(0xFFFFFFFF)
_tables: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, mod 2^64."""
    if len(_tables.get("p", ())) < n:
        for name, base in (("p", P), ("q", P_INV)):
            a = np.full(n + n // 4 + 1, base, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["p"], _tables["q"]


def _letters() -> np.ndarray:
    return np.random.default_rng(20_240).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Names:
    """Names (hashes) of any byte ranges of a buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.p, self.q = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters()[buf] * self.p[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.q[start])


def _winnow(buf: np.ndarray, off: np.ndarray, names: Names, gram: int, threshold: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that chose the same gram: its start, first window, number of windows, document."""
    n = len(buf)
    width = threshold - gram + 1
    if n < threshold:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    h = _mix((names.sums[gram:] - names.sums[:-gram]) * names.q[: n - gram + 1])
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)  # the hash's upper half, then the leftmost
    del h
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & LOW).astype(np.int64)
    del least
    # windows that cross into the next document don't count
    for s in range(len(off) - 1):
        at[max(off[s], off[s + 1] - threshold + 1) : off[s + 1]] = -1
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    keep = at[first] >= 0
    first, count = first[keep], count[keep]
    return at[first], first, count, np.searchsorted(off, first, "right") - 1


def _offset_mix(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for k, x in enumerate(more):
        h = _mix(h + (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93 + 2 * k))
    return h


def _rows(core, ext, doc, place, part, mk) -> pa.RecordBatch:
    n = len(core)
    return pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(ext.view(np.int64)), pa.array(doc), pa.array(place), pa.array(np.full(n, part, np.int32)), pa.array(mk.astype(np.int32))], schema=SCHEMA)


def _combine(core: np.ndarray, ext: np.ndarray, doc: np.ndarray, place: np.ndarray, count: np.ndarray, at: np.ndarray, part: int) -> pa.RecordBatch:
    """Within a batch: later ones of equal pairs are known to be later occurrences; hot names get a marker. at: the position's offset from its first window."""
    order = np.lexsort((place, doc, ext, core))
    core, ext, doc, place, info = core[order], ext[order], doc[order], place[order], (at << COUNT | count)[order]
    n = len(core)
    new_core = np.r_[True, core[1:] != core[:-1]] if n else np.zeros(0, bool)
    new = new_core | np.r_[True, ext[1:] != ext[:-1]] if n else new_core
    group = np.cumsum(new_core) - 1
    classes = np.bincount(group[new], minlength=int(group[-1]) + 1 if n else 0)
    kind = np.where(new, np.where(classes[group] >= HOT_CLASSES, HOT, OPEN), LATER) if n else np.zeros(0, int)
    hot = np.flatnonzero(new_core & (kind == HOT))
    mk = info * 8 + kind
    return _rows(np.r_[core, core[hot]], np.r_[ext, ~core[hot]], np.r_[doc, doc[hot]], np.r_[place, place[hot]], part, np.r_[mk, np.full(len(hot), MARK)])


def _count(mk: np.ndarray) -> np.ndarray:
    return (mk >> 3) & ((1 << COUNT) - 1)


def _chunks(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[np.ndarray, list, list, int]]:
    """Texts as bytes, doc_ids and the row number of the first, up to about size bytes at a time; a longer text is one chunk."""
    row, start, held, ids, total = 0, 0, [], [], 0
    for b in batches:
        texts, docs = b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()
        for t, d in zip(texts, docs):
            t = t or b""
            if held and total + len(t) > size:
                yield _offsets(held), held, ids, start
                held, ids, total, start = [], [], 0, row
            held.append(t)
            ids.append(d)
            total += len(t)
            row += 1
    if held:
        yield _offsets(held), held, ids, start


def _offsets(texts: list[bytes]) -> np.ndarray:
    return np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _doc_ids(ids: list) -> np.ndarray:
    return np.array([-(1 << 63) if d is None else d for d in ids], np.int64)


def _guard(crc: int, off: np.ndarray, ids: list) -> int:
    return zlib.crc32(_doc_ids(ids).tobytes(), zlib.crc32(np.diff(off).tobytes(), crc))


def first_round(gram: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, crc = TaskContext.get().partitionId(), 0
        for off, texts, ids, start in _chunks(batches):
            crc = _guard(crc, off, ids)
            whole, own = np.frombuffer(b"".join(texts), np.uint8), _doc_ids(ids)
            for a in range(0, len(whole), SLICE):  # overlapping, so that each window lies in one slice
                buf = whole[a : a + SLICE + threshold - 1]
                names = Names(buf)
                at, first, count, d = _winnow(buf, np.clip(off - a, 0, len(buf)), names, gram, threshold)
                core = names.of(at, at + gram)
                ext = _offset_mix(names.of(first, first + count - 1 + threshold), at - first, count)
                yield _combine(core, ext, own[d], ((start + d) << 31) | (first + a - off[d]), count, at - first, part)
        z = np.zeros(1, np.uint64)
        yield _rows(z + np.uint64(part), z, np.zeros(1, np.int64), np.array([crc], np.int64), part, np.array([GUARD]))

    return run


def next_round(folder: str, gram: int, threshold: int, step):
    """Pairs (rank, name of more bytes) of what the last round left open in this partition; step says which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place, mk, rank = _extents(folder, part)
        keep = (mk & 7) == OPEN
        place, mk, rank = place[keep], mk[keep].astype(np.int64), rank[keep].view(np.uint64)
        if not len(place):
            for _ in batches:
                return
        row_of = place >> 31
        for off, texts, ids, start in _chunks(batches):
            a, b = np.searchsorted(row_of, [start, start + len(texts)])
            own = _doc_ids(ids)
            for i in range(a, b, EXTENTS):
                own_rows = slice(i, min(b, i + EXTENTS))
                p, n, at = place[own_rows], _count(mk[own_rows]), mk[own_rows] >> (3 + COUNT)
                d, x0 = (p >> 31) - start, p & 0x7FFFFFFF
                buf = np.frombuffer(b"".join([texts[k][u:v] for k, u, v in zip(d.tolist(), x0.tolist(), (x0 + n - 1 + threshold).tolist())]), np.uint8)
                size = n - 1 + threshold
                first = np.cumsum(size) - size
                core, ext, w, count, at, rep = step(Names(buf), first, n, at, rank[own_rows], gram, threshold)
                yield _combine(core, ext, own[d[rep]], ((start + d[rep]) << 31) | (x0[rep] + w - first[rep]), count, at, part)

    return run


def _spans(names: Names, w: np.ndarray, count: np.ndarray, threshold: int, at: np.ndarray) -> np.ndarray:
    """Names of whole extents, with the position's offset."""
    return _offset_mix(names.of(w, w + count - 1 + threshold), at, count)


def doubled(names: Names, first, n, at, rank, gram: int, threshold: int) -> tuple[np.ndarray, ...]:
    """The gram after the position, or, for the windows that end before it does, the gram before."""
    reach = threshold - 2 * gram  # from a window's start to the position, at most, if the window holds the gram after it too
    before = np.clip(at - reach, 0, n)  # so many of the windows, the first ones
    rep = np.concatenate([np.flatnonzero(before > 0), np.flatnonzero(before < n)])
    left = np.arange(len(rep)) < np.count_nonzero(before > 0)
    skip = np.where(left, 0, before[rep])
    w, count, at = first[rep] + skip, np.where(left, before[rep], n[rep] - before[rep]), at[rep] - skip
    other = w + at + np.where(left, -gram, gram)
    core = _offset_mix(rank[rep] + names.of(other, other + gram), left)
    return core, _spans(names, w, count, threshold, at), w, count, at, rep


def pieces(names: Names, first, n, at, rank, gram: int, threshold: int) -> tuple[np.ndarray, ...]:
    """The bytes common to PIECE windows around the two grams; at is then the offset of the first of them."""
    reach = threshold - 2 * gram
    at = at - np.where(at > reach, gram, 0)
    k0, k1 = (at - n + 1) // PIECE, at // PIECE
    m = k1 - k0 + 1
    rep = np.repeat(np.arange(len(first)), m)
    k = np.repeat(k0, m) + np.arange(len(rep)) - np.repeat(np.cumsum(m) - m, m)
    grams = (first + at)[rep]
    top, bottom = np.minimum(k * PIECE + PIECE - 1, at[rep]), np.maximum(k * PIECE, (at - n + 1)[rep])
    c0, c1 = _common(grams, k, reach, threshold)
    core = _offset_mix(rank[rep] + names.of(c0, grams), k) ^ names.of(grams + 2 * gram, c1)
    w, count = grams - top, top - bottom + 1
    return core, _spans(names, w, count, threshold, top), w, count, top, rep


def _common(grams: np.ndarray, k: np.ndarray, reach: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that all windows of the k-th piece hold."""
    return grams - k * PIECE, grams - np.minimum(k * PIECE + PIECE - 1, reach) + threshold


def windows(names: Names, first, n, at, rank, gram: int, threshold: int) -> tuple[np.ndarray, ...]:
    """Single windows: the bytes before and after those common to the piece."""
    rep = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    w, own = first[rep] + i, at[rep] - i
    c0, c1 = _common((first + at)[rep], at[rep] // PIECE, threshold - 2 * gram, threshold)
    core = _offset_mix(rank[rep] + names.of(w, c0), own) ^ names.of(c1, w + threshold)
    return core, names.of(w, w + threshold), w, np.ones(len(w), np.int64), own, rep


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by name, markers first, then pair and position: the earliest of each pair stays open if its name has other pairs, others are later ones.

    Open rows get their name's rank: its number among this task's names, or, for hot names, which several tasks meet, the name itself."""
    last_core = last_ext = None
    classes, hot, pending, seen, task = 0, False, None, 0, TaskContext.get().partitionId() << 40
    for b in batches:
        core, ext = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        mk = b.column(5).to_numpy(zero_copy_only=False)
        kind = mk & 7
        passed = (kind == GUARD) | (kind == LATER)
        out = [_ranked(b.filter(pa.array(passed)), np.zeros(int(passed.sum()), np.int64))]
        live = np.flatnonzero(~passed)
        if len(live):
            core, ext, kind = core[live], ext[live], kind[live]
            new_core = np.r_[last_core is None or core[0] != last_core, core[1:] != core[:-1]]
            new = new_core | np.r_[last_ext is None or ext[0] != last_ext, ext[1:] != ext[:-1]]
            group = np.cumsum(new_core) - new_core[0]
            number = np.bincount(group[new], minlength=int(group[-1]) + 1)
            heat = np.bincount(group[(kind == HOT) | (kind == MARK)], minlength=int(group[-1]) + 1) > 0
            if not new_core[0]:
                number[0] += classes
                heat[0] |= hot
            many = (number >= 2) | heat
            place_in_sort = seen + np.cumsum(new_core)
            rank = np.where(heat[group], core | np.int64(-(1 << 63)), task | place_in_sort)
            if not new_core[0] and many[0] and pending is not None:
                out.append(_ranked(pending, rank[:1]))
            if not new_core[0] and not many[0] and group[-1] == 0:
                pass  # the same name goes on, still with one pair: the pending row stays
            else:
                pending = None
            mark = kind == MARK
            opened = new & many[group] & ~mark
            later = ~new & ~mark
            if not many[-1]:
                own = np.flatnonzero(new & (group == group[-1]) & ~mark)
                if len(own):
                    pending = _kinds(b.take(pa.array(live[own[:1]])), OPEN)
            out += [_ranked(_kinds(b.take(pa.array(live[opened])), OPEN), rank[opened]), _ranked(_kinds(b.take(pa.array(live[later])), LATER), np.zeros(int(later.sum()), np.int64))]
            classes, hot, last_core, last_ext, seen = int(number[-1]), bool(heat[-1]), core[-1], ext[-1], int(place_in_sort[-1])
        for x in out:
            if x.num_rows:
                yield x


def _ranked(b: pa.RecordBatch, rank: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[b.column(k) for k in (3, 4, 5)], pa.array(rank)], names=["place", "part", "mk", "rank"])


def _kinds(b: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    mk = b.column(5).to_numpy(zero_copy_only=False)
    return b.set_column(5, SCHEMA.field("mk"), pa.array(((mk >> 3 << 3) | kind).astype(np.int32)))


def _extents(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the sorted rounds wrote for one partition of the input, by place."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, path = filesystem(folder)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True)) if f.path.endswith(".parquet")]
    read = [pq.ParquetFile(system.open_input_file(f)).read(columns=["place", "mk", "rank"]) for f in sorted(files)]
    if not read:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    t = pa.concat_tables(read)
    place, mk, rank = t["place"].to_numpy(), t["mk"].to_numpy(), t["rank"].to_numpy()
    order = np.argsort(place, kind="stable")
    return place[order], mk[order], rank[order]


def _round(named: DataFrame, name: str, n: int, last: bool = False) -> str:
    """One sort of all names; the extents that it settles or leaves open, written by partition of the input.

    A hot pair that other batches sent as a common one is met in two partitions, where its earliest ones stay open alike. The
    last round settles them: there rows are placed by the whole pair.
    """
    spark = named.sparkSession
    kind = F.col("mk").bitwiseAND(7)
    salt = F.when(kind.isin(LATER, GUARD), F.col("place")).when(F.lit(last) | (kind == HOT), F.col("ext")).otherwise(F.lit(0).cast("long"))
    path = scratch(spark, name)
    (
        named.withColumn("salt", salt).repartition(n, "core", "salt").drop("salt").sortWithinPartitions("core", kind != MARK, "ext", "doc", "part", "place")
        .mapInArrow(_sorted_groups, "place long, part int, mk int, rank long")
        .repartition("part").sortWithinPartitions("part", "place").write.partitionBy("part").parquet(path)
    )
    return path


def _removed(folders: list[str], threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, crc = TaskContext.get().partitionId(), 0
        read = [_extents(f, part) for f in folders]
        guard = [int(p) for place, mk, _ in read for p in place[(mk & 7) == GUARD]]
        keep = [(mk & 7) == LATER for _, mk, _ in read]
        place = np.concatenate([p[k] for (p, _, _), k in zip(read, keep)])
        count = np.concatenate([_count(m[k]) for (_, m, _), k in zip(read, keep)]).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, count = place[order], count[order]
        row_of = place >> 31
        for off, texts, ids, start in _chunks(batches):
            crc = _guard(crc, off, ids)
            a, b = np.searchsorted(row_of, [start, start + len(texts)])
            d = row_of[a:b] - start
            first = off[d] + (place[a:b] & 0x7FFFFFFF)
            reach = np.maximum.accumulate(first + count[a:b] - 1 + threshold)
            new = np.r_[True, (first[1:] > reach[:-1]) | (d[1:] != d[:-1])] if a < b else np.zeros(0, bool)
            run0, run1, d = first[new], reach[np.r_[new[1:], True]] if a < b else reach, d[new]
            sizes = np.diff(np.c_[np.r_[0, run1], np.r_[run0, off[-1]]].ravel())
            gone = np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)
            buf = np.frombuffer(b"".join(texts), np.uint8)
            lists = np.r_[0, np.cumsum(np.bincount(d, minlength=len(texts)))].astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(run0 - off[d]), pa.array(run1 - off[d])], names=["start", "end"]))
            whole = buf[~gone].tobytes()
            lost = np.bincount(d, weights=run1 - run0, minlength=len(texts)).astype(np.int64)
            at = off - np.r_[0, np.cumsum(lost)]
            kept = pa.array([whole[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(off)), kept, spans], names=["doc_id", "n_bytes", "kept", "removed"])
        if guard != [crc]:
            raise RuntimeError("the input's partitions changed between two passes; pass stable=False")

    return run


def remove_repeats(docs: DataFrame, threshold: int = 100, gram: int | None = None, stable: bool = True) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), removed (start and end of each maximal removed run). gram: the first h, a quarter of the threshold unless given."""
    gram = gram or max(1, threshold // 4)
    if not 1 <= gram <= threshold // 3 or threshold >> (COUNT - 1):
        raise ValueError(f"three grams must fit in the threshold, which must lie below {1 << (COUNT - 1)}")
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    if not stable:
        docs = materialize(docs, "suffix-input")
    n = tasks_for(docs)
    folders = [_round(docs.mapInArrow(first_round(gram, threshold), ROW), "suffix-1", n)]
    for k, step in ((2, doubled), (3, pieces), (4, windows)):
        folders.append(_round(docs.mapInArrow(next_round(folders[-1], gram, threshold, step), ROW), f"suffix-{k}", n, last=step is windows))
    return docs.mapInArrow(_removed(folders, threshold), "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
