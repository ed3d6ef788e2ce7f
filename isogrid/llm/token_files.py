"""Token ids in files of independent zstandard frames, with a seek table.

A file holds the ids of consecutive documents, each ended by `end`, little-endian, two bytes an id if the vocabulary allows, four
otherwise. Its frames hold FRAME ids each, whatever documents they belong to. After them come two skippable frames: the
index (doc_ids and numbers of ids), and the seek table of the public zstd seekable format: compressed and plain size of each frame,
and the lower half of its plain bytes' XXH64. TokenFile reads chosen documents by decompressing only the frames that hold them, and checks each.

Documents are range-partitioned and sorted by doc_id, so a task writes one file, and files follow each other in doc_id order. A file is
named by its attempt; the manifest, written to the shared folder, names those that count.

Texts are encoded by the tokenizers library word by word (between ASCII white space), each distinct word once in a
while: the vocabulary's pre-tokenizer drops white space and none of its pieces spans it, so the ids are those of the whole text. Pass by_word=False for a tokenizer of another kind.

Defined cases: null text is empty and has only the end id; null doc_id comes before all others; equal doc_ids follow each other in
order of a hash of their text; an empty table writes no file and reads as no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import arrow_batches, materialize, scratch, table, tasks_for
from .suffix_dedup import Names
from .warc import filesystem

FRAME = 1 << 16
CACHE = 800_000  # words that are kept with their ids
KEPT = 64 << 20  # bytes of long words that are kept
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
LETTERS, MARKS = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyz", b".,;:!?*#$%&"))
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_tokenizers: dict = {}


class WordTable:
    """Words and their ids in arrays: an open-addressed hash table that many words are looked up in at once.

    A word counts as found only if all its bytes agree: its length, its first and last eight bytes, and, if it is longer than these, the
    whole word, which is kept. The 64-bit name only says where to look; different words may share it.
    """

    BITS = 21

    def __init__(self, dtype: np.dtype):
        n = 1 << self.BITS
        self.name, self.head, self.tail = (np.zeros(n, np.uint64) for _ in range(3))
        self.size, self.count, self.at = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
        self.ids, self.used, self.words = np.zeros(1 << 16, dtype), 0, 0
        self.bytes, self.filled, self.byte_at = np.zeros(1 << 16, np.uint8), 0, np.zeros(n, np.int64)
        self.again = np.zeros(n, bool)  # words that a later batch had too

    def find(self, name: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray, buf: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Slots of the words of buf that begin at start, -1 where there is none."""
        out, left = np.full(len(name), -1, np.int64), np.arange(len(name))
        slot = (name >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(left):
            there = self.name[slot]
            same = (there == name[left]) & (self.head[slot] == head[left]) & (self.tail[slot] == tail[left]) & (self.size[slot] == size[left])
            long = np.flatnonzero(same & (size[left] > 16))
            if len(long):
                same[long] = self._equal(slot[long], size[left[long]], buf, start[left[long]])
            out[left[same]] = slot[same]
            on = ~same & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.BITS) - 1)
        return out

    def renew(self, most: int, most_bytes: int) -> None:
        """Keeps only words that came again, most of them at most, and most_bytes of the long ones' bytes."""
        slot = np.flatnonzero(self.again)
        slot = slot[np.unique(self.name[slot], return_index=True)[1]][:most]
        size = self.size[slot].astype(np.int64)
        slot = slot[np.cumsum(np.where(size > 16, size, 0)) <= most_bytes]
        name, head, tail, size = (x[slot] for x in (self.name, self.head, self.tail, self.size))
        ids = [self.ids[a : a + n].tobytes() for a, n in zip(self.at[slot].tolist(), self.count[slot].tolist())]
        long = np.where(size > 16, size, 0).astype(np.int64)
        text = b"".join(self.bytes[a : a + n].tobytes() for a, n in zip(self.byte_at[slot].tolist(), long.tolist()) if n)
        self.__init__(self.ids.dtype)
        if len(slot):
            self.add(name, head, tail, size, np.frombuffer(text, np.uint8), np.cumsum(long) - long, ids)

    def _equal(self, slot: np.ndarray, size: np.ndarray, buf: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether the long words kept at slot are those of buf at start, byte by byte, some megabytes at a time."""
        out = np.zeros(len(slot), bool)
        for part in np.array_split(np.arange(len(slot)), max(1, int(size.sum(dtype=np.int64)) >> 22)):
            n = size[part].astype(np.int64)
            first = np.cumsum(n) - n
            k = np.arange(int(n.sum())) - np.repeat(first, n)
            differ = self.bytes[np.repeat(self.byte_at[slot[part]], n) + k] != buf[np.repeat(start[part], n) + k]
            if len(part):
                out[part] = ~np.logical_or.reduceat(differ, first)
        return out

    def add(self, name: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray, buf: np.ndarray, start: np.ndarray, ids: list[bytes]) -> None:
        """Words with different names, none of which is there yet as a whole; another word of the same name may be."""
        flat = np.frombuffer(b"".join(ids), self.ids.dtype)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(max(len(self.ids), 2 * len(flat)), self.ids.dtype)]
        self.ids[self.used : self.used + len(flat)] = flat
        count = np.array([len(x) for x in ids], np.int64) // self.ids.dtype.itemsize
        at = self.used + np.cumsum(count) - count
        self.used, self.words = self.used + len(flat), self.words + len(ids)
        long = np.flatnonzero(size > 16)
        text = np.frombuffer(b"".join(buf[a : a + n].tobytes() for a, n in zip(start[long].tolist(), size[long].tolist())), np.uint8)
        if self.filled + len(text) > len(self.bytes):
            self.bytes = np.r_[self.bytes[: self.filled], np.zeros(max(len(self.bytes), 2 * len(text)), np.uint8)]
        self.bytes[self.filled : self.filled + len(text)] = text
        byte_at = np.zeros(len(size), np.int64)
        byte_at[long] = self.filled + np.cumsum(size[long], dtype=np.int64) - size[long]
        self.filled += len(text)
        left, slot = np.arange(len(name)), (name >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(left):
            free = self.name[slot] == 0
            self.name[slot[free]] = name[left[free]]
            won = free & (self.name[slot] == name[left])  # of several for one slot, one
            k, s = left[won], slot[won]
            self.head[s], self.tail[s], self.size[s], self.count[s], self.at[s], self.byte_at[s] = head[k], tail[k], size[k], count[k], at[k], byte_at[k]
            left, slot = left[~won], (slot[~won] + ~free[~won]) & ((1 << self.BITS) - 1)


class Encoder:
    """Ids of texts as bytes.

    Words are kept with their ids, CACHE of them and a batch's at most; when they are full, those that came again stay, half of
    that at most. New words of Latin letters, with marks after them or
    none, are encoded many at a time and told apart by the ids that end words; any other word is encoded by itself.
    """

    TAIL = ".,;:!?*#$%&"
    JOINED = 200
    PIECE = 2_000_000

    def __init__(self, path: str, width: int, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.by_word = Tokenizer.from_file(path), np.dtype(f"<u{width}"), by_word
        self.table = WordTable(self.dtype)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _pieces(self, word: str) -> int:
        """How many pieces a word is cut into, each of which ends with one id that ends words: 1 for letters, 2 with marks after them; 0 for any other word."""
        base = word.rstrip(self.TAIL)
        if not (base.isalpha() and (base.isascii() or (max(base) < "\u0250" and base.lower().isalpha()))):
            return 0
        return 1 + (len(base) < len(word))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        out, held, size = [], [], 0
        for t in texts:
            # the vocabulary is of lower case; only a text that might hold a special token's name keeps its case
            t = t if b"<|" in t else t.lower()
            if len(t) > self.PIECE:
                out += self._batch(held) + [b"".join(x for c in self._cut(t) for x in self._batch([c]))]
                held, size = [], 0
                continue
            held.append(t)
            size += len(t)
            if size > self.PIECE:
                out += self._batch(held)
                held, size = [], 0
        return out + self._batch(held)

    def _cut(self, text: bytes) -> Iterator[bytes]:
        """Pieces of a long text, cut at white space."""
        a = 0
        while a < len(text):
            z = a + self.PIECE
            while z < len(text) and text[z] not in b" \t\n\r\x0b\x0c":
                z += 1
            yield text[a:z]
            a = z

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        whole = b"\n".join(texts) + b"\n"
        padded = np.frombuffer(b"\0" * 8 + whole + b"\0" * 8, np.uint8)
        buf = padded[8 : 8 + len(whole)]
        space = np.r_[True, SPACES[buf]]
        start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        eight = np.ndarray((len(whole) + 9,), "<u8", padded, 0, (1,))  # of the padded bytes, from each place
        size = (end - start).astype(np.int32)
        cut = (np.uint64(64) - np.minimum(size, 8).astype(np.uint64) * np.uint64(8))
        key = [np.maximum(Names(buf).of(start, end), np.uint64(1)), eight[start + 8] << cut, eight[end] >> cut, size]
        if self.table.words > CACHE or self.table.filled > KEPT:
            self.table.renew(CACHE // 2, KEPT // 2)
        slot = self.table.find(*key, buf, start)
        self.table.again[slot[slot >= 0]] = True
        while len(new := np.flatnonzero(slot < 0)):
            if len(new) > (1 << WordTable.BITS - 1) - self.table.words:  # a batch of very many words goes in halves
                half = len(texts) // 2
                if half:
                    self.table = WordTable(self.dtype)
                    return self._batch(texts[:half]) + self._batch(texts[half:])
            first = new[np.unique(key[0][new], return_index=True)[1]]
            pieces = self._simple(buf, start[first], end[first])
            bounds = list(zip(start[first].tolist(), end[first].tolist()))
            ids = [x for i in range(0, len(first), 4_000) for x in self._new([whole[a:b] for a, b in bounds[i : i + 4_000]], pieces[i : i + 4_000])]
            self.table.add(*[k[first] for k in key], buf, start[first], ids)
            slot[new] = self.table.find(*[k[new] for k in key], buf, start[new])
        count = self.table.count[slot].astype(np.int64)
        ends = np.r_[0, np.cumsum(count)]
        data = self.table.ids[np.repeat(self.table.at[slot] - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        # where each text's ids begin
        places = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        at = ends[np.searchsorted(start, places)] * self.dtype.itemsize
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _simple(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What _pieces says of words of small letters with marks after them; -1 for the others."""
        letters, marks = (np.r_[0, np.cumsum(kind[buf], dtype=np.int32)] for kind in (LETTERS, MARKS))
        n, m = letters[end] - letters[start], marks[end] - marks[start]
        plain = (n > 0) & (n + m == end - start) & (letters[start + n] - letters[start] == n)
        return np.where(plain, 1 + (m > 0), -1)

    def _new(self, words: list[bytes], pieces: np.ndarray) -> list[bytes]:
        if self.last is None:
            return self._encode(words)
        for i in np.flatnonzero(pieces < 0).tolist():
            pieces[i] = self._pieces(words[i].decode())
        out: list[bytes] = [b""] * len(words)
        simple, rest = np.flatnonzero(pieces), np.flatnonzero(pieces == 0).tolist()
        groups = [simple[i : i + self.JOINED] for i in range(0, len(simple), self.JOINED)]
        own = [g.tolist() for g in groups]
        for g, places, data in zip(groups, own, self._encode([b" ".join([words[i] for i in g]) for g in own])):
            end = np.flatnonzero(self.last[np.frombuffer(data, self.dtype)]) + 1
            last = np.cumsum(pieces[g])
            if len(end) != last[-1]:
                rest += places  # some letters are not as supposed
                continue
            a = 0
            for i, z in zip(places, (end[last - 1] * self.dtype.itemsize).tolist()):
                out[i] = data[a:z]
                a = z
        for i, data in zip(rest, self._encode([words[i] for i in rest])):
            out[i] = data
        return out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]


class TokenWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.packer = out, width, zstandard.ZstdCompressor(level=1)
        self.held, self.size, self.frames, self.docs, self.counts = [], 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME * self.width:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, step = b"".join(self.held), FRAME * self.width
        end = len(data) if last else len(data) // step * step
        for a in range(0, end, step):
            part = data[a : min(end, a + step)]
            packed = self.packer.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.held, self.size = [data[end:]], len(data) - end

    def close(self) -> int:
        """Number of ids."""
        self._flush(True)
        ids = pa.array(self.docs, pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t := pa.schema([("doc_id", pa.int64()), ("n", pa.int64())], metadata={"width": str(self.width)})) as w:
            w.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(self.counts, pa.int64())], schema=t))
        index = self.packer.compress(sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table_ = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table_)) + table_)
        self.out.close()
        return sum(self.counts)


class TokenFile:
    """Reads by documents' places in the file; only their frames are read, decompressed and checked."""

    def __init__(self, f):
        self.f, end = f, f.size()
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != FOOT_MAGIC or flags != 0x80:
            raise ValueError("not a seekable file with checksums")
        f.seek(end - 9 - 12 * n)
        self.frames = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.r_[0, np.cumsum(self.frames[:, 0])]
        f.seek(int(self.at[-1]))
        magic, size = struct.unpack("<II", f.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index")
        self.unpacker = zstandard.ZstdDecompressor()
        t = pa.ipc.open_stream(self.unpacker.decompress(f.read(size))).read_all()
        self.width = int(t.schema.metadata[b"width"])
        self.doc_ids, self.counts = t["doc_id"], t["n"].to_numpy()
        self.starts = np.cumsum(self.counts) - self.counts
        self.read_frames, self.last = 0, (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.f.seek(int(self.at[k]))
            data = self.unpacker.decompress(self.f.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.last, self.read_frames = (k, data), self.read_frames + 1
        return self.last[1]

    def ids(self, place: int) -> np.ndarray:
        """Ids of the document at a place."""
        a, b = int(self.starts[place]), int(self.starts[place] + self.counts[place])
        parts = [self._frame(k)[max(0, a - k * FRAME) * self.width : (b - k * FRAME) * self.width] for k in range(a // FRAME, (b - 1) // FRAME + 1)] if b > a else []
        return np.frombuffer(b"".join(parts), f"<u{self.width}")


def _write(folder: str, tokenizer: str, end: int, width: int, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, width, by_word)
        encoder = _tokenizers.get(key) or _tokenizers.setdefault(key, Encoder(*key))
        system, path = filesystem(folder)
        writer, name, tail = None, "", int(end).to_bytes(width, "little")
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            ids = b.column(0).to_pylist()
            for a in range(0, len(texts), 500):
                for doc_id, data in zip(ids[a : a + 500], encoder.encode(texts[a : a + 500])):
                    if writer is None:
                        system.create_dir(path, recursive=True)
                        name = f"{path}/{uuid.uuid4().hex}.ids.zst"
                        writer = TokenWriter(system.open_output_stream(name, compression=None), width)
                    writer.add(doc_id, data + tail)
        if writer is not None:
            n = len(writer.docs)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([n]), pa.array([writer.close()])], names=["place", "file", "docs", "ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int, vocabulary: int, by_word: bool = True) -> DataFrame:
    """Writes the files under the shared folder; returns the manifest (place, file, docs, ids, start)."""
    spark = docs.sparkSession
    arrow_batches(spark, rows=500, size="8m")
    folder = scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the rows' own numbers part even equal rows, so that a frequent doc_id, or null, spreads over tasks
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_n"]
    ordered = rows.repartitionByRange(tasks_for(rows), *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = ordered.mapInArrow(_write(folder, tokenizer, end, 2 if vocabulary <= 1 << 16 else 4, by_word), "place long, file string, docs long, ids long")
    manifest = materialize(written, "tokens-manifest")  # one row a file
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_file(path) as f:
                    t = TokenFile(f)
                    for a in range(0, len(t.counts), 2000):
                        places = range(a, min(a + 2000, len(t.counts)))
                        crc = [zlib.crc32(t.ids(k).astype("<u4").tobytes()) for k in places]
                        s = slice(a, a + 2000)
                        yield pa.RecordBatch.from_arrays([t.doc_ids.combine_chunks()[s], pa.array(base + t.starts[s]), pa.array(t.counts[s]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""
    files = materialize(manifest.select("file", "start", "place"), "tokens-files")
    n = max(1, files.count())
    tasks = files.repartitionByRange(n, "place").select("file", "start")
    return tasks.mapInArrow(_read(scratch(manifest.sparkSession, "any")), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, vocabulary=49_408))
