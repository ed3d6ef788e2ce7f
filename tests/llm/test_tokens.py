import io
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from llm import tables

public_tokenizers = pytest.importorskip("public_tokenizers")

from isogrid.llm import token_files as tf  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encode(t):
    return tokenizer().encode(t or "", add_special_tokens=False).ids + [2]


def test_round_trip_of_the_table(spark, tmp_path):
    odd = [(400, "<|ENDOFTEXT|> <|endoftext|> it's I'LL no break é É ΣΑΣ İ ß", None, None, 1), (401, "Ａ ﬁ ́x \x85 y\x1cz", None, None, 1)]
    folder = tables.write(spark, tmp_path, [d for d in tables.documents() if d[0] != 3] + odd)
    rows = tf.op9_token_files(spark, folder).collect()
    docs = sorted(((d.doc_id is not None, d.doc_id or 0, d.text) for d in tables.texts(spark, folder)), key=lambda d: d[:2])
    got = sorted((tuple(r) for r in rows), key=lambda r: r[1])
    assert [g[0] for g in got] == [d[1] if d[0] else None for d in docs]
    start = 0
    by = {}
    for g, d in zip(got, docs):
        assert g[1] == start
        start += g[2]
        by.setdefault(g[0], []).append(g[2:])
    want = {}
    for has, d, t in docs:
        ids = encode(t)
        want.setdefault(d if has else None, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}


class Sink(io.BytesIO):
    def close(self):
        pass


@pytest.mark.parametrize("width", [2, 4])
def test_file_reads_only_what_is_asked(width):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 60000, n).astype(f"<u{width}") for n in (0, 1, 5, 200_000, 3, tf.FRAME, 7)]
    sink = Sink()
    w = tf.TokenWriter(sink, width)
    for i, d in enumerate(docs):
        w.add(None if i == 2 else i, d.tobytes())
    assert w.close() == sum(map(len, docs))
    f = pa.BufferReader(sink.getvalue())
    r = tf.TokenFile(f)
    assert r.doc_ids.to_pylist() == [0, 1, None, 3, 4, 5, 6] and len(r.frames) == -(-sum(map(len, docs)) // tf.FRAME)
    assert np.array_equal(r.ids(6), docs[6]) and r.read_frames == 1
    assert all(np.array_equal(r.ids(i), d) for i, d in enumerate(docs))


def test_any_zstandard_reader_and_damage():
    import zstandard

    sink = Sink()
    w = tf.TokenWriter(sink, 2)
    w.add(1, np.arange(1000, dtype="<u2").tobytes())
    w.close()
    data = bytearray(sink.getvalue())
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)), read_across_frames=True).read()
    assert whole == np.arange(1000, dtype="<u2").tobytes()
    data[30] ^= 1
    with pytest.raises(Exception):
        tf.TokenFile(pa.BufferReader(bytes(data))).ids(0)


def test_word_by_word_equals_whole_texts():
    rng = random.Random(0)
    e = tf.Encoder(PATH, 2, True)
    letters = "aB'é_1.!<|>☃ \t\n\r\x0b ſK"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>A <|startoftext|>", "<|EndOfText|>"]
    assert [np.frombuffer(x, "<u2").tolist() + [2] for x in e.encode([t.encode() for t in texts])] == [encode(t) for t in texts]


def test_small_cache_and_pieces(monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 10)
    monkeypatch.setattr(tf.Encoder, "PIECE", 50)
    monkeypatch.setattr(tf.WordTable, "BITS", 6)
    e = tf.Encoder(PATH, 2, True)
    for k in range(3):
        texts = [tables.prose(random.Random(k * 10 + i), 30) for i in range(5)]
        assert [np.frombuffer(x, "<u2").tolist() + [2] for x in e.encode([t.encode() for t in texts])] == [encode(t) for t in texts]


def test_empty(spark, tmp_path):
    assert tf.op9_token_files(spark, tables.write(spark, tmp_path, [])).collect() == []


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_one_name():
    """Polynomial names can't tell a long Thue-Morse word from its complement; the bytes do."""
    t = thue_morse(2048)
    other = t.translate(str.maketrans("ab", "ba"))
    a, b = (("x" * 8 + w + "x" * 8) for w in (t, other))
    names = tf.Names(np.frombuffer((a + b).encode(), np.uint8))
    assert names.of(np.array([0, len(a)]), np.array([len(a), 2 * len(a)])).tolist()[0:1] == names.of(np.array([len(a)]), np.array([2 * len(a)])).tolist()
    rng = random.Random(5)
    long = ["".join(rng.choices("abcdé", k=rng.randint(17, 400))) for _ in range(200)]
    texts = [f"{a} {b} {a}", b, a, " ".join(long), " ".join(long[::-1]), f"{b} z {b}"]
    e = tf.Encoder(PATH, 2, True)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() + [2] for x in e.encode([t.encode() for t in texts])] == [encode(t) for t in texts]


def test_frequent_doc_id_and_long_text(spark, tmp_path):
    """A third of the rows share an id, a third have none; one text of over two megabytes."""
    docs = [(5, f"text {i}", None, None, 1) for i in range(60)] + [(None, f"none {i}", None, None, 1) for i in range(60)] + [(i + 10, "word " * 20, None, None, 1) for i in range(60)]
    docs.append((1000, tables.prose(random.Random(1), 400) * 900, None, None, 1))
    rows = tf.op9_token_files(spark, tables.write(spark, tmp_path, docs, extra=False)).collect()
    want = Counter((d[0], len(x := encode(d[1])), zlib.crc32(np.array(x, "<u4").tobytes())) for d in docs)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_words_that_came_again_outlast_a_full_table(monkeypatch):
    """They are not encoded anew, also long ones; words seen once go, and all ids stay those of the whole text."""
    monkeypatch.setattr(tf, "CACHE", 60)
    encoder = tf.Encoder(PATH, 2, True)
    common = ["anthology", "river,", "it's", "é", "a" * 30, "q" * 16 + "-" + "z" * 20 + "!"]
    asked, new = [], encoder._new
    monkeypatch.setattr(encoder, "_new", lambda words, pieces: asked.extend(w.decode() for w in words) or new(words, pieces))
    for k in range(12):
        text = " ".join(common + [f"w{k}x{i}" for i in range(25)])
        (data,) = encoder.encode([text.encode()])
        assert np.frombuffer(data, "<u2").tolist() + [2] == encode(text)
        assert encoder.table.words <= 60 + 31
    assert [asked.count(w) for w in common] == [1] * len(common)
    table = encoder.table
    table.renew(2, 0)
    assert table.words <= 2 and not table.filled
