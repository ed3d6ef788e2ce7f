import random
import zlib

import numpy as np
from llm import tables

from isogrid.llm.language_id import LENGTH, ByteCNN, op4_language_id, windows


def test_windows_cover_every_byte():
    for n in (0, 1, LENGTH - 1, LENGTH, LENGTH + 1, 5 * LENGTH, 5 * LENGTH + 7):
        t = bytes(random.Random(n).choices(range(1, 256), k=n))
        w = windows(t)
        assert w.shape[1] == LENGTH
        full = n // LENGTH
        assert w[:full].tobytes() == t[: full * LENGTH] and (n <= LENGTH or w[-1].tobytes() == t[-LENGTH:])


def test_pair_tables_equal_plain_convolution():
    m = ByteCNN(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, LENGTH)).astype(np.uint8)
    want = []
    for k, c in enumerate(m.conv):
        w = len(c)
        h = sum(c[j][x[:, j : LENGTH - w + 1 + j]] for j in range(w))
        want.append(np.maximum(h.max(axis=1) + m.bias[k], 0))
    assert np.allclose(m.features(x, m._pairs()), np.hstack(want), atol=1e-5)


def test_held_out_accuracy_and_awkward_cases(spark, tmp_path):
    rng = random.Random(2)
    sets = {"en": tables.SYLLABLES, "de": tables.UMLAUTS, "xx": "qua zé ñi çõ lhe".split()}
    docs = [(1000 + i, tables.prose(rng, rng.randint(10, 120), sets[lang]), lang, "s", 1) for i in range(450) for lang in [list(sets)[i % 3]]]
    folder = tables.write(spark, tmp_path, docs + tables.documents()[60:])
    rows = op4_language_id(spark, folder).collect()
    assert len(rows) == len(docs) + len(tables.documents()[60:])
    lang = {d[0]: d[2] for d in docs}
    own = [r for r in rows if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) / len(own) > 0.95
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {120, 121, 122, 124}


def test_nothing_to_learn_from(spark, tmp_path):
    a = tables.write(spark, tmp_path / "a", [(1, "some text", None, None, 1)])
    assert [(r.lang_pred, r.score) for r in op4_language_id(spark, a).collect()] == [("und", 0.0)]
    assert op4_language_id(spark, tables.write(spark, tmp_path / "b", [])).collect() == []
