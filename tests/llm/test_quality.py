import random
import re
import zlib
from collections import Counter

import pytest
from llm import tables
from oracle import same
from pyspark.sql import functions as F

from isogrid.llm import quality_rules as qr
from isogrid.llm.quality_model import op2_quality_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep)


def test_rules_against_brute_force(spark, tmp_path):
    folder = tables.write(spark, tmp_path, tables.documents() + [(200, "a b c a b c d e a b c", None, None, 1), (201, "x\x0by\x0cz ☃ é", None, None, 1), (202, "# * $ % & | < >", None, None, 1)])
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.op3_quality_rules(spark, folder).collect())
    want = Counter()
    for r in tables.texts(spark, folder):
        m = measures(r.text)
        want[r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]] += 1
    assert got == want


def test_rules_against_sql(spark, tmp_path):
    docs = [d for d in tables.documents() if d[0] not in (None, 3)]
    folder = tables.write(spark, tmp_path, docs, extra=False)
    same(qr.op3_quality_rules(spark, folder), qr.ORACLE, folder)


def test_kept_follows_the_policy_and_ablations(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    book = qr.ledger(spark.read.parquet(f"{folder}/documents.parquet"))
    bits = [r.fail_bits for r in book.collect()]
    for version, rules in qr.POLICIES.items():
        m = qr.mask(rules)
        assert qr.apply_policy(book, version).filter("kept").count() == sum(not b & m for b in bits)
        for r in qr.ablations(book, version).collect():
            bit = 1 << qr.RULES[r.rule][0]
            assert (r.failed, r.failed_alone, r.kept_without) == (sum(b & bit != 0 for b in bits), sum(b & m == bit for b in bits), sum(not b & m & ~bit for b in bits))


def test_clashing_columns_pass(spark, tmp_path):
    docs = spark.read.parquet(tables.write(spark, tmp_path) + "/documents.parquet")
    tables.assert_kept(qr.ledger(docs).collect(), {*qr.MEASURES, "fail_bits"})


def test_ablations_against_sql(spark, tmp_path):
    folder = tables.write(spark, tmp_path, [d for d in tables.documents() if d[0] not in (None, 3)], extra=False)
    same(qr.quality_ablations(spark, folder), qr.ABLATIONS, folder)


def test_rules_on_nothing(spark, tmp_path):
    assert qr.op3_quality_rules(spark, tables.write(spark, tmp_path, [])).collect() == []


def test_native_plan(spark, tmp_path):
    plan = qr.op3_quality_rules(spark, tables.write(spark, tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = tables.prose(rng, rng.randint(60, 150))
        if not good:
            t = rng.choice([lambda t: " ".join(w + "***" for w in t.split()), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w for x in t.split()[:8] for w in [x] * 12), lambda t: t.replace(" ", " | ")])(t)
        docs.append((i, t, None, None, 1))
        labels.append((i, int(good), 0))
    return docs, labels


def test_model_on_held_out(spark, tmp_path):
    docs, labels = labelled()
    folder = tables.write(spark, tmp_path, docs + tables.documents()[60:], labels=(labels + [(5000, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = op2_quality_model(spark, folder).collect()
    assert len(rows) == len(tables.texts(spark, folder))
    y = {d: q for d, q, _ in labels}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    own = [r for r in rows if r.held_out and r.doc_id in y and r.doc_id < 900 and r.doc_id >= 200]
    assert sum((r.score >= 0.5) == y[r.doc_id] for r in own) / len(own) > 0.9


def test_model_without_labels_or_rows(spark, tmp_path):
    none = ([], "doc_id long, quality int, toxic int")
    a = tables.write(spark, tmp_path / "a", labels=none)
    assert {r.score for r in op2_quality_model(spark, a).collect()} == {0.5}
    assert op2_quality_model(spark, tables.write(spark, tmp_path / "b", [], labels=none)).collect() == []


def test_labels_are_not_read_from_held_out_rows(spark, tmp_path):
    docs, labels = labelled(300)
    flip = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (op2_quality_model(spark, tables.write(spark, tmp_path / n, docs, labels=(x, schema))).orderBy("doc_id").collect() for n, x in (("a", labels), ("b", flip)))
    assert all(abs(x.score - y.score) < 1e-9 for x, y in zip(a, b))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pieces_cover_all_words(size):
    from isogrid.llm import quality_model as qm

    data = [t.encode() for t in ("one two three " * 5, "", "x" * 50)]
    whole = [b for p in qm._pieces(data, 10**9) for b in p[0].tolist()]
    cut = [b for p in qm._pieces(data, size) for b in p[0].tolist()]
    assert cut == whole or size == 1 or len(cut) >= len(whole)


def test_held_out(spark):
    from isogrid.llm.folds import held_out

    got = {r[0]: r[1] for r in spark.range(50).select("id", held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
