import random
import re
from collections import Counter, defaultdict

import pytest
from llm import tables
from oracle import same
from pyspark.sql import functions as F

from isogrid.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict):
    """Water-filling by rounds; sources in order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, total = {}, set(names), float(sum(sizes.values()))
    while left:
        level = total / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        for s in over:
            out[s] = 3.0 * sizes[s]
            total -= out[s]
        left -= over
    return out


def check(rows, docs):
    size = Counter((d.doc_id, len(WORD.findall(d.text or "")), d.source) for d in docs)
    sizes = defaultdict(int)
    for (_, n, s), c in size.items():
        sizes[s] += n * c
    want = targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == size
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and 0 <= r.position <= 1
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]


def test_awkward_cases(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    assert len(mixing.op6_mixing(spark, folder).collect()) == len(tables.documents())
    check(mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect(), tables.texts(spark, folder))


@pytest.mark.parametrize("seed", range(3))
def test_targets_with_stops(spark, tmp_path, seed):
    rng = random.Random(seed)
    docs = [(i, "w " * rng.choice([1, 5, 50]), None, rng.choice(["a"] * 30 + ["b", "c", "d", "e", None, "f", "g"]), 1) for i in range(150)]
    folder = tables.write(spark, tmp_path, docs, extra=False)
    check(mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect(), tables.texts(spark, folder))
    same(mixing.op6_mixing(spark, folder), mixing.ORACLE, folder)


def test_many_buckets_give_the_same(spark, tmp_path, monkeypatch):
    folder = tables.write(spark, tmp_path)
    a = sorted(map(str, mixing.op6_mixing(spark, folder).collect()))
    monkeypatch.setattr(mixing, "buckets_for", lambda n: 13)
    assert sorted(map(str, mixing.op6_mixing(spark, folder).collect())) == a


def test_order_and_inversion(spark, tmp_path):
    rows = mixing.op6_mixing(spark, tables.write(spark, tmp_path)).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    u = spark.range(101).select((F.col("id") / 100).alias("u"))
    for s in (-0.5, 0.0, 0.5, 1.0, -1.0):
        for r in u.select("u", mixing.invert(F.col("u"), F.lit(s)).alias("t")).collect():
            assert abs(r.t + s * (r.t**2 - r.t) - r.u) < 1e-9


def test_emit_repeats_by_copies(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] += r.copies
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in out.collect())
    assert got == +want


def test_empty_and_wordless(spark, tmp_path):
    assert mixing.op6_mixing(spark, tables.write(spark, tmp_path / "a", [])).collect() == []
    rows = mixing.op6_mixing(spark, tables.write(spark, tmp_path / "b", [(1, None, None, None, None), (2, "", None, "s", 0)])).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0)] * 2


def test_native_plan(spark, tmp_path):
    plan = mixing.op6_mixing(spark, tables.write(spark, tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_pass(spark, tmp_path):
    docs = spark.read.parquet(tables.write(spark, tmp_path) + "/documents.parquet")
    tables.assert_kept(mixing.mix(docs).collect(), set(mixing.RESULTS))
    tables.assert_kept(mixing.emit(docs).collect(), set())


def test_positions_are_shares_of_the_run(spark, tmp_path):
    """Words taken before a document, of all sources, are its position's share, whatever the slopes."""
    rng = random.Random(9)
    docs = [(i, "w " * rng.randint(1, 9), None, f"s{min(2, i % 5)}", 1) for i in range(900)]
    folder = tables.write(spark, tmp_path, docs, extra=False)
    out = mixing.emit(spark.read.parquet(f"{folder}/documents.parquet"))
    n = out.count()
    by_id = {r.doc_id: r for r in mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    total, seen = sum(r.taken for r in by_id.values()), 0
    first = {}
    for k, r in enumerate(out.select("doc_id").collect()):
        if r.doc_id not in first:
            first[r.doc_id] = seen / total
        seen += by_id[r.doc_id].size
    assert n == sum(r.copies for r in by_id.values())
    assert all(abs(first[d] - by_id[d].position) < 0.02 for d in first)


def test_repeated_rows(spark, tmp_path):
    """A third of all rows are one row, and as many have no doc_id."""
    docs = [(7, "same words here", None, "a", 1)] * 100 + [(None, f"text {i}", None, "a", 1) for i in range(100)] + [(1000 + i, "w " * 9, None, "b", 1) for i in range(100)]
    folder = tables.write(spark, tmp_path, docs, extra=False)
    check(mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect(), tables.texts(spark, folder))
    same(mixing.op6_mixing(spark, folder), mixing.ORACLE, folder)
