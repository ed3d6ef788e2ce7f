import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm import tables

from isogrid.llm import sharding


def check(rows, docs, shards, near):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) <= set(range(shards))
    mean = sum(size.values()) / shards
    assert all(abs(size[k] - mean) <= near * mean for k in range(shards)), size
    return where


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_near_equal_and_copies_together(spark, tmp_path, shards):
    rng = random.Random(shards)
    texts = [tables.prose(rng, rng.randint(20, 200)) for _ in range(600)]
    docs = [(i, texts[rng.randrange(600)] if i % 3 else texts[i % 600], None, None, 1) for i in range(900)]
    folder = tables.write(spark, tmp_path, docs)
    rows = sharding.shard(spark.read.parquet(f"{folder}/documents.parquet"), shards, slack=0.06).collect()
    assert all(len(s) == 1 for s in check(rows, tables.texts(spark, folder), shards, 0.1).values())


def test_hot_group_is_split(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, "the same text " * 10 if i % 3 else tables.prose(rng, 25), None, None, 1) for i in range(1200)]
    folder = tables.write(spark, tmp_path, docs)
    where = check(sharding.op10_sharding(spark, folder).collect(), tables.texts(spark, folder), 8, 0.05)
    assert max(map(len, where.values())) > 3


def test_awkward_cases(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    rows = sharding.op10_sharding(spark, folder).collect()
    check(rows, tables.texts(spark, folder), 8, 8)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sorted(map(str, sharding.op10_sharding(spark, folder).collect())) == sorted(map(str, rows))


def test_target_bytes(spark, tmp_path):
    docs = [(i, "x" * 99, None, None, 1) for i in range(100)]
    df = spark.read.parquet(tables.write(spark, tmp_path, docs) + "/documents.parquet")
    assert sharding.shard(df, target_bytes=1000).select("shard").distinct().count() == 10


def test_many_buckets_give_gapless_slots(spark, tmp_path, monkeypatch):
    folder = tables.write(spark, tmp_path)
    monkeypatch.setattr(sharding, "buckets_for", lambda n, per: 11)
    check(sharding.op10_sharding(spark, folder).collect(), tables.texts(spark, folder), 8, 8)


def test_few_rows(spark, tmp_path):
    assert sharding.op10_sharding(spark, tables.write(spark, tmp_path / "a", [])).collect() == []
    rows = sharding.op10_sharding(spark, tables.write(spark, tmp_path / "b", [(1, None, None, None, None), (1, None, None, None, None)])).collect()
    assert [(r.size, r.text_crc32) for r in rows] == [(1, 0)] * 2


def test_clashing_columns_pass(spark, tmp_path):
    docs = spark.read.parquet(tables.write(spark, tmp_path) + "/documents.parquet")
    out = sharding.shard(docs, 3)
    assert sorted(out.columns) == sorted({*docs.columns, "size", "text_crc32", "shard", "slot"})
    tables.assert_kept(out.collect(), {"size", "text_crc32", "shard", "slot"})


def test_repeated_rows_are_split(spark, tmp_path):
    docs = [(None, "one text " * 12, None, None, 1)] * 1200
    check(sharding.op10_sharding(spark, tables.write(spark, tmp_path, docs)).collect(), [tables_row(d) for d in docs], 8, 0.05)


def tables_row(d):
    from pyspark.sql import Row

    return Row(doc_id=d[0], text=d[1])


def brute(points, shards):
    """Shard of each point (size, extra, crc), by recursion over sorted lists; points with equal coordinates stay together."""
    span = [max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in range(3)]

    def split(own, first, count):
        if count == 1:
            return dict.fromkeys(own, first)
        if not own:
            return {}
        wide = sorted(range(3), key=lambda d: (-(max(p[d] for p in own) - min(p[d] for p in own)) / span[d], d))
        groups = sorted(set(own), key=lambda p: [p[d] for d in wide])
        weight = Counter()
        for p in own:
            weight[p] += p[0]
        goal, low, cut = sum(weight.values()) * (count // 2) / count, 0, len(groups)
        for i, g in enumerate(groups):
            if low + weight[g] >= goal:
                cut = i + (low + weight[g] - goal < goal - low)
                break
            low += weight[g]
        left = set(groups[:cut])
        return split([p for p in own if p in left], first, count // 2) | split([p for p in own if p not in left], first + count // 2, count - count // 2)

    return split(points, 0, shards)


@pytest.mark.parametrize("shards", [2, 7])
def test_tree_against_brute_force(spark, tmp_path, shards):
    rng = random.Random(shards)
    texts = [tables.prose(rng, rng.randint(5, 30), tables.UMLAUTS if i % 3 else tables.SYLLABLES) for i in range(150)] + ["abc"] * 5
    docs = spark.read.parquet(tables.write(spark, tmp_path, [(i, t, None, None, 1) for i, t in enumerate(texts)]) + "/documents.parquet")
    point = lambda t: (len(t.encode()) + 1, len(t.encode()) - len(t), zlib.crc32(t.encode()))
    want = brute([point(t) for t in texts], shards)
    for r in sharding.shard(docs, shards, slack=100).collect():
        assert r.shard == want[point(r.text)]


def test_many_shards(spark):
    """Dozens of shards: expressions don't grow with the tree."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 1 + int(id % 7)) AS text")
    out = sharding.shard(docs, 40, slack=1.0)
    sizes = Counter()
    for r in out.select("shard", "size").collect():
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < 1.5 * mean
