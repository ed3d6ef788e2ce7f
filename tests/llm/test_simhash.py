import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from llm import tables

from isogrid.llm import simhash
from isogrid.llm.components import components


def fingerprint(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in b.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if x]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h)) if h else 0


def roots(prints):
    """Least member of each print's component, by all pairs."""
    p = sorted(set(prints))
    up = {x: x for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    v = np.array(p, np.uint64)
    for i, x in enumerate(p):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3) + i + 1:
            a, b = find(x), find(p[j])
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def test_blocks_avoid_any_three_positions():
    assert len(simhash.BLOCKS) == 14
    for bad in combinations(range(8), 3):
        assert any(not set(bad) & set(b) for b in simhash.BLOCKS)


def test_tally_separates_shared_bytes():
    """Pairs that share m bytes in place meet in C(m, 3) lists: only from five shared bytes on, the minimum is reached."""
    rng = random.Random(0)
    for m in range(9):
        x = rng.getrandbits(64).to_bytes(8, "little")
        same = set(rng.sample(range(8), m))
        y = bytes(c if i in same else c ^ rng.randint(1, 255) for i, c in enumerate(x))
        meet = sum(all(x[i] == y[i] for i in t) for t in simhash.TRIPLES)
        assert (meet >= simhash.MINIMUM) == (m >= 5)


@pytest.mark.parametrize("words", [0, 1, 2, 3, 4, 255, 257, 258, 600, 70_000])
def test_fingerprints(words):
    t = tables.prose(random.Random(words), words)
    assert simhash.fingerprint(t.encode()) == fingerprint(t)


def test_against_brute_force(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    docs = tables.texts(spark, folder)
    prints = [fingerprint(d.text) for d in docs]
    root = roots(prints)
    least = {}
    for d, p in zip(docs, prints):
        if d.doc_id is not None:
            least[root[p]] = min(least.get(root[p], d.doc_id), d.doc_id)
    want = sorted(((d.doc_id, f"{p:016x}", least.get(root[p])) for d, p in zip(docs, prints)), key=str)
    assert sorted((tuple(r) for r in simhash.op7_simhash(spark, folder).collect()), key=str) == want


@pytest.mark.parametrize("long_list", [4, 10_000])
def test_links_reach_all_pairs(spark, long_list):
    """Dense clusters: with long lists, with short ones, the components are those of all pairs."""
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(200)} | {0}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(80):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    edges = simhash.links(df, long_list)
    for r in edges.collect():
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3
    found = {r.node: r.root for r in components(edges).collect()}
    want = roots(prints)
    groups = {}
    for x in prints:
        groups.setdefault(want[x], set()).add(found.get(signed(x), signed(x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_variants_of_long_lists_are_not_broadcast(spark):
    """They are thousands of rows a fingerprint, which Spark's estimate doesn't know: a broadcast would hold them all in the driver."""
    x = random.Random(5).getrandbits(63)
    prints = [x, *(x ^ 1 << i for i in range(63)), *(x ^ 1 << i ^ 1 << j for i, j in combinations(range(16), 2))]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16m")
    try:
        found = {r.node: r.root for r in components(simhash.links(df, 4)).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert found == dict.fromkeys(prints, min(prints))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    nodes = list(range(400))
    rng.shuffle(nodes)
    edges = list(zip(nodes[:150], nodes[1:150])) + [(nodes[200], x) for x in nodes[201:300]] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    root = roots([fingerprint(d.text) for d in tables.texts(spark, folder)])
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    stay = out.collect()
    groups = [root[fingerprint(r.text)] for r in stay]
    assert len(groups) == len(set(groups)) == len(set(root.values()))
    assert {r.doc_id for r in stay} >= set(range(60)) and None in {r.doc_id for r in stay}


def test_empty(spark, tmp_path):
    assert simhash.op7_simhash(spark, tables.write(spark, tmp_path, [])).collect() == []
