from collections import Counter

import pytest
from llm import tables
from llm.test_decontaminate import SCHEMA, brute, items
from llm.test_quality import measures

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import random  # noqa: E402


def similar(texts):
    """Number of each text's component: five-word shingles, Jaccard similarity of 0.8 or more, by all pairs."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def expected(docs, bench):
    """What the first three stages leave, by brute force."""

    def passes(t):
        n, chars, sym, dup, rep = measures(t)
        lines = sum(any(c not in " \t\n\x0b\x0c\r" for c in x) for x in (t or "").split("\n"))
        return not (n < 50 or 100 * rep > 50 * n or 100 * sym > 20 * n or 100 * dup > 50 * lines or chars < 2 * n or chars > 20 * n or 100 * (t or "").count("!") > 60 * n)

    kept = [d for d in docs if passes(d.text)]
    root = similar([d.text for d in kept])
    first = {}
    for d, r in zip(kept, root):
        if r not in first or (d.doc_id is not None and (first[r].doc_id is None or d.doc_id < first[r].doc_id)):
            first[r] = d
    return kept, list(first.values()), [d for d in first.values() if not next(iter(brute([d], bench)))[-1]]


def test_stages_against_brute_force(spark, tmp_path):
    bench = items(random.Random(0))
    folder = tables.write(spark, tmp_path, benchmark=(bench, SCHEMA))
    want = expected(tables.texts(spark, folder), bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert Counter(str(r.doc_id) for r in docs.collect()) == Counter(str(d.doc_id) for d in want[k]), name
    assert docs.count() == before.count() and {"shard", "slot", "size"} <= set(docs.columns)
    assert 0 < docs.count() and {r.doc_id for r in docs.select("doc_id").collect()} <= {d.doc_id for d in want[2]}
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_empty(spark, tmp_path):
    folder = tables.write(spark, tmp_path, [], benchmark=([], SCHEMA))
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries()


def test_near_copies_of_one_text_are_not_broadcast(spark):
    """Long lists of fingerprints make thousands of variants each; the stage takes SimHash's links without sending those through the driver."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(600):
        w = list(words)
        w[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16m")
    try:
        pairs = corpus_pipeline.simhash.candidates(docs, 4)  # written at once
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [r.doc_id for r in corpus_pipeline.simhash.one_of_each(docs, corpus_pipeline.shingles.near_duplicates(docs, pairs)).collect()] == [0]
