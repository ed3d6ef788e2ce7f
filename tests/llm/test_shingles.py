import random

import corpus_pipeline
from llm import tables

from isogrid.llm import shingles


def words5(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(docs):
    """Least index of each document's component, by all pairs."""
    sets, up = [words5(d.text) for d in docs], list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))]


def edited(rng, t, n):
    w = t.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def rows():
    """Texts with one to eight words altered, about both sides of 0.8, all with the same long line, and the awkward ones."""
    rng = random.Random(5)
    line = tables.prose(rng, 40)
    out = [(1000 + i * 10 + n, edited(rng, t, n) if n else t, "en", "s0", None) for i, t in enumerate(tables.prose(rng, rng.randint(90, 260)) + " " + line for _ in range(25)) for n in range(9)]
    return tables.documents() + out


def check(docs, stay):
    root = groups(docs)
    least = {}
    for d, r in zip(docs, root):
        if r not in least or (d.doc_id is not None and (least[r] is None or d.doc_id < least[r])):
            least[r] = d.doc_id
    assert sorted((r.doc_id for r in stay), key=str) == sorted(least.values(), key=str)


def test_stage_drops_all_pairs_of_similarity_08(spark, tmp_path):
    docs = spark.read.parquet(f"{tables.write(spark, tmp_path, rows())}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    check(docs.collect(), out.collect())


def test_frequent_shingles_alter_no_result(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{tables.write(spark, tmp_path, rows())}/documents.parquet")
    want = sorted(tuple(r) for r in shingles.near_duplicates(docs).select("text_hash", "component_id").collect())
    monkeypatch.setattr(shingles, "frequent", lambda docs: shingles.np.zeros(0, shingles.np.uint64))
    assert sorted(tuple(r) for r in shingles.near_duplicates(docs).select("text_hash", "component_id").collect()) == want


def test_summary_keeps_frequent_tokens():
    """A count is never too large, and short by at most the tokens / counters."""
    import numpy as np

    rng = np.random.default_rng(0)
    stream = np.r_[rng.integers(0, 1 << 60, 20_000), np.repeat(rng.integers(0, 1 << 60, 20), 500)].astype(np.uint64)
    rng.shuffle(stream)
    summary = shingles.Summary(200)
    for part in np.array_split(stream, 30):
        summary.add(part)
    assert len(summary.tokens) <= 200
    true = dict(zip(*(x.tolist() for x in np.unique(stream, return_counts=True))))
    kept = dict(zip(summary.tokens.tolist(), summary.counts.tolist()))
    assert all(true[t] - len(stream) / 200 <= kept.get(t, 0) <= true[t] for t in true)


def test_stage_takes_simhash_links_first(spark, tmp_path, monkeypatch):
    """SimHash's candidates reach the check; the index forms no pair between texts that they connect, and candidates that aren't similar connect nothing."""
    docs = spark.read.parquet(f"{tables.write(spark, tmp_path, rows())}/documents.parquet")
    kept, write = {}, shingles.materialize

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(shingles, "materialize", keep)
    given = []
    monkeypatch.setattr(corpus_pipeline.simhash, "links", lambda *a, f=corpus_pipeline.simhash.links: given.append(f(*a)) or given[-1])
    corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).count()
    assert len(given) == 1 and given[0].count()
    near = {tuple(r) for r in kept["shingle-checked"].collect()}
    assert near and not near & {tuple(r) for r in kept["shingle-pairs"].collect()}
    texts = docs.selectExpr("xxhash64(coalesce(text, '')) AS h").distinct()
    wrong = texts.selectExpr("h AS a").join(texts.limit(3).selectExpr("h AS b"), how="cross").filter("a < b")
    check(docs.collect(), corpus_pipeline.simhash.one_of_each(docs, shingles.near_duplicates(docs, wrong)).collect())
