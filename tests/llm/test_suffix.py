import hashlib
import random
from collections import Counter

import pytest
from llm import tables

from isogrid.llm.suffix_dedup import op1_suffix_dedup, remove_repeats


def brute(rows, width=100):
    """rows of (doc_id, bytes), in order; the multiset of results."""
    seen, out = set(), Counter()
    for d, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if (w := b[s : s + width]) in seen:
                gone[s : s + width] = b"\1" * width
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


def check(spark, folder):
    rows = [(r.doc_id, (r.text or "").encode()) for r in tables.texts(spark, folder)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = Counter(tuple(r) for r in op1_suffix_dedup(spark, folder).collect())
    return got, rows


def test_awkward_cases(spark, tmp_path):
    docs = [d for d in tables.documents() if d[0] is not None]  # order among null ids is that of the scan
    got, rows = check(spark, tables.write(spark, tmp_path, docs))
    assert got == brute(rows)


def test_null_ids_come_first(spark, tmp_path):
    t = tables.prose(random.Random(5), 60)
    got, rows = check(spark, tables.write(spark, tmp_path, [(1, t, None, None, 1), (None, t, None, None, 1)]))
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_pieces(spark, tmp_path, seed):
    """Texts glued from few pieces: junctions at every offset, runs of one letter, repeats within a text."""
    rng = random.Random(seed)
    pieces = [tables.prose(rng, rng.randint(3, 40)) for _ in range(12)] + ["a" * 150, "ab" * 90]
    docs = [(i, "".join(rng.choice(pieces)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 9))), None, None, 0) for i in range(120)]
    got, rows = check(spark, tables.write(spark, tmp_path, docs, extra=False))
    assert got == brute(rows)


def test_hot_passage_in_all(spark, tmp_path):
    rng = random.Random(9)
    passage = tables.prose(rng, 50)
    docs = [(i, tables.prose(rng, 5) + passage + tables.prose(rng, 5), None, None, 0) for i in range(200)]
    got, rows = check(spark, tables.write(spark, tmp_path, docs))
    assert got == brute(rows)


def test_other_thresholds_and_unstable_input(spark):
    rng = random.Random(4)
    pieces = [tables.prose(rng, 6) for _ in range(6)]
    docs = [(i, "".join(rng.choice(pieces) for _ in range(5))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "text")
    got = {r.doc_id: len(r.kept) for r in remove_repeats(df, threshold=20, stable=False).collect()}
    want = {d: n - g for (d, n, g, _, _), c in brute([(d, t.encode()) for d, t in docs], 20).items()}
    assert got == want


def test_empty(spark, tmp_path):
    assert op1_suffix_dedup(spark, tables.write(spark, tmp_path, [])).collect() == []


def test_text_over_a_slice(spark, tmp_path):
    """A text of over two megabytes, with repeats across the border of a slice, and in other documents."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghij \n", k=2_100_000))
    docs = [(1, long[:1_999_950] + long[500:900] + long[1_999_950:], None, None, 0), (2, long[1_999_800:2_000_300] + " " * 500, None, None, 0), (0, long[77:400], None, None, 0)]
    got, rows = check(spark, tables.write(spark, tmp_path, docs, extra=False))
    assert got == brute(rows)


def test_name_with_many_pairs(spark, tmp_path):
    """One gram with very many surroundings, in many batches: spread over tasks, its rank the same in all."""
    rng = random.Random(12)
    docs = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(30, 60))) + "=" * 60 + rng.choice(["one", "two", "three"]) * 12 + "".join(rng.choice("uv") for _ in range(rng.randint(1, 40))), None, None, 0) for i in range(1500)]
    got, rows = check(spark, tables.write(spark, tmp_path, docs, extra=False))
    assert got == brute(rows)
