import hashlib
import random
import re
from collections import Counter

import pytest
from llm import tables

from isogrid.llm import decontaminate as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def brute(docs, items):
    pats = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            pats.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    out = Counter()
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in pats:
                    hit |= set(range(k, k + n))
                    found |= pats[p]
        out[d.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def items(rng):
    docs = tables.documents()
    w = docs[2][1].split()
    out = [(1, " ".join(w[5:30]).upper()), (2, " ".join(w[20:32])), (10, "-".join(w[0:11])), (2, " ".join(w[20:32])), (3, None), (4, " .!? "), (5, "line one"), (6, "123"), (7, tables.prose(rng, 15)), (None, "ünïcode ☃ text here naïve Ünïcode ☃ text here NAÏVE"), (8, "x" * 5000), (9, "ab")]
    return out + [(100 + i, tables.prose(rng, 12)) for i in range(40)]


SCHEMA = "item_id long, text string"


@pytest.mark.parametrize("block", [200_000, 5])
def test_against_brute_force(spark, tmp_path, monkeypatch, block):
    rng = random.Random(0)
    bench = items(rng)
    docs = tables.documents() + [(300, tables.prose(rng, 30) + " " + bench[-1][1] + ". " + tables.prose(rng, 5), None, None, 1)]
    folder = tables.write(spark, tmp_path, docs, benchmark=(bench, SCHEMA))
    write = dc.write_patterns
    monkeypatch.setattr(dc, "write_patterns", lambda b, w: write(b, w, block))
    got = Counter(tuple(r) for r in dc.op8_decontaminate(spark, folder).collect())
    assert got == brute(tables.texts(spark, folder), bench)


def test_search_finds_all_overlaps():
    rng = random.Random(1)
    text = " ".join(rng.choice(["aa", "ab", "b", "ba"]) for _ in range(3000))
    text = f" {text} ".encode()
    for low, high in ((1, 4), (3, 9), (8, 12)):
        pats = sorted({b" " + b" ".join(rng.choice([b"aa", b"ab", b"b", b"ba"]) for _ in range(rng.randint(low, high))) + b" " for _ in range(60)})
        t = dc.WuManber(pats, ["i"] * len(pats))
        want = {(i, p) for p in pats for i in range(len(text)) if text.startswith(p, i)}
        got = [(a, t.patterns[k]) for a, k in t.search(text)]
        assert set(got) == want and len(got) == len(want)


def test_clean_keeps_the_rest_whole(spark, tmp_path):
    bench = items(random.Random(0))
    folder = tables.write(spark, tmp_path, benchmark=(bench, SCHEMA))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = dc.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert out.columns == docs.columns
    assert Counter(map(str, out.collect())) == Counter(str(d) for d in tables.texts(spark, folder) if not next(iter(brute([d], bench)))[-1])


def test_empty_sides(spark, tmp_path):
    assert dc.op8_decontaminate(spark, tables.write(spark, tmp_path / "a", [], benchmark=([(1, "a b")], SCHEMA))).collect() == []
    rows = dc.op8_decontaminate(spark, tables.write(spark, tmp_path / "b", benchmark=([], SCHEMA))).collect()
    assert len(rows) == len(tables.documents()) and not any(r.contaminated for r in rows)
