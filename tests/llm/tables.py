"""Small tables with the awkward cases: nulls, empty and long texts, copies, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

SYLLABLES = "ba ke li mo nu pra ste or an the un der il con ta ri".split()
UMLAUTS = "ä ö ü ß ach ung keit der die sch".split()
EXTRA = "size int, target string, shard int, slot string, n_words string, score string, _h string, position int, copies string, component_id string, row int, part int, kept string, fp string, lang_pred string, _base int, _k0 string, _in int, _b int, _extra int, _source string, _place int, _cum int, _u double, _w string, _l string, _row string, _t int, _slope string, _bend int, _s string, _n int, node string, _text int, _id string, fail_bits string, dims int, target_bytes int"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, syllables=SYLLABLES) -> str:
    out = []
    for i in range(words):
        out.append("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))))
        if i % 12 == 11:
            out[-1] += "."
    return " ".join(out)


def documents(n: int = 60, seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(55, 220), UMLAUTS if i % 4 == 3 else SYLLABLES) for i in range(n)]
    passage = prose(rng, 60)
    rows = []
    for i, t in enumerate(base):
        if i % 7 == 0:
            t = t + "\n" + passage + "\n" + prose(rng, 20)
        rows.append((i, t, "de" if i % 4 == 3 else "en", None if i % 11 == 0 else f"s{i % 3}"))
    rows += [(100 + i, base[i], "en", "s0") for i in range(5)]  # exact copies
    rows += [(110 + i, base[i + 5].replace(base[i + 5].split()[9], "zzz", 1), "en", "s1") for i in range(5)]  # near copies
    rows += [(120, None, None, None), (121, "", "en", "s2"), (122, " \n\t ", None, "s2"), (123, "ab", "en", "s0"), (124, "!!! ??? 123", None, "s1")]
    rows += [(125, "word " * 300, "en", "s0"), (126, "x" * 5000, "en", "s1"), (127, "line one here\n" * 60, "en", "s1"), (128, prose(rng, 9000), "en", "s2")]
    rows += [(None, base[1], "en", "s0"), (None, "lonely text without an id " + prose(rng, 70), "en", "s0"), (3, base[3], "de", "s0"), (3, base[3], "de", "s0"), (130, "naïve Ünïcode ☃ text here " * 20, None, "s0")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def write(spark, folder, docs=None, extra: bool = True, **more) -> str:
    df = spark.createDataFrame(docs if docs is not None else documents(), DOC)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({n.split()[0]: F.lit("7").cast(n.split()[1]) for n in EXTRA.split(", ")})
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name, (rows, schema) in more.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def extras() -> list[str]:
    return [n.split()[0] for n in EXTRA.split(", ")]


def assert_kept(rows, results, but=()) -> None:
    """Columns with clashing names keep their values, but those named like results."""
    names = [n for n in extras() if n not in results and n not in but]
    for r in rows:
        d = r.asDict()
        assert all(float(d[n]) == 7 for n in names), d


def texts(spark, folder) -> list:
    return spark.read.parquet(f"{folder}/documents.parquet").collect()
