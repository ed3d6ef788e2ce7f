"""Quality rules as a ledger of bits, in DataFrame expressions only.

Each rule is evaluated once a document: its measurements and one failure bit a rule go into the ledger, which is stored. A policy
is a version and the mask of the rules that reject; policies and ablations read the stored bits, never the texts.

Defined cases: null text has no words and fails SHORT; an empty table gives an empty ledger; repeated rows are judged each
for itself; other columns pass through, whatever their names, but a column named like a measurement is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import ASCII_SPACE, WORD, materialize, nested, table, unnested

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim")

#: Bit of each rule, and when it fails. Ratios are in whole numbers, so any engine agrees.
RULES: dict[str, tuple[int, Callable[[], Column]]] = {
    "short": (0, lambda: F.col("n_words") < 50),
    "repeats": (1, lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    "symbols": (2, lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    "dup_lines": (3, lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    "word_length": (4, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    "exclaim": (5, lambda: 100 * F.col("n_exclaim") > 60 * F.col("n_words")),
}
BASE = ("short", "repeats")
#: Versioned policies: the rules of which none may fail.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbols", "dup_lines"), "v2": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are named by a 64-bit hash within their text."""

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1), x + 3) - x))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, lambda s: _let(repeated(s), covered)))

    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, of))


def ledger(docs: DataFrame) -> DataFrame:
    """The documents with their measurements and fail_bits."""
    rows = nested(docs, "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    drop = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    by_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    measured = rows.withColumns(
        {
            "_w": by_words,
            "_l": by_lines,
            "word_chars": F.length(F.translate(text, ASCII_SPACE, "")).cast("long"),
            "n_symbols": drop(SYMBOLS).cast("long"),
            "n_exclaim": drop("!").cast("long"),
        }
    ).withColumns({"n_words": F.col("_w.n_words"), "n_repeat_words": F.col("_w.n_repeat_words"), "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines")})
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(failed(), F.lit(1 << bit)).otherwise(0) for bit, failed in RULES.values()])
    return unnested(measured.withColumn("fail_bits", bits.cast("long")), docs.columns, [*MEASURES, "fail_bits"])


def apply_policy(book: DataFrame, version: str, out: str = "kept") -> DataFrame:
    """Adds whether a document passes that version of the policy."""
    return book.withColumn(out, F.col("fail_bits").bitwiseAND(mask(POLICIES[version])) == 0)


def ablations(book: DataFrame, version: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, those that fail it alone, and those kept without it. One pass over the bits."""
    rules, all_bits = POLICIES[version], F.lit(mask(POLICIES[version])).cast("long")
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(all_bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in rules]))
    n = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    return (
        counts.select("bits", "n", one.alias("r")).select("bits", "n", "r.rule", "r.bit").groupBy("rule")
        .agg(n(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"), n(F.col("bits") == F.col("bit"))("failed_alone"), n(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("kept_without"))
    )


def ablation_report(book: DataFrame) -> DataFrame:
    """The ablations of all policies: version, rule, failed, failed_alone, kept_without."""
    reports = [ablations(book, v).select(F.lit(v).alias("version"), "rule", "failed", "failed_alone", "kept_without") for v in POLICIES]
    return reduce(DataFrame.unionByName, reports)


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder: doc_id, measurements, fail_bits."""
    return materialize(ledger(docs.select("doc_id", "text")).select("doc_id", *MEASURES, "fail_bits"), "quality-ledger")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule of which policy rejects how many documents, from the bits of the stored ledger."""
    return ablation_report(stored(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(stored(table(spark, sf_dir, "documents")), "v2")
    failed = F.col("fail_bits").bitwiseAND(mask(BASE)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "n_lines", "n_exclaim", "fail_bits")


_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
s AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM i),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM s),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclaim,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                 + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
                 + CASE WHEN 100 * n_exclaim > 60 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
"""

ORACLE = _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_exclaim, fail_bits FROM b"

_ONE = "SELECT '{version}' AS version, '{rule}' AS rule, coalesce(sum(CASE WHEN fail_bits & {bit} <> 0 THEN 1 ELSE 0 END), 0)::BIGINT AS failed, coalesce(sum(CASE WHEN fail_bits & {mask} = {bit} THEN 1 ELSE 0 END), 0)::BIGINT AS failed_alone, coalesce(sum(CASE WHEN fail_bits & {rest} = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS kept_without FROM b"
ABLATIONS = _LEDGER + " UNION ALL ".join(_ONE.format(version=v, rule=r, bit=1 << RULES[r][0], mask=mask(rules), rest=mask(rules) & ~(1 << RULES[r][0])) for v, rules in POLICIES.items() for r in rules)
