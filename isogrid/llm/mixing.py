"""Mixing sources to target weights as a time-varying curriculum, in DataFrame expressions only.

Sources in order of code points, null last, weigh 5, 2, 1, repeating. All words are shared out by weight; a source's target stops at
`most` times its size, and the excess is shared again by weight until no target is above its stop. In closed form: sources are
sorted by stop / weight, and the stopped ones are a prefix of that order.

A source's weight changes over the training time t in [0, 1] as 1 + slope * (2t - 1). Its integral is t + slope * (t^2 - t), 1 at the
end, so the whole run meets the target. A document's place in its source's token stream, inverted through that source's demand, is the time at
which it is due. By then the run has used all sources' demands, sum of target * (t + slope * (t^2 - t)): divided by all targets, that is the
document's training position, the share of the run's tokens before it. So positions are evenly filled with tokens whatever the slopes.
emit() repeats documents by their copies and range-sorts them by position.

Documents go whole, in hash order (of doc_id and text) within their source: floor(target / size) passes over all, and one copy more of those whose
middle lies within the rest. So a source's taken words miss its target by half a document at most. Order and sums run in hash
buckets whose number grows with the rows; no task holds a whole source, or all documents without a doc_id. Rows that repeat doc_id and text are first summed
up by a salt of their row number, so that they spread as well. The table of sources is ordered in one task: some 100 bytes a source.

Defined cases: null text has size 0 and takes 0; a source without words has target 0, its documents no copies; null doc_id
takes part as any other; equal doc_ids are ordered by text; an empty table gives an empty result; other columns pass
through, whatever their names, but columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import WORD, buckets_for, materialize, nested, running, table, unnested

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)


SALTS = 64


def sized(docs: DataFrame, text: bool = False) -> DataFrame:
    """_row (the document, without its text unless asked for), doc_id, source, size (words), the hash that orders documents within their source, and a salt of the row's number."""
    kept = docs if text else docs.drop("text")
    rows = nested(docs, "doc_id", "source", "text") if text else docs.select(nested_of(kept), "doc_id", "source", "text")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.md5(body))), 1, 15), 16, 10).cast("long")
    return rows.select("_row", "doc_id", "source", F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), order.alias("_h"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("_s"))


def nested_of(docs: DataFrame) -> Column:
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = 3) -> DataFrame:
    """source, source_size, _slope, target, _bend (all sources' slope); one row a source. The windows run over that table only."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")).cast("long")
    all_ = Window.partitionBy()
    before = Window.orderBy(F.col("_stop") / F.col("_weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    s = by.withColumn("_place", place).withColumn("_weight", weight).withColumn("_stop", most * F.col("source_size"))
    s = s.withColumns({"_free": F.sum("source_size").over(all_) - F.coalesce(F.sum("_stop").over(before), F.lit(0)), "_left": F.sum("_weight").over(all_) - F.coalesce(F.sum("_weight").over(before), F.lit(0))})
    level = F.col("_free").cast("double") / F.col("_left")
    # the first source, in the order of stop / weight, that the level leaves below its stop sets the level for it and all after it
    fits = F.col("_stop") >= level * F.col("_weight")
    s = s.withColumn("_level", F.when(fits, level))
    from_here = F.first("_level", ignorenulls=True).over(Window.orderBy(F.col("_stop") / F.col("_weight"), "_place").rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(F.col("_at").isNull(), F.col("_stop").cast("double")).otherwise(F.least(F.col("_at") * F.col("_weight"), F.col("_stop").cast("double")))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("_place") % len(slopes) + 1).cast("int"))
    s = s.withColumn("_at", from_here).withColumns({"target": target, "_slope": slope})
    # the slope of all demands together
    ordered = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("target").over(ordered)
    bend = F.when(total > 0, F.sum(F.col("target") * F.col("_slope")).over(ordered) / total).otherwise(0.0)
    return s.select("source", "source_size", "_slope", "target", bend.alias("_bend"))


def invert(u: Column, slope: Column) -> Column:
    """The time t at which the integral t + slope * (t^2 - t) reaches u."""
    b = 1 - slope
    root = (F.sqrt(F.greatest(b * b + 4 * slope * u, F.lit(0.0))) - b) / (2 * slope)
    return F.when(slope == 0, u).otherwise(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)))


def position(time: Column) -> Column:
    """The share of the run's tokens that are due before a time."""
    return time + F.col("_bend") * (time * time - time)


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = 3) -> DataFrame:
    """Of stored sized rows: source_size, target, copies, taken, position of the first copy; _u, its place in the source's demand, and _ahead, how far a pass moves it."""
    key = ["source", "_h", "doc_id", "size", "_s"]
    groups = sizes.groupBy(*key).agg(F.sum("size").alias("_words"))  # equal rows with equal salts are one
    n = buckets_for(sizes.count())
    groups = running(groups.withColumn("_b", F.floor(F.col("_h") / F.lit(float(1 << 60)) * n).cast("long")), ["source"], "_b", ["_h", "doc_id", "size", "_s"], F.col("_words"), "_start")
    groups = groups.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(key)], "_start")
    again = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(key)]
    rows = sizes.withColumn("_again", again).join(groups, same, "left")
    rows = rows.withColumn("_cum", F.col("_start") + F.col("_again") * F.col("size")).drop("_start", "_again", "_s", *[f"_g{i}" for i in range(len(key))])
    t = targets(sizes, weights, slopes, most).withColumnRenamed("source", "_source")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    rest = F.col("target") - F.col("_passes") * size
    more = F.when((size > 0) & (2 * F.col("_cum") + F.col("size") <= 2 * rest), 1).otherwise(0)
    rows = rows.withColumn("_passes", passes).withColumn("copies", F.least(F.col("_passes") + more, F.lit(most)).cast("int"))
    middle = F.col("_cum") + F.col("size") / 2
    rows = rows.withColumns({"taken": F.col("copies") * F.col("size"), "_u": F.when(F.col("target") > 0, middle / F.col("target")).otherwise(0.0), "_ahead": F.when(F.col("target") > 0, size / F.col("target")).otherwise(0.0)})
    return rows.withColumn("_t", invert(F.least(F.col("_u"), F.lit(1.0)), F.col("_slope"))).withColumn("position", position(F.col("_t"))).drop("_passes", "_cum", "_t")


RESULTS = ["size", "source_size", "target", "taken", "copies", "position"]


def mix(docs: DataFrame, **how) -> DataFrame:
    """All columns of the documents but the text, with their part in the mix. The sizes are written once, the texts read once."""
    return unnested(plan(materialize(sized(docs), "mix-sizes"), **how), [c for c in docs.columns if c.lower() != "text"], RESULTS)


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, range-sorted by training position. All columns as they were."""
    rows = sized(docs, text=True)
    p = plan(materialize(rows.drop("_row"), "mix-sizes"), **how)
    # joined by one number, as rows that agree in it, that is in doc_id and text, may take each other's places
    p = p.select(F.xxhash64("source", "_h", "doc_id", "size").alias("_p"), "_u", "_ahead", "_slope", "_bend", "copies")
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_u"))).filter("copies > 0")
    rows = rows.select("_row", F.xxhash64("source", "_h", "doc_id", "size").alias("_q"))
    rows = rows.withColumn("_r0", F.row_number().over(Window.partitionBy("_q").orderBy(F.lit(0))))
    out = rows.join(p, (F.col("_q") == F.col("_p")) & (F.col("_r0") == F.col("_r"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    time = invert(F.least(F.col("_u") + F.col("_k") * F.col("_ahead"), F.lit(1.0)), F.col("_slope"))
    out = out.withColumn("_t", time).withColumn("position", position(F.col("_t")))
    return out.orderBy("position", F.col("_q")).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("position"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '-' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1]::BIGINT AS weight, [-0.5, 0.0, 0.5][place % 3 + 1]::DOUBLE AS slope, 3 * source_size AS stop FROM s),
c AS (SELECT *, sum(source_size) OVER () - coalesce(sum(stop) OVER o, 0) AS free, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest
      FROM w WINDOW o AS (ORDER BY stop::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, first(CASE WHEN stop >= free::DOUBLE / rest * weight THEN free::DOUBLE / rest END IGNORE NULLS)
                OVER (ORDER BY stop::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM c),
t0 AS (SELECT source, source_size, slope, place, CASE WHEN level IS NULL THEN stop::DOUBLE ELSE least(level * weight, stop::DOUBLE) END AS target FROM l),
t AS (SELECT *, CASE WHEN sum(target) OVER () > 0 THEN sum(target * slope) OVER () / sum(target) OVER () ELSE 0.0 END AS bend FROM t0),
r AS (SELECT d.*, t.source_size, t.slope, t.target, t.bend,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM r),
x AS (SELECT *, CASE WHEN source_size > 0 THEN least(passes + CASE WHEN 2 * cum + size <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END, 3) ELSE 0 END::INT AS copies,
             CASE WHEN target > 0 THEN least((cum + size / 2) / target, 1.0) ELSE 0.0 END AS u FROM k),
y AS (SELECT *, CASE WHEN slope = 0 THEN u ELSE least(greatest((sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope), 0), 1) END AS t FROM x)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, round(t + bend * (t * t - t), 6) AS position FROM y
"""
