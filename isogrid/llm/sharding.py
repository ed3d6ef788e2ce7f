"""Shards by a k-d tree over the documents' metadata, split at distributed weighted medians.

Dimensions are metadata of the text alone: bytes, bytes beyond one a character, crc32. So equal texts share all
coordinates, and a split leaves them together. A node that holds several shards is split along its widest
dimension (its range against the whole table's) where the bytes reach the share of the shards on the left, a half for even
numbers; ties in that dimension are split along the next one. A group of equal texts is split, by a hash of doc_id, then, for rows that repeat
even that, by the row's own number, only where whole it would put a split off by more than `slack` of a shard's bytes.

The tree grows a level at a time, all nodes of a level at once. Each point carries its node's number; the splits of a level are a small
table (one row a node) that is broadcast to the points, so expressions don't grow with the tree. A median comes from histograms over
BITS bits of the coordinate at a time; their bins are summed up by node on the executors, and only the bin that holds the median is
returned. So the driver sees one row a node, at most one a shard, whatever the table's size.

Law `bytes`: sizes near equal. Slots run from 0 in hash order within a shard.

Defined cases: null text has size 1 and crc32 0; null doc_id counts as an empty one; repeated rows count each; an empty table
gives an empty result; other columns pass through, whatever their names, but columns named like the results are replaced.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import buckets_for, hash_bucket, materialize, nested, running, table, unnested

#: Columns of the dimensions. The last two only part equal texts, and rows that repeat doc_id and text.
DIMS = ("size", "_extra", "text_crc32")
ORDER = (*DIMS, "_h", "_n")
BITS, PASSES = 17, 2  # coordinates lie below 2^34
SPLIT = "node int, dims array<int>, values array<long>, ties boolean, shift int, prefix long, goal double, low double, n int"


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """_row (the document), the columns named in more, the dimensions, and two coordinates that part equal texts."""
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    rows = nested(docs, *more).withColumns({"_text": F.col("_row").getField(_named(docs, "text")), "_id": F.col("_row").getField(_named(docs, "doc_id"))})
    return rows.select(
        "_row", *more,
        (F.octet_length(text) + 1).cast("long").alias("size"), (F.octet_length(text) - F.length(text)).cast("long").alias("_extra"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit(""))), 31).alias("_h"), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 31).alias("_n"),
    )


def _named(docs: DataFrame, name: str) -> str:
    return next(c for c in docs.columns if c.lower() == name)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table from a literal, one row a node."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([{k: v for k, v in zip(names, r) if v is not None} for r in rows])
    fields = ", ".join(x.replace(" ", ": ", 1) for x in schema.split(", "))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def _root() -> Column:
    """Zero, in a form that the optimizer doesn't fold: a join by a constant would have no key left."""
    return F.when(F.col("size") < 0, 1).otherwise(0)


def _step(i: int) -> tuple[Column, Column]:
    """The point's coordinate in the i-th step's dimension, and that step's value."""
    return F.get(F.array(*[F.col(d).cast("long") for d in ORDER]), F.get("dims", F.lit(i))), F.get("values", F.lit(i))


def _goes_left() -> Column:
    """Lexicographic: the first step in which the point differs decides; ties says where a point at all of them goes."""
    steps = [_step(i) for i in range(len(ORDER))]  # null beyond the last step, so that neither case holds
    left = F.when(steps[0][0] < steps[0][1], True).when(steps[0][0] > steps[0][1], False)
    for x, v in steps[1:]:
        left = left.when(x < v, True).when(x > v, False)
    return left.otherwise(F.col("ties"))


def _at_all_steps() -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(x == v, F.lit(True)) for x, v in map(_step, range(len(ORDER)))])


def _medians(points: DataFrame, open_: dict[int, dict]) -> None:
    """For each open node: the value of its dimension at which its bytes reach goal, with the bytes below (low) and at it (tie)."""
    spark = points.sparkSession
    for w in open_.values():
        w |= {"prefix": 0, "low": w["base"]}
    for k in range(PASSES):
        shift = BITS * (PASSES - 1 - k)
        rows = [(i, w["dims"], w["values"], None, shift, w["prefix"] if k else None, float(w["goal"]), float(w["low"]), w["dim"]) for i, w in open_.items()]
        splits = F.broadcast(_small(spark, rows, SPLIT))
        x = F.get(F.array(*[F.col(d).cast("long") for d in ORDER]), F.col("n"))
        inside = _at_all_steps() & (F.col("prefix").isNull() | (F.shiftright(x, shift + BITS) == F.col("prefix")))
        bins = points.join(splits, "node").filter(inside).groupBy("node", F.shiftright(x, shift).alias("bin")).agg(F.sum("size").alias("b"), F.first("goal").alias("goal"), F.first("low").alias("low"))
        before = F.coalesce(F.sum("b").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = bins.withColumn("below", F.col("low") + before)
        one = F.struct("bin", "b", "below")
        # the first bin that reaches the goal, else the last
        found = placed.groupBy("node").agg(F.coalesce(F.min_by(F.when(F.col("below") + F.col("b") >= F.col("goal"), one), F.when(F.col("below") + F.col("b") >= F.col("goal"), F.col("bin"))), F.max_by(one, "bin")).alias("m"))
        for r in found.collect():
            open_[r["node"]] |= {"prefix": r["m"]["bin"], "tie": r["m"]["b"], "low": r["m"]["below"]}


def grow(points: DataFrame, shards: int, slack: float = 0.01) -> list[dict[int, tuple]]:
    """The tree: for each level, by node, (dims, values, ties, left's node, right's node). A node's number is its first shard.

    points (size and the other dimensions) should be a stored table; it is read a few times a level."""
    points = points.select(*ORDER)
    spans = points.agg(F.sum("size").alias("b"), *[f(d).alias(n + d) for d in DIMS for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    whole = {d: max(1, (spans["hi" + d] or 0) - (spans["lo" + d] or 0)) for d in DIMS}
    limit = slack * (spans["b"] or 0) / shards
    level, tree = {0: shards}, []
    points = points.withColumn("node", _root())
    while any(n > 1 for n in level.values()):
        aggs = [F.sum("size").alias("b"), *[f(d).alias(n + d) for d in DIMS for f, n in ((F.min, "lo"), (F.max, "hi"))]]
        splits: dict[int, dict] = {i: {"dims": [0], "values": [0], "ties": False} for i, n in level.items() if n > 1}  # as they stay without rows
        open_ = {}
        for r in points.groupBy("node").agg(*aggs).collect():
            i = r["node"]
            if level[i] > 1:
                order = sorted(DIMS, key=lambda d: (-(r["hi" + d] - r["lo" + d]) / whole[d], DIMS.index(d)))
                open_[i] = {"order": [ORDER.index(d) for d in (*order, "_h", "_n")], "dim": ORDER.index(order[0]), "dims": [], "values": [], "goal": r["b"] * (level[i] // 2) / level[i], "base": 0}
        while open_:
            _medians(points, open_)
            for i, w in list(open_.items()):
                below, above = w["goal"] - w["low"], w["low"] + w["tie"] - w["goal"]
                w["dims"], w["values"] = [*w["dims"], w["dim"]], [*w["values"], w["prefix"]]
                splits[i] = {"dims": w["dims"], "values": w["values"], "ties": above < below}
                rest = w["order"][w["order"].index(w["dim"]) + 1 :]
                # ties are split further along the next dimension; equal texts only beyond the slack
                if not rest or min(below, above) <= 0 or (rest[0] >= len(DIMS) and min(below, above) <= limit):
                    del open_[i]
                else:
                    w |= {"dim": rest[0], "base": w["low"]}
        tree.append({i: (s["dims"], s["values"], s["ties"], i, i + level[i] // 2) for i, s in splits.items()})
        level = {k: v for i, n in level.items() for k, v in (((i, n // 2), (i + n // 2, n - n // 2)) if n > 1 else ((i, n),))}
        points = materialize(descend(points, tree[-1]), "shard-level") if any(n > 1 for n in level.values()) else points
    return tree


def descend(points: DataFrame, splits: dict[int, tuple]) -> DataFrame:
    """Points with their node on the next level."""
    rows = [(i, list(d), list(v), t, a, b) for i, (d, v, t, a, b) in splits.items()]
    s = _small(points.sparkSession, rows, "node int, dims array<int>, values array<long>, ties boolean, left int, right int")
    joined = points.join(F.broadcast(s), "node", "left")
    return joined.withColumn("node", F.when(F.col("left").isNull(), F.col("node")).when(_goes_left(), F.col("left")).otherwise(F.col("right"))).drop("dims", "values", "ties", "left", "right")


def place(rows: DataFrame, tree: list[dict[int, tuple]], count: int, per_bucket: int = 100_000) -> DataFrame:
    """Adds shard and slot to measured rows. One task orders per_bucket rows at a time: fewer where rows hold their texts."""
    rows = rows.withColumn("node", _root())
    for splits in tree:
        rows = descend(rows, splits)
    # by a hash of all that tells rows apart, so that a frequent doc_id, or text, spreads over the buckets
    rows = rows.withColumn("_o", F.xxhash64("_h", "size", "text_crc32", "_n"))
    rows = rows.withColumnRenamed("node", "shard").withColumn("_b", hash_bucket(F.col("_o"), buckets_for(count, per_bucket)))
    return running(rows, ["shard"], "_b", ["_o"], F.lit(1), "slot")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, slack: float = 0.01) -> DataFrame:
    """The documents with size, text_crc32, shard and slot. Either a number of shards or the bytes that none should exceed by much."""
    rows = measured(docs)
    points = materialize(rows.select(*ORDER), "shard-points")
    count, total = points.agg(F.count(F.lit(1)), F.sum("size")).first()
    if shards is None:
        shards = max(1, -(-(total or 0) // target_bytes))
    return unnested(place(rows, grow(points, shards, slack), count, per_bucket=10_000), docs.columns, ["size", "text_crc32", "shard", "slot"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialize(measured(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", *ORDER), "shard-points")
    rows = place(points, grow(points, 8), points.count())
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
