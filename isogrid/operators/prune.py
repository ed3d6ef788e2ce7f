"""How many coefficients, in zig-zag order, a block needs for a stated largest error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dct import basis, basis_table, zigzag, zigzag_table


def prefix_errors(blocks: DataFrame, coefficients: DataFrame, n: int, kind: int = 2) -> DataFrame:
    """block_idx, k, max_error, mean_error of the first k coefficients (k from 1), by running sums of basis images."""
    spark = blocks.sparkSession
    b = basis_table(spark, n, kind)
    zz = zigzag_table(spark, n).select("pos", "zz")
    images = b.select(F.col("u"), F.col("x").alias("i"), F.col("w").alias("_a")).crossJoin(b.select(F.col("u").alias("v"), F.col("x").alias("j"), F.col("w").alias("_b")))
    images = images.select((F.col("u") * n + F.col("v")).alias("pos"), (F.col("i") * n + F.col("j")).alias("pixel"), (F.col("_a") * F.col("_b")).alias("w")).join(zz, "pos")
    parts = coefficients.join(F.broadcast(images), "pos").select("block_idx", "pixel", "zz", (F.col("value") * F.col("w")).alias("part"))
    so_far = Window.partitionBy("block_idx", "pixel").orderBy("zz").rowsBetween(Window.unboundedPreceding, 0)
    made = parts.withColumn("made", F.sum("part").over(so_far))
    error = F.abs(F.col("value") - F.col("made"))
    return made.join(blocks.select("block_idx", F.col("pos").alias("pixel"), "value"), ["block_idx", "pixel"]).groupBy("block_idx", (F.col("zz") + 1).alias("k")).agg(F.max(error).alias("max_error"), F.avg(error).alias("mean_error"))


def minimal_prefix(errors: DataFrame, accuracy: float, length: int) -> DataFrame:
    """The least k within accuracy, else all coefficients, with its error."""
    ok = F.col("max_error") <= accuracy
    last = F.max_by("max_error", "k")
    return errors.groupBy("block_idx").agg(F.coalesce(F.min(F.when(ok, F.col("k"))), F.lit(length)).alias("k"), F.coalesce(F.min_by(F.when(ok, F.col("max_error")), F.when(ok, F.col("k"))), last).alias("max_error"))


class Prefixes:
    """Errors of the prefixes of one block, from cumulative sums of basis images, STEP of them at a time and only as far as they are asked for."""

    STEP = 16

    def __init__(self, coefficients: np.ndarray, pixels: np.ndarray, kind: int):
        n = pixels.shape[0]
        self.basis, self.order, self.length = basis(n, kind), zigzag(n), n * n
        self.values, self.pixels, self.made = coefficients.ravel()[self.order], pixels, np.zeros((n, n))
        self.known, self.found = 0, np.zeros(n * n + 1)
        self.found[0] = np.abs(pixels).max()

    def _extend(self, k: int) -> None:
        n = self.pixels.shape[0]
        while self.known < k:
            part = slice(self.known, min(self.length, self.known + self.STEP))
            u, v = np.divmod(self.order[part], n)
            made = self.made + np.cumsum(self.values[part][:, None, None] * self.basis[u][:, :, None] * self.basis[v][:, None, :], axis=0)
            self.found[part.start + 1 : part.stop + 1] = np.abs(self.pixels - made).max(axis=(1, 2))
            self.made, self.known = made[-1], part.stop

    @property
    def errors(self) -> np.ndarray:
        """Of all prefixes, from none to all coefficients."""
        self._extend(self.length)
        return self.found

    def minimal(self, accuracy: float) -> tuple[int, float]:
        for k in range(0, self.length, self.STEP):
            self._extend(min(self.length, k + self.STEP))
            ok = np.flatnonzero(self.found[k + 1 : self.known + 1] <= accuracy)
            if len(ok):
                return k + int(ok[0]) + 1, float(self.found[k + int(ok[0]) + 1])
        return self.length, float(self.found[self.length])

    def bisect(self, accuracy: float) -> tuple[int, float]:
        """Halving steps; once they are used up, two coefficients forward and one back, until the error is small enough or the rounds are."""
        step, at, error = self.length // 2, 0, accuracy + 1
        tried: dict[int, float] = {}
        for _ in range(int(20 * np.log2(self.length) + 10)):
            step //= 2
            at = min(max(at - step if error <= accuracy else at + step, 0), self.length)
            error = float(self.errors[at])
            tried[at] = error
            if step == 0 and error > accuracy:
                step = 2
            if step <= 1 and error <= accuracy:
                return min(k for k, e in tried.items() if e <= accuracy), error
        best = min(tried, key=lambda k: (tried[k], k))
        while tried.get(best, self.errors[best]) > accuracy and best < self.length:
            best += 1
        return best, float(self.errors[best])
