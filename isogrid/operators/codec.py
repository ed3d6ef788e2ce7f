"""Blocks to pruned coefficients and back, with a bound on the largest error.

Blocks that are all zero or all NoData never reach Python: their kind alone is stored. The others go through
numpy, a batch of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CompressionConfig
from .blocks import NODATA
from .dct import basis, zigzag
from .prune import Prefixes

STREAM = "block_idx int, kind string, nodata_runs array<struct<start:int,len:int>>, zero_runs array<struct<start:int,len:int>>, coeffs array<int>, max_error double"


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def nearest_fill(tile: np.ndarray) -> np.ndarray:
    """Zero cells take the value of the nearest other cell, ties by position."""
    n = tile.shape[0]
    full, empty = np.argwhere(tile != 0), np.argwhere(tile == 0)
    out = tile.copy()
    if len(full) and len(empty):
        for i in range(0, len(empty), 256):
            e = empty[i : i + 256]
            d = ((e[:, None, :] - full[None, :, :]) ** 2).sum(axis=2) * n * n + (full[:, 0] * n + full[:, 1])[None, :]
            s = full[d.argmin(axis=1)]
            out[e[:, 0], e[:, 1]] = tile[s[:, 0], s[:, 1]]
    return out


def encode_block(tile: np.ndarray, cfg: CompressionConfig) -> tuple[list[int], float]:
    """Quantised coefficients of the shortest accepted prefix, and its largest error."""
    c = basis(tile.shape[0], cfg.dct_type)
    scale = 10**cfg.decimal
    quantised = np.rint(np.round(c @ tile @ c.T * scale, 6))
    found = Prefixes(quantised / scale, tile, cfg.dct_type)
    k, error = found.minimal(cfg.accuracy) if cfg.search == "minimal" else found.bisect(cfg.accuracy)
    return quantised.ravel()[zigzag(tile.shape[0])][:k].astype(int).tolist(), error


def decode_block(coeffs: list[int], n: int, decimal: int, kind: int) -> np.ndarray:
    flat = np.zeros(n * n)
    used = min(len(coeffs), n * n)
    flat[zigzag(n)[:used]] = np.asarray(coeffs[:used], float) / 10**decimal
    c = basis(n, kind)
    return c.T @ flat.reshape(n, n) @ c


def compress(tiles: DataFrame, cfg: CompressionConfig) -> DataFrame:
    """tiles (block_idx, pixels; other columns are dropped) to STREAM. Coefficients that don't fit 32 bits raise an error."""
    n = cfg.block
    pix = F.col("pixels")
    kind = F.when(F.forall(pix, lambda v: v == 0), "zero").when(F.forall(pix, lambda v: v == NODATA), "nodata").when(F.exists(pix, lambda v: (v == 0) | (v == NODATA)), "mixed").otherwise("data")
    sorted_ = tiles.select("block_idx", "pixels", kind.alias("kind"))
    none = "array<struct<start:int,len:int>>"
    plain = sorted_.filter(F.col("kind").isin("zero", "nodata")).select("block_idx", "kind", F.array().cast(none).alias("nodata_runs"), F.array().cast(none).alias("zero_runs"), F.array().cast("array<int>").alias("coeffs"), F.lit(0.0).alias("max_error"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for idx, pixels, kind in zip(b["block_idx"], b["pixels"], b["kind"]):
                flat = np.asarray(pixels, float)
                none_, zero = flat == NODATA, flat == 0
                tile = np.where(none_, 0.0, flat).reshape(n, n)
                coeffs, error = encode_block(nearest_fill(tile) if kind == "mixed" else tile, cfg)
                as_rows = lambda mask: [{"start": s, "len": x} for s, x in runs(mask)]
                out.append((idx, kind, as_rows(none_), as_rows(zero), coeffs, error))
            yield pd.DataFrame(out, columns=["block_idx", "kind", "nodata_runs", "zero_runs", "coeffs", "max_error"])

    return sorted_.filter(F.col("kind").isin("mixed", "data")).mapInPandas(encode, STREAM).unionByName(plain)


def decompress(stream: DataFrame, cfg: CompressionConfig) -> DataFrame:
    """block_idx, pos, value."""
    n = cfg.block

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                out = np.zeros((len(part), n * n))
                for k, (kind, none_, zero, coeffs) in enumerate(zip(part["kind"], part["nodata_runs"], part["zero_runs"], part["coeffs"])):
                    if kind == "nodata":
                        out[k] = NODATA
                    elif kind != "zero":
                        out[k] = decode_block(list(coeffs), n, cfg.decimal, cfg.dct_type).ravel()
                        for rows, value in ((zero, 0.0), (none_, NODATA)):
                            for r in rows:
                                out[k, r["start"] : r["start"] + r["len"]] = value
                yield pd.DataFrame({"block_idx": np.repeat(part["block_idx"].to_numpy(), n * n), "pos": np.tile(np.arange(n * n), len(part)), "value": out.ravel()})

    return stream.mapInPandas(decode, "block_idx int, pos int, value double")


def validity(stream: DataFrame, cfg: CompressionConfig) -> DataFrame:
    """One row: the largest error of all blocks, rounded, and T, or F if it reaches the accuracy."""
    top = stream.agg(F.coalesce(F.max("max_error"), F.lit(0.0)).alias("_e"))
    return top.select(F.round("_e", cfg.decimal + 2).alias("max_error"), F.when(F.col("_e") >= cfg.accuracy, "F").otherwise("T").alias("valid"))
