"""Neighbourhood filters by tiles with a halo, and the tissue masks made of them.

A raster (y, x, v), with columns ``by`` that tell images apart, is dealt by tile: each pixel goes to its own tile and
to those whose halo it lies in, so the rows shuffled are little more than the pixels, whatever the footprint. A tile
is one bounded numpy array in an Arrow group. Places without a pixel are absent: they don't count and get no value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import raster as R

#: (row offset, first and last column offset) of each run of a footprint.
Runs = list[tuple[int, int, int]]
#: Places of a footprint up to which order statistics sort them all; larger ones count value by value.
SORTED_PLACES = 121


def square(size: int) -> Runs:
    """size x size places around the middle one; an even size reaches further up and left."""
    low, high = -(size // 2), size - 1 - size // 2
    return [(dy, low, high) for dy in range(low, high + 1)]


def disk(radius: int) -> Runs:
    return [(dy, -(half := math.isqrt(radius * radius - dy * dy)), half) for dy in range(-radius, radius + 1)]


def reach(runs: Runs) -> int:
    return max(max(abs(dy), abs(low), abs(high)) for dy, low, high in runs)


def run_sums(weights: np.ndarray, runs: Runs, halo: int) -> np.ndarray:
    """Sums under the footprint at each place but the halo."""
    h, w = weights.shape[0] - 2 * halo, weights.shape[1] - 2 * halo
    sums = np.zeros((weights.shape[0], weights.shape[1] + 1), dtype=np.int64)
    np.cumsum(weights, axis=1, out=sums[:, 1:])
    out = np.zeros((h, w), dtype=np.int64)
    for dy, low, high in runs:
        rows = sums[halo + dy : halo + dy + h]
        out += rows[:, halo + high + 1 : halo + high + 1 + w] - rows[:, halo + low : halo + low + w]
    return out


def run_max(values: np.ndarray, runs: Runs, halo: int) -> np.ndarray:
    """Maxima under the footprint at each place but the halo; runs are put together from doubled stretches."""
    h, w = values.shape[0] - 2 * halo, values.shape[1] - 2 * halo
    out = np.full((h, w), -np.inf)
    stretches = [values]  # maxima of 1, 2, 4 ... places from each place on
    while 1 << len(stretches) <= max(high - low + 1 for _, low, high in runs):
        last, step = stretches[-1], 1 << (len(stretches) - 1)
        stretches.append(np.maximum(last[:, : last.shape[1] - step], last[:, step:]))
    for dy, low, high in runs:
        k = (high - low + 1).bit_length() - 1
        rows = stretches[k][halo + dy : halo + dy + h]
        for at in (halo + low, halo + high + 1 - (1 << k)):
            np.maximum(out, rows[:, at : at + w], out=out)
    return out


def tile_entropy(values: np.ndarray, there: np.ndarray, runs: Runs, halo: int) -> np.ndarray:
    """Entropy in bits of the values under the footprint."""
    n = run_sums(there, runs, halo)
    total = np.zeros(n.shape)
    for v in np.unique(values[there]).tolist():
        k = run_sums(there & (values == v), runs, halo)
        total += k * np.log2(np.maximum(k, 1))
    return np.log2(np.maximum(n, 1)) - total / np.maximum(n, 1)


def tile_quantile(values: np.ndarray, there: np.ndarray, runs: Runs, halo: int, share: float, lower: bool) -> np.ndarray:
    """Quantile of the values under the footprint, between two of them by their places (or the lower one)."""
    n = run_sums(there, runs, halo)
    at = np.maximum(n - 1, 0) * share
    first = np.floor(at).astype(np.int64)
    second = first if lower else np.ceil(at).astype(np.int64)
    h, w = n.shape
    if sum(high - low + 1 for _, low, high in runs) <= SORTED_PLACES:
        filled = np.where(there, values, np.inf)
        stack = np.sort(np.stack([filled[halo + dy : halo + dy + h, halo + dx : halo + dx + w] for dy, low, high in runs for dx in range(low, high + 1)]), axis=0)
        a, b = (np.take_along_axis(stack, i[None], axis=0)[0] for i in (first, second))
    else:
        a, b = np.full(n.shape, np.nan), np.full(n.shape, np.nan)
        below = np.zeros(n.shape, dtype=np.int64)
        for v in np.unique(values[there]).tolist():
            below += run_sums(there & (values == v), runs, halo)
            for out, place in ((a, first), (b, second)):
                out[np.isnan(out) & (below > place)] = v
    return a + (np.where(n > 0, b, 0) - np.where(n > 0, a, 0)) * (at - first)


def by_tiles(pixels: DataFrame, runs: Runs, function: Callable[[np.ndarray, np.ndarray, Runs, int], np.ndarray], by: tuple[str, ...] = (), tile: int | None = None) -> DataFrame:
    """(by, y, x, v) of ``function`` (values, which are there, runs, halo) over each tile, for the pixels that are there."""
    halo = reach(runs)
    tile = tile or max(64, 4 * halo)
    over = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    known = pixels.where("v IS NOT NULL").select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    dealt = known.select("*", over("y").alias("__ty")).select("*", over("x").alias("__tx"))

    def one(table: pa.Table) -> pa.Table:
        top, left = table["__ty"][0].as_py() * tile, table["__tx"][0].as_py() * tile
        side = tile + 2 * halo
        values, there = np.zeros((side, side)), np.zeros((side, side), dtype=bool)
        y, x = (table[c].to_numpy() - at + halo for c, at in (("y", top), ("x", left)))
        values[y, x], there[y, x] = table["v"].to_numpy(), True
        out = function(values, there, runs, halo)
        yy, xx = np.nonzero(there[halo : halo + tile, halo : halo + tile])
        columns = [pa.array([table[c][0].as_py()] * len(yy), table.schema.field(c).type) for c in by]
        return pa.table([*columns, pa.array(yy + top), pa.array(xx + left), pa.array(out[yy, xx])], names=[*by, "y", "x", "v"])

    schema = StructType([known.schema[c] for c in by] + [StructField("y", LongType()), StructField("x", LongType()), StructField("v", DoubleType())])
    return dealt.groupBy(*by, "__ty", "__tx").applyInArrow(one, schema)


def like(found: DataFrame, pixels: DataFrame) -> DataFrame:
    """Values as the pixels' own type."""
    return found.withColumn("v", F.col("v").cast(pixels.schema["v"].dataType))


def entropy(pixels: DataFrame, runs: Runs, by: tuple[str, ...] = ()) -> DataFrame:
    return by_tiles(pixels, runs, tile_entropy, by)


def quantile(pixels: DataFrame, runs: Runs, share: float = 0.5, by: tuple[str, ...] = (), lower: bool = False) -> DataFrame:
    return by_tiles(pixels, runs, lambda *a: tile_quantile(*a, share, lower), by)


def median(pixels: DataFrame, runs: Runs, by: tuple[str, ...] = ()) -> DataFrame:
    return quantile(pixels, runs, 0.5, by)


def dilated(pixels: DataFrame, runs: Runs, by: tuple[str, ...] = ()) -> DataFrame:
    return like(by_tiles(pixels, runs, lambda v, t, r, h: run_max(np.where(t, v, -np.inf), r, h), by), pixels)


def eroded(pixels: DataFrame, runs: Runs, by: tuple[str, ...] = ()) -> DataFrame:
    return like(by_tiles(pixels, runs, lambda v, t, r, h: -run_max(np.where(t, -v, -np.inf), r, h), by), pixels)


def closed(pixels: DataFrame, runs: Runs, by: tuple[str, ...] = ()) -> DataFrame:
    """Dilation, then erosion."""
    return eroded(dilated(pixels, runs, by), runs, by)


# ---- tissue masks


def saturation(pixels: DataFrame) -> DataFrame:
    """(y, x, v 0..255) of bytes (y, x, c, v): the spread of a place's channels against their maximum, rounded."""
    top, low = F.max("v"), F.min("v")
    return pixels.groupBy("y", "x").agg(F.when(top == 0, 0).otherwise(F.rint((top - low) * 255.0 / top)).cast("long").alias("v"))


def over_otsu(pixels: DataFrame) -> DataFrame:
    """1 where v (bytes) is over Otsu's threshold of all pixels, else 0."""
    return pixels.crossJoin(F.broadcast(R.otsu(pixels))).select("y", "x", (F.col("v") > F.col("threshold")).cast("long").alias("v"))  # one threshold


def stretched(pixels: DataFrame) -> DataFrame:
    """v as bytes between the least and the greatest of all pixels, truncated; 0 where they are equal."""
    ends = pixels.agg(F.min("v").alias("__low"), F.max("v").alias("__high"))
    return pixels.crossJoin(F.broadcast(ends)).select("y", "x", F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("__low"), F.col("__high") - F.col("__low")) * 255), F.lit(0)).alias("v"))  # one row


def without_holes(mask: DataFrame, least: int = 0) -> DataFrame:
    """A mask of one image's thumbnail with its holes filled and its parts under ``least`` pixels gone."""
    from .adaptive import cleaned_mask

    return cleaned_mask(mask.withColumn("image", F.lit("")), least, fill=least == 0).select("y", "x", "v")


def tissue_mask(pixels: DataFrame, entropy_size: int = 7, percentile: float = 0, median_size: int = 51, closing: int = 0, opening: int = 0, dilation: int = 0, remove_holes: bool = True, remove_light: float = 0, kernel: str = "disk") -> DataFrame:
    """0/1 mask of a stained section's thumbnail (y, x, c, v bytes), by the texture of its saturation.

    Without ``percentile`` the local entropy, stretched to bytes and median-filtered, is cut by Otsu's threshold; with
    it (a share) the local quantile is. Then holes are filled, places whose own quantile ``remove_light`` is under its
    Otsu threshold go, and the mask is closed by a disk of ``closing`` and one of ``opening``, and dilated.
    """
    runs = disk(entropy_size) if kernel == "disk" else square(entropy_size)
    grey = saturation(pixels)
    cut = over_otsu(quantile(grey, runs, percentile, lower=True)) if percentile else over_otsu(median(stretched(entropy(grey, runs)), square(median_size)).withColumn("v", F.floor("v")))
    mask = without_holes(cut) if remove_holes else cut
    if remove_light:
        keep = over_otsu(quantile(grey, runs, remove_light, lower=True)).withColumnRenamed("v", "keep")
        mask = mask.join(keep, ["y", "x"]).select("y", "x", F.col("v").bitwiseAND(F.col("keep")).alias("v"))
    for radius in (closing, opening):
        mask = closed(mask, disk(radius)) if radius else mask
    return dilated(mask, disk(dilation)) if dilation else mask


def fluorescence_mask(pixels: DataFrame, entropy_size: int = 5, dilation: int = 26, least: int = 40_000, bins: int = 256) -> DataFrame:
    """0/1 mask of one channel's thumbnail (y, x, v): entropy of log(v + 1) as bytes over its float Otsu threshold.

    log(v + 1) less its mean over its range, negative ones as zero, times 255 and rounded, are the bytes; the mask is dilated by a
    square and parts under ``least`` pixels go.
    """
    logged = pixels.select("y", "x", F.log1p(F.col("v").cast("double")).alias("v"))
    ends = logged.agg(F.avg("v").alias("__mean"), (F.max("v") - F.min("v")).alias("__range"))
    grey = logged.crossJoin(F.broadcast(ends)).select("y", "x", F.rint(F.greatest(F.coalesce(F.try_divide(F.col("v") - F.col("__mean"), F.col("__range")), F.lit(0.0)), F.lit(0.0)) * 255).alias("v"))  # one row
    found = entropy(grey, square(entropy_size))
    low, high = F.col("__low"), F.col("__high")
    ends = found.agg(F.min("v").alias("__low"), F.max("v").alias("__high"))
    placed = found.crossJoin(F.broadcast(ends))
    binned = placed.select("y", "x", F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - low, high - low) * bins), F.lit(bins - 1)), F.lit(0)).alias("v"))
    threshold = low + (F.col("threshold") + 0.5) / bins * (high - low)
    mask = placed.crossJoin(F.broadcast(R.otsu(binned))).select("y", "x", (F.col("v") > threshold).cast("long").alias("v"))  # one threshold
    return without_holes(dilated(mask, square(dilation)), max(least, 1))


def training_mask(classes: DataFrame, spark: SparkSession, source: tuple[int, int], target: tuple[int, int], positive: list[int], size: int = 31, cleanup: int = 0) -> DataFrame:
    """(y, x, v) soft mask of a dense class raster: the positive classes, resized by cubics and blurred.

    With ``cleanup`` parts and holes under so many pixels go first; the raster is one image's, of training size.
    """
    hard = classes.select("y", "x", F.coalesce(F.col("v").isin(positive), F.lit(False)).cast("long").alias("v"))
    if cleanup:
        other = lambda m: m.withColumn("v", 1 - F.col("v"))
        hard = other(without_holes(other(without_holes(hard, cleanup)), cleanup))
    soft = R.resized_cubic(hard.withColumn("v", F.col("v").cast("double")), spark, source, target)
    return R.convolved(soft, R.gaussian_kernel(size), *target)


def resized_mask(mask: DataFrame, spark: SparkSession, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """A thumbnail's mask at the base level, by nearest places."""
    return R.resized(mask, spark, source, target)
