"""Slides as tables: levels and channels, pyramids of tiles, training sets, masks of regions, registration bundles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import raster as R

CHANNELS = {"HnE": ("r", "g", "b"), "mono": ("c",)}


def named_channels(pixels: DataFrame, kind: str) -> DataFrame:
    """Pixels with ``channel``: HnE keeps the first three as r, g, b; mIF names all c0, c1, ...; mono has one, c."""
    if kind == "mIF":
        return pixels.withColumn("channel", F.concat(F.lit("c"), F.col("c").cast("string")))
    if kind not in CHANNELS:
        raise ValueError(f"kind {kind}: HnE, mIF or mono")
    names = CHANNELS[kind]
    return pixels.where(F.col("c") < len(names)).withColumn("channel", F.element_at(F.array(*map(F.lit, names)), (F.col("c") + 1).cast("int")))


def multiscale(pixels: DataFrame, downsamples: dict[int, float], kind: str) -> DataFrame:
    """Pixels (level, c, y, x, v) with the channel's name and base coordinates (base_y, base_x) of their level."""
    scale = F.element_at(F.create_map(*[F.lit(v) for k, s in sorted(downsamples.items()) for v in (int(k), float(s))]), F.col("level").cast("int"))
    return named_channels(pixels, kind).withColumns({"base_y": F.col("y") * scale, "base_x": F.col("x") * scale})


def to_cyx(pixels: DataFrame, axes: str, sizes: dict[str, int]) -> DataFrame:
    """Pixels whose columns are the letters of ``axes`` to (c, y, x, v): other axes, in their order, are one channel axis."""
    other = [a for a in axes if a not in "YX"]
    if {"Y", "X"} - set(axes):
        raise ValueError("axes need Y and X")
    c: Column = F.lit(0)
    for a in other:
        c = c * sizes[a] + F.col(a)
    return pixels.select(c.cast("long").alias("c"), F.col("Y").alias("y"), F.col("X").alias("x"), "v")


def channel_view(pixels: DataFrame, c: int) -> DataFrame:
    return pixels.where(F.col("c") == c).drop("c")


def preloaded(pixels: DataFrame, levels: list[int]) -> DataFrame:
    """The chosen levels in the cluster's memory, the others as they are."""
    chosen = F.col("level").isin(levels)
    return pixels.where(chosen).persist().unionByName(pixels.where(~chosen))


def chunk_size(c: int, y: int, x: int) -> tuple[int, int, int]:
    """Chunks for reading: twice the stored ones on each side."""
    return c, 2 * y, 2 * x


def tile_side(height: int, width: int, most: int = 1024) -> int:
    """``most``, or the largest power of two within the smaller side."""
    side = min(height, width)
    return most if side >= most else 1 << max(side.bit_length() - 1, 0)


def xml_safe(text: Column) -> Column:
    """Text without the characters that XML 1.0 has no place for."""
    return F.regexp_replace(text, "[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "")


def auto_pyramid(pixels: DataFrame, factors: tuple[int, ...] = (2, 2, 2, 2), mask: bool = False) -> DataFrame:
    """(level, c, y, x, v): the base and a level for each factor; means of blocks (absent pixels are zeros), half-even, or nearest."""
    level, out = pixels.select("c", "y", "x", "v"), pixels.select(F.lit(0).cast("long").alias("level"), "c", "y", "x", "v")
    for k, f in enumerate(factors, 1):
        down = lambda a, f=f: F.floor(F.col(a) / f).alias(a)
        if mask:
            level = level.where(f"y % {f} = 0 AND x % {f} = 0").select("c", down("y"), down("x"), "v")
        else:
            level = level.groupBy("c", down("y"), down("x")).agg(F.rint(F.sum("v") / (f * f)).cast("long").alias("v"))
        out = out.unionByName(level.select(F.lit(k).cast("long").alias("level"), "c", "y", "x", "v"))
    return out


def tiled(pixels: DataFrame, tile: int, channels: int, bytes_a_pixel: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Tiles (by, y, x, h, w, data: channels x h x w little-endian) of pixels (by, c, y, x, v); absent pixels are zeros."""
    kind = np.dtype(f"<u{bytes_a_pixel}")
    top = F.max("y").alias("__height"), F.max("x").alias("__width")
    ends = pixels.groupBy(*by).agg(*top) if by else pixels.agg(*top)
    keyed = pixels.select(*by, F.col("c").cast("long").alias("c"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))
    keyed = (keyed.join(ends, list(by)) if by else keyed.crossJoin(F.broadcast(ends))).withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})  # without by: one row

    def one(table: pa.Table) -> pa.Table:
        y0, x0 = table["ty"][0].as_py() * tile, table["tx"][0].as_py() * tile
        h, w = min(tile, table["__height"][0].as_py() + 1 - y0), min(tile, table["__width"][0].as_py() + 1 - x0)
        data = np.zeros((channels, h, w), dtype=kind)
        data[table["c"].to_numpy(), table["y"].to_numpy() - y0, table["x"].to_numpy() - x0] = table["v"].to_numpy()
        return pa.table([*([table[c][0].as_py()] for c in by), [y0], [x0], [h], [w], [data.tobytes()]], names=[*by, "y", "x", "h", "w", "data"])

    types = ", ".join(f"`{c}` {pixels.schema[c].dataType.simpleString()}" for c in by)
    return keyed.groupBy(*by, "ty", "tx").applyInArrow(one, f"{types}{', ' if by else ''}y long, x long, h long, w long, data binary")


def untiled(tiles: DataFrame, channels: int, bytes_a_pixel: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels (by, c, y, x, v) of tiles."""
    kind = np.dtype(f"<u{bytes_a_pixel}")
    names = [*by, "y", "x", "h", "w", "data"]

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
                own, (y, x, h, w, data) = row[: len(by)], row[len(by) :]
                c, yy, xx = np.mgrid[0:channels, y : y + h, x : x + w]
                n = c.size
                columns = [pa.array([v] * n, batch.schema.field(i).type) for i, v in enumerate(own)]
                columns += [pa.array(a.ravel()) for a in (c, yy, xx)] + [pa.array(np.frombuffer(data, kind).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "c", "y", "x", "v"])

    types = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in by)
    return tiles.select(*names).mapInArrow(run, f"{types}{', ' if by else ''}c long, y long, x long, v long")


def write_pyramid(pixels: DataFrame, path: str, height: int, width: int, channels: int, tile: int = 1024, mask: bool = False, bits: int = 8, names: list[str] | None = None, microns: float | None = None) -> None:
    """A pyramid of halved levels as tiles, a folder for each level, and a one-row table of what they are.

    Levels go on until one fits a tile. Images have 8 or 16 bits a pixel, masks up to 32 and nearest places; the path
    must not exist, and tiles are multiples of 16.
    """
    if bits not in ((8, 16, 32) if mask else (8, 16)) or tile % 16 or (names is not None and len(names) != channels):
        raise ValueError("bits, tile or channel names")
    spark = pixels.sparkSession
    n = R.pyramid_levels(height, width, tile)
    levels = auto_pyramid(pixels, (2,) * (n - 1), mask)
    tiled(levels, tile, channels, bits // 8, ("level",)).write.mode("errorifexists").partitionBy("level").parquet(f"{path}/tiles")
    about = [(height, width, channels, tile, bits, n, names, microns)]
    spark.createDataFrame(about, "height long, width long, channels long, tile long, bits int, levels int, names array<string>, microns double").write.mode("errorifexists").parquet(f"{path}/about")


def read_pyramid(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(tiles with their level, what they are)."""
    about = spark.read.parquet(f"{path}/about").first().asDict()
    return spark.read.parquet(f"{path}/tiles"), about


def write_training_set(images: DataFrame, masks: DataFrame, path: str) -> int:
    """Pairs of images and masks (id, c, h, w, data: array of c * h * w numbers) as one table; their number.

    An error: a mask of several channels, sides that differ, data of another size, ids that are not in both.
    """
    both = images.select("id", *(F.col(c).alias(f"i{c}") for c in ("c", "h", "w", "data"))).join(masks.select("id", *(F.col(c).alias(f"m{c}") for c in ("c", "h", "w", "data"))), "id", "full")
    right = "ic IS NOT NULL AND mc = 1 AND ih = mh AND iw = mw AND size(idata) = ic * ih * iw AND size(mdata) = mh * mw"
    facts = both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"CAST(NOT coalesce({right}, FALSE) AS LONG)")).alias("wrong")).first()
    if facts.wrong:
        raise ValueError(f"{facts.wrong} of {facts.n} pairs have shapes that don't match")
    both.select("id", F.col("ic").alias("channels"), F.col("ih").alias("height"), F.col("iw").alias("width"), F.col("idata").alias("image"), F.col("mdata").alias("mask")).write.parquet(path)
    return facts.n


def write_roi_mask(rois: DataFrame, path: str, height: int, width: int, tile: int = 1024, most: int = 10_000) -> None:
    """Rows of a region file (SizeX, SizeY, Points) as a pyramid of a label mask, numbered from one in their order.

    Sizes that aren't the slide's are an error. Regions become literals of a plan, so their number is checked.
    """
    found = rois.select(F.col("SizeX").cast("long").alias("w"), F.col("SizeY").cast("long").alias("h"), G.parse_points(F.col("Points")).alias("p")).limit(most + 1).collect()
    if len(found) > most or any((r.h, r.w) != (height, width) for r in found):
        raise ValueError("too many regions, or of another size than the slide")
    rings = [(k, [(p.x, p.y) for p in r.p]) for k, r in enumerate(found, 1)]
    mask = R.filled_polygons(rois.sparkSession, rings, height, width).withColumn("c", F.lit(0).cast("long"))
    write_pyramid(mask, path, height, width, 1, tile, mask=True, bits=16)


def write_channel(pixels: DataFrame, path: str, c: int) -> None:
    """One channel's raster into its own partition of a store; the others stay."""
    pixels.where(F.col("c") == c).drop("c").write.mode("overwrite").parquet(f"{path}/c={int(c)}")


@dataclass
class Registration:
    """An affine matrix (2 x 3) and a displacement field between two slides, with the pads that make their sides equal."""

    affine: list[list[float]]
    field: DataFrame
    source_shape: tuple[int, int]
    target_shape: tuple[int, int]
    field_shape: tuple[int, int]

    def __post_init__(self):
        self.pad_source, self.pad_target = G.padding(self.source_shape, self.target_shape)

    @classmethod
    def read(cls, spark: SparkSession, path: str, source: DataFrame, target: DataFrame) -> Registration:
        """From a bundle's tables ``affine`` (row, a, b, c) and ``field`` (y, x, dx, dy), and the base tiles of both slides."""
        rows = spark.read.parquet(f"{path}/affine").orderBy("row").collect()
        shape = lambda t: tuple(t.agg(F.max(F.col("y") + F.col("h")), F.max(F.col("x") + F.col("w"))).first())
        field = spark.read.parquet(f"{path}/field")
        size = field.agg(F.max("y") + 1, F.max("x") + 1).first()
        return cls([[r.a, r.b, r.c] for r in rows], field, shape(source), shape(target), tuple(size))

    def transform(self, points: DataFrame) -> DataFrame:
        """(id, x, y) in the source to the target: the displacement, then the inverse of the affine matrix."""
        inverse = np.linalg.inv(np.vstack([np.array(self.affine, dtype=float), [0, 0, 1]]))[:2].tolist()
        return G.transform_points(points, self.field, self.field_shape, self.source_shape, inverse, (self.pad_source, self.pad_target))

    def __repr__(self) -> str:
        sides = {"source": self.source_shape, "target": self.target_shape, "field": self.field_shape}
        return "Registration(" + ", ".join(f"{k} {h} x {w}" for k, (h, w) in sides.items()) + ")"


def format_shape(shape: tuple[int, ...]) -> str:
    return " x ".join(map(str, shape))
