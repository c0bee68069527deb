"""Raster operators on long pixel tables (image, y, x, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Side of the tiles of the nearest-seed search, and how often it is doubled to find the first seeds.
SEED_TILE, SEED_LEVELS = 16, 24


def canvas(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))


def nearest_seed(pixels: DataFrame, seeds: DataFrame, value: str = "label", tile: int = SEED_TILE) -> DataFrame:
    """Pixels with ``nearest``: the value of the seed (x, y, value) nearest to them and its squared distance ``d2``.

    Ties go to the lowest value; without seeds there are no rows. Pixels are taken by tiles. For each tile cells of
    doubled sides are tried until one beside it holds a seed; that seed's distance bounds those that can be nearest
    to any of the tile's pixels, and only they are joined, by tile. Seeds are never broadcast or held in one task.
    """
    spots = seeds.groupBy("x", "y").agg(F.min(value).alias("v")).withColumns({"__sy": F.floor(F.col("y") / tile), "__sx": F.floor(F.col("x") / tile)})
    levels = F.explode(F.sequence(F.lit(0), F.lit(SEED_LEVELS))).alias("__l")
    up = lambda c, level: F.expr(f"shiftright({c}, {level})")  # noqa: E731  (floors, below zero too)
    cell = ["__l", "__cy", "__cx"]
    by_level = spots.select("x", "y", "v", "__sy", "__sx", levels).select("x", "y", "v", "__l", up("__sy", "__l").alias("__cy"), up("__sx", "__l").alias("__cx"))
    around = lambda n: F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-n, n + 1) for dx in range(-n, n + 1)))).alias("__o")
    beside = lambda t, n: t.select("__ty", "__tx", "__l", around(n)).select("__ty", "__tx", "__l", (up("__ty", "__l") + F.col("__o.dy")).alias("__cy"), (up("__tx", "__l") + F.col("__o.dx")).alias("__cx"))

    placed = pixels.withColumns({"__ty": F.floor(F.col("y") / tile), "__tx": F.floor(F.col("x") / tile)})
    tiles = placed.select("__ty", "__tx").distinct()
    first = beside(tiles.select("__ty", "__tx", levels), 1).join(by_level.select(*cell).distinct(), cell).groupBy("__ty", "__tx").agg(F.min("__l").alias("__l"))
    # a seed in a cell beside lies under two sides away on each axis: nearer ones are at most three cells off
    pairs = beside(first, 3).join(by_level, cell).select("__ty", "__tx", "x", "y", "v")
    low = lambda t, c: F.greatest(F.col(t) * tile - F.col(c), F.col(c) - F.col(t) * tile - (tile - 1), F.lit(0))
    high = lambda t, c: F.greatest(F.abs(F.col(c) - F.col(t) * tile), F.abs(F.col(t) * tile + (tile - 1) - F.col(c)))
    bound = lambda side: side("__ty", "y") * side("__ty", "y") + side("__tx", "x") * side("__tx", "x")
    whole = Window.partitionBy("__ty", "__tx")
    able = pairs.select("*", F.min(bound(high)).over(whole).alias("__most")).where(bound(low) <= F.col("__most"))
    able = able.groupBy("__ty", "__tx").agg(F.collect_list(F.struct("x", "y", "v")).alias("__seeds"))
    d2 = lambda s: (s.x - F.col("x")) * (s.x - F.col("x")) + (s.y - F.col("y")) * (s.y - F.col("y"))
    least = F.array_min(F.transform("__seeds", lambda s: F.struct(d2(s).alias("d2"), s.v.alias("v"))))
    found = placed.join(able, ["__ty", "__tx"]).select(*pixels.columns, least.alias("__near"))
    return found.select(*pixels.columns, F.col("__near.v").alias("nearest"), F.col("__near.d2").alias("d2"))


def scaled_seeds(samples: DataFrame, height: int, width: int, downsample: int, order: str | None = None) -> DataFrame:
    """Seeds at coordinates // downsample, clipped to the raster; of seeds on one pixel the last by ``order`` stays."""
    place = lambda c, n: F.least(F.greatest(F.floor(F.col(c) / downsample), F.lit(0)), F.lit(n - 1))
    rows = samples.withColumns({"x": place("x", width), "y": place("y", height)})
    return rows.groupBy("x", "y").agg(F.max_by("label", order).alias("label")) if order else rows


def binary_nearest(pixels: DataFrame, seeds: DataFrame, positive: Column) -> DataFrame:
    """Pixels with ``fg``: one iff the nearest background seed is strictly further than the nearest foreground one.

    Without background seeds all is foreground; without foreground none is.
    """
    seeds = seeds.select("x", "y", (~positive).cast("long").alias("label"))  # background sorts after: ties must go to it
    near = nearest_seed(pixels, seeds.withColumn("label", -F.col("label")))
    return near.select(*pixels.columns, (F.col("nearest") == 0).cast("long").alias("fg"))


def paint_max(spark: SparkSession, patches: DataFrame, height: int, width: int, patch: int, downsample: int) -> DataFrame:
    """Squares of ``score`` around centres (x, y), highest wins, background 0.

    Centres round half to even; half is (patch // downsample) // 2; ends are exclusive and clamped to the last row
    and column, which therefore stay unpainted; a square that lies outside paints nothing.
    """
    half = patch // downsample // 2
    cx, cy = F.rint(F.col("x") / downsample).cast("long"), F.rint(F.col("y") / downsample).cast("long")
    span = lambda c, n: F.when(F.greatest(c - half, F.lit(0)) <= F.least(c + half, F.lit(n - 1)) - 1, F.sequence(F.greatest(c - half, F.lit(0)), F.least(c + half, F.lit(n - 1)) - 1)).otherwise(F.array().cast("array<bigint>"))
    painted = patches.select("score", F.explode(span(cx, width)).alias("x"), cy.alias("cy")).select("score", "x", F.explode(span(F.col("cy"), height)).alias("y"))
    top = painted.groupBy("y", "x").agg(F.max("score").alias("score"))
    return canvas(spark, height, width).join(top, ["y", "x"], "left").select("y", "x", F.coalesce("score", F.lit(0.0)).alias("v"))


def feature_maps(patches: DataFrame, sizes: DataFrame, patch: int, downsample: int) -> DataFrame:
    """(image, y, x, v): squares of ``score`` around centres (image, x, y) on each image's own canvas, highest wins.

    Images (image, height, width: of the map) without patches stay empty (zeros), patches without an image are left
    out. Rounding and edges are those of ``paint_max``.
    """
    half = patch // downsample // 2
    placed = patches.join(sizes, "image").withColumns({"cx": F.rint(F.col("x") / downsample).cast("long"), "cy": F.rint(F.col("y") / downsample).cast("long")})
    ends = lambda c, n: (F.greatest(F.col(c) - half, F.lit(0)), F.least(F.col(c) + half, F.col(n) - 1) - 1)
    span = lambda c, n: F.when(ends(c, n)[0] <= ends(c, n)[1], F.sequence(*ends(c, n))).otherwise(F.array().cast("array<bigint>"))
    painted = placed.select("image", "score", "cy", "height", F.explode(span("cx", "width")).alias("x")).select("image", "score", "x", F.explode(span("cy", "height")).alias("y"))
    top = painted.groupBy("image", "y", "x").agg(F.max("score").alias("score"))
    rows = sizes.select("image", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y"))
    whole = rows.select("image", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("x"))
    return whole.join(top, ["image", "y", "x"], "left").select("image", "y", "x", F.coalesce("score", F.lit(0.0)).alias("v"))


def pyramid_level(pixels: DataFrame, mask: bool = False) -> DataFrame:
    """The next level from this one: 2 x 2 means over four (absent pixels are zeros), half-even; or every other pixel."""
    if mask:
        return pixels.where("x % 2 = 0 AND y % 2 = 0").select(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")
    return pixels.groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.rint(F.sum("v") / 4).cast("long").alias("v"))


def pyramid_levels(height: int, width: int, tile: int) -> int:
    n = 1
    while max(height, width) > tile << (n - 1):
        n += 1
    return n


def reflect_padded(pixels: DataFrame, height: int, width: int, tile: int) -> DataFrame:
    """Rows mirrored (without the edge) so that both sides are multiples of the tile."""
    more_y, more_x = -height % tile, -width % tile
    y2, x2 = 2 * (height - 1) - F.col("y"), 2 * (width - 1) - F.col("x")
    down = pixels.unionByName(pixels.withColumn("y", y2).where(F.col("y").between(height, height + more_y - 1)))
    return down.unionByName(down.withColumn("x", x2).where(F.col("x").between(width, width + more_x - 1)))


def tile_percentiles(pixels: DataFrame, tile: int, low: float, high: float) -> DataFrame:
    """Exact linear percentiles (0..100) of each tile."""
    key = [F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")]
    return pixels.groupBy(*key).agg(F.percentile("v", low / 100).alias("low"), F.percentile("v", high / 100).alias("high"))


def normalised_channel(pixels: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """clip((v - low) / (high - low + 1e-5), 0, 1) * mask * 255, truncated; limits of the pixel's own tile."""
    key = pixels.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)}).join(tiles, ["ty", "tx"])
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low") + 1e-5)
    return key.select("y", "x", F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * F.col("mask") * 255).alias("v"))


def interpolated_channel(pixels: DataFrame, spark: SparkSession, height: int, width: int, spacing: int, tile: int, low: float = 5.0, high: float = 99.9) -> DataFrame:
    """A channel (y, x, v, mask) as bytes between its local percentiles.

    log1p of v; percentiles of the tiles of every ``spacing``-th row and column, mirrored to whole tiles; their grid
    resized bilinearly to the mirrored sample, cut, and resized bilinearly to the raster; then
    clip((log1p v - low) / (high - low + 1e-5), 0, 1) * mask * 255, truncated.
    """
    h, w = -(-height // spacing), -(-width // spacing)
    logged = pixels.withColumn("v", F.log1p(F.col("v").cast("double")))
    sample = logged.where(f"y % {spacing} = 0 AND x % {spacing} = 0").select(F.floor(F.col("y") / spacing).alias("y"), F.floor(F.col("x") / spacing).alias("x"), "v")
    gh, gw = -(-h // tile), -(-w // tile)
    grid = tile_percentiles(reflect_padded(sample, h, w, tile), tile, low, high).select(F.col("ty").alias("y"), F.col("tx").alias("x"), "low", "high")
    limits = bilinear(grid, spark, (gh, gw), (gh * tile, gw * tile), ("low", "high")).where((F.col("y") < h) & (F.col("x") < w))
    if spacing > 1:
        limits = bilinear(limits, spark, (h, w), (height, width), ("low", "high"))
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low") + 1e-5)
    return logged.join(limits, ["y", "x"]).select("y", "x", F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * F.col("mask").cast("long") * 255).alias("v"))


def integral_cells(pixels: DataFrame, cells: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of v over each cell (x0, y0, size) by two-way prefix sums, and whether it is over the threshold.

    ``by`` names columns, such as the image, that tell rasters apart in both tables.
    """
    rows = pixels.withColumn("r", F.sum("v").over(Window.partitionBy(*by, "y").orderBy("x")))
    sums = rows.withColumn("s", F.sum("r").over(Window.partitionBy(*by, "x").orderBy("y"))).select(*by, "y", "x", "s")
    corner = F.array(*(F.struct((F.col("y0") + dy * F.col("size") - 1).alias("y"), (F.col("x0") + dx * F.col("size") - 1).alias("x"), F.lit(sign).alias("sign")) for dy, dx, sign in ((0, 0, 1), (0, 1, -1), (1, 0, -1), (1, 1, 1))))
    four = cells.select(*by, "x0", "y0", "size", F.explode(corner).alias("c")).select(*by, "x0", "y0", "size", "c.y", "c.x", "c.sign")
    total = four.join(sums, [*by, "y", "x"], "left").groupBy(*by, "x0", "y0", "size").agg(F.sum(F.coalesce(F.col("s"), F.lit(0.0)) * F.col("sign")).alias("t"))
    mean = F.col("t") / (F.col("size") * F.col("size"))
    return total.select(*by, "x0", "y0", "size", mean.alias("mean"), (mean > threshold).alias("active"))


def bilinear(pixels: DataFrame, spark: SparkSession, source: tuple[int, int], target: tuple[int, int], values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Bilinear resize of a dense raster with half-pixel centres, edges clamped.

    The source's pixels are first put together by fours, so that each target pixel is one row of one join.
    """
    (h, w), (th, tw) = source, target
    corners = pixels.select(*values, "y", "x", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("n"))
    corners = corners.withColumns({"y0": F.col("y") - F.col("n.a"), "x0": F.col("x") - F.col("n.b")}).where("y0 >= 0 AND x0 >= 0")
    corner = lambda c, a, b: F.max(F.when((F.col("n.a") == a) & (F.col("n.b") == b), F.col(c))).alias(f"{c}{a}{b}")
    corners = corners.groupBy("y0", "x0").agg(*(corner(c, a, b) for c in values for a in (0, 1) for b in (0, 1)))
    sy = F.greatest(F.least((F.col("y") + 0.5) * (h / th) - 0.5, F.lit(h - 1.0)), F.lit(0.0))
    sx = F.greatest(F.least((F.col("x") + 0.5) * (w / tw) - 0.5, F.lit(w - 1.0)), F.lit(0.0))
    out = canvas(spark, th, tw).withColumns({"sy": sy, "sx": sx}).withColumns({"y0": F.floor("sy"), "x0": F.floor("sx")}).join(corners, ["y0", "x0"])
    fy, fx = F.col("sy") - F.col("y0"), F.col("sx") - F.col("x0")
    # on the last row and column there is nothing beyond, and its weight is zero
    at = lambda c, a, b: F.coalesce(f"{c}{a}{b}", F.lit(0.0))
    mixed = lambda c: (1 - fy) * ((1 - fx) * at(c, 0, 0) + fx * at(c, 0, 1)) + fy * ((1 - fx) * at(c, 1, 0) + fx * at(c, 1, 1))
    return out.select("y", "x", *(mixed(c).alias(c) for c in values))


def resized(pixels: DataFrame, spark: SparkSession, source: tuple[int, int], target: tuple[int, int], linear: bool = False) -> DataFrame:
    """Nearest (floor of the scaled place) or bilinear resize with half-pixel centres, edges clamped."""
    if linear:
        return bilinear(pixels, spark, source, target)
    (h, w), (th, tw) = source, target
    out = canvas(spark, th, tw).select(F.col("y").alias("oy"), F.col("x").alias("ox"))
    at = out.withColumns({"y": F.floor(F.col("oy") * h / th), "x": F.floor(F.col("ox") * w / tw)})
    return at.join(pixels, ["y", "x"]).select(F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def resized_cubic(pixels: DataFrame, spark: SparkSession, source: tuple[int, int], target: tuple[int, int], a: float = -0.75) -> DataFrame:
    """Bicubic resize of a dense raster, half-pixel centres, edges repeated: sixteen taps by one equi-join, summed before the shuffle."""
    (h, w), (th, tw) = source, target

    def weight(d: Column) -> Column:
        d = F.abs(d)
        near = ((a + 2) * d - (a + 3)) * d * d + 1
        far = ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
        return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)

    taps = F.sequence(F.lit(-1), F.lit(2))
    out = canvas(spark, th, tw).select(F.col("y").alias("oy"), F.col("x").alias("ox"), ((F.col("y") + 0.5) * (h / th) - 0.5).alias("sy"), ((F.col("x") + 0.5) * (w / tw) - 0.5).alias("sx"))
    out = out.select("*", F.explode(taps).alias("j")).select("*", F.explode(taps).alias("i"))
    py, px = F.floor("sy") + F.col("j"), F.floor("sx") + F.col("i")
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("long")
    near = out.select("oy", "ox", clamp(py, h).alias("y"), clamp(px, w).alias("x"), (weight(F.col("sy") - py) * weight(F.col("sx") - px)).alias("wt")).where("wt <> 0")
    return near.join(pixels, ["y", "x"]).groupBy(F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("wt") * F.col("v")).alias("v"))


def otsu(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """One row: the bin (v in 0..bins-1) whose split has the greatest between-class variance; ties to the lowest."""
    h = pixels.groupBy(F.col("v").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin")
    whole = Window.partitionBy()
    h = h.select("bin", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("s"))
    between = F.when(F.col("n0") == F.col("n"), 0.0).otherwise(F.pow(F.col("s0") / F.col("n0") - F.try_divide(F.col("s") - F.col("s0"), F.col("n") - F.col("n0")), 2) * F.col("n0") * (F.col("n") - F.col("n0")))
    return h.select("bin", between.alias("between")).agg(F.max_by("bin", F.struct(F.round("between", 6), -F.col("bin"))).alias("threshold"))


def filled_polygons(spark: SparkSession, polygons: list[tuple[int, list[tuple[int, int]]]], height: int, width: int) -> DataFrame:
    """Label raster: pixels inside each polygon by the even-odd rule, later polygons over earlier ones, else 0."""
    from .geometry import inside_polygon

    value = F.lit(0).cast("long")
    for label, ring in polygons:
        value = F.when(inside_polygon(F.col("x").cast("double"), F.col("y").cast("double"), ring), F.lit(label).cast("long")).otherwise(value)
    return canvas(spark, height, width).withColumn("v", value)


def gaussian_kernel(size: int, sigma: float | None = None) -> list[float]:
    """Weights that sum to one; the usual width for a size where none is given."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(weights) for w in weights]


def convolved(pixels: DataFrame, kernel: list[float], height: int, width: int) -> DataFrame:
    """(y, x, v) of a dense raster under a symmetric separable kernel; borders mirror without repeating the edge.

    Each pixel sends its weighted value to the places that see it, directly or mirrored, and sums are taken
    before the shuffle. The kernel's half must be smaller than the sides.
    """
    half = len(kernel) // 2
    if half >= min(height, width):
        raise ValueError("the kernel is larger than the raster")
    taps = F.array(*(F.struct(F.lit(i - half).alias("d"), F.lit(float(w)).alias("w")) for i, w in enumerate(kernel)))
    for axis, other, side in (("y", "x", height), ("x", "y", width)):
        images = F.array_distinct(F.array(F.col(axis), -F.col(axis), F.lit(2 * side - 2) - F.col(axis)))
        seen = pixels.select(other, "v", F.explode(images).alias("at")).select(other, "v", "at", F.explode(taps).alias("t"))
        seen = seen.select(other, (F.col("at") - F.col("t.d")).alias(axis), (F.col("v") * F.col("t.w")).alias("v"))
        pixels = seen.where((F.col(axis) >= 0) & (F.col(axis) < side)).groupBy("y", "x").agg(F.sum("v").alias("v"))
    return pixels


def soft_labels(classes: DataFrame, positive: list[int], size: int, height: int, width: int) -> DataFrame:
    """Training masks: 1 for pixels of the positive classes, blurred."""
    hard = classes.withColumn("v", F.coalesce(F.col("v").isin(positive), F.lit(False)).cast("double"))
    return convolved(hard, gaussian_kernel(size), height, width)


def unit_pairs(pairs: DataFrame) -> DataFrame:
    """Training pairs (id, image, mask as arrays of doubles): images over 1 are divided by 255, masks clipped to 0..1."""
    scaled = F.when(F.array_max("image") > 1, F.transform("image", lambda v: v / 255)).otherwise(F.col("image"))
    return pairs.select("id", scaled.alias("image"), F.transform("mask", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).alias("mask"))
