"""Grids, boxes, polygons, blocks, quadtree cells and point transforms as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _steps(start: int, stop: int, step: int) -> Column:
    return F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step)) if start < stop else F.array().cast("array<int>")


def grid_points(spark: SparkSession, width: int, height: int, step: tuple[int, int], shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """point_id, x, y: cell centres, x-major; ids are positions."""
    x0, y0 = shift[0] + step[0] // 2, shift[1] + step[1] // 2
    n = len(range(y0, height, step[1]))
    rows = spark.range(1).select(F.posexplode(_steps(x0, width, step[0])).alias("xi", "x"))
    rows = rows.select("xi", "x", F.posexplode(_steps(y0, height, step[1])).alias("yi", "y"))
    return rows.select((F.col("xi").cast("long") * n + F.col("yi")).alias("point_id"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def boxes(points: DataFrame, size: float) -> DataFrame:
    """Corners BL, BR, TR, TL of squares around points; half is size / 2, a fraction for odd sizes."""
    h = size / 2
    corner = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    return points.withColumn("corners", F.array(corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h)))


def patch_boxes(points: DataFrame, size: int) -> DataFrame:
    """Integer patch boxes; half is size // 2 here."""
    half = size // 2
    return points.withColumns({"xmin": F.col("x") - half, "ymin": F.col("y") - half, "xmax": F.col("x") + half, "ymax": F.col("y") + half, "is_tissue": F.lit(True)})


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule by ray casting; a point on a left or lower edge is inside, on a right or upper one outside."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if y0 == y1:
            continue
        spans = (F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)
        at = F.lit(float(x1 - x0)) * (y - y0) / F.lit(float(y1 - y0)) + x0
        crossings = crossings + (spans & (x < at)).cast("int")
    return crossings % 2 == 1


def filter_points(points: DataFrame, rings: list[list[tuple[float, float]]], width: int, height: int, size: float) -> DataFrame:
    """Points in any of the polygons whose box of ``size`` lies in the image."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    hit = F.lit(not rings)
    for ring in rings:
        hit = hit | inside_polygon(x, y, ring)
    h = size / 2
    return points.where(hit & x.between(h, width - h) & y.between(h, height - h))


def spatial_blocks(patches: DataFrame, block_h: int, block_w: int) -> DataFrame:
    """Rows and bounding box of each image's blocks of patches; members stay rows, counts are combined early."""
    return patches.groupBy("image", F.floor(F.col("ymin") / block_h).alias("block_y"), F.floor(F.col("xmin") / block_w).alias("block_x")).agg(
        F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("xmin", "ymin")), *(F.max(c).alias(c) for c in ("xmax", "ymax"))
    )


def uniform_geometry(patches: DataFrame, width: int, height: int) -> DataFrame:
    """One row: patch_h, patch_w if all patches share a size and lie in the image, else nulls."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    one = patches.agg(F.min(w).alias("w0"), F.max(w).alias("w1"), F.min(h).alias("h0"), F.max(h).alias("h1"), F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1"))
    fits = F.expr(f"w0 = w1 AND h0 = h1 AND x0 >= 0 AND y0 >= 0 AND x1 <= {width} AND y1 <= {height}")
    return one.select(F.when(fits, F.col("h0")).alias("patch_h"), F.when(fits, F.col("w0")).alias("patch_w"))


def block_size(chunk: int | None, patch: int, target: int) -> int:
    """Block side snapped to the chunk grid (half-even), at least a patch."""
    if not chunk or chunk > 2 * target:
        return max(target, patch)
    return max(max(1, round(target / chunk)) * chunk, patch)


def model_batches(rows: DataFrame, size: int, number: str = "row_idx") -> DataFrame:
    """Fixed-size batches of densely numbered rows, the remainder last."""
    return rows.withColumns({"batch": F.floor(F.col(number) / size), "place": F.col(number) % size})


def quadtree_cells(patches: DataFrame, size: int, patch: int) -> DataFrame:
    """One cell for each pair of an image's distinct patch columns and rows; the corner is the patch's centre."""
    xs = patches.select("image", (F.col("xmin") + patch // 2).alias("x0")).distinct()
    ys = patches.select("image", (F.col("ymin") + patch // 2).alias("y0")).distinct()
    return xs.join(ys, "image").withColumn("size", F.lit(size).cast("long"))


def samples_on_grid(patches: DataFrame, label: str, patch: int) -> DataFrame:
    """Labels at patch centres over a grid of -1; the last row of a place wins."""
    grid = quadtree_cells(patches, 0, patch).select("image", F.col("x0").alias("x"), F.col("y0").alias("y"))
    known = patches.groupBy("image", (F.col("xmin") + patch // 2).alias("x"), (F.col("ymin") + patch // 2).alias("y")).agg(F.max_by(F.col(label), F.col("row_idx")).alias("label"))
    return grid.join(known, ["image", "x", "y"], "left").select("image", "x", "y", F.coalesce(F.col("label"), F.lit(-1)).cast("long").alias("label"))


def corners(cells: DataFrame) -> DataFrame:
    """Distinct corners of cells."""
    s = F.col("size")
    four = F.array(*(F.struct((F.col("x0") + dx * s).alias("x"), (F.col("y0") + dy * s).alias("y")) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1))))
    return cells.select("image", F.explode(four).alias("c")).select("image", "c.x", "c.y").distinct()


def unsampled_corners(cells: DataFrame, samples: DataFrame) -> DataFrame:
    return corners(cells).join(samples.select("image", "x", "y"), ["image", "x", "y"], "left_anti")


def children(cells: DataFrame) -> DataFrame:
    """Four cells of half the size, halves floored."""
    half = F.floor(F.col("size") / 2)
    four = F.array(*(F.struct((F.col("x0") + dx * half).alias("x0"), (F.col("y0") + dy * half).alias("y0"), half.alias("size")) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1))))
    return cells.select("image", F.explode(four).alias("c")).select("image", "c.x0", "c.y0", "c.size")


def parse_points(text: Column) -> Column:
    """'x,y x,y' to an array of points; malformed numbers are null."""
    parts = F.filter(F.split(F.trim(text), " +"), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(F.split_part(s, F.lit(","), F.lit(1)).try_cast("double").alias("x"), F.split_part(s, F.lit(","), F.lit(2)).try_cast("double").alias("y")))


def format_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p.x.cast("long").cast("string"), p.y.cast("long").cast("string"))), " ")


def padding(source: tuple[int, int], target: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """(before, ...) pads by axis of source and of target that make the two the same size: floor half first."""
    d = [(max(t - s, 0), max(s - t, 0)) for s, t in zip(source, target)]
    return tuple(a // 2 for a, _ in d), tuple(b // 2 for _, b in d)


def transform_points(points: DataFrame, field: DataFrame, field_shape: tuple[int, int], source_shape: tuple[int, int], affine: list[list[float]], pads: tuple[tuple[int, int], tuple[int, int]] = ((0, 0), (0, 0))) -> DataFrame:
    """Registration of points (id, x, y): unpad, scale to the field, add its bilinear displacement, apply the
    inverse affine matrix (2 x 3, given), scale back by the source's size, and take off the target's pad.

    Shapes are (height, width). The four neighbours of a point are four rows of one equi-join with the field.
    """
    (fh, fw), (sh, sw) = field_shape, source_shape
    x = (F.col("x") - pads[0][1]) * F.lit(fw / sw)
    y = (F.col("y") - pads[0][0]) * F.lit(fh / sh)
    near = points.select("id", x.alias("px"), y.alias("py"))
    near = near.withColumns({"cx": F.greatest(F.least("px", F.lit(fw - 1.0)), F.lit(0.0)), "cy": F.greatest(F.least("py", F.lit(fh - 1.0)), F.lit(0.0))})
    near = near.select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy")) for a in (0, 1) for b in (0, 1)))).alias("o"))
    fx, fy = F.col("cx") - F.floor("cx"), F.col("cy") - F.floor("cy")
    weight = F.when(F.col("o.ox") == 1, fx).otherwise(1 - fx) * F.when(F.col("o.oy") == 1, fy).otherwise(1 - fy)
    near = near.select("id", "px", "py", weight.alias("w"), F.least(F.floor("cx") + F.col("o.ox"), F.lit(fw - 1)).cast("long").alias("x"), F.least(F.floor("cy") + F.col("o.oy"), F.lit(fh - 1)).cast("long").alias("y"))
    moved = near.join(field, ["x", "y"]).groupBy("id").agg(F.first("px").alias("px"), F.first("py").alias("py"), F.sum(F.col("w") * F.col("dx")).alias("dx"), F.sum(F.col("w") * F.col("dy")).alias("dy"))
    qx, qy = F.col("px") + F.col("dx"), F.col("py") + F.col("dy")
    ax, ay = (F.lit(float(r[0])) * qx + F.lit(float(r[1])) * qy + F.lit(float(r[2])) for r in affine)
    return moved.select("id", (ax * F.lit(sw / fw) - pads[1][1]).alias("x"), (ay * F.lit(sh / fh) - pads[1][0]).alias("y"))


def transform_patches(patches: DataFrame, size: int, **settings) -> DataFrame:
    """Patch boxes of ``size`` around their transformed centres, in fractions."""
    centres = patches.select(F.col("row_idx").alias("id"), ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    half = size // 2
    return transform_points(centres, **settings).select("id", (F.col("x") - half).alias("xmin"), (F.col("y") - half).alias("ymin"), (F.col("x") + half).alias("xmax"), (F.col("y") + half).alias("ymax"))


def extract_pixels(patches: DataFrame, pixels: DataFrame, tile: int = 448) -> DataFrame:
    """Pixels (image, c, y, x, v) under each patch with patch-relative places; edges are clipped.

    Both sides carry the tile they fall in, so the range join is an equi-join on tiles with a residual test.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))
    cover = patches.withColumn("ty", F.explode(span("ymin", "ymax"))).withColumn("tx", F.explode(span("xmin", "xmax")))
    placed = pixels.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    hit = cover.join(placed, ["image", "ty", "tx"]).where("y >= ymin AND y < ymax AND x >= xmin AND x < xmax")
    return hit.select("image", "row_idx", "c", (F.col("y") - F.col("ymin")).alias("py"), (F.col("x") - F.col("xmin")).alias("px"), "v")


def vertices(rings: DataFrame) -> DataFrame:
    """(shape, place, x, y) of rings (shape, points: array of (x, y))."""
    return rings.select("shape", F.posexplode("points").alias("place", "p")).select("shape", F.col("place").cast("long").alias("place"), "p.x", "p.y")


def nearest_vertices(left: DataFrame, right: DataFrame, levels: int = 20) -> DataFrame:
    """(shape, i, j, distance): the closest vertices of two rings of a shape, the first pair on ties.

    Both are vertex rows (shape, place, x, y), or rings (shape, points: array of (x, y)); i and j are positions in
    the order of ``place``. Vertices on one spot are merged first; rings that share a spot need no more. For the
    others each shape's extent is halved ``levels`` times at most: the finest cells in which both rings have a
    vertex bound the distance by their diagonal, so only cells two steps apart at most are joined. No ring is held
    in one row or task. Null coordinates never pair, but count as positions; a shape without a pair has no row.
    """
    left, right = (vertices(t) if "points" in t.columns else t.select("shape", "place", "x", "y") for t in (left, right))
    spots = lambda t, name: t.where("x IS NOT NULL AND y IS NOT NULL").groupBy("shape", "x", "y").agg(F.min("place").alias(name))
    a, b = spots(left, "p"), spots(right, "q")
    same = a.join(b, ["shape", "x", "y"]).groupBy("shape").agg(F.min(F.struct(F.lit(0.0).alias("d"), "p", "q")).alias("best"))
    a, b = (t.join(same.select("shape"), "shape", "left_anti") for t in (a, b))

    both = a.select("shape", "x", "y", F.lit(1).alias("side")).unionByName(b.select("shape", "x", "y", F.lit(2).alias("side")))
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).cast("double")
    extents = both.groupBy("shape").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), span.alias("span"), F.bit_or("side").alias("sides")).where("sides = 3").drop("sides")
    cell = lambda c, level: F.least(F.floor((F.col(c) - F.col(c + "0")) / F.col("span") * F.pow(F.lit(2.0), level)).cast("long"), (F.pow(F.lit(2.0), level) - 1).cast("long"))
    at_levels = both.join(extents, "shape").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    shared = at_levels.groupBy("shape", "level", cell("x", F.col("level")).alias("cx"), cell("y", F.col("level")).alias("cy")).agg(F.bit_or("side").alias("sides")).where("sides = 3")
    scales = extents.join(shared.groupBy("shape").agg(F.max("level").alias("level")), "shape")

    placed = lambda t: t.join(scales, "shape").withColumns({"cx": cell("x", F.col("level")), "cy": cell("y", F.col("level"))})
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3)))
    near = placed(b).select("shape", F.col("x").alias("u"), F.col("y").alias("v"), "q", "cx", "cy", F.explode(around).alias("o"))
    near = near.select("shape", "u", "v", "q", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
    square = ((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))).cast("double")
    apart = placed(a).join(near, ["shape", "cx", "cy"]).groupBy("shape").agg(F.min(F.struct(square.alias("d"), "p", "q")).alias("best"))

    best = same.unionByName(apart).select("shape", "best.*")
    every = left.select("shape", "place", F.lit(1).alias("side")).unionByName(right.select("shape", "place", F.lit(2).alias("side")))
    before = lambda side, own: F.count_if((F.col("side") == side) & (F.col("place") < F.col(own)))
    return best.join(every, "shape").groupBy("shape").agg(before(1, "p").alias("i"), before(2, "q").alias("j"), F.sqrt(F.first("d")).alias("distance"))


def contour_holes(contours: DataFrame) -> DataFrame:
    """(contour, holes): each outer contour with its holes' numbers in order; rows have contour and parent (-1: outer)."""
    outer = contours.where("parent = -1").select("contour")
    holes = contours.where("parent <> -1").groupBy(F.col("parent").alias("contour")).agg(F.sort_array(F.collect_list(contours["contour"])).alias("holes"))
    return outer.join(holes, "contour", "left").withColumn("holes", F.coalesce("holes", F.array().cast("array<bigint>")))
