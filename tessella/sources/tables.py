"""Sources and sinks: a container of elements as Parquet tables, ROI files, tiles, samples, exports.

A container is a folder with one Parquet table for each element and the registries ``images`` (name, type, path)
and ``models_metadata`` (name, model_type, serializer, path).
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = "name string, type string, path string"
MODELS = "name string, model_type string, serializer string, path string"


class Container:
    """Elements by name; pixels are left out on writing, models are parameter tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.elements: dict[str, DataFrame] = {}
        self.loaded: dict[str, object] = {}
        self.images = spark.createDataFrame([], IMAGES)
        self.models = spark.createDataFrame([], MODELS)

    def add_image(self, name: str, kind: str, path: str, tiles: DataFrame | None = None) -> Container:
        self.images = self.images.unionByName(self.spark.createDataFrame([(name, kind, path)], IMAGES))
        if tiles is not None:
            self.elements[name] = tiles
            tiles.createOrReplaceTempView(name)
        return self

    def add_model(self, name: str, model) -> Container:
        """A model with numpy or plain parameters, registered under its class."""
        self.loaded[name] = model
        self.models = self.models.unionByName(self.spark.createDataFrame([(name, type(model).__name__, "json", f"models/{name}")], MODELS))
        return self

    def model(self, name: str):
        """The first registered model of that name."""
        found = self.models.where(F.col("name") == name).limit(1).collect()
        if not found:
            raise KeyError(name)
        return found[0]

    def write(self, path: str, pixels: tuple[str, ...] = ("data", "v")) -> None:
        names = {r.name for r in self.images.select("name").collect()}
        for name, df in self.elements.items():
            df = df.drop(*pixels) if name in names else df
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        self.images.write.mode("overwrite").parquet(f"{path}/images")
        self.models.write.mode("overwrite").parquet(f"{path}/models_metadata")
        for name, model in self.loaded.items():
            text = json.dumps({k: plain(v) for k, v in vars(model).items()})
            self.spark.createDataFrame([(type(model).__name__, text)], "kind string, parameters string").write.mode("overwrite").parquet(f"{path}/models/{name}")
        names_written = [(n,) for n in self.elements]
        self.spark.createDataFrame(names_written, "name string").write.mode("overwrite").parquet(f"{path}/elements")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Container:
        """Elements by name (all that were written, where none are named), registries and models."""
        out = cls(spark)
        names = names if names is not None else [r.name for r in spark.read.parquet(f"{path}/elements").collect()]
        out.elements = {n: spark.read.parquet(f"{path}/{n}") for n in names}
        out.images, out.models = spark.read.parquet(f"{path}/images"), spark.read.parquet(f"{path}/models_metadata")
        for r in out.models.select("name").distinct().collect():
            kind, text = spark.read.parquet(f"{path}/models/{r.name}").first()
            out.loaded[r.name] = restored(kind, json.loads(text))
        return out


def plain(value):
    """numpy arrays as lists under a mark."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    return {"table": {k: plain(v) for k, v in value.items()}} if isinstance(value, dict) else value


def restored(kind: str, parameters: dict):
    """A model of one of the library's own classes; others are a ValueError."""
    from ..operators.autoencoder import SparseAutoencoder
    from ..operators.cluster import FrequencyRankedKMeans

    known = {c.__name__: c for c in (SparseAutoencoder, FrequencyRankedKMeans)}
    if kind not in known:
        raise ValueError(f"model of kind {kind}")

    def back(value):
        if isinstance(value, dict):
            return np.array(value["array"]) if "array" in value else {k: back(v) for k, v in value["table"].items()}
        return value

    model = known[kind]()
    vars(model).update({k: back(v) for k, v in parameters.items()})
    return model


def overwrite_element(df: DataFrame, path: str) -> None:
    """Write beside the old table, then put it in its place; ``df`` may read the old one.

    The old table is moved aside before the new one takes its name, and deleted last: at any time one of them is whole.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}{suffix}") for suffix in (f".{uuid.uuid4().hex}", ""))
    df.write.parquet(new.toString())
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    there = fs.exists(old)
    if there and not fs.rename(old, aside):
        raise OSError(f"could not move {old} aside")
    if not fs.rename(new, old):
        if there:
            fs.rename(aside, old)
        raise OSError(f"could not move {new} to {old}")
    if there:
        fs.delete(aside, True)


def read_rois_xml(spark: SparkSession, path: str, points_type: str = "Polygon") -> DataFrame:
    """ROI rows (roi_id, text, points) of an OME-XML file: polygons with their text, polylines with the ROI's name."""
    shape = lambda fields: f"struct<{fields}>"
    schema = f"_ID string, _Name string, Union {shape('Polygon:' + shape('_Text:string,_Points:string') + ',Polyline:' + shape('_Points:string'))}"
    rois = spark.read.format("xml").option("rowTag", "ROI").schema(schema).load(path)
    polygons = rois.where("`Union`.Polygon._Points IS NOT NULL").select(F.col("_ID").alias("roi_id"), F.col("Union.Polygon._Text").alias("text"), F.col("Union.Polygon._Points").alias("points"))
    lines = rois.where("`Union`.Polyline._Points IS NOT NULL").select(F.col("_ID").alias("roi_id"), F.col("_Name").alias("text"), F.col("Union.Polyline._Points").alias("points"))
    return polygons.unionByName(lines)


def read_rois_csv(spark: SparkSession, path: str, size: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a region file; missing columns, or sizes (height, width) other than the slide's, are a ValueError."""
    rois = spark.read.csv(path, header=True)
    missing = {"SizeX", "SizeY", "Points"} - set(rois.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if size is not None and not rois.where((F.col("SizeY").cast("long") != size[0]) | (F.col("SizeX").cast("long") != size[1]) | F.col("SizeX").isNull() | F.col("SizeY").isNull()).isEmpty():
        raise ValueError("regions of another size than the slide")
    return rois


def write_samples(samples: DataFrame, path: str) -> None:
    """x, y int and label tinyint, zstd; a label out of range is an error."""
    samples.selectExpr("CAST(x AS INT) AS x", "CAST(y AS INT) AS y", "CAST(label AS TINYINT) AS label").write.option("compression", "zstd").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("x int, y int, label tinyint").parquet(path)


def export_rows(patches: DataFrame) -> DataFrame:
    """Boxes with a dense row number in (image, row) order, numbered by image and row range, not in one sort."""
    from ..operators.selection import global_number, range_of, ranges

    boxes = patches.select("image", "row_idx", "xmin", "ymin", "xmax", "ymax")
    key = [("__image", F.col("image")), ("__range", range_of("row_idx", ranges(boxes, "row_idx")))]
    rows = global_number(boxes, key, [F.col("row_idx")], "row_no")
    return rows.select((F.col("row_no") - 1).alias("row_no"), "image", "xmin", "ymin", "xmax", "ymax")


def export_patches(patches: DataFrame, path: str, image: str = "all") -> None:
    rows = patches if image == "all" else patches.where(F.col("image") == image)
    export_rows(rows).write.csv(path, header=True)


def overlaid(base: DataFrame, edits: DataFrame, key: list[str], value: str = "v") -> DataFrame:
    """Copy on write: edited values where there are any."""
    changed = edits.select(*key, F.col(value).alias("__new"), F.lit(True).alias("__edited"))
    return base.join(changed, key, "left").select(*key, F.when(F.col("__edited"), F.col("__new")).otherwise(F.col(value)).alias(value))


def merged_metadata(rows: DataFrame) -> DataFrame:
    """(level, k, v): a key that all levels have with one value stays, others are prefixed by level."""
    levels = rows.select("level").distinct().groupBy().agg(F.count(F.lit(1)).alias("levels"))
    keys = rows.groupBy("k").agg(F.count_distinct("level").alias("n"), F.count_distinct("v").alias("nv")).join(F.broadcast(levels))
    named = rows.join(keys, "k").withColumn("name", F.when((F.col("n") == F.col("levels")) & (F.col("nv") == 1), F.col("k")).otherwise(F.concat_ws(".", "level", "k")))
    return named.select("name", F.col("v").alias("value")).distinct()


def tile_grid(spark: SparkSession, height: int, width: int, step_y: int, step_x: int) -> DataFrame:
    """Tiles row by row, cut at the edges."""
    ny, nx = -(-height // step_y), -(-width // step_x)
    at = spark.range(ny * nx).select((F.floor(F.col("id") / nx) * step_y).alias("y"), (F.col("id") % nx * step_x).alias("x"))
    return at.select("y", "x", F.least(F.lit(step_y), F.lit(height) - F.col("y")).cast("long").alias("h"), F.least(F.lit(step_x), F.lit(width) - F.col("x")).cast("long").alias("w"))


def tile_address(key, downsample, tile: int):
    """'level/y.x.c' to (level, y, x, channel) of the region at the base level."""
    part = lambda i: F.split(key, "[/.]")[i].cast("long")
    return F.struct(part(0).alias("level"), (part(1) * downsample * tile).cast("long").alias("y"), (part(2) * downsample * tile).cast("long").alias("x"), part(3).alias("c"))


def levels(tiles: DataFrame) -> DataFrame:
    """image, base size, top level and its scale (y, x)."""
    size = tiles.groupBy("image", "level").agg(F.max(F.col("y") + F.col("h")).alias("height"), F.max(F.col("x") + F.col("w")).alias("width"))
    w = Window.partitionBy("image").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return size.select("image", "level", "height", "width", (F.first("height").over(w) / F.col("height")).alias("scale_y"), (F.first("width").over(w) / F.col("width")).alias("scale_x"))


def kept_names(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Rows of ``old`` whose names ``new`` doesn't replace."""
    return old.join(new.select(name), name, "left_anti")
