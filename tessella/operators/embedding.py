"""Embedding of patches from tiled slides, dispatch by embedder, token maps and saliency of several clusterizers.

A slide is a table of tiles (image, y, x, h, w, data: bytes of channels x h x w). Patches are read by blocks: those
that start in one block are a group, beside the tiles that any of them can overlap, so a tile is decoded once a block.
What lies outside the slide is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as IO
from . import features as A
from . import geometry as G
from .autoencoder import SparseAutoencoder, hash_embedder
from .cluster import FrequencyRankedKMeans, TokenClusters

#: Patches of one group; a fuller block is read by several.
MOST_PATCHES = 4096
#: Patches (n, channels, h, w) of bytes to vectors (n, width), or to vectors of tokens (n, tokens, width).
Embedder = Callable[[np.ndarray], np.ndarray]


def embed_blocks(patches: DataFrame, tiles: DataFrame, embedder: Embedder, channels: int = 3, size: int = 448, block: int = 4096, batch: int = 32, tokens: bool = False) -> DataFrame:
    """(image, row_idx, vec) of patches (image, row_idx, xmin, ymin, xmax, ymax) of at most ``size`` pixels a side.

    With ``tokens`` the embedder gives several vectors a patch: (image, row_idx, position, vec). Patches of one shape
    are embedded ``batch`` at a time; a patch on no tile is all zeros, one larger than ``size`` is an error.
    """
    small = F.raise_error(F.lit("a patch is larger than size"))
    fits = (F.col("xmax") - F.col("xmin") <= size) & (F.col("ymax") - F.col("ymin") <= size)
    cut = lambda c: F.floor(F.col(c) / block)
    own = patches.select("image", F.when(fits, F.col("row_idx")).otherwise(small.cast("long")).alias("row_idx"), *(F.col(c).cast("long").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    # a block with more patches than its pixels explain (one place many times) is several groups
    own = own.withColumns({"by": cut("ymin"), "bx": cut("xmin")})
    crowded = own.groupBy("image", "by", "bx").agg(F.ceil(F.count(F.lit(1)) / MOST_PATCHES).alias("parts"))
    own = own.join(crowded, ["image", "by", "bx"]).withColumn("part", F.pmod(F.xxhash64("row_idx"), F.col("parts"))).drop("parts")
    # the blocks in which a patch that overlaps the tile can start
    over = lambda c, n: F.explode(F.sequence(F.floor((F.col(c) - (size - 1)) / block), F.floor((F.col(c) + F.col(n) - 1) / block)))
    seen = tiles.select("image", "y", "x", "h", "w", "data", over("y", "h").alias("by")).select("*", over("x", "w").alias("bx"))
    seen = seen.join(crowded, ["image", "by", "bx"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts")
    names = ["image", "row_idx", *(["position"] if tokens else []), "vec"]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), *([pa.int64()] if tokens else []), pa.list_(pa.float32()))], names=names)
        x0, y0, x1, y1 = (left[c].to_numpy() for c in ("xmin", "ymin", "xmax", "ymax"))
        top, edge = y0.min(), x0.min()
        held = np.zeros((channels, y1.max() - top, x1.max() - edge), dtype=np.uint8)
        for y, x, h, w, data in zip(*(right[c].to_pylist() for c in ("y", "x", "h", "w", "data"))):
            a, b = max(y, top), max(x, edge)
            c, d = min(y + h, top + held.shape[1]), min(x + w, edge + held.shape[2])
            if a < c and b < d:
                held[:, a - top : c - top, b - edge : d - edge] = np.frombuffer(data, np.uint8).reshape(channels, h, w)[:, a - y : c - y, b - x : d - x]
        found: list = [None] * left.num_rows
        shapes: dict[tuple[int, int], list[int]] = {}
        for i in range(left.num_rows):
            shapes.setdefault((y1[i] - y0[i], x1[i] - x0[i]), []).append(i)
        for members in shapes.values():
            for at in range(0, len(members), batch):
                some = members[at : at + batch]
                out = np.asarray(embedder(np.stack([held[:, y0[i] - top : y1[i] - top, x0[i] - edge : x1[i] - edge] for i in some])), dtype=np.float32)
                for i, vec in zip(some, out):
                    found[i] = vec
        rows = left["row_idx"].to_numpy()
        image = left["image"][0].as_py()
        if tokens:
            n = [len(v) for v in found]
            columns = [pa.array([image] * sum(n), pa.string()), pa.array(np.repeat(rows, n)), pa.array(np.concatenate([np.arange(k) for k in n])), pa.array([t for v in found for t in v], pa.list_(pa.float32()))]
        else:
            columns = [pa.array([image] * len(rows), pa.string()), pa.array(rows), pa.array(found, pa.list_(pa.float32()))]
        return pa.table(columns, names=names)

    key = ["image", "by", "bx", "part"]
    schema = "image string, row_idx long, " + ("position long, " if tokens else "") + "vec array<float>"
    return own.groupBy(*key).cogroup(seen.groupBy(*key)).applyInArrow(lambda left, right: one(left, right), schema)


def channel_means(images: np.ndarray) -> np.ndarray:
    """An embedder without a model: mean and greatest byte of each channel."""
    flat = images.reshape(*images.shape[:2], -1)
    return np.concatenate([flat.mean(axis=2), flat.max(axis=2)], axis=1)


def hashed(width: int = 1024) -> Embedder:
    embed = hash_embedder(width)
    return lambda images: embed([x.tobytes() for x in images])


#: Embedders by name: (maker, kind). Kinds: Vision (patches to vectors), SAE, KMeans.
EMBEDDERS: dict[str, tuple[Callable[[], object], str]] = {"test": (hashed, "Vision"), "channel_means": (lambda: channel_means, "Vision")}


def embedder_of(container: IO.Container, name: str) -> tuple[object, str]:
    """An embedder and its kind, by its name or from the container's models; an unknown name is a ValueError."""
    if name in EMBEDDERS:
        make, kind = EMBEDDERS[name]
        return make(), kind
    if name in container.loaded:
        model = container.loaded[name]
        kind = "SAE" if isinstance(model, SparseAutoencoder) else "KMeans" if isinstance(model, FrequencyRankedKMeans) else "Vision"
        return model, kind
    raise ValueError(f"unknown embedder {name}")


def embed_patch(container: IO.Container, table: str, embedder: str, image: str | None = None, source: str | None = None, keep: list[int] | None = None, overwrite: bool = False, save_to: str | None = None, **settings) -> DataFrame:
    """Embed the rows of the patch table ``table`` and put the result into the container.

    * Vision: element ``<table>.<name>_embedding`` (image, row_idx, vec) from the tiles of element ``image``;
    * SAE: element ``<table>.features`` (row_idx, name, score) from the embedding ``source``: names ``<name>_<unit>``
      replace those it has, other features stay;
    * KMeans: columns ``<name>_label`` and one 0/1 column a label in the patch table, from the embedding ``source``.

    What is there already stays unless ``overwrite``. With ``save_to``, a container's folder, the element is written.
    """
    model, kind = embedder_of(container, embedder)
    elements = container.elements
    if kind == "Vision":
        name = f"{table}.{embedder}_embedding"
        if name not in elements or overwrite:
            elements[name] = embed_blocks(elements[table], elements[image], model, **settings)
    elif kind == "SAE":
        name = f"{table}.features"
        old = elements.get(name)
        units = keep if keep is not None else list(range(len(model.p["b"])))
        if old is not None and not overwrite and {f"{embedder}_{i}" for i in units} <= {r.name for r in old.select("name").distinct().collect()}:
            return old
        new = model.transform(elements[f"{table}.{source}"], keep).select("row_idx", F.concat(F.lit(f"{embedder}_"), F.col("feature").cast("string")).alias("name"), "score")
        if old is not None:
            ours = F.col("name").rlike(f"^{embedder}_[0-9]+$") & F.substring_index("name", "_", -1).cast("long").isin(units)
            new = old.where(~ours).unionByName(new)
        elements[name] = new
    else:
        name, column = table, f"{embedder}_label"
        if column not in elements[table].columns or overwrite:
            labels = model.transform(elements[f"{table}.{source}"]).select("row_idx", F.col("label").alias(column))
            gone = [c for c in elements[table].columns if c == column or c.startswith(column + "_")]
            elements[table] = A.one_hot(elements[table].drop(*gone).join(labels, "row_idx", "left"), model.k, embedder, column)
    if save_to:
        IO.overwrite_element(elements[name], f"{save_to}/{name}")
        elements[name] = container.spark.read.parquet(f"{save_to}/{name}")
    return elements[name]


# ---- token clusters and saliency


def token_maps(patches: DataFrame, tiles: DataFrame, embedder: Embedder, clusterizer: TokenClusters, **settings) -> DataFrame:
    """(row_idx, y, x, v): each patch's grid of cluster numbers, from pixels to tokens to clusters."""
    return clusterizer.maps(embed_blocks(patches, tiles, embedder, tokens=True, **settings).select("row_idx", "position", "vec"))


def saliency_maps(tokens: DataFrame | list[DataFrame], clusterizers: list[TokenClusters], height: int, width: int) -> DataFrame:
    """(row_idx, k, y, x, v) of K clusterizers, from one table of tokens that all share or from one for each."""
    if not clusterizers:
        raise ValueError("no clusterizers")
    shared = isinstance(tokens, DataFrame)
    if not shared and len(tokens) != len(clusterizers):
        raise ValueError("as many token tables as clusterizers, or one for all")
    out = [c.saliency(tokens if shared else tokens[k], height, width).select("row_idx", F.lit(k).cast("long").alias("k"), "y", "x", F.col("v").cast("long").alias("v")) for k, c in enumerate(clusterizers)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def coordinate_labeler(tiles: DataFrame, embedder: Embedder, classifier: FrequencyRankedKMeans, patch: int = 448, **settings) -> Callable[[DataFrame], DataFrame]:
    """(image, x, y) to (image, x, y, label): the class of the patch around each place, zero outside the slide."""

    def label(places: DataFrame) -> DataFrame:
        numbered = places.select("image", "x", "y").distinct().withColumn("row_idx", F.xxhash64("image", "x", "y"))
        half = patch // 2
        boxes = numbered.select("image", "row_idx", (F.col("x") - half).alias("xmin"), (F.col("y") - half).alias("ymin"), (F.col("x") + half).alias("xmax"), (F.col("y") + half).alias("ymax"))
        found = classifier.transform(embed_blocks(boxes, tiles, embedder, size=2 * half, **settings)).select("image", "row_idx", "label")
        return numbered.join(found, ["image", "row_idx"]).select("image", "x", "y", "label")

    return label


def sample_slides(patches: DataFrame, labels: str, labeler: Callable[[DataFrame], DataFrame], height: int, width: int, groups: list[list[int]], initial: int = 256, patch: int = 448, least: int | list[int] = 32, classes: int = 26, **settings) -> DataFrame:
    """Adaptive samples of slides: for each group of classes the grid is refined anew where the group begins or ends.

    Starts from the patches' own ``labels``; a group maps its classes to one and the others under ``classes`` to zero.
    ``least`` is one smallest cell for all groups, or one for each.
    """
    from .adaptive import adaptive_samples

    sizes = least if isinstance(least, list) else [least] * len(groups)
    if len(sizes) != len(groups):
        raise ValueError("as many least sizes as groups")
    samples = G.samples_on_grid(patches, labels, patch)
    for group, size in zip(groups, sizes):
        cells = G.quadtree_cells(patches, initial, patch)
        mapping = {i: float(i in group) for i in range(-1, classes)}
        samples = adaptive_samples(cells, samples, labeler, height, width, least=size, mapping=mapping, **settings)
    return samples


def rows_of_batches(rows: DataFrame, size: int) -> Iterator[DataFrame]:
    """Fixed-size batches of densely numbered rows, one frame each."""
    batches = G.model_batches(rows, size)
    for r in batches.agg(F.max("batch").alias("last")).collect():
        for k in range(0 if r.last is None else r.last + 1):
            yield batches.where(F.col("batch") == k)
