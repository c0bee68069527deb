"""Hierarchical clustering of selected features, frequency-ranked KMeans, token clusters.

The number of selected features is small by selection (the caller passes at most ``MOST_FEATURES``), so the
linkage of their k x k distances runs on the driver; everything over rows stays in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import features as A

MOST_FEATURES = 5000


def linkage(distance: np.ndarray, method: str = "average") -> np.ndarray:
    """Rows (a, b, distance, size) of merges, in the usual numbering; ties go to the lowest pair."""
    if method not in ("average", "single", "complete"):
        raise ValueError(method)
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    names, sizes, out = list(range(n)), [1] * n, []
    # each row's nearest to its right, kept up to date: a merge changes few of them
    nearest, least = np.zeros(n, dtype=np.int64), np.full(n, np.inf)

    def look(k: int) -> None:
        if k + 1 < n:
            nearest[k] = k + 1 + int(np.argmin(d[k, k + 1 :]))
            least[k] = d[k, nearest[k]]

    for k in range(n):
        look(k)
    alive = np.ones(n, dtype=bool)
    for step in range(n - 1):
        i = int(np.argmin(least))
        j = int(nearest[i])
        a, b = sorted((names[i], names[j]))
        out.append((a, b, d[i, j], sizes[i] + sizes[j]))
        if method == "average":
            row = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        else:
            row = (np.minimum if method == "single" else np.maximum)(d[i], d[j])
        alive[j] = False
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        least[j] = np.inf
        names[i], sizes[i] = n + step, sizes[i] + sizes[j]
        before = np.arange(n) < i
        nearer = before & alive & ((row < least) | ((row == least) & (i < nearest))) & (nearest != i) & (nearest != j)
        nearest[nearer], least[nearer] = i, row[nearer]
        for k in np.flatnonzero(alive & ((nearest == i) & before & ~nearer | (nearest == j) & (np.arange(n) < j))).tolist():
            look(k)
        look(i)
    return np.array(out).reshape(-1, 4)


def flat_clusters(merges: np.ndarray, n: int, threshold: float, criterion: str = "distance") -> np.ndarray:
    """Cluster number (from 1, by first appearance) of each item: merges up to a distance, or at most so many clusters."""
    if criterion == "maxclust":
        used = merges[: max(0, n - int(threshold))]
    elif criterion == "distance":
        used = merges[merges[:, 2] <= threshold]
    else:
        raise ValueError(criterion)
    members = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(merges[: len(used)]):
        members[n + step] = members.pop(int(a)) + members.pop(int(b))
    out = np.zeros(n, dtype=np.int64)
    for k, group in enumerate(sorted(members.values(), key=min)):
        out[group] = k + 1
    return out


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Items from left to right in the dendrogram."""
    order, stack = [], [n + len(merges) - 1 if len(merges) else 0]
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            a, b = merges[node - n][:2].astype(int)
            stack += [b, a]
    return order


@dataclass
class FeatureClusters:
    """Clusters of features by 1 - IoU; reading results before ``fit`` is an error."""

    threshold: float = 0.5
    criterion: str = "distance"
    method: str = "average"
    table: DataFrame | None = field(default=None, repr=False)

    def fit(self, iou: DataFrame) -> FeatureClusters:
        """From pairs (i, j, iou) with i < j."""
        return self.fit_distances(iou.select("i", "j", (1 - F.col("iou")).alias("distance")))

    def fit_vectors(self, rows: DataFrame, metric: str = "cosine") -> FeatureClusters:
        """From vectors (row_idx, vec) of a small set."""
        return self.fit_distances(pair_distances(rows, metric))

    def fit_distances(self, pairs: DataFrame) -> FeatureClusters:
        """From all pairs (i, j, distance), i < j, of at most ``MOST_FEATURES`` items; they come as Arrow columns."""
        few = pairs.select(F.explode(F.array("i", "j")).alias("f")).distinct().limit(MOST_FEATURES + 1).toArrow()["f"].to_pylist()
        if len(few) > MOST_FEATURES:
            raise ValueError("select features first")
        names = sorted(few)
        table = pairs.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("distance").cast("double")).toArrow()
        i, j = (np.searchsorted(names, table[c].to_numpy()) for c in ("i", "j"))
        distance = np.zeros((len(names), len(names)))
        distance[i, j] = distance[j, i] = table["distance"].to_numpy()
        merges = linkage(distance, self.method)
        clusters, order = flat_clusters(merges, len(names), self.threshold, self.criterion), leaf_order(merges, len(names))
        place = {k: p for p, k in enumerate(order)}
        rows = [(names[k], int(clusters[k]), place[k]) for k in range(len(names))]
        self.table = pairs.sparkSession.createDataFrame(rows, "feature long, cluster long, place long")
        return self

    def clusters(self) -> DataFrame:
        if self.table is None:
            raise RuntimeError("fit first")
        return self.table

    def display(self, iou: DataFrame) -> DataFrame:
        """Heatmap cells (row, col, iou) in leaf order, both triangles and the diagonal."""
        t = self.clusters()
        both = iou.select("i", "j", "iou").unionByName(iou.select(F.col("j").alias("i"), F.col("i").alias("j"), "iou")).unionByName(t.select(F.col("feature").alias("i"), F.col("feature").alias("j"), F.lit(1.0).alias("iou")))
        a, b = t.select(F.col("feature").alias("i"), F.col("place").alias("row")), t.select(F.col("feature").alias("j"), F.col("place").alias("col"))
        return both.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("row", "col", "iou")


def pair_distances(rows: DataFrame, metric: str = "cosine") -> DataFrame:
    """(i, j, distance) of all pairs of a small set of vectors (row_idx, vec), such as features or centroids."""
    if metric == "cosine":
        return cosine_distances(rows)
    apart = {"euclidean": lambda x: x * x, "sqeuclidean": lambda x: x * x, "cityblock": F.abs}
    if metric not in apart:
        raise ValueError(metric)
    a, b = rows.select("row_idx", "vec").alias("a"), rows.select("row_idx", "vec").alias("b")
    total = F.aggregate(F.zip_with(F.col("a.vec"), F.col("b.vec"), lambda x, y: apart[metric](x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, F.col("a.row_idx") < F.col("b.row_idx")).select(F.col("a.row_idx").alias("i"), F.col("b.row_idx").alias("j"), (F.sqrt(total) if metric == "euclidean" else total).alias("distance"))


def cosine_distances(rows: DataFrame) -> DataFrame:
    """(i, j, distance) of all pairs of a small set of vectors (row_idx, vec)."""
    unit = rows.select("row_idx", A.l2_normalised(F.col("vec")).alias("v"))
    a, b = unit.alias("a"), unit.alias("b")
    return a.join(b, F.col("a.row_idx") < F.col("b.row_idx")).select(F.col("a.row_idx").alias("i"), F.col("b.row_idx").alias("j"), (1 - A.dot(F.col("a.v"), F.col("b.v"))).alias("distance"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column without nulls as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :], 0.0)


@dataclass
class FrequencyRankedKMeans:
    """KMeans whose labels are renumbered by falling frequency in the fitted rows.

    Every pass is one Arrow map over the whole table: a task adds up its rows by centre, and the sums are combined
    in Spark, so the driver sees k rows of numbers whatever the table's size. Starts are drawn by k-means|| (rows
    with odds by their distance from the starts so far, weighed by the rows nearest to each, then k-means++ of
    those on the driver). Passes end when the centres' squared shift is at most ``tolerance`` times the mean
    variance, or after ``most_passes``. Rows without a vector are left out of the fit and have a null label.
    """

    k: int = 25
    normalise: bool = True
    seed: int = 0
    centroids: list[list[float]] | None = None
    tolerance: float = 1e-4
    most_passes: int = 20
    rounds: int = 3

    def _read(self, column: pa.Array) -> np.ndarray:
        x = matrix(column)
        return unit_rows(x) if self.normalise else x

    def _sums(self, rows: DataFrame, centres: np.ndarray, width: int) -> np.ndarray:
        """(centres, width + 3): sums of the rows nearest to each centre, their count, squared distances and norms."""
        read = self._read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), width + 3))
            for batch in batches:
                x = read(batch.column(0))
                if not len(x):
                    continue
                d = squared_distances(x, centres)
                near = d.argmin(axis=1)
                hot = np.zeros((len(centres), len(x)))
                hot[near, np.arange(len(x))] = 1
                total[:, :width] += hot @ x
                total[:, width] += hot.sum(axis=1)
                total[:, width + 1] += hot @ d[np.arange(len(x)), near]
                total[:, width + 2] += hot @ (x * x).sum(axis=1)
            for at in range(0, len(centres), 512):
                part = total[at : at + 512]
                place = np.arange(at * total.shape[1], (at + len(part)) * total.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(part.reshape(-1))], names=["place", "total"])

        added = rows.mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
        out = np.zeros(len(centres) * (width + 3))
        out[added["place"].to_numpy()] = added["total"].to_numpy()
        return out.reshape(len(centres), -1)

    def _drawn(self, rows: DataFrame, centres: np.ndarray, cost: float, turn: int) -> np.ndarray:
        """About 2 k rows, with odds by squared distance; draws depend on the seed, the task and the round."""
        read, odds, seed = self._read, 2.0 * self.k / cost, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng((seed, turn, TaskContext.get().partitionId()))
            for batch in batches:
                x = read(batch.column(0))
                if len(x):
                    some = x[rng.random(len(x)) < odds * squared_distances(x, centres).min(axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(some.tolist(), pa.list_(pa.float64()))], names=["vec"])

        found = rows.mapInArrow(run, "vec array<double>").distinct().toArrow()["vec"].to_pylist()
        return np.array(sorted(found)).reshape(-1, centres.shape[1])

    def _starts(self, rows: DataFrame, width: int) -> tuple[np.ndarray, float]:
        """Start centres, and the mean variance of a component."""
        first = rows.agg(F.min_by("vec", F.xxhash64(F.lit(self.seed), "vec"))).toArrow().column(0).combine_chunks()
        candidates = self._read(first)
        variance = 0.0
        for turn in range(self.rounds):
            sums = self._sums(rows, candidates, width)
            if not turn:
                n = sums[:, width].sum()
                mean = sums[:, :width].sum(axis=0) / n
                variance = max(sums[:, width + 2].sum() / n - float(mean @ mean), 0.0) / width
            cost = sums[:, width + 1].sum()
            if cost <= 1e-12 * max(1.0, sums[:, width + 2].sum()):
                break
            candidates = np.unique(np.vstack([candidates, self._drawn(rows, candidates, cost, turn)]), axis=0)
        weights = self._sums(rows, candidates, width)[:, width]
        rng = np.random.default_rng(self.seed)
        chosen = [int(weights.argmax())]
        while len(chosen) < min(self.k, len(candidates)):
            far = squared_distances(candidates, candidates[chosen]).min(axis=1) * weights
            far[chosen] = 0
            if far.sum() <= 0:
                break
            # the best of a few draws, by the cost it leaves
            draws = np.unique(rng.choice(len(candidates), 2 + int(np.log(self.k + 1)), p=far / far.sum()))
            chosen.append(min(draws.tolist(), key=lambda c: float((squared_distances(candidates, candidates[[*chosen, c]]).min(axis=1) * weights).sum())))
        centres = candidates[chosen]
        for _ in range(10):  # Lloyd's steps over the weighted candidates
            near = squared_distances(candidates, centres).argmin(axis=1)
            hot = np.eye(len(centres))[near] * weights[:, None]
            size = hot.sum(axis=0)
            centres = np.where(size[:, None] > 0, hot.T @ candidates / np.maximum(size, 1e-300)[:, None], centres)
        return centres, variance

    def fit(self, rows: DataFrame) -> FrequencyRankedKMeans:
        """From (row_idx, vec); fewer distinct rows than k give fewer centres, none is an error."""
        data = rows.select("vec").where("vec IS NOT NULL")
        widths = data.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if not widths[1] or widths[0] != widths[1]:
            raise ValueError("no rows, or vectors of several lengths")
        width = widths[0]
        centres, variance = self._starts(data, width)
        for _ in range(self.most_passes):
            sums = self._sums(data, centres, width)
            size = sums[:, width]
            new = np.where(size[:, None] > 0, sums[:, :width] / np.maximum(size, 1)[:, None], centres)
            shift = float(((new - centres) ** 2).sum())
            centres = new
            if shift <= self.tolerance * variance:
                break
        size = self._sums(data, centres, width)[:, width]
        self.centroids = [centres[i].tolist() for i in np.lexsort((np.arange(len(centres)), -size)).tolist()]
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``label``, the nearest centre; ties go to the lowest number, a null vector has none."""
        if self.centroids is None:
            raise RuntimeError("fit first")
        rows = rows.drop("label")
        at, read, centres = rows.columns.index("vec"), self._read, np.array(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = np.flatnonzero(batch.column(at).is_valid().to_numpy(zero_copy_only=False))
                labels = np.full(len(batch), -1)
                if len(known):
                    labels[known] = squared_distances(read(batch.column(at).drop_null()), centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.int64(), mask=labels < 0)], names=[*batch.schema.names, "label"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("label", LongType())]))


@dataclass
class TokenClusters:
    """Tokens of patches to a grid of cluster numbers, in an order learned from enriched clusters."""

    model: FrequencyRankedKMeans
    grid: int = 14
    mode: str = "nearest"
    order: dict[int, int] | None = None

    def __post_init__(self):
        if self.mode not in ("nearest", "bilinear"):
            raise ValueError(self.mode)

    def maps(self, tokens: DataFrame) -> DataFrame:
        """(row_idx, position, vec) to (row_idx, y, x, v)."""
        labelled = self.model.transform(tokens)
        place = F.floor(F.col("position") / self.grid).alias("y"), (F.col("position") % self.grid).alias("x")
        value = F.col("label")
        if self.order:
            value = F.create_map(*[F.lit(int(x)) for p in self.order.items() for x in p])[value].cast("long")
        return labelled.select("row_idx", *place, value.alias("v"))

    def fit(self, tokens: DataFrame, positive: Column) -> TokenClusters:
        """Order clusters by how much more of the positive patches' tokens they hold."""
        labelled = self.model.transform(tokens).withColumn("__p", positive)
        ranks = A.differential_abundance(labelled, self.model.k, F.col("__p")).collect()
        self.order = {r.label: self.model.k - 1 - r.diff_rank for r in ranks}
        return self

    def saliency(self, tokens: DataFrame, height: int, width: int) -> DataFrame:
        """Maps resized to the patch: (row_idx, y, x, v); bilinear values, as bytes of an image, round to the nearest."""
        maps = self.maps(tokens)
        size = tokens.sparkSession.range(height * width).select(F.floor(F.col("id") / width).alias("oy"), (F.col("id") % width).alias("ox"))
        if self.mode == "nearest":
            at = size.select("oy", "ox", F.floor(F.col("oy") * self.grid / height).alias("y"), F.floor(F.col("ox") * self.grid / width).alias("x"))
            return maps.join(F.broadcast(at), ["y", "x"]).select("row_idx", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")
        # half-pixel centres, edges clamped; each pixel takes four cells by their weights
        place = lambda c, n: F.greatest(F.least((F.col(c) + 0.5) * (self.grid / n) - 0.5, F.lit(self.grid - 1.0)), F.lit(0.0))
        four = size.withColumns({"sy": place("oy", height), "sx": place("ox", width)}).select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("n"))
        share = lambda c, side: F.when(side == 1, F.col(c) - F.floor(c)).otherwise(1 - (F.col(c) - F.floor(c)))
        cell = lambda c, side: F.least(F.floor(c) + side, F.lit(self.grid - 1))
        at = four.select("oy", "ox", cell("sy", F.col("n.a")).alias("y"), cell("sx", F.col("n.b")).alias("x"), (share("sy", F.col("n.a")) * share("sx", F.col("n.b"))).alias("w")).where("w > 0")
        sums = maps.join(F.broadcast(at), ["y", "x"]).groupBy("row_idx", "oy", "ox").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        return sums.select("row_idx", F.col("oy").alias("y"), F.col("ox").alias("x"), F.floor(F.round("v", 9) + 0.5).alias("v"))
