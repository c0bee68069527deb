"""Sparse features, embeddings, centroids and their statistics.

Sparse features are long tables (row_idx, feature, score) without zeros; statistics give absent rows their zeros.
Centroids and encoder weights are parameters of bounded, checked size and go into expressions as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that may become literals of a plan: centroids or encoder rows times width.
MOST_LITERALS = 200_000


def _checked(rows: list[list[float]]) -> list[list[float]]:
    if sum(map(len, rows)) > MOST_LITERALS:
        raise ValueError("parameters too large for literals; FrequencyRankedKMeans and SparseAutoencoder take any size")
    return rows


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def encode_sparse(rows: DataFrame, weights: list[list[float]], bias: list[float], centre: list[float] | None = None, norm: float = 1.0, keep: list[int] | None = None) -> DataFrame:
    """(row_idx, vec) to (row_idx, feature, score): relu(W ((x - c) / norm) + b), positive scores only.

    Unwanted features are left out before the product, not after it.
    """
    wanted = [i for i in range(len(weights)) if keep is None or i in set(keep)]
    _checked([weights[i] for i in wanted])
    x = F.col("vec")
    if centre is not None:
        x = F.zip_with(x, vector(centre), lambda a, c: (a - c) / norm)
    units = F.array(*(F.struct(F.lit(i).cast("long").alias("feature"), (dot(x, vector(weights[i])) + bias[i]).alias("score")) for i in wanted))
    return rows.select("row_idx", F.explode(units).alias("u")).select("row_idx", "u.feature", "u.score").where("score > 0")


def nearest_centroid(v: Column, centroids: list[list[float]]) -> Column:
    """Number of the nearest centroid; ties go to the lowest number."""
    _checked(centroids)
    near = [F.struct(F.aggregate(F.zip_with(v, vector(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(i).cast("long").alias("i")) for i, c in enumerate(centroids)]
    return (F.least(*near) if len(near) > 1 else near[0])["i"]


def centering(rows: DataFrame, skip: int) -> tuple[list[float], float]:
    """Mean vector of every skip-th row and the mean norm of those rows about it."""
    some = rows.where(F.col("row_idx") % skip == 0).select("row_idx", F.posexplode("vec").alias("i", "v"))
    mean = {r.i: r.m for r in some.groupBy("i").agg(F.avg("v").alias("m")).collect()}
    centre = [mean[i] for i in sorted(mean)]
    away = F.sqrt(F.aggregate(F.zip_with("vec", vector(centre), lambda a, c: (a - c) * (a - c)), F.lit(0.0), lambda s, x: s + x))
    return centre, rows.where(F.col("row_idx") % skip == 0).agg(F.avg(away)).first()[0]


def frequency_rank(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, n, new_label (0 is the most frequent; ties by label), share in percent."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("n").desc(), label)  # as many rows as there are labels
    return counts.select(label, "n", (F.row_number().over(order) - 1).cast("long").alias("new_label"), (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def relabelled(labels: DataFrame, ranks: DataFrame, label: str = "label") -> DataFrame:
    return labels.join(ranks.select(label, "new_label"), label)


def one_hot(labels: DataFrame, k: int, name: str, label: str = "label") -> DataFrame:
    return labels.withColumns({f"{name}_label_{i}": (F.col(label) == i).cast("long") for i in range(k)})


def activation_stats(activations: DataFrame, n_rows: int, n_features: int, n_chunks: int = 40, exact: bool = False) -> DataFrame:
    """feature, pct_active, max_score of all features.

    pct_active is the plain mean of the chunks' shares (the last chunk takes the remainder), or with ``exact``
    the share of all rows; max_score counts absent rows as zero.
    """
    if n_rows < n_chunks and not exact:
        raise ValueError("fewer rows than chunks")
    size = max(1, n_rows // n_chunks)
    active = activations.where(F.col("score") > 0)
    if exact:
        stats = active.groupBy("feature").agg((F.count(F.lit(1)) / n_rows).alias("p"), F.max("score").alias("m"))
    else:
        chunk = F.least(F.floor(F.col("row_idx") / size), F.lit(n_chunks - 1))
        length = F.when(F.col("chunk") == n_chunks - 1, n_rows - size * (n_chunks - 1)).otherwise(size)
        each = active.groupBy("feature", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m"))
        stats = each.groupBy("feature").agg((F.sum(F.col("n") / length) / n_chunks).alias("p"), F.max("m").alias("m"))
    features = activations.sparkSession.range(n_features).select(F.col("id").alias("feature"))
    return features.join(stats, "feature", "left").select("feature", F.coalesce("p", F.lit(0.0)).alias("pct_active"), F.coalesce("m", F.lit(0.0)).alias("max_score"))


def selected_features(stats: DataFrame, pct: float = 0.01, most: float = 0.5) -> DataFrame:
    """Stats with the flag ``selected``: both thresholds are strict."""
    return stats.withColumn("selected", (F.col("pct_active") > pct) & (F.col("max_score") > most))


def selection_scatter(stats: DataFrame, pct: float = 0.01, most: float = 0.5) -> DataFrame:
    """What a plot of the selection shows: features that are ever active, with the flag."""
    return selected_features(stats, pct, most).where((F.col("pct_active") > 0) & (F.col("max_score") > 0))


def overlaps(values: DataFrame, features: DataFrame) -> DataFrame:
    """Weighted IoU, sum(min) / (sum a + sum b - sum(min)), of all pairs i < j; zero union gives zero.

    ``values``: (row_idx, feature, score). The self-join is on rows, of which each has few features; pairs
    without a common row are completed from the features, a selected set.
    """
    v = values.select("row_idx", "feature", "score")
    sums = v.groupBy("feature").agg(F.sum("score").alias("total"))
    a, b = v.alias("a"), v.alias("b")
    both = a.join(b, (F.col("a.row_idx") == F.col("b.row_idx")) & (F.col("a.feature") < F.col("b.feature")))
    both = both.groupBy(F.col("a.feature").alias("i"), F.col("b.feature").alias("j")).agg(F.sum(F.least("a.score", "b.score")).alias("common"))
    f = features.select("feature").join(sums, "feature", "left").select("feature", F.coalesce("total", F.lit(0.0)).alias("total"))
    pairs = f.select(F.col("feature").alias("i"), F.col("total").alias("ti")).join(f.select(F.col("feature").alias("j"), F.col("total").alias("tj")), F.col("i") < F.col("j"))
    out = pairs.join(both, ["i", "j"], "left").withColumn("common", F.coalesce("common", F.lit(0.0)))
    union = F.col("ti") + F.col("tj") - F.col("common")
    return out.select("i", "j", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("iou"))


def soft_set(values: DataFrame) -> DataFrame:
    """Every row where the feature is not zero, as weight one."""
    return values.where("score <> 0").withColumn("score", F.lit(1.0))


def strict_set(values: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows over ``threshold`` of the feature's maximum, as weight one."""
    most = values.groupBy("feature").agg(F.max("score").alias("m"))
    return values.join(most, "feature").where(F.col("score") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")) > threshold).select(*[c for c in values.columns if c != "score"], F.lit(1.0).alias("score"))


def differential_abundance(labels: DataFrame, k: int, positive: Column) -> DataFrame:
    """label, pos_share, neg_share, diff and its rank (0 is the most enriched; ties by label) of labels 0..k-1."""
    n = labels.groupBy("label").agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    every = labels.sparkSession.range(k).select(F.col("id").alias("label")).join(n, "label", "left").fillna(0, ["p", "q"])
    whole = Window.partitionBy()
    every = every.select("label", (F.col("p") / (F.sum("p").over(whole) + 1e-12)).alias("pos_share"), (F.col("q") / (F.sum("q").over(whole) + 1e-12)).alias("neg_share"))
    every = every.withColumn("diff", F.col("pos_share") - F.col("neg_share"))
    return every.withColumn("diff_rank", (F.row_number().over(Window.orderBy(F.col("diff").desc(), "label")) - 1).cast("long"))


def first_seen_labels(labels: DataFrame, number: str = "row_idx", label: str = "label") -> DataFrame:
    """Labels renumbered from 1 by first appearance."""
    first = labels.groupBy(label).agg(F.min(number).alias("first_at"))
    new = first.withColumn("new_label", F.row_number().over(Window.orderBy("first_at")).cast("long"))
    return labels.join(new, label)


def cluster_extents(labels: DataFrame, place: str, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.min(place).alias("start_at"), F.max(place).alias("end_at"), F.count(F.lit(1)).alias("n"))


def segmentation_metrics(masks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From (image, truth, guess) booleans: micro IoU and mean of images' IoU (an empty union counts as one).

    One row, or one for each value of ``by``, such as the epoch.
    """
    t, g = F.col("truth"), F.col("guess")
    each = masks.groupBy(*by, "image").agg(*(F.count_if(c).alias(n) for n, c in (("tp", t & g), ("fp", ~t & g), ("fn", t & ~g), ("tn", ~t & ~g))))
    iou = F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn")))
    total = F.sum("tp") + F.sum("fp") + F.sum("fn")
    return each.withColumn("iou", iou).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), F.when(total == 0, 1.0).otherwise(F.sum("tp") / total).alias("micro_iou"), F.avg("iou").alias("image_iou"))


def label_codes(labels: DataFrame, label: str = "label", background: str = "") -> DataFrame:
    """Rows with ``code``: 1..K over the sorted distinct labels, 0 for null or ``background``.

    The labels alone are sorted, after they are made distinct; rows meet them in a join.
    """
    used = F.col(label).isNotNull() & (F.col(label) != background)
    known = labels.where(used).select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)).cast("long"))
    return labels.join(known, label, "left").withColumn("code", F.coalesce("code", F.lit(0).cast("long")))


def cluster_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, percent) of each cluster."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def rescaled(rows: DataFrame, value: str = "v", top: float = 255.0) -> DataFrame:
    """``value`` brought to 0..top by its least and greatest; 0 where all are equal."""
    ends = rows.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    scaled = F.coalesce(F.try_divide((F.col(value) - F.col("__low")) * top, F.col("__high") - F.col("__low")), F.lit(0.0))
    return rows.join(F.broadcast(ends)).withColumn(value, F.when(F.col(value).isNotNull(), scaled)).drop("__low", "__high")
