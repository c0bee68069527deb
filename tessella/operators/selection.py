"""Selection of patch rows: samples, global and per-feature top-k, strided and negative selections.

Every ranking ends its order with (table_name, row_idx), so results don't depend on how rows are laid out.
Scores that are NaN are never selected. Output keeps the input's columns and adds ``_source_patch_table``, and
where rows are ranked ``_feature_score``, ``_feature_rank`` (1 is best) and ``_feature_name``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE, SCORE, RANK, NAME = "_source_patch_table", "_feature_score", "_feature_rank", "_feature_name"
TIES = ("table_name", "row_idx")


def usable(score: str, least: float | None) -> Column:
    """score > least, NaN excluded (Spark sorts NaN above every number)."""
    c = F.col(score)
    return ~F.isnan(c) & c.isNotNull() & ((c > least) if least is not None else F.lit(True))


def global_number(df: DataFrame, coarse: list[tuple[str, Column]], order: list[Column], name: str) -> DataFrame:
    """row_number over the whole table without sorting it in one task.

    ``coarse`` names key columns whose ascending order agrees with ``order``: rows are numbered inside each key
    and the keys' counts, a small table, give the offsets.
    """
    names = [n for n, _ in coarse]
    keyed = df.withColumns(dict(coarse))
    counts = keyed.groupBy(names).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = keyed.withColumn("__k", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    on = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    same = on[0]
    for more in on[1:]:
        same = same & more
    joined = inside.alias("a").join(before.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__k") + F.col("b.__offset")).cast("long").alias(name))


def ranges(df: DataFrame, column: str, parts: int = 64) -> list[float]:
    """Approximate quantiles as cut points; results don't depend on how good they are."""
    return sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.01)))


def range_of(column: str, cuts: list[float], descending: bool = False) -> Column:
    n = F.lit(0)
    for c in cuts:
        n = n + (F.col(column) >= c).cast("int")
    return -n if descending else n


def tie_ranges(df: DataFrame, score: str, table: str | None = "table_name", row: str = "row_idx") -> list[tuple[str, Column]]:
    """Coarse keys for an order by score descending, table, row, in which a hot tied score is split.

    Every cut has a range of its own for the rows that equal it; those are told apart further by table and row range.
    """
    cuts, rows = (sorted(set(q)) for q in df.approxQuantile([score, row], [i / 64 for i in range(1, 64)], 0.01))  # one pass
    n = F.lit(0)
    for c in cuts:
        n = n - (F.col(score) >= c).cast("int") - (F.col(score) > c).cast("int")
    tied = n % 2 != 0
    return [("__range", n), *([("__table", F.when(tied, F.col(table)))] if table else []), ("__rows", F.when(tied, range_of(row, rows)))]


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, in table order; all rows if there are fewer. The feature is the limit."""
    if n < 0:
        raise ValueError("n must not be negative")
    picked = df.orderBy(F.xxhash64(F.lit(seed), *TIES), *TIES).limit(n)
    return picked.withColumn(SOURCE, F.col("table_name"))


def rows_with_feature(df: DataFrame, feature: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """Rows whose binary feature is one; none is an error."""
    if feature not in df.columns:
        warnings.warn(f"column {feature} is missing", stacklevel=2)
        raise ValueError(f"no rows with {feature}")
    active = df.where(F.col(feature) == 1)
    if active.isEmpty():
        raise ValueError(f"no rows with {feature}")
    return sample_rows(active, n, seed) if n is not None else active.withColumn(SOURCE, F.col("table_name"))


def top_rows(df: DataFrame, n: int | None = None, min_score: float | None = None, take_every: int | None = 1, name: str | None = None, score: str = "score") -> DataFrame:
    """Rows by score descending, every ``take_every``-th of them, n at most.

    Without n the least score is 0; ``take_every=None`` spreads n rows over all: max(1, rows // n).
    """
    least = min_score if min_score is not None else (0.0 if n is None else None)
    kept = df.where(usable(score, least))
    order = [F.col(score).desc(), *map(F.col, TIES)]
    if take_every is None:
        take_every = max(1, kept.count() // n) if n else 1
    if take_every == 1 and n is not None:
        few = kept.orderBy(*order).limit(n)  # TakeOrderedAndProject
        out = few.withColumn(RANK, F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        ranked = global_number(kept, tie_ranges(kept, score), order, "__number").where((F.col("__number") - 1) % take_every == 0)
        out = ranked.withColumn(RANK, ((F.col("__number") - 1) / take_every).cast("long") + 1).drop("__number")
        out = out.where(F.col(RANK) <= n) if n is not None else out
    out = out.withColumns({SOURCE: F.col("table_name"), SCORE: F.col(score)})
    return out.withColumn(NAME, F.lit(name)) if name else out


def negative_rows(df: DataFrame, n: int | None = None, take_every: int | None = None, score: str = "score") -> DataFrame:
    """Every k-th of the rows whose score is zero, in (table, row) order."""
    zero = df.where(F.col(score) == 0)
    if take_every is None:
        take_every = max(1, zero.count() // n) if n else 1
    key = [("__table", F.col("table_name")), ("__range", range_of("row_idx", ranges(zero, "row_idx")))]
    out = global_number(zero, key, [F.col("row_idx")], "__number").where((F.col("__number") - 1) % take_every == 0)
    out = out.where(F.col("__number") <= (n - 1) * take_every + 1) if n else out
    return out.drop("__number").withColumn(SOURCE, F.col("table_name"))


def exemplars(activations: DataFrame, features: list | None = None, k: int = 1, min_score: float = 0.0) -> DataFrame:
    """Top k rows of each feature in one pass: Spark limits each group before the shuffle (WindowGroupLimit)."""
    rows = activations.where(usable("score", min_score))
    rows = rows.where(F.col("feature").isin(features)) if features is not None else rows
    w = Window.partitionBy("feature").orderBy(F.col("score").desc(), *TIES)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).select(
        F.col("table_name").alias(SOURCE), "row_idx", F.col("feature").alias(NAME), F.col("__k").cast("long").alias(RANK), F.col("score").alias(SCORE)
    )


def patch_scores(rows: DataFrame, activations: DataFrame, feature, name: str = "score") -> DataFrame:
    """A feature's score for every row, zero where the sparse table has none; KeyError for an unknown column."""
    if isinstance(feature, str) and feature in rows.columns:
        return rows.withColumn(name, F.col(feature))
    if isinstance(feature, str):
        raise KeyError(feature)
    one = activations.where(F.col("feature") == feature).select("table_name", "row_idx", F.col("score").alias("__s"))
    return rows.join(one, ["table_name", "row_idx"], "left").withColumn(name, F.coalesce("__s", F.lit(0.0))).drop("__s")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Outer concatenation: missing columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def block_order(patches: DataFrame, block_h: int, block_w: int) -> DataFrame:
    """Patches with ``place``: their number from 0 by image, block row, block column and row_idx."""
    key = [("__image", F.col("image")), ("__by", F.floor(F.col("ymin") / block_h)), ("__bx", F.floor(F.col("xmin") / block_w))]
    return global_number(patches, key, [F.col("row_idx")], "place").withColumn("place", F.col("place") - 1)


def drain_order(cells: DataFrame, by: str = "image") -> DataFrame:
    """Active cells (mean, active, place) with ``turn`` from 1 in each image: the steepest first, then by place.

    Images are numbered one after the other by ranges of their means, and each image's first number is taken off.
    """
    active = cells.where("active")
    key = [("__by", F.col(by)), *tie_ranges(active, "mean", None, "place")]
    ranked = global_number(active, key, [F.col("mean").desc(), F.col("place")], "__turn")
    first = ranked.groupBy(F.col(by).alias("__by")).agg(F.min("__turn").alias("__first"))
    return ranked.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn("turn", F.col("__turn") - F.col("__first") + 1).drop("__by", "__turn", "__first")


def saliency_rows(ranked: DataFrame, maps: int, per_page: int, columns: int, number: str = RANK) -> DataFrame:
    """Gallery places (page, grid_row, grid_col, panel) of each ranked row's image (panel 0) and of its maps under it."""
    at = F.col(number) - 1
    panels = ranked.withColumn("panel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(maps).cast("long"))))
    return panels.withColumns({"page": F.floor(at / per_page), "grid_row": F.floor(at % per_page / columns) * (maps + 1) + F.col("panel"), "grid_col": at % per_page % columns})


def feature_gallery(activations: DataFrame, clusters: DataFrame, columns: int) -> DataFrame:
    """The best row of each clustered feature, laid out in the clusters' leaf order (feature, cluster, place)."""
    best = exemplars(activations).select(F.col(NAME).alias("feature"), SOURCE, "row_idx", SCORE)
    return clusters.join(best, "feature", "left").select("feature", "cluster", SOURCE, "row_idx", SCORE, F.floor(F.col("place") / columns).alias("grid_row"), (F.col("place") % columns).alias("grid_col"))


def pages_of(ranked: DataFrame, per_page: int, columns: int, number: str = RANK) -> DataFrame:
    """Gallery layout: page, grid row and column of each ranked row."""
    at = F.col(number) - 1
    return ranked.withColumns({"page": F.floor(at / per_page), "grid_row": F.floor(at % per_page / columns), "grid_col": at % per_page % columns})
