"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import features as A
from ..operators import filters as N
from ..operators import geometry as G
from ..operators import raster as R
from ..operators import selection as T
from ..sources import slides as W
from ..sources import tables as IO
from .fixtures import ACT, EV, P, activations, patches, scored_events, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        name = function.__name__.removeprefix("q_")
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def r6(c: str):
    return F.round(c, 6).alias(c)


# ---- selection

RANKED = "table_name, row_idx, score, table_name AS _source_patch_table, score AS _feature_score"


@query(f"WITH {ACT} SELECT table_name AS _source_patch_table, row_idx, feature AS _feature_name, k AS _feature_rank, score AS _feature_score FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, table_name, row_idx) AS k FROM act) WHERE k <= 3")
def q_exemplars_topk(spark, d):
    return T.exemplars(activations(spark, d), k=3)


@query(f"WITH {EV} SELECT {RANKED}, row_number() OVER (ORDER BY score DESC, table_name, row_idx) AS _feature_rank FROM ev ORDER BY score DESC, table_name, row_idx LIMIT 50")
def q_top_patches(spark, d):
    return T.top_rows(scored_events(spark, d), n=50)


@query(f"WITH {EV}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, table_name, row_idx) AS k FROM ev WHERE score > 0) SELECT {RANKED}, (k - 1) // 7 + 1 AS _feature_rank FROM k WHERE (k - 1) % 7 = 0")
def q_top_patches_strided(spark, d):
    return T.top_rows(scored_events(spark, d), min_score=0.0, take_every=7)


@query(f"WITH {EV}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, table_name, row_idx) AS k, greatest(1, count(*) OVER () // 40) AS e FROM ev) SELECT {RANKED}, (k - 1) // e + 1 AS _feature_rank FROM k WHERE (k - 1) % e = 0 AND (k - 1) // e < 40")
def q_top_patches_auto_stride(spark, d):
    return T.top_rows(scored_events(spark, d), n=40, take_every=None)


@query(f"WITH {EV}, k AS (SELECT *, row_number() OVER (ORDER BY table_name, row_idx) AS k, greatest(1, count(*) OVER () // 60) AS e FROM ev WHERE score = 0) SELECT table_name, row_idx, score, table_name AS _source_patch_table FROM k WHERE (k - 1) % e = 0 AND (k - 1) // e < 60")
def q_negative_patches(spark, d):
    return T.negative_rows(scored_events(spark, d), n=60)


@query(f"WITH {EV} SELECT table_name, row_idx, (score > 100)::INT AS active, table_name AS _source_patch_table FROM ev WHERE score > 100")
def q_binary_feature_rows(spark, d):
    return T.rows_with_feature(scored_events(spark, d).selectExpr("table_name", "row_idx", "CAST(score > 100 AS INT) AS active"), "active")


@query()
def q_random_sample(spark, d):
    return T.sample_rows(scored_events(spark, d), 100, seed=5)


@query(f"WITH {P}, {ACT} SELECT p.table_name, p.row_idx, coalesce(act.score, 0) AS score FROM p LEFT JOIN act ON p.table_name = act.table_name AND p.row_idx = act.row_idx AND act.feature = 5")
def q_patch_scores_multi_table(spark, d):
    return T.patch_scores(patches(spark, d).select("table_name", "row_idx"), activations(spark, d), 5)


@query(f"WITH {P}, {ACT} SELECT p.table_name, p.row_idx, coalesce(a.score, 0) AS f3, coalesce(b.score, 0) AS f9 FROM p LEFT JOIN act a ON p.row_idx = a.row_idx AND a.feature = 3 LEFT JOIN act b ON p.row_idx = b.row_idx AND b.feature = 9")
def q_score_to_obs(spark, d):
    rows, act = patches(spark, d).select("table_name", "row_idx"), activations(spark, d)
    return T.patch_scores(T.patch_scores(rows, act, 3, "f3"), act, 9, "f9")


@query(f"WITH {EV} SELECT table_name, row_idx, k AS number, (k - 1) // 12 AS page, (k - 1) % 12 // 4 AS grid_row, (k - 1) % 12 % 4 AS grid_col FROM (SELECT *, row_number() OVER (ORDER BY score DESC, table_name, row_idx) AS k FROM ev) WHERE k <= 50")
def q_gallery_pages(spark, d):
    top = T.top_rows(scored_events(spark, d), n=50)
    return T.pages_of(top, 12, 4).select("table_name", "row_idx", F.col(T.RANK).alias("number"), "page", "grid_row", "grid_col")


@query("SELECT DISTINCT split_part('slide_' || label, '_', 1) AS prefix, 'slide_' || label AS image FROM embeddings")
def q_slide_prefixes(spark, d):
    return patches(spark, d).select(F.split_part("image", F.lit("_"), F.lit(1)).alias("prefix"), "image").distinct()


@query(f"WITH {P} SELECT row_idx, image, NULL::BIGINT AS extra FROM p WHERE row_idx < 10 UNION ALL SELECT row_idx, image, row_idx * 2 FROM p WHERE row_idx >= 490 AND row_idx < 500")
def q_union_tables(spark, d):
    p = patches(spark, d)
    return T.union_tables([p.where("row_idx < 10").select("row_idx", "image"), p.where("row_idx >= 490 AND row_idx < 500").selectExpr("row_idx", "image", "row_idx * 2 AS extra")])


@query(f"WITH {P} SELECT row_idx, image, NULL::BIGINT AS extra FROM p UNION ALL SELECT row_idx, image, row_idx * 2 FROM p")
def q_union_tables_whole(spark, d):
    p = patches(spark, d)
    return T.union_tables([p.select("row_idx", "image"), p.selectExpr("row_idx", "image", "row_idx * 2 AS extra")])


# ---- features

STATS = "s AS (SELECT f.feature, coalesce(p, 0) AS pct_active, coalesce(m, 0) AS max_score FROM (SELECT unnest(range(64)) AS feature) f LEFT JOIN (SELECT feature, sum(n / CASE WHEN chunk = 39 THEN nr - sz * 39 ELSE sz END) / 40 AS p, max(m) AS m FROM (SELECT feature, least(row_idx // sz, 39) AS chunk, count(*) AS n, max(score) AS m, any_value(sz) AS sz, any_value(nr) AS nr FROM act, (SELECT count(*) AS nr, count(*) // 40 AS sz FROM embeddings) GROUP BY 1, 2) GROUP BY feature) USING (feature))"


def stats(spark, d):
    return A.activation_stats(activations(spark, d), table(spark, d, "embeddings").count(), 64)


@query(f"WITH {ACT}, {STATS} SELECT feature, round(pct_active, 9) AS pct_active, round(max_score, 6) AS max_score FROM s")
def q_activation_stats_chunked(spark, d):
    return stats(spark, d).select("feature", F.round("pct_active", 9).alias("pct_active"), r6("max_score"))


@query(f"WITH {ACT}, {STATS} SELECT feature, round(pct_active, 9) AS pct_active, round(max_score, 6) AS max_score, pct_active > 0.1 AND max_score > 0.2 AS selected FROM s WHERE pct_active > 0 AND max_score > 0")
def q_selected_features(spark, d):
    return A.selection_scatter(stats(spark, d), 0.1, 0.2).select("feature", F.round("pct_active", 9).alias("pct_active"), r6("max_score"), "selected")


def iou_sql(values: str) -> str:
    return f"WITH {ACT}, v AS ({values}), t AS (SELECT f.feature, coalesce(sum(score), 0) AS t FROM (SELECT unnest(range(64)) AS feature) f LEFT JOIN v USING (feature) GROUP BY 1), c AS (SELECT a.feature AS i, b.feature AS j, sum(least(a.score, b.score)) AS c FROM v a JOIN v b ON a.row_idx = b.row_idx AND a.feature < b.feature GROUP BY 1, 2) SELECT a.feature AS i, b.feature AS j, round(CASE WHEN a.t + b.t - coalesce(c, 0) > 0 THEN coalesce(c, 0) / (a.t + b.t - coalesce(c, 0)) ELSE 0 END, 6) AS iou FROM t a JOIN t b ON a.feature < b.feature LEFT JOIN c ON c.i = a.feature AND c.j = b.feature"


def iou(spark, values):
    return A.overlaps(values, spark.range(64).select(F.col("id").alias("feature"))).select("i", "j", r6("iou"))


@query(iou_sql("SELECT row_idx, feature, 1.0::DOUBLE AS score FROM act WHERE score <> 0"))
def q_iou_soft(spark, d):
    return iou(spark, A.soft_set(activations(spark, d)))


@query(iou_sql("SELECT row_idx, feature, 1.0::DOUBLE AS score FROM (SELECT *, max(score) OVER (PARTITION BY feature) AS m FROM act) WHERE score / m > 0.5"))
def q_iou_strict(spark, d):
    return iou(spark, A.strict_set(activations(spark, d)))


@query(iou_sql("SELECT row_idx, feature, score FROM act"))
def q_iou_weighted(spark, d):
    return iou(spark, activations(spark, d))


@query("SELECT vec_id, unnest(range(64)) AS i, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 6) AS v FROM embeddings")
def q_l2_normalise(spark, d):
    unit = A.l2_normalised(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(unit).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), r6("v"))


def centroids(spark, d):
    """Mean vectors by label: ten labels of 64 numbers."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).orderBy("label", "i").collect()
    return [[r.m for r in rows if r.label == k] for k in sorted({r.label for r in rows})]


NEAR = "x AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label AS k, i, avg(v) AS m FROM x GROUP BY 1, 2), dist AS (SELECT vec_id, k, sum((v - m) * (v - m)) AS d FROM x JOIN c USING (i) GROUP BY 1, 2), a AS (SELECT vec_id, arg_min(k, d)::BIGINT AS label FROM dist GROUP BY 1)"


def assigned(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.nearest_centroid(F.col("embedding").cast("array<double>"), centroids(spark, d)).alias("label"))


@query(f"WITH {NEAR} SELECT vec_id, label FROM a")
def q_centroid_assign(spark, d):
    return assigned(spark, d)


RANK = f"{NEAR}, r AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS new_label, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM a GROUP BY label)"


@query(f"WITH {RANK} SELECT label, n, new_label, share FROM r")
def q_frequency_rank(spark, d):
    return A.frequency_rank(assigned(spark, d)).select("label", "n", "new_label", r6("share"))


@query(f"WITH {RANK} SELECT a.vec_id, r.new_label FROM a JOIN r USING (label)")
def q_frequency_labels(spark, d):
    labels = assigned(spark, d)
    return A.relabelled(labels, A.frequency_rank(labels)).select("vec_id", "new_label")


@query("SELECT vec_id, label::BIGINT AS label, " + ", ".join(f"(label = {i})::BIGINT AS kmeans_label_{i}" for i in range(4)) + " FROM embeddings")
def q_one_hot(spark, d):
    return A.one_hot(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), 4, "kmeans")


@query("SELECT vec_id, label::BIGINT AS label, " + ", ".join(f"(label = {i})::BIGINT AS kmeans_label_{i}" for i in range(10)) + " FROM embeddings")
def q_one_hot_whole(spark, d):
    return A.one_hot(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), 10, "kmeans")


@query("WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), w AS (SELECT vec_id AS feature, i, v FROM x WHERE vec_id < 16), h AS (SELECT x.vec_id AS row_idx, feature, sum(x.v * w.v) AS score FROM x JOIN w USING (i) GROUP BY 1, 2) SELECT row_idx, feature, round(score, 6) AS score FROM h WHERE score > 1e-9")
def q_sae_forward(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<double>").alias("vec"))
    weights = [list(r.vec) for r in rows.where("row_idx < 16").orderBy("row_idx").collect()]
    return A.encode_sparse(rows, weights, [0.0] * 16).where("score > 1e-9").select("row_idx", "feature", r6("score"))


@query("WITH n AS (SELECT label, count(*) FILTER (WHERE vec_id % 3 = 0) AS p, count(*) FILTER (WHERE vec_id % 3 <> 0) AS q FROM embeddings GROUP BY label), e AS (SELECT k AS label, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT unnest(range(12)) AS k) LEFT JOIN n ON k = label), s AS (SELECT label, p / (sum(p) OVER () + 1e-12) AS a, q / (sum(q) OVER () + 1e-12) AS b FROM e) SELECT label, round(a, 6) AS pos_share, round(b, 6) AS neg_share, round(a - b, 6) AS diff, row_number() OVER (ORDER BY a - b DESC, label) - 1 AS diff_rank FROM s")
def q_differential_abundance(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id")
    return A.differential_abundance(rows, 12, F.col("vec_id") % 3 == 0).select("label", r6("pos_share"), r6("neg_share"), r6("diff"), "diff_rank")


FIRST = "f AS (SELECT label, min(vec_id) AS first_at FROM embeddings GROUP BY label), n AS (SELECT label, first_at, row_number() OVER (ORDER BY first_at) AS new_label FROM f)"


@query(f"WITH {FIRST} SELECT vec_id, new_label FROM embeddings JOIN n USING (label)")
def q_cluster_relabel(spark, d):
    return A.first_seen_labels(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "new_label")


@query("SELECT label::BIGINT AS label, min(vec_id) AS start_at, max(vec_id) AS end_at, count(*) AS n FROM embeddings GROUP BY label")
def q_cluster_extents(spark, d):
    return A.cluster_extents(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")


@query("WITH m AS (SELECT doc_id % 10 AS image, quality = 1 AS t, toxic = 1 AS g FROM labels), e AS (SELECT image, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM m GROUP BY image) SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, round(CASE WHEN sum(tp + fp + fn) = 0 THEN 1 ELSE sum(tp) / sum(tp + fp + fn) END, 6) AS micro_iou, round(avg(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END), 6) AS image_iou FROM e")
def q_seg_metrics(spark, d):
    masks = table(spark, d, "labels").selectExpr("doc_id % 10 AS image", "quality = 1 AS truth", "toxic = 1 AS guess")
    return A.segmentation_metrics(masks).select("tp", "fp", "fn", "tn", r6("micro_iou"), r6("image_iou"))


# ---- geometry

@query("WITH x AS (SELECT unnest(range(35, 1000, 64)) AS x), y AS (SELECT unnest(range(29, 700, 48)) AS y) SELECT row_number() OVER (ORDER BY x, y) - 1 AS point_id, x, y FROM x, y")
def q_grid_points(spark, d):
    return G.grid_points(spark, 1000, 700, (64, 48), (3, 5))


@query(f"WITH {P} SELECT row_idx, k AS corner, CASE WHEN k IN (0, 3) THEN xmin + 224 - 112.5 ELSE xmin + 224 + 112.5 END::DOUBLE AS x, CASE WHEN k < 2 THEN ymin + 224 - 112.5 ELSE ymin + 224 + 112.5 END::DOUBLE AS y FROM p, (SELECT unnest(range(4)) AS k)")
def q_bbox_corners(spark, d):
    points = patches(spark, d).selectExpr("row_idx", "xmin + 224 AS x", "ymin + 224 AS y")
    return G.boxes(points, 225).select("row_idx", F.posexplode("corners").alias("corner", "c")).select("row_idx", F.col("corner").cast("long").alias("corner"), "c.x", "c.y")


RING = [(500.0, 300.0), (9000.0, 1000.0), (7000.0, 8000.0), (2500.0, 6000.0)]
HIT = "(" + " + ".join(f"(({y0} > y) <> ({y1} > y) AND x < {x1 - x0} * (y - {y0}) / {y1 - y0} + {x0})::INT" for (x0, y0), (x1, y1) in zip(RING, RING[1:] + RING[:1])) + ") % 2 = 1"


@query(f"WITH {P}, c AS (SELECT row_idx, (xmin + 224)::DOUBLE AS x, (ymin + 224)::DOUBLE AS y FROM p) SELECT row_idx FROM c WHERE {HIT}")
def q_point_in_polygon(spark, d):
    points = patches(spark, d).selectExpr("row_idx", "CAST(xmin + 224 AS DOUBLE) AS x", "CAST(ymin + 224 AS DOUBLE) AS y")
    return points.where(G.inside_polygon(F.col("x"), F.col("y"), RING)).select("row_idx")


@query(f"WITH {P}, c AS (SELECT row_idx, (xmin + 224)::DOUBLE AS x, (ymin + 224)::DOUBLE AS y FROM p) SELECT row_idx, (x - 224)::BIGINT AS xmin, (y - 224)::BIGINT AS ymin, (x + 224)::BIGINT AS xmax, (y + 224)::BIGINT AS ymax, TRUE AS is_tissue FROM c WHERE {HIT} AND x BETWEEN 224 AND 8000 - 224 AND y BETWEEN 224 AND 6000 - 224")
def q_patch_table_filter(spark, d):
    points = patches(spark, d).selectExpr("row_idx", "xmin + 224 AS x", "ymin + 224 AS y")
    return G.patch_boxes(G.filter_points(points, [RING], 8000, 6000, 448), 448).drop("x", "y")


@query(f"WITH {P} SELECT image, ymin // 2000 AS block_y, xmin // 2000 AS block_x, count(*) AS n, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM p GROUP BY 1, 2, 3")
def q_spatial_blocks(spark, d):
    return G.spatial_blocks(patches(spark, d), 2000, 2000)


@query(f"WITH {P} SELECT CASE WHEN min(xmax - xmin) = max(xmax - xmin) AND min(ymax - ymin) = max(ymax - ymin) AND min(xmin) >= 0 AND min(ymin) >= 0 AND max(xmax) <= 20000 AND max(ymax) <= 100000 THEN min(ymax - ymin) END AS patch_h, CASE WHEN min(xmax - xmin) = max(xmax - xmin) AND min(ymax - ymin) = max(ymax - ymin) AND min(xmin) >= 0 AND min(ymin) >= 0 AND max(xmax) <= 20000 AND max(ymax) <= 100000 THEN min(xmax - xmin) END AS patch_w FROM p")
def q_uniform_geometry(spark, d):
    return G.uniform_geometry(patches(spark, d), 20000, 100000)


@query("SELECT vec_id AS row_idx, vec_id // 32 AS batch, vec_id % 32 AS place FROM embeddings")
def q_model_batches(spark, d):
    return G.model_batches(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx")), 32)


CELLS = f"{P}, cells AS (SELECT image, x0, y0, 256 AS size FROM (SELECT DISTINCT image, xmin + 224 AS x0 FROM p) JOIN (SELECT DISTINCT image, ymin + 224 AS y0 FROM p) USING (image))"


@query(f"WITH {CELLS} SELECT image, x0, y0, size::BIGINT AS size FROM cells")
def q_quadtree_init(spark, d):
    return G.quadtree_cells(patches(spark, d), 256, 448)


@query(f"WITH {CELLS} SELECT image, x0 + dx * 128 AS x0, y0 + dy * 128 AS y0, 128::BIGINT AS size FROM cells, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) v(dx, dy)")
def q_quadtree_children(spark, d):
    return G.children(G.quadtree_cells(patches(spark, d), 256, 448))


@query(f"WITH {CELLS} SELECT c.image, c.x0 AS x, c.y0 AS y, coalesce(max(p.label), -1)::BIGINT AS label FROM cells c LEFT JOIN p ON p.image = c.image AND p.xmin + 224 = c.x0 AND p.ymin + 224 = c.y0 GROUP BY 1, 2, 3")
def q_grid_samples(spark, d):
    return G.samples_on_grid(patches(spark, d), "label", 448)


@query(f"WITH {CELLS}, k AS (SELECT DISTINCT image, x0 + dx * 256 AS x, y0 + dy * 256 AS y FROM cells, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) v(dx, dy)) SELECT image, x, y FROM k EXCEPT SELECT image, x0, y0 FROM cells")
def q_unsampled_corners(spark, d):
    p = patches(spark, d)
    return G.unsampled_corners(G.quadtree_cells(p, 256, 448), G.samples_on_grid(p, "label", 448))


FIELD = "fld AS (SELECT x, y, 0.5 * x + 0.25 * y AS dx, 3.0 - 0.125 * x AS dy FROM (SELECT unnest(range(40)) AS x), (SELECT unnest(range(60)) AS y))"


def field(spark):
    return spark.range(2400).selectExpr("id % 40 AS x", "id div 40 AS y").selectExpr("x", "y", "CAST(0.5 * x + 0.25 * y AS DOUBLE) AS dx", "CAST(3.0 - 0.125 * x AS DOUBLE) AS dy")


SHAPES = {"field_shape": (60, 40), "source_shape": (12000, 11200), "affine": [[0.9, 0.1, 2.0], [-0.1, 1.1, -3.0]], "pads": ((10, 20), (5, 7))}
MOVED = f"{P}, q AS (SELECT row_idx, ((xmin + xmax) / 2 - 20) * (40 / 11200) AS px, ((ymin + ymax) / 2 - 10) * (60 / 12000) AS py FROM p), c AS (SELECT *, greatest(least(px, 39.0), 0) AS cx, greatest(least(py, 59.0), 0) AS cy FROM q), m AS (SELECT row_idx, px + 0.5 * cx + 0.25 * cy AS mx, py + 3.0 - 0.125 * cx AS my FROM c), o AS (SELECT row_idx, (0.9 * mx + 0.1 * my + 2) * (11200 / 40) - 7 AS x, (-0.1 * mx + 1.1 * my - 3) * (12000 / 60) - 5 AS y FROM m)"


@query(f"WITH {MOVED} SELECT row_idx AS id, round(x, 4) AS x, round(y, 4) AS y FROM o")
def q_register_points(spark, d):
    centres = patches(spark, d).selectExpr("row_idx AS id", "(xmin + xmax) / 2 AS x", "(ymin + ymax) / 2 AS y")
    return G.transform_points(centres, field(spark), **SHAPES).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {MOVED} SELECT row_idx AS id, round(x - 112, 4) AS xmin, round(y - 112, 4) AS ymin, round(x + 112, 4) AS xmax, round(y + 112, 4) AS ymax FROM o")
def q_register_patches(spark, d):
    moved = G.transform_patches(patches(spark, d), 224, field=field(spark), **SHAPES)
    return moved.select("id", *(F.round(c, 4).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query(f"WITH {P}, px AS (SELECT image, c, x, y, (x * 7 + y * 3 + c) % 251 AS v FROM (SELECT DISTINCT image FROM p), (SELECT unnest(range(2)) AS c), (SELECT unnest(range(430, 470)) AS x), (SELECT unnest(range(0, 20)) AS y)) SELECT p.image, p.row_idx, c, y - ymin AS py, x - xmin AS px, v FROM p JOIN px ON p.image = px.image AND y >= ymin AND y < ymax AND x >= xmin AND x < xmax")
def q_extract_pixels(spark, d):
    p = patches(spark, d)
    pixels = spark.range(1600).selectExpr("id div 800 AS c", "430 + id % 40 AS x", "id % 800 div 40 AS y").selectExpr("*", "(x * 7 + y * 3 + c) % 251 AS v").join(p.select("image").distinct())
    return G.extract_pixels(p, pixels)


@query("SELECT k.label, posn - 1 AS vertex, split_part(part, ',', 1)::DOUBLE AS x, split_part(part, ',', 2)::DOUBLE AS y FROM (SELECT label, unnest(range(1, len(ps) + 1)) AS posn, unnest(ps) AS part FROM (SELECT label, string_split(string_agg(vec_id || ',' || vec_id * 2 + 1, ' ' ORDER BY vec_id), ' ') AS ps FROM embeddings GROUP BY label)) k")
def q_roi_parse(spark, d):
    rois = table(spark, d, "embeddings").groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda i: F.concat(i.cast("string"), F.lit(","), (i * 2 + 1).cast("string"))), " ").alias("points"))
    return rois.select("label", F.posexplode(G.parse_points(F.col("points"))).alias("vertex", "p")).select("label", F.col("vertex").cast("long").alias("vertex"), "p.x", "p.y")


@query("SELECT label, string_agg(vec_id || ',' || vec_id * 2 + 1, ' ' ORDER BY vec_id) AS all_points FROM embeddings GROUP BY label")
def q_roi_format(spark, d):
    points = F.array_sort(F.collect_list(F.struct(F.col("vec_id").cast("double").alias("x"), (F.col("vec_id") * 2 + 1).cast("double").alias("y"))))
    return table(spark, d, "embeddings").groupBy("label").agg(points.alias("p")).select("label", G.format_points(F.col("p")).alias("all_points"))


# ---- raster

SEEDS = [(3, 4, 2), (20, 7, 1), (11, 25, 3), (30, 30, 1), (0, 39, 4), (39, 0, 2), (11, 25, 1)]
SEED_SQL = "s(x, y, label) AS (VALUES " + ", ".join(map(str, SEEDS)) + ")"
CANVAS = "px AS (SELECT y, x FROM (SELECT unnest(range(40)) AS y), (SELECT unnest(range(40)) AS x))"


def seeds(spark):
    return spark.createDataFrame(SEEDS, "x long, y long, label long")


@query(f"WITH {SEED_SQL}, {CANVAS} SELECT y, x, nearest::BIGINT AS nearest FROM (SELECT px.y, px.x, s.label AS nearest, row_number() OVER (PARTITION BY px.y, px.x ORDER BY (s.x - px.x) * (s.x - px.x) + (s.y - px.y) * (s.y - px.y), s.label) AS k FROM px, s) WHERE k = 1")
def q_voronoi(spark, d):
    return R.nearest_seed(R.canvas(spark, 40, 40), seeds(spark)).drop("d2")


@query(f"WITH {SEED_SQL}, {CANVAS}, m AS (SELECT px.y, px.x, min((s.x - px.x) * (s.x - px.x) + (s.y - px.y) * (s.y - px.y)) FILTER (WHERE label IN (1, 3)) AS f, min((s.x - px.x) * (s.x - px.x) + (s.y - px.y) * (s.y - px.y)) FILTER (WHERE label NOT IN (1, 3)) AS b FROM px, s GROUP BY 1, 2) SELECT y, x, (b > f)::BIGINT AS fg FROM m")
def q_binary_nearest(spark, d):
    return R.binary_nearest(R.canvas(spark, 40, 40), seeds(spark), F.col("label").isin(1, 3))


@query(f"WITH {SEED_SQL}, u AS (SELECT least(greatest(x // 2, 0), 14) AS x, least(greatest(y // 2, 0), 14) AS y, arg_max(label, k) AS label FROM (SELECT *, row_number() OVER () AS k FROM s) GROUP BY 1, 2), px AS (SELECT y, x FROM (SELECT unnest(range(15)) AS y), (SELECT unnest(range(15)) AS x)) SELECT y, x, nearest::BIGINT AS nearest FROM (SELECT px.y, px.x, u.label AS nearest, row_number() OVER (PARTITION BY px.y, px.x ORDER BY (u.x - px.x) * (u.x - px.x) + (u.y - px.y) * (u.y - px.y), u.label) AS k FROM px, u) WHERE k = 1")
def q_multiclass_downsampled(spark, d):
    numbered = spark.createDataFrame([(*s, i) for i, s in enumerate(SEEDS)], "x long, y long, label long, k long")
    return R.nearest_seed(R.canvas(spark, 15, 15), R.scaled_seeds(numbered, 15, 15, 2, "k")).drop("d2")


@query("WITH c AS (SELECT event_id, round_even(event_id * 37 % 900 / 16, 0)::BIGINT AS cx, round_even(event_id * 91 % 700 / 16, 0)::BIGINT AS cy, value AS score FROM events WHERE event_id < 60), px AS (SELECT y, x FROM (SELECT unnest(range(50)) AS y), (SELECT unnest(range(60)) AS x)) SELECT px.y, px.x, coalesce(max(score), 0) AS v FROM px LEFT JOIN c ON px.x >= greatest(cx - 3, 0) AND px.x < least(cx + 3, 59) AND px.y >= greatest(cy - 3, 0) AND px.y < least(cy + 3, 49) GROUP BY 1, 2")
def q_patch_max_raster(spark, d):
    rows = table(spark, d, "events").where("event_id < 60").selectExpr("event_id * 37 % 900 AS x", "event_id * 91 % 700 AS y", "value AS score")
    return R.paint_max(spark, rows, 50, 60, 96, 16)


@query("WITH c AS (SELECT round_even(event_id * 37 % 900 / 16, 0)::BIGINT AS cx, round_even(event_id * 91 % 700 / 16, 0)::BIGINT AS cy, value AS score FROM events), top AS (SELECT cx, cy, max(score) AS score FROM c GROUP BY 1, 2), px AS (SELECT y, x FROM (SELECT unnest(range(50)) AS y), (SELECT unnest(range(60)) AS x)) SELECT px.y, px.x, coalesce(max(score), 0) AS v FROM px LEFT JOIN top ON px.x >= greatest(cx - 3, 0) AND px.x < least(cx + 3, 59) AND px.y >= greatest(cy - 3, 0) AND px.y < least(cy + 3, 49) GROUP BY 1, 2")
def q_patch_max_raster_whole(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id * 37 % 900 AS x", "event_id * 91 % 700 AS y", "value AS score")
    return R.paint_max(spark, rows, 50, 60, 96, 16)


PIXELS = "px AS (SELECT l_partkey % 37 AS y, l_suppkey % 53 AS x, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2)"


def pixels(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 37).alias("y"), (F.col("l_suppkey") % 53).alias("x")).agg(F.sum("l_quantity").cast("long").alias("v"))


@query(f"WITH {PIXELS}, a AS (SELECT y // 2 AS y, x // 2 AS x, round_even(sum(v) / 4, 0)::BIGINT AS v FROM px GROUP BY 1, 2) SELECT y // 2 AS y, x // 2 AS x, round_even(sum(v) / 4, 0)::BIGINT AS v FROM a GROUP BY 1, 2")
def q_pyramid_mean(spark, d):
    return R.pyramid_level(R.pyramid_level(pixels(spark, d)))


@query(f"WITH {PIXELS} SELECT y // 2 AS y, x // 2 AS x, v FROM px WHERE y % 2 = 0 AND x % 2 = 0")
def q_pyramid_mask(spark, d):
    return R.pyramid_level(pixels(spark, d), mask=True)


TILES = f"{PIXELS}, t AS (SELECT y // 16 AS ty, x // 16 AS tx, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.95) AS high FROM px GROUP BY 1, 2)"


@query(f"WITH {TILES} SELECT ty, tx, round(low, 6) AS low, round(high, 6) AS high FROM t")
def q_tile_percentiles(spark, d):
    return R.tile_percentiles(pixels(spark, d), 16, 5, 95).select("ty", "tx", r6("low"), r6("high"))


@query(f"WITH {TILES} SELECT y, x, floor(greatest(least((v - low) / (high - low + 1e-5), 1.0), 0.0) * (x % 2) * 255)::BIGINT AS v FROM px JOIN t ON ty = y // 16 AND tx = x // 16")
def q_channel_normalise(spark, d):
    p = pixels(spark, d)
    return R.normalised_channel(p.withColumn("mask", F.col("x") % 2), R.tile_percentiles(p, 16, 5, 95), 16)


def taps_sql(name: str, source: int, target: int, used: int | None = None) -> str:
    """Rows (o, i, w): the source places of each target place and their weights in a bilinear resize."""
    place = f"SELECT o, greatest(least((o + 0.5) * ({source} / {target}.0) - 0.5, {source - 1}), 0) AS s FROM (SELECT unnest(range({used or target})) AS o)"
    return f"{name} AS (SELECT o, least(floor(s)::BIGINT + k, {source - 1}) AS i, CASE WHEN k = 1 THEN s - floor(s) ELSE 1 - (s - floor(s)) END AS w FROM ({place}), (VALUES (0), (1)) t(k))"


DENSE = "dn AS (SELECT g.y, g.x, coalesce(px.v, 0) AS v FROM (SELECT y, x FROM (SELECT unnest(range(37)) AS y), (SELECT unnest(range(53)) AS x)) g LEFT JOIN px ON px.y = g.y AND px.x = g.x)"


def dense_pixels(spark, d):
    return R.canvas(spark, 37, 53).join(pixels(spark, d), ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0)).alias("v"))


@query(
    f"WITH {PIXELS}, {DENSE}, sm AS (SELECT y // 2 AS y, x // 2 AS x, ln(1.0 + v) AS v FROM dn WHERE y % 2 = 0 AND x % 2 = 0), "
    "pad AS (SELECT py.p AS y, px.p AS x, sm.v FROM (SELECT unnest(range(24)) AS p) py, (SELECT unnest(range(32)) AS p) px JOIN sm ON sm.y = CASE WHEN py.p < 19 THEN py.p ELSE 36 - py.p END AND sm.x = CASE WHEN px.p < 27 THEN px.p ELSE 52 - px.p END), "
    "g AS (SELECT y // 8 AS y, x // 8 AS x, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.95) AS high FROM pad GROUP BY 1, 2), "
    + ", ".join((taps_sql("ay", 3, 24, 19), taps_sql("ax", 4, 32, 27), taps_sql("by_", 19, 37), taps_sql("bx", 27, 53)))
    + ", m AS (SELECT ay.o AS y, ax.o AS x, sum(ay.w * ax.w * low) AS low, sum(ay.w * ax.w * high) AS high FROM ay, ax JOIN g ON g.y = ay.i AND g.x = ax.i GROUP BY 1, 2), "
    "b AS (SELECT by_.o AS y, bx.o AS x, sum(by_.w * bx.w * low) AS low, sum(by_.w * bx.w * high) AS high FROM by_, bx JOIN m ON m.y = by_.i AND m.x = bx.i GROUP BY 1, 2) "
    "SELECT y, x, floor(greatest(least((ln(1.0 + v) - low) / (high - low + 1e-5), 1.0), 0.0) * (x % 2) * 255)::BIGINT AS v FROM dn JOIN b USING (y, x)"
)
def q_channel_normalise_interpolated(spark, d):
    dense = dense_pixels(spark, d).withColumn("mask", F.col("x") % 2)
    return R.interpolated_channel(dense, spark, 37, 53, 2, 8, 5.0, 95.0)


@query(
    f"WITH {PIXELS}, {DENSE}, {taps_sql('ay', 37, 20)}, {taps_sql('ax', 53, 90)} SELECT ay.o AS y, ax.o AS x, round(sum(ay.w * ax.w * v), 6) AS v FROM ay, ax JOIN dn ON dn.y = ay.i AND dn.x = ax.i GROUP BY 1, 2"
)
def q_resize_bilinear(spark, d):
    return R.resized(dense_pixels(spark, d), spark, (37, 53), (20, 90), linear=True).select("y", "x", r6("v"))


CUBIC = "CASE WHEN abs(u) <= 1 THEN (1.25 * abs(u) - 2.25) * abs(u) * abs(u) + 1 ELSE ((-0.75 * abs(u) + 3.75) * abs(u) - 6) * abs(u) + 3 END"


def cubic_sql(name: str, source: int, target: int) -> str:
    place = f"SELECT o, j, s - floor(s) - j AS u, floor(s)::BIGINT + j AS i FROM (SELECT o, (o + 0.5) * ({source} / {target}.0) - 0.5 AS s FROM (SELECT unnest(range({target})) AS o)), (SELECT unnest(range(-1, 3)) AS j)"
    return f"{name} AS (SELECT o, least(greatest(i, 0), {source - 1}) AS i, {CUBIC} AS w FROM ({place}))"


@query(f"WITH {PIXELS}, {DENSE}, {cubic_sql('ay', 37, 50)}, {cubic_sql('ax', 53, 40)} SELECT ay.o AS y, ax.o AS x, round(sum(ay.w * ax.w * v), 6) AS v FROM ay, ax JOIN dn ON dn.y = ay.i AND dn.x = ax.i GROUP BY 1, 2")
def q_resize_cubic(spark, d):
    return R.resized_cubic(dense_pixels(spark, d), spark, (37, 53), (50, 40)).select("y", "x", r6("v"))


@query(f"WITH {PIXELS}, {DENSE}, f AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy * dy + dx * dx <= 9) SELECT a.y, a.x, round(quantile_cont(b.v, 0.25), 6) AS v FROM dn a, f JOIN dn b ON b.y = a.y + f.dy AND b.x = a.x + f.dx GROUP BY 1, 2")
def q_disk_percentile(spark, d):
    return N.quantile(dense_pixels(spark, d), N.disk(3), 0.25).select("y", "x", r6("v"))


@query(f"WITH {PIXELS}, d AS (SELECT y, x, coalesce(v, 0) AS v FROM (SELECT y, x FROM (SELECT unnest(range(32)) AS y), (SELECT unnest(range(48)) AS x)) g LEFT JOIN px USING (y, x)) SELECT x0, y0, 8::BIGINT AS size, round(avg(v), 6) AS mean, avg(v) > 300 AS active FROM d JOIN (SELECT x0, y0 FROM (SELECT unnest(range(0, 48, 8)) AS x0), (SELECT unnest(range(0, 32, 8)) AS y0)) ON x >= x0 AND x < x0 + 8 AND y >= y0 AND y < y0 + 8 GROUP BY 1, 2")
def q_integral_cells(spark, d):
    dense = R.canvas(spark, 32, 48).join(pixels(spark, d), ["y", "x"], "left").select("y", "x", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    cells = spark.range(24).selectExpr("id % 6 * 8 AS x0", "id div 6 * 8 AS y0", "CAST(8 AS BIGINT) AS size")
    return R.integral_cells(dense, cells, 300.0).select("x0", "y0", "size", r6("mean"), "active")


@query(f"WITH {PIXELS} SELECT o.y, o.x, px.v FROM (SELECT y, x FROM (SELECT unnest(range(20)) AS y), (SELECT unnest(range(90)) AS x)) o JOIN px ON px.y = o.y * 37 // 20 AND px.x = o.x * 53 // 90")
def q_resize_nearest(spark, d):
    return R.resized(pixels(spark, d), spark, (37, 53), (20, 90))


@query(f"WITH {PIXELS}, h AS (SELECT least(v // 10, 255) AS bin, count(*) AS n FROM px GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS n0, sum(n * bin) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS n, sum(n * bin) OVER () AS s FROM h), b AS (SELECT bin, CASE WHEN n0 = n THEN 0 ELSE round(pow(s0 / n0 - (s - s0) / (n - n0), 2) * n0 * (n - n0), 6) END AS between_v FROM c) SELECT bin AS threshold FROM b ORDER BY between_v DESC, bin LIMIT 1")
def q_otsu_threshold(spark, d):
    return R.otsu(pixels(spark, d).withColumn("v", F.least(F.floor(F.col("v") / 10), F.lit(255))))


@query(f"WITH {PIXELS} SELECT a.y, a.x, max(b.v) AS v FROM px a JOIN px b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2")
def q_dilate(spark, d):
    return N.dilated(pixels(spark, d), N.square(3))


@query(f"WITH {CANVAS}, q AS (SELECT y, x, y::DOUBLE AS fy, x::DOUBLE AS fx FROM px) SELECT y, x, CASE WHEN fx >= 10 AND fx < 25 AND fy >= 5 AND fy < 20 THEN 2 WHEN fx >= 2 AND fx < 18 AND fy >= 2 AND fy < 30 THEN 1 ELSE 0 END::BIGINT AS v FROM q")
def q_filled_polygons(spark, d):
    return R.filled_polygons(spark, [(1, [(2, 2), (18, 2), (18, 30), (2, 30)]), (2, [(10, 5), (25, 5), (25, 20), (10, 20)])], 40, 40)


# ---- sources, sinks, scalars

@query(f"WITH {P} SELECT row_number() OVER (ORDER BY image, row_idx) - 1 AS row_no, image, xmin, ymin, xmax, ymax FROM p")
def q_export_patches(spark, d):
    return IO.export_rows(patches(spark, d))


@query(f"WITH {P} SELECT row_idx, 'x' AS c, CASE WHEN row_idx % 7 = 0 THEN row_idx * 10 ELSE label END::BIGINT AS v FROM p")
def q_overlay_edits(spark, d):
    base = patches(spark, d).selectExpr("row_idx", "'x' AS c", "CAST(label AS BIGINT) AS v")
    edits = base.where("row_idx % 7 = 0").selectExpr("row_idx", "c", "row_idx * 10 AS v")
    return IO.overlaid(base, edits, ["row_idx", "c"])


@query("WITH m(level, k, v) AS (VALUES ('a', 'mpp', '0.5'), ('b', 'mpp', '0.5'), ('a', 'w', '10'), ('b', 'w', '5'), ('a', 'only', 'z')), g AS (SELECT k, count(*) AS n, count(DISTINCT v) AS nd FROM m GROUP BY k) SELECT DISTINCT CASE WHEN n = 2 AND nd = 1 THEN k ELSE level || '.' || k END AS name, v AS value FROM m JOIN g USING (k)")
def q_metadata_merge(spark, d):
    rows = [("a", "mpp", "0.5"), ("b", "mpp", "0.5"), ("a", "w", "10"), ("b", "w", "5"), ("a", "only", "z")]
    return IO.merged_metadata(spark.createDataFrame(rows, "level string, k string, v string"))


@query("WITH m(unit, num, den) AS (VALUES ('INCH', 50800.0::DOUBLE, 1.0::DOUBLE), ('CENTIMETER', 20000.0, 1.0), ('MILLIMETER', 4000.0, 2.0), ('MICROMETER', 4.0, 1.0), ('NONE', 5.0, 1.0), ('INCH', 0.0, 1.0)) SELECT unit, num, round(CASE unit WHEN 'INCH' THEN 25400 WHEN 'CENTIMETER' THEN 10000 WHEN 'MILLIMETER' THEN 1000 WHEN 'MICROMETER' THEN 1 END / nullif(num / den, 0), 6) AS mpp FROM m")
def q_microns_per_pixel(spark, d):
    rows = spark.createDataFrame([("INCH", 50800.0, 1.0), ("CENTIMETER", 20000.0, 1.0), ("MILLIMETER", 4000.0, 2.0), ("MICROMETER", 4.0, 1.0), ("NONE", 5.0, 1.0), ("INCH", 0.0, 1.0)], "unit string, num double, den double")
    return rows.select("unit", "num", F.round(S.microns_per_pixel(F.col("unit"), F.col("num"), F.col("den")), 6).alias("mpp"))


@query("SELECT l AS level, round_even((w0 / w + h0 / h) / 2, 0)::BIGINT AS downsample FROM (SELECT l, 10001 AS w0, 8003 AS h0, 10001 // (2 ** l)::INT AS w, 8003 // (2 ** l)::INT AS h FROM (SELECT unnest(range(5)) AS l))")
def q_level_downsamples(spark, d):
    levels = spark.range(5).selectExpr("id AS level", "10001 div CAST(pow(2, id) AS INT) AS w", "8003 div CAST(pow(2, id) AS INT) AS h")
    return levels.select("level", S.level_downsample(F.lit(10001), F.lit(8003), F.col("w"), F.col("h")).alias("downsample"))


@query("SELECT y, x, least(300, 1000 - y) AS h, least(400, 900 - x) AS w FROM (SELECT unnest(range(0, 1000, 300)) AS y), (SELECT unnest(range(0, 900, 400)) AS x)")
def q_tile_iterator(spark, d):
    return IO.tile_grid(spark, 1000, 900, 300, 400)


@query("SELECT p_partkey, upper(p_brand) AS marker, CASE WHEN p_brand = 'Brand#11' THEN 'gold' WHEN p_brand = 'Brand#12' THEN 'cyan' ELSE 'white' END AS colour FROM part")
def q_marker_colours(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_brand").alias("marker"), S.marker_colour(F.col("p_brand"), {"Brand#11": "gold"}, {"Brand#11": "red", "Brand#12": "cyan"}).alias("colour"))


@query("SELECT p_partkey, (p_size * 1000) >> 8 AS v8, floor(p_size * 20 * least(640 / (p_size * 20), 480 / (p_size * 30)))::BIGINT AS w, floor(p_size * 30 * least(640 / (p_size * 20), 480 / (p_size * 30)))::BIGINT AS h, round(pow(p_size % 4 / 3, 2.0), 6) AS alpha FROM part")
def q_scalar_maths(spark, d):
    size = F.col("p_size").cast("long")
    w, h = S.fitted(size * 20, size * 30, 640, 480)
    return table(spark, d, "part").select("p_partkey", S.to_byte(size * 1000).alias("v8"), w.alias("w"), h.alias("h"), F.round(S.saliency_alpha(size % 4, 2.0), 6).alias("alpha"))


@query("SELECT i AS step, 255::BIGINT AS r, 128::BIGINT AS g, 0::BIGINT AS b, round(i / 255, 6) AS a FROM (SELECT unnest(range(256)) AS i)")
def q_colour_ramp(spark, d):
    return S.transparent_ramp(spark, (255, 128, 0)).select("step", "r", "g", "b", r6("a"))


# ---- lookups, labels, training data and neighbourhoods

@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN ['Width', 'Height'][p_size] WHEN p_size = 3 THEN 'Unit' ELSE p_size::VARCHAR END AS tag FROM part")
def q_tag_names(spark, d):
    registries = [{1: "Width", 2: "Height"}, {2: "Other", 3: "Unit"}]
    return table(spark, d, "part").select("p_partkey", S.tag_name(F.col("p_size"), registries).alias("tag"))


@query("SELECT p_partkey, greatest(30 - p_size, 0)::BIGINT // 2 AS before, greatest(30 - p_size, 0)::BIGINT - greatest(30 - p_size, 0)::BIGINT // 2 AS after FROM part")
def q_equal_padding(spark, d):
    before, after = S.padding_halves(F.col("p_size"), F.lit(30))
    return table(spark, d, "part").select("p_partkey", before.alias("before"), after.alias("after"))


@query("SELECT image, level, h AS height, w AS width, round(10000 / h, 9) AS scale_y, round(8000 / w, 9) AS scale_x FROM (SELECT 's' || i AS image, l AS level, 10000 // (2 ** l)::INT AS h, 8000 // (2 ** l)::INT AS w FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(4)) AS l))")
def q_level_scales(spark, d):
    tiles = spark.range(12).selectExpr("concat('s', id % 3) AS image", "id div 3 AS level", "0L AS y", "0L AS x", "10000 div CAST(pow(2, id div 3) AS INT) AS h", "8000 div CAST(pow(2, id div 3) AS INT) AS w")
    return IO.levels(tiles).select("image", "level", "height", "width", F.round("scale_y", 9).alias("scale_y"), F.round("scale_x", 9).alias("scale_x"))


@query("SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN 0 ELSE dense_rank() OVER (ORDER BY r_name = 'ASIA', r_name) END::BIGINT AS code FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_label_codes(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.label_codes(rows, "r_name", background="ASIA").select("n_nationkey", "code")


@query("SELECT label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, d):
    return A.cluster_sizes(table(spark, d, "embeddings")).select("label", "n", r6("percent"))


@query("SELECT event_id, round((value - min(value) OVER ()) * 255 / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM events")
def q_rescaled_values(spark, d):
    return A.rescaled(table(spark, d, "events").select("event_id", "value"), "value").select("event_id", r6("value"))


@query("SELECT 'sae_' || i AS name FROM (SELECT unnest(range(64)) AS i) WHERE 'sae_' || i NOT IN (SELECT 'sae_' || label FROM embeddings)")
def q_kept_names(spark, d):
    old = spark.range(64).selectExpr("concat('sae_', id) AS name")
    return IO.kept_names(old, table(spark, d, "embeddings").selectExpr("concat('sae_', label) AS name"))


@query(f"WITH {PIXELS} SELECT y, x, v & 240 & 85 AS v FROM px")
def q_mask_intersection(spark, d):
    a = pixels(spark, d).selectExpr("y", "x", "v & 240 AS a")
    b = pixels(spark, d).selectExpr("y", "x", "v & 85 AS b")
    return a.join(b, ["y", "x"]).select("y", "x", F.col("a").bitwiseAND(F.col("b")).alias("v"))


RINGS = "SELECT label AS shape, (vec_id * 7919 % 101)::BIGINT AS x, (vec_id * 104729 % 97)::BIGINT AS y, vec_id % 2 AS side, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS k FROM embeddings"


@query(f"WITH r AS ({RINGS}), c AS (SELECT a.shape, a.k AS i, b.k AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS s FROM r a JOIN r b ON a.shape = b.shape AND a.side = 0 AND b.side = 1) SELECT shape, i, j, round(sqrt(s), 6) AS distance FROM c QUALIFY row_number() OVER (PARTITION BY shape ORDER BY s, i, j) = 1")
def q_nearest_vertices(spark, d):
    rows = table(spark, d, "embeddings").selectExpr("label AS shape", "vec_id", "vec_id % 2 AS side", "vec_id * 7919 % 101 AS x", "vec_id * 104729 % 97 AS y")
    ring = lambda side: rows.where(F.col("side") == side).select("shape", F.col("vec_id").alias("place"), "x", "y")
    return G.nearest_vertices(ring(0), ring(1)).select("shape", "i", "j", r6("distance"))


@query("SELECT a.n_nationkey::BIGINT AS contour, coalesce(string_agg(b.n_nationkey::VARCHAR, ' ' ORDER BY b.n_nationkey), '') AS holes FROM nation a LEFT JOIN nation b ON b.n_nationkey >= 5 AND b.n_nationkey % 4 = a.n_nationkey WHERE a.n_nationkey < 5 GROUP BY 1")
def q_contour_holes(spark, d):
    rows = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS contour", "CAST(if(n_nationkey < 5, -1, n_nationkey % 4) AS BIGINT) AS parent")
    return G.contour_holes(rows).select("contour", F.array_join(F.col("holes").cast("array<string>"), " ").alias("holes"))


@query(f"WITH {PIXELS} SELECT a.y, a.x, median(b.v) AS v FROM px a JOIN px b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2")
def q_median_filter(spark, d):
    return N.median(pixels(spark, d), N.square(3))


@query(f"WITH {PIXELS}, h AS (SELECT a.y, a.x, b.v // 50 AS v, count(*) AS n FROM px a JOIN px b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL) SELECT y, x, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS v FROM h GROUP BY y, x")
def q_local_entropy(spark, d):
    return N.entropy(pixels(spark, d).selectExpr("y", "x", "v div 50 AS v"), N.square(5)).select("y", "x", r6("v"))


@query(f"WITH {PIXELS}, m AS (SELECT a.y, a.x, max(b.v) AS v FROM px a JOIN px b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2) SELECT a.y, a.x, min(b.v) AS v FROM m a JOIN m b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2")
def q_closed_mask(spark, d):
    return N.closed(pixels(spark, d), N.square(3))


SOFT = "g AS (SELECT unnest(range(24)) AS y), h AS (SELECT unnest(range(30)) AS x), p AS (SELECT y, x, ((y // 4 + x // 5) % 3 IN (1, 2))::INT AS v FROM g, h), k AS (SELECT i - 3 AS o, w / sum(w) OVER () AS w FROM (SELECT i, exp(-((i - 3) ** 2) / (2 * 1.4 ** 2)) AS w FROM (SELECT unnest(range(7)) AS i)))"


@query(f"WITH {SOFT}, a AS (SELECT t.y, p.x, sum(k.w * p.v) AS v FROM g t, k JOIN p ON p.y = CASE WHEN t.y + k.o < 0 THEN -(t.y + k.o) WHEN t.y + k.o > 23 THEN 46 - t.y - k.o ELSE t.y + k.o END GROUP BY 1, 2) SELECT a.y, t.x, round(sum(k.w * a.v), 6) AS v FROM h t, k JOIN a ON a.x = CASE WHEN t.x + k.o < 0 THEN -(t.x + k.o) WHEN t.x + k.o > 29 THEN 58 - t.x - k.o ELSE t.x + k.o END GROUP BY 1, 2")
def q_soft_labels(spark, d):
    classes = R.canvas(spark, 24, 30).withColumn("v", F.expr("(y div 4 + x div 5) % 3"))
    return R.soft_labels(classes, [1, 2], 7, 24, 30).select("y", "x", r6("v"))


@query("SELECT vec_id AS id, round(list_sum([CASE WHEN list_max(embedding) > 0.25 THEN v / 255 ELSE v / 1 END FOR v IN list_transform(embedding, lambda v: v::DOUBLE * 4)]), 6) AS image, round(list_sum([least(greatest(v::DOUBLE, 0), 1) FOR v IN embedding]), 6) AS mask FROM embeddings")
def q_training_pairs(spark, d):
    rows = table(spark, d, "embeddings").selectExpr("vec_id AS id", "transform(embedding, v -> CAST(v AS DOUBLE) * 4) AS image", "CAST(embedding AS ARRAY<DOUBLE>) AS mask")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6).alias(c)
    return R.unit_pairs(rows).select("id", total("image"), total("mask"))


@query("WITH u AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings WHERE vec_id < 40) SELECT a.vec_id AS i, b.vec_id AS j, round(1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS distance FROM u a JOIN u b ON a.vec_id < b.vec_id")
def q_cosine_distances(spark, d):
    from ..operators.cluster import cosine_distances

    rows = table(spark, d, "embeddings").where("vec_id < 40").select(F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<double>").alias("vec"))
    return cosine_distances(rows).select("i", "j", r6("distance"))


@query("WITH m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY 1), k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM n) SELECT ka.k AS i, kb.k AS j, round(1 - sum(a.v * b.v) / (any_value(na.n) * any_value(nb.n)), 6) AS distance FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label JOIN k ka ON ka.label = a.label JOIN k kb ON kb.label = b.label GROUP BY 1, 2")
def q_cosine_distances_labels(spark, d):
    from ..operators.cluster import cosine_distances

    rows = spark.createDataFrame(list(enumerate(centroids(spark, d))), "row_idx long, vec array<double>")
    return cosine_distances(rows).select("i", "j", r6("distance"))


@query(f"WITH {PIXELS}, s AS (SELECT a.y, a.x, sum(b.v * (a.y - b.y) * CASE WHEN a.x = b.x THEN 2 ELSE 1 END) AS gy, sum(b.v * (a.x - b.x) * CASE WHEN a.y = b.y THEN 2 ELSE 1 END) AS gx FROM px a JOIN px b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2) SELECT y, x, round(sqrt(gy * gy + gx * gx) / 4, 6) AS v FROM s")
def q_sobel_gradient(spark, d):
    from ..operators.adaptive import gradient

    return gradient(pixels(spark, d).withColumn("image", F.lit("a"))).select("y", "x", r6("v"))


MIRRORED = "CASE WHEN {t} + k.o < 0 THEN -({t} + k.o) WHEN {t} + k.o > {last} THEN {twice} - {t} - k.o ELSE {t} + k.o END"


@query(
    f"WITH {SOFT}, {cubic_sql('ay', 24, 36)}, {cubic_sql('ax', 30, 40)}, r AS (SELECT ay.o AS y, ax.o AS x, sum(ay.w * ax.w * v) AS v FROM ay, ax JOIN p ON p.y = ay.i AND p.x = ax.i GROUP BY 1, 2), "
    f"a AS (SELECT t.y, r.x, sum(k.w * r.v) AS v FROM (SELECT unnest(range(36)) AS y) t, k JOIN r ON r.y = {MIRRORED.format(t='t.y', last=35, twice=70)} GROUP BY 1, 2) "
    f"SELECT a.y, t.x, round(sum(k.w * a.v), 6) AS v FROM (SELECT unnest(range(40)) AS x) t, k JOIN a ON a.x = {MIRRORED.format(t='t.x', last=39, twice=78)} GROUP BY 1, 2"
)
def q_training_mask(spark, d):
    classes = R.canvas(spark, 24, 30).withColumn("v", F.expr("(y div 4 + x div 5) % 3"))
    return N.training_mask(classes, spark, (24, 30), (36, 40), [1, 2], 7).select("y", "x", r6("v"))


# ---- slides, embedding, galleries and maps

COLOURS = "rgb AS (SELECT 's' || s AS image, c, y, x, (x * 7 + y * 13 + c * 31 + s * 5) % 256 AS v FROM (SELECT unnest(range(2)) AS s), (SELECT unnest(range(3)) AS c), (SELECT unnest(range(90)) AS y), (SELECT unnest(range(120)) AS x))"


def colours(spark):
    return spark.range(2 * 3 * 90 * 120).selectExpr("concat('s', id div 32400) AS image", "id div 32400 AS s", "id % 32400 div 10800 AS c", "id % 10800 div 120 AS y", "id % 120 AS x").selectExpr("image", "c", "y", "x", "(x * 7 + y * 13 + c * 31 + s * 5) % 256 AS v")


BOXES = "SELECT 's' || vec_id % 2 AS image, vec_id AS row_idx, vec_id * 37 % 110 - 8 AS xmin, vec_id * 53 % 85 - 8 AS ymin, vec_id * 37 % 110 + 8 AS xmax, vec_id * 53 % 85 + 8 AS ymax FROM embeddings"


def boxes(spark, d):
    return table(spark, d, "embeddings").selectExpr("concat('s', vec_id % 2) AS image", "vec_id AS row_idx", "vec_id * 37 % 110 - 8 AS xmin", "vec_id * 53 % 85 - 8 AS ymin", "vec_id * 37 % 110 + 8 AS xmax", "vec_id * 53 % 85 + 8 AS ymax")


@query(f"WITH {COLOURS}, p AS ({BOXES}), k AS (SELECT unnest(range(3)) AS c), u AS (SELECT DISTINCT image, xmin, ymin, xmax, ymax FROM p), m AS (SELECT u.image, u.xmin, u.ymin, k.c, coalesce(sum(v), 0) / 256.0 AS mean, coalesce(max(v), 0) AS most FROM u CROSS JOIN k LEFT JOIN rgb ON rgb.image = u.image AND rgb.c = k.c AND x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY ALL) SELECT row_idx, c AS i, round(mean, 3) AS v FROM p JOIN m USING (image, xmin, ymin) UNION ALL SELECT row_idx, c + 3, round(most::DOUBLE, 3) FROM p JOIN m USING (image, xmin, ymin)")
def q_embed_blocks(spark, d):
    from ..operators import embedding as E

    tiles = W.tiled(colours(spark), 32, 3, by=("image",))
    found = E.embed_blocks(boxes(spark, d), tiles, E.channel_means, size=16, block=40)
    return found.select("row_idx", F.posexplode("vec").alias("i", "v")).select("row_idx", F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), 3).alias("v"))


@query(f"WITH {COLOURS} SELECT image, c, y, x, v FROM rgb")
def q_tile_round_trip(spark, d):
    return W.untiled(W.tiled(colours(spark), 32, 3, by=("image",)), 3, by=("image",))


@query(f"WITH {COLOURS}, l1 AS (SELECT c, y // 2 AS y, x // 2 AS x, round_even(sum(v) / 4, 0)::BIGINT AS v FROM rgb WHERE image = 's0' GROUP BY 1, 2, 3), l2 AS (SELECT c, y // 2 AS y, x // 2 AS x, round_even(sum(v) / 4, 0)::BIGINT AS v FROM l1 GROUP BY 1, 2, 3) SELECT 0::BIGINT AS level, c, y, x, v FROM rgb WHERE image = 's0' UNION ALL SELECT 1, c, y, x, v FROM l1 UNION ALL SELECT 2, c, y, x, v FROM l2")
def q_auto_pyramid(spark, d):
    return W.auto_pyramid(colours(spark).where("image = 's0'"), (2, 2))


@query(f"WITH {COLOURS} SELECT image, c, y, x, v, ['r', 'g', 'b'][c + 1] AS channel, y * CASE image WHEN 's0' THEN 1.0::DOUBLE ELSE 4.0 END AS base_y, x * CASE image WHEN 's0' THEN 1.0::DOUBLE ELSE 4.0 END AS base_x FROM rgb")
def q_multiscale_channels(spark, d):
    leveled = colours(spark).withColumn("level", F.substring("image", 2, 1).cast("int"))
    return W.multiscale(leveled, {0: 1.0, 1: 4.0}, "HnE").drop("level")


@query(f"WITH {COLOURS} SELECT substr(image, 2, 1)::BIGINT * 3 + c AS c, y, x, v FROM rgb")
def q_axes_to_cyx(spark, d):
    named = colours(spark).select(F.substring("image", 2, 1).cast("long").alias("T"), F.col("c").alias("S"), F.col("y").alias("Y"), F.col("x").alias("X"), "v")
    return W.to_cyx(named, "TSYX", {"T": 2, "S": 3})


@query("WITH px AS (SELECT 's' || s AS image, y, x FROM (SELECT unnest(range(3)) AS s), (SELECT unnest(range(20)) AS y), (SELECT unnest(range(30)) AS x)), p AS (SELECT 's' || user_id % 4 AS image, round_even(event_id * 37 % 480 / 16, 0)::BIGINT AS cx, round_even(event_id * 91 % 320 / 16, 0)::BIGINT AS cy, max(value) AS score FROM events WHERE user_id % 4 <> 1 GROUP BY 1, 2, 3) SELECT px.image, px.y, px.x, coalesce(max(score), 0) AS v FROM px LEFT JOIN p ON p.image = px.image AND px.x >= greatest(cx - 2, 0) AND px.x < least(cx + 2, 29) AND px.y >= greatest(cy - 2, 0) AND px.y < least(cy + 2, 19) GROUP BY 1, 2, 3")
def q_feature_maps(spark, d):
    rows = table(spark, d, "events").where("user_id % 4 <> 1").selectExpr("concat('s', user_id % 4) AS image", "event_id * 37 % 480 AS x", "event_id * 91 % 320 AS y", "value AS score")
    sizes = spark.range(3).selectExpr("concat('s', id) AS image", "20L AS height", "30L AS width")
    return R.feature_maps(rows, sizes, 64, 16)


@query(f"WITH {EV}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, table_name, row_idx) AS number FROM ev) SELECT table_name, row_idx, number, panel, (number - 1) // 10 AS page, (number - 1) % 10 // 5 * 4 + panel AS grid_row, (number - 1) % 10 % 5 AS grid_col FROM k, (SELECT unnest(range(4)) AS panel) WHERE number <= 24")
def q_gallery_saliency_rows(spark, d):
    top = T.top_rows(scored_events(spark, d), n=24)
    return T.saliency_rows(top, 3, 10, 5).select("table_name", "row_idx", F.col(T.RANK).alias("number"), "panel", "page", "grid_row", "grid_col")


@query(f"WITH {ACT}, b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, table_name, row_idx) AS k FROM act) SELECT f.feature, f.feature % 5 AS cluster, table_name AS _source_patch_table, row_idx, score AS _feature_score, (63 - f.feature) // 10 AS grid_row, (63 - f.feature) % 10 AS grid_col FROM (SELECT unnest(range(64)) AS feature) f LEFT JOIN b ON b.feature = f.feature AND k = 1")
def q_feature_gallery(spark, d):
    clusters = spark.range(64).selectExpr("id AS feature", "id % 5 AS cluster", "63 - id AS place")
    return T.feature_gallery(activations(spark, d), clusters, 10)


@query(f"WITH {P} SELECT image, row_idx, row_number() OVER (ORDER BY image, ymin // 2000, xmin // 2000, row_idx) - 1 AS place FROM p")
def q_block_order(spark, d):
    return T.block_order(patches(spark, d), 2000, 2000).select("image", "row_idx", "place")


@query("WITH c AS (SELECT event_type AS image, event_id AS place, round(value, 0) AS mean FROM events) SELECT image, place, row_number() OVER (PARTITION BY image ORDER BY mean DESC, place) AS turn FROM c WHERE mean > 100")
def q_drain_order(spark, d):
    cells = table(spark, d, "events").select(F.col("event_type").alias("image"), F.col("event_id").alias("place"), F.round("value", 0).alias("mean")).withColumn("active", F.col("mean") > 100)
    return T.drain_order(cells).select("image", "place", "turn")


@query("WITH m AS (SELECT doc_id % 3 AS epoch, doc_id % 10 AS image, quality = 1 AS t, toxic = 1 AS g FROM labels), e AS (SELECT epoch, image, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM m GROUP BY 1, 2) SELECT epoch, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, round(CASE WHEN sum(tp + fp + fn) = 0 THEN 1 ELSE sum(tp) / sum(tp + fp + fn) END, 6) AS micro_iou, round(avg(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END), 6) AS image_iou FROM e GROUP BY epoch")
def q_epoch_metrics(spark, d):
    masks = table(spark, d, "labels").selectExpr("doc_id % 3 AS epoch", "doc_id % 10 AS image", "quality = 1 AS truth", "toxic = 1 AS guess")
    return A.segmentation_metrics(masks, ("epoch",)).select("epoch", "tp", "fp", "fn", "tn", r6("micro_iou"), r6("image_iou"))


@query("WITH m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2) SELECT a.label::BIGINT AS i, b.label::BIGINT AS j, round(sqrt(sum((a.v - b.v) ** 2)), 6) AS euclidean, round(sum(abs(a.v - b.v)), 6) AS cityblock FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def q_pair_distances_labels(spark, d):
    from ..operators.cluster import pair_distances

    rows = spark.createDataFrame(list(enumerate(centroids(spark, d))), "row_idx long, vec array<double>")
    far = pair_distances(rows, "euclidean").withColumnRenamed("distance", "euclidean").join(pair_distances(rows, "cityblock").withColumnRenamed("distance", "cityblock"), ["i", "j"])
    return far.select("i", "j", r6("euclidean"), r6("cityblock"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', '', 'g'))::BIGINT AS kept FROM documents")
def q_xml_safe(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length(W.xml_safe(F.coalesce("text", F.lit("")))).cast("long").alias("kept"))


# ---- no SQL: iterative or geometric algorithms, tested against brute force

@query()
def q_feature_linkage(spark, d):
    from ..operators.cluster import FeatureClusters

    return FeatureClusters(threshold=0.9).fit(iou(spark, A.strict_set(activations(spark, d)))).clusters()


@query()
def q_kmeans_frequency_ranked(spark, d):
    from ..operators.cluster import FrequencyRankedKMeans

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vec"))
    return FrequencyRankedKMeans(k=10).fit(rows).transform(rows).select("row_idx", "label")


@query()
def q_linear_interpolation(spark, d):
    from ..operators.adaptive import interpolate_linear

    return interpolate_linear(seeds(spark).withColumn("image", F.lit("a")), 40, 40)


@query()
def q_mask_polygons(spark, d):
    from ..operators.adaptive import mask_polygons

    raster = R.filled_polygons(spark, [(1, [(2, 2), (18, 2), (18, 30), (2, 30)]), (2, [(10, 5), (25, 5), (25, 20), (10, 20)])], 40, 40)
    return mask_polygons(raster.withColumn("image", F.lit("a")))


@query()
def q_cleaned_mask(spark, d):
    from ..operators.adaptive import cleaned_mask

    return cleaned_mask(pixels(spark, d).select(F.lit("a").alias("image"), "y", "x", (F.col("v") > 300).cast("long").alias("v")), 4)


@query()
def q_sae_fit_transform(spark, d):
    from ..operators.autoencoder import SparseAutoencoder

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vec"))
    return SparseAutoencoder(expansion=2, steps=100, rate=1e-3, target=0.05).fit(rows).transform(rows)


@query()
def q_embed_patches(spark, d):
    from ..operators.autoencoder import embed_patches, hash_embedder

    return embed_patches(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("vec_id").cast("string").alias("data")), hash_embedder(16))


@query()
def q_token_clusters(spark, d):
    from ..operators.cluster import FrequencyRankedKMeans, TokenClusters

    rows = table(spark, d, "embeddings").select((F.col("vec_id") / 25).cast("long").alias("row_idx"), (F.col("vec_id") % 25).alias("position"), F.col("embedding").cast("array<double>").alias("vec"))
    model = FrequencyRankedKMeans(k=10, normalise=False, centroids=centroids(spark, d))
    return TokenClusters(model, grid=5).fit(rows, F.col("row_idx") % 2 == 0).maps(rows)


@query()
def q_adaptive_samples(spark, d):
    from ..operators.adaptive import adaptive_samples

    label = lambda df: df.withColumn("label", ((F.col("x") - 20) * (F.col("x") - 20) + (F.col("y") - 14) * (F.col("y") - 14) < 70).cast("long"))
    cells = spark.range(30).selectExpr("concat('s', id div 15) AS image", "id % 5 * 8 AS x0", "id div 5 % 3 * 8 AS y0", "CAST(8 AS BIGINT) AS size")
    start = label(G.corners(cells).where("x < 41 AND y < 25"))
    return adaptive_samples(cells, start, label, 25, 41, threshold=0.05, least=4, most_epochs=2)


@query()
def q_feature_heatmap(spark, d):
    from ..operators.cluster import FeatureClusters

    pairs = iou(spark, A.strict_set(activations(spark, d)))
    return FeatureClusters(threshold=0.9).fit(pairs).display(pairs)
