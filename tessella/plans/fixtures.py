"""Views over the test tables that stand in for patch tables, activations and scored rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_idx, image and box of 448-pixel patches, 25 to a row."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('slide_', label) AS image", "concat('slide_', label) AS table_name", "vec_id AS row_idx", "label",
        "vec_id % 25 * 448 AS xmin", "vec_id div 25 * 448 AS ymin", "vec_id % 25 * 448 + 448 AS xmax", "vec_id div 25 * 448 + 448 AS ymax",
    )


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse features in long form: what an embedding's components have over 0.15."""
    return (
        table(spark, sf_dir, "embeddings")
        .selectExpr("vec_id AS row_idx", "label", "posexplode(embedding) AS (feature, v)")
        .selectExpr("concat('slide_', label) AS table_name", "row_idx", "CAST(feature AS BIGINT) AS feature", "CAST(v AS DOUBLE) - 0.15D AS score")
        .where("score > 0")
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in five tables with scores of which many are zero."""
    return table(spark, sf_dir, "events").selectExpr("event_type AS table_name", "event_id AS row_idx", "greatest(value - 30, 0D) AS score")


P = "p AS (SELECT 'slide_' || label AS image, 'slide_' || label AS table_name, vec_id AS row_idx, label, vec_id % 25 * 448 AS xmin, vec_id // 25 * 448 AS ymin, vec_id % 25 * 448 + 448 AS xmax, vec_id // 25 * 448 + 448 AS ymax FROM embeddings)"
ACT = "act AS (SELECT table_name, row_idx, feature, v::DOUBLE - 0.15 AS score FROM (SELECT 'slide_' || label AS table_name, vec_id AS row_idx, unnest(range(len(embedding))) AS feature, unnest(embedding) AS v FROM embeddings) WHERE v::DOUBLE - 0.15 > 0)"
EV = "ev AS (SELECT event_type AS table_name, event_id AS row_idx, greatest(value - 30, 0) AS score FROM events)"
