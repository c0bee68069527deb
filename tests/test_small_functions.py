import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import embedding, features, geometry, selection
from tessella.sources import slides, tables


@pytest.mark.parametrize(("chunk", "patch", "target", "want"), [(None, 448, 4096, 4096), (0, 448, 100, 448), (1024, 448, 4096, 4096), (1000, 448, 4096, 4000), (600, 448, 1500, 1200), (9000, 448, 4096, 4096), (5000, 448, 4096, 5000), (100, 448, 250, 448)])
def test_block_size(chunk, patch, target, want):
    assert geometry.block_size(chunk, patch, target) == want


def test_centering(spark):
    x = np.random.default_rng(0).normal(0, 2, (60, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, vec array<double>")
    centre, norm = features.centering(rows, 7)
    some = x[::7]
    assert np.allclose(centre, some.mean(axis=0)) and norm == pytest.approx(np.linalg.norm(some - some.mean(axis=0), axis=1).mean())


def test_tile_addresses(spark):
    keys = [("0/3.5.0", 1.0), ("2/7.1.2", 4.0006)]
    got = [r.a for r in spark.createDataFrame(keys, "k string, d double").select(tables.tile_address(F.col("k"), F.col("d"), 512).alias("a")).collect()]
    assert [(r.level, r.y, r.x, r.c) for r in got] == [(0, 1536, 2560, 0), (2, int(7 * 4.0006 * 512), int(4.0006 * 512), 2)]


def test_channels_are_written_apart(spark, tmp_path):
    px = spark.createDataFrame([(c, y, y, 10 * c + y) for c in range(3) for y in range(4)], "c long, y long, x long, v long")
    for c in (0, 2):
        slides.write_channel(px, str(tmp_path), c)
    slides.write_channel(px.withColumn("v", F.lit(7).cast("long")), str(tmp_path), 0)
    back = spark.read.parquet(str(tmp_path))
    assert sorted((r.c, r.v) for r in back.collect()) == [(0, 7)] * 4 + [(2, 20 + y) for y in range(4)]


def test_gallery_layouts(spark):
    ranked = spark.createDataFrame([(k,) for k in range(1, 8)], f"{selection.RANK} long")
    got = {(r[selection.RANK], r.panel): (r.page, r.grid_row, r.grid_col) for r in selection.saliency_rows(ranked, 2, 6, 3).collect()}
    assert got[1, 0] == (0, 0, 0) and got[5, 2] == (0, 5, 1) and got[7, 1] == (1, 1, 0) and len(got) == 21


def test_batches_of_rows(spark):
    rows = spark.range(7).withColumnRenamed("id", "row_idx")
    assert [sorted(r.row_idx for r in b.collect()) for b in embedding.rows_of_batches(rows, 3)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert not list(embedding.rows_of_batches(rows.limit(0), 3))


def test_large_parameters_are_refused():
    with pytest.raises(ValueError, match="literals"):
        features.nearest_centroid(F.array(F.lit(1.0)), [[0.0] * 1000] * 201)
