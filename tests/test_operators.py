import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import adaptive, autoencoder, cluster, features, geometry, raster, selection
from tessella.sources import tables
from tessella.streaming import exemplars


def test_linkage_and_clusters():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0]], dtype=float)
    z = cluster.linkage(d)
    assert z.tolist() == [[0, 1, 1, 2], [2, 3, 2, 2], [4, 5, 4.5, 4]]
    assert cluster.linkage(d, "single")[-1, 2] == 3 and cluster.linkage(d, "complete")[-1, 2] == 6
    assert cluster.flat_clusters(z, 4, 2.5).tolist() == [1, 1, 2, 2] == cluster.flat_clusters(z, 4, 2, "maxclust").tolist()
    assert sorted(cluster.leaf_order(z, 4)) == [0, 1, 2, 3]
    with pytest.raises(RuntimeError):
        cluster.FeatureClusters().clusters()


def test_linear_interpolation_of_a_plane():
    rng = np.random.default_rng(1)
    p = np.vstack([[[0, 0], [30, 0], [0, 20], [30, 20]], rng.integers(1, 20, (12, 2))])
    p = np.unique(p, axis=0)
    out = adaptive.linear_raster(p, 2.0 * p[:, 0] - p[:, 1] + 3, 21, 31)
    yy, xx = np.mgrid[0:21, 0:31]
    assert np.allclose(out, 2 * xx - yy + 3)


def test_triangulation():
    rng = np.random.default_rng(5)
    for points in (rng.random((400, 2)) * 90, np.array([(x, y) for x in range(12) for y in range(15)], dtype=float) * 8, np.unique(rng.integers(0, 25, (300, 2)), axis=0) / 4):
        t = adaptive.delaunay(points)
        a, b, c = (points[t[:, k]] for k in range(3))
        area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
        assert (area > 0).all() and sorted(set(t.ravel().tolist())) == list(range(len(points)))
        # no point lies in the circle of a triangle
        d = 4 * area
        a2, b2, c2 = ((v**2).sum(axis=1) for v in (a, b, c))
        x = (a2 * (b - c)[:, 1] + b2 * (c - a)[:, 1] + c2 * (a - b)[:, 1]) / d
        y = (a2 * (c - b)[:, 0] + b2 * (a - c)[:, 0] + c2 * (b - a)[:, 0]) / d
        radius = (a[:, 0] - x) ** 2 + (a[:, 1] - y) ** 2
        assert (((points[None] - np.stack([x, y], axis=1)[:, None]) ** 2).sum(axis=2).min(axis=1) > radius * (1 - 1e-6) - 1e-6).all()
    assert len(adaptive.delaunay(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 0
    many = np.unique(rng.integers(0, 3000, (20_000, 2)), axis=0).astype(float)
    began = time.perf_counter()
    assert len(adaptive.delaunay(many)) > 1.9 * len(many) and time.perf_counter() - began < 15


def test_contours_and_components():
    mask = np.zeros((8, 9), dtype=bool)
    mask[1:6, 1:7] = True
    mask[3, 3] = False
    areas = sorted(adaptive.ring_area(r) for r in adaptive.trace(mask))
    assert areas == [-1, 30] or areas == [-30, 1]
    mask[7, 8] = True
    number, sizes = adaptive.component_sizes(mask)
    assert sorted(sizes[1:].tolist()) == [1, 29]


def test_selection_edges(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("b", 1, 1.0), ("b", 2, -1.0), ("b", 3, None)], "table_name string, row_idx long, score double")
    top = selection.top_rows(rows, n=10).orderBy("_feature_rank").collect()
    assert [(r.table_name, r.row_idx, r._feature_rank) for r in top] == [("a", 1, 1), ("b", 1, 2), ("b", 2, 3)]
    assert selection.top_rows(rows).count() == 2 and selection.top_rows(rows.limit(0), n=3).count() == 0
    assert selection.sample_rows(rows, 0).count() == 0 and selection.sample_rows(rows, 99).count() == 5
    for bad in (lambda: selection.sample_rows(rows, -1), lambda: selection.rows_with_feature(rows.withColumn("f", F.lit(0)), "f")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        selection.patch_scores(rows, rows, "missing")


def test_plans(spark):
    act = spark.createDataFrame([("a", 1, 1, 1.0)], "table_name string, row_idx long, feature long, score double")
    assert "WindowGroupLimit" in selection.exemplars(act)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in selection.top_rows(act, n=3)._jdf.queryExecution().executedPlan().toString()


def test_container_and_files(spark, tmp_path):
    c = tables.Container(spark).add_image("s1", "HnE", "/x", spark.createDataFrame([(0, b"z")], "level int, data binary"))
    c.elements["p"] = spark.createDataFrame([(1, 2)], "a long, b long")
    c.write(str(tmp_path / "c"))
    back = tables.Container.read(spark, str(tmp_path / "c"), ["s1", "p"])
    assert back.elements["s1"].columns == ["level"] and back.images.count() == 1 and back.elements["p"].collect() == [(1, 2)]
    with pytest.raises(KeyError):
        back.model("none")
    tables.overwrite_element(back.elements["p"].withColumn("b", F.lit(9)), str(tmp_path / "c" / "p"))
    assert spark.read.parquet(str(tmp_path / "c" / "p")).collect() == [(1, 9)]
    (tmp_path / "r.xml").write_text('<OME><ROI ID="R1" Name="n1"><Union><Polygon Text="t" Points="1,2 3,4"/></Union></ROI><ROI ID="R2" Name="n2"><Union><Polyline Points="5,6 7,8"/></Union></ROI></OME>')
    assert sorted(map(tuple, tables.read_rois_xml(spark, str(tmp_path / "r.xml")).collect())) == [("R1", "t", "1,2 3,4"), ("R2", "n2", "5,6 7,8")]
    s = spark.createDataFrame([(1, 2, 3)], "x int, y int, label int")
    tables.write_samples(s, str(tmp_path / "s"))
    assert tables.read_samples(spark, str(tmp_path / "s")).collect() == [(1, 2, 3)]


def test_autoencoder_learns(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (200, 3)) @ rng.normal(0, 1, (3, 8)))], "row_idx long, vec array<double>")
    sae = autoencoder.SparseAutoencoder(expansion=2, steps=150, rate=5e-3, target=0.2, batch=64).fit(rows)
    assert np.mean(sae.losses[-10:]) < np.mean(sae.losses[:10])
    kept = sae.transform(rows, keep=[1, 3]).select("feature").distinct().collect()
    assert {r.feature for r in kept} <= {1, 3}


def test_adaptive_samples(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    step = lambda df: df.withColumn("label", (F.col("x") > 13).cast("long"))
    cells = spark.createDataFrame([("a", x, y, 8) for x in (0, 8, 16) for y in (0, 8)], "image string, x0 long, y0 long, size long")
    samples = step(geometry.corners(cells).where("x < 25 AND y < 17"))
    out = adaptive.adaptive_samples(cells, samples, step, 17, 25, threshold=0.05, least=4, most_epochs=3)
    assert out.count() > samples.count() and out.count() == out.select("x", "y").distinct().count()


def test_stream_exemplars(spark, tmp_path):
    rows = [("t", i, i % 3, float(i * 7 % 11)) for i in range(40)]
    schema = "table_name string, row_idx long, feature long, score double"
    whole = spark.createDataFrame(rows, schema)
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = exemplars.start(stream, str(tmp_path / "out"), str(tmp_path / "ck"), k=2)
    q.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = spark.read.parquet(str(tmp_path / "out" / str(last))).collect()
    assert sorted(map(str, got)) == sorted(map(str, selection.exemplars(whole, k=2).collect()))


def test_resize_and_pyramid(spark):
    px = raster.canvas(spark, 4, 4).withColumn("v", F.col("y") * 4.0 + F.col("x"))
    same = raster.resized(px, spark, (4, 4), (4, 4), linear=True).orderBy("y", "x").collect()
    assert [r.v for r in same] == [float(i) for i in range(16)]
    assert raster.pyramid_levels(1000, 700, 256) == 3 and raster.pyramid_levels(10, 10, 256) == 1
    pad = raster.reflect_padded(px, 4, 4, 3).collect()
    assert len(pad) == 36 and {(r.y, r.x): r.v for r in pad}[4, 5] == 2 * 4 + 1


def test_two_images_refine_apart(spark):
    pixels = spark.createDataFrame([(i, y, x, float(y * 3 + x) * (1 if i == "a" else 5)) for i in "ab" for y in range(4) for x in range(6)], "image string, y long, x long, v double")
    cells = spark.createDataFrame([(i, x, y, 2) for i in "ab" for x in (0, 2, 4) for y in (0, 2)], "image string, x0 long, y0 long, size long")
    got = {(r.image, r.x0, r.y0): r.mean for r in raster.integral_cells(pixels, cells, 1.0, by=("image",)).collect()}
    for (image, x0, y0), mean in got.items():
        want = np.mean([(y * 3 + x) * (1 if image == "a" else 5) for y in (y0, y0 + 1) for x in (x0, x0 + 1)])
        assert abs(mean - want) < 1e-9
    assert len(got) == 12


def test_edges_of_small_operators(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("",), ("b",)], "label string")
    assert sorted((r.label or "", r.code) for r in features.label_codes(rows).collect()) == [("", 0), ("", 0), ("a", 1), ("b", 2), ("b", 2)]
    assert features.label_codes(rows.limit(0)).count() == 0
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert sorted(str(r.v) for r in features.rescaled(same).collect()) == ["0.0", "0.0", "None"]
    ring = "shape long, points array<struct<x: long, y: long>>"
    a, b = spark.createDataFrame([(1, [(0, 0), (4, 0)]), (2, [])], ring), spark.createDataFrame([(1, [(4, 3), (0, 3)]), (2, [(1, 1)])], ring)
    assert [tuple(r) for r in geometry.nearest_vertices(a, b).collect()] == [(1, 0, 1, 3.0)]
    with pytest.raises(ValueError):
        raster.convolved(raster.canvas(spark, 3, 3).withColumn("v", F.lit(1.0)), raster.gaussian_kernel(7), 3, 3)
    level = raster.convolved(raster.canvas(spark, 5, 6).withColumn("v", F.lit(2.0)), raster.gaussian_kernel(5), 5, 6).collect()
    assert len(level) == 30 and all(abs(r.v - 2) < 1e-12 for r in level)
