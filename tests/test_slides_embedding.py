import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import embedding as E
from tessella.operators.autoencoder import SparseAutoencoder
from tessella.operators.cluster import FrequencyRankedKMeans, TokenClusters
from tessella.sources import slides as W
from tessella.sources import tables as IO


@pytest.fixture(scope="module")
def slide(spark):
    image = np.random.default_rng(0).integers(0, 256, (3, 70, 90)).astype(np.uint8)
    rows = [("a", int(c), int(y), int(x), int(image[c, y, x])) for c, y, x in np.ndindex(image.shape)]
    tiles = W.tiled(spark.createDataFrame(rows, "image string, c long, y long, x long, v long"), 32, 3, by=("image",)).persist()
    return image, tiles


def crop(image, x0, y0, x1, y1):
    out = np.zeros((3, y1 - y0, x1 - x0), np.uint8)
    a, b, c, d = max(y0, 0), min(y1, image.shape[1]), max(x0, 0), min(x1, image.shape[2])
    if a < b and c < d:
        out[:, a - y0 : b - y0, c - x0 : d - x0] = image[:, a:b, c:d]
    return out


BOXES = [(0, -5, -7, 11, 9), (1, 20, 20, 36, 36), (2, 85, 60, 101, 76), (3, 400, 400, 416, 416), (4, 31, 31, 39, 40), (5, 20, 20, 36, 36)]


def test_embed_blocks(spark, slide, monkeypatch):
    image, tiles = slide
    patches = spark.createDataFrame([("a", *b) for b in BOXES], "image string, row_idx long, xmin long, ymin long, xmax long, ymax long")
    for block in (8, 30, 4096):
        got = {r.row_idx: r.vec for r in E.embed_blocks(patches, tiles, E.channel_means, size=16, block=block, batch=2).collect()}
        assert got.keys() == {b[0] for b in BOXES}
        for i, *box in BOXES:
            assert np.allclose(got[i], E.channel_means(crop(image, *box)[None])[0])
    assert E.embed_blocks(patches.limit(0), tiles, E.channel_means, size=16).count() == 0
    monkeypatch.setattr(E, "MOST_PATCHES", 2)
    many = spark.createDataFrame([("a", 10 * k + b[0], *b[1:]) for k in range(5) for b in BOXES], patches.schema)
    crowded = {r.row_idx: r.vec for r in E.embed_blocks(many, tiles, E.channel_means, size=16).collect()}
    assert len(crowded) == 30 and all(np.allclose(v, got[i % 10]) for i, v in crowded.items())
    with pytest.raises(Exception, match="larger than size"):
        E.embed_blocks(patches, tiles, E.channel_means, size=4).collect()


def quarters_embedder():
    def quarters(images):
        """Four tokens a patch: channel means of its quarters."""
        h, w = images.shape[2] // 2, images.shape[3] // 2
        return np.stack([images[:, :, y : y + h, x : x + w].mean(axis=(2, 3)) for y in (0, h) for x in (0, w)], axis=1)

    return quarters


def test_tokens_maps_and_saliency(spark, slide):
    image, tiles = slide
    quarters = quarters_embedder()
    patches = spark.createDataFrame([("a", i, 16 * i, 16, 16 * i + 16, 32) for i in range(4)], "image string, row_idx long, xmin long, ymin long, xmax long, ymax long")
    centres = [[110.0, 120.0, 130.0], [135.0, 130.0, 120.0]]
    model = FrequencyRankedKMeans(k=2, normalise=False, centroids=centres)
    clusters = TokenClusters(model, grid=2)
    got = {(r.row_idx, r.y, r.x): r.v for r in E.token_maps(patches, tiles, quarters, clusters, size=16).collect()}
    for i in range(4):
        tokens = quarters(crop(image, 16 * i, 16, 16 * i + 16, 32)[None])[0]
        for k, t in enumerate(tokens):
            assert got[i, k // 2, k % 2] == np.argmin([((t - c) ** 2).sum() for c in np.array(centres)])
    tokens = E.embed_blocks(patches, tiles, quarters, size=16, tokens=True).select("row_idx", "position", "vec")
    other = TokenClusters(FrequencyRankedKMeans(k=2, normalise=False, centroids=centres[::-1]), grid=2)
    maps = E.saliency_maps(tokens, [clusters, other], 4, 4).collect()
    assert len(maps) == 4 * 2 * 16
    for r in maps:
        own = got[r.row_idx, r.y // 2, r.x // 2]
        assert r.v == (own if r.k == 0 else 1 - own)
    with pytest.raises(ValueError):
        E.saliency_maps(tokens, [], 4, 4)
    with pytest.raises(ValueError):
        E.saliency_maps([tokens], [clusters, other], 4, 4)


def test_dispatch_and_container(spark, slide, tmp_path):
    _, tiles = slide
    c = IO.Container(spark).add_image("slide", "HnE", "/x", tiles)
    c.elements["p"] = spark.createDataFrame([("a", i, 5 * i, 8, 5 * i + 16, 24) for i in range(12)], "image string, row_idx long, xmin long, ymin long, xmax long, ymax long")
    first = E.embed_patch(c, "p", "channel_means", image="slide", size=16)
    assert E.embed_patch(c, "p", "channel_means", image="slide", size=16) is first and first.count() == 12
    assert E.embed_patch(c, "p", "channel_means", image="slide", size=16, overwrite=True) is not first
    rows = first.select("row_idx", "vec")
    c.add_model("km", FrequencyRankedKMeans(k=3).fit(rows)).add_model("sae", SparseAutoencoder(expansion=1, steps=5, batch=4).fit(rows))
    labelled = E.embed_patch(c, "p", "km", source="channel_means_embedding")
    assert {"km_label", "km_label_0", "km_label_1", "km_label_2"} <= set(labelled.columns)
    assert all(r[f"km_label_{r.km_label}"] == 1 and sum(r[f"km_label_{i}"] for i in range(3)) == 1 for r in labelled.collect())
    assert len(E.embed_patch(c, "p", "km", source="channel_means_embedding", overwrite=True).columns) == len(labelled.columns)
    c.elements["p.features"] = spark.createDataFrame([(0, "sae_0", 9.0), (0, "other", 1.0), (1, "sae_5", 7.0)], "row_idx long, name string, score double")
    some = E.embed_patch(c, "p", "sae", source="channel_means_embedding", keep=[0, 2])
    got = {(r.row_idx, r.name): r.score for r in some.collect()}
    assert got[0, "other"] == 1.0 and got[1, "sae_5"] == 7.0 and got.get((0, "sae_0")) != 9.0
    want = {(r.row_idx, f"sae_{r.feature}"): r.score for r in c.loaded["sae"].transform(rows, [0, 2]).collect()}
    assert {k: v for k, v in got.items() if k[1] in ("sae_0", "sae_2")} == want
    with pytest.raises(ValueError):
        E.embed_patch(c, "p", "nobody")
    path = str(tmp_path / "c")
    c.elements = {k: v for k, v in c.elements.items() if k in ("slide", "p")}
    c.write(path)
    back = IO.Container.read(spark, path)
    assert set(back.elements) == {"slide", "p"} and set(back.loaded) == {"km", "sae"}
    assert back.loaded["km"].centroids == c.loaded["km"].centroids
    assert sorted(map(tuple, back.loaded["sae"].transform(rows).collect())) == sorted(map(tuple, c.loaded["sae"].transform(rows).collect()))
    E.embed_patch(back, "p", "km", source="none", save_to=path)  # there already
    assert back.elements["p"].count() == 12 and not [p.name for p in (tmp_path / "c").iterdir() if p.name.endswith(".old")]


def test_pyramid_round_trip(spark, slide, tmp_path):
    image, tiles = slide
    path = str(tmp_path / "pyramid")
    pixels = W.untiled(tiles, 3).select("c", "y", "x", "v")
    W.write_pyramid(pixels, path, 70, 90, 3, tile=32, names=["r", "g", "b"], microns=0.5)
    got, about = W.read_pyramid(spark, path)
    assert about["levels"] == 3 and about["names"] == ["r", "g", "b"]
    back = W.untiled(got, 3, by=("level",)).collect()
    levels = [image.astype(int)]
    for _ in range(2):
        a = np.pad(levels[-1], ((0, 0), (0, levels[-1].shape[1] % 2), (0, levels[-1].shape[2] % 2)))
        levels.append(np.rint(a.reshape(3, a.shape[1] // 2, 2, a.shape[2] // 2, 2).sum(axis=(2, 4)) / 4).astype(int))
    assert len(back) == sum(a.size for a in levels)
    assert all(levels[r.level][r.c, r.y, r.x] == r.v for r in back)
    with pytest.raises(Exception, match="(?i)exist"):
        W.write_pyramid(pixels, path, 70, 90, 3, tile=32)
    for bad in ({"tile": 30}, {"bits": 32}, {"names": ["r"]}):
        with pytest.raises(ValueError):
            W.write_pyramid(pixels, path + "2", 70, 90, 3, **{"tile": 32, **bad})


def test_training_set_and_roi_mask(spark, tmp_path):
    schema = "id long, c int, h int, w int, data array<int>"
    images = spark.createDataFrame([(i, 2, 2, 3, list(range(12))) for i in range(3)], schema)
    masks = spark.createDataFrame([(i, 1, 2, 3, [0, 1, 0, 1, 1, 0]) for i in range(3)], schema)
    assert W.write_training_set(images, masks, str(tmp_path / "t")) == 3 and spark.read.parquet(str(tmp_path / "t")).count() == 3
    for bad in (masks.withColumn("c", F.lit(2)), masks.withColumn("w", F.lit(4)), masks.where("id < 2"), masks.withColumn("data", F.slice("data", 1, 2))):
        with pytest.raises(ValueError):
            W.write_training_set(images, bad, str(tmp_path / "u"))
    (tmp_path / "r.csv").write_text('SizeX,SizeY,Points\n40,30,"2,2 20,2 20,12 2,12"\n40,30,"10,6 30,6 30,25 10,25"\n')
    rois = IO.read_rois_csv(spark, str(tmp_path / "r.csv"), (30, 40))
    W.write_roi_mask(rois, str(tmp_path / "m"), 30, 40, tile=16)
    got, about = W.read_pyramid(spark, str(tmp_path / "m"))
    base = np.zeros((30, 40), int)
    base[2:12, 2:20], base[6:25, 10:30] = 1, 2
    for r in W.untiled(got.where("level = 0"), 1, 2).collect():
        assert base[r.y, r.x] == r.v
    assert about["levels"] == 3
    with pytest.raises(ValueError):
        IO.read_rois_csv(spark, str(tmp_path / "r.csv"), (30, 41))


def test_registration(spark, tmp_path):
    path = str(tmp_path / "bundle")
    spark.createDataFrame([(0, 2.0, 0.0, 1.0), (1, 0.0, 2.0, -1.0)], "row long, a double, b double, c double").write.parquet(path + "/affine")
    spark.createDataFrame([(y, x, 0.5 * x, 0.25 * y) for y in range(10) for x in range(20)], "y long, x long, dx double, dy double").write.parquet(path + "/field")
    tiles = lambda h, w: spark.createDataFrame([(0, 0, h, w)], "y long, x long, h long, w long")
    r = W.Registration.read(spark, path, tiles(100, 200), tiles(120, 180))
    assert repr(r) == "Registration(source 100 x 200, target 120 x 180, field 10 x 20)" and r.pad_source == (10, 0) and r.pad_target == (0, 10)
    got = r.transform(spark.createDataFrame([(1, 50.0, 60.0)], "id long, x double, y double")).first()
    px, py = 50 / 10, (60 - 10) / 10
    x, y = ((px * 1.5 - 1) / 2, (py * 1.25 + 1) / 2)
    assert (got.x, got.y) == pytest.approx((x * 10 - 10, y * 10))


def test_small_things(spark):
    assert W.tile_side(5000, 4000) == 1024 and W.tile_side(700, 900) == 512 and W.tile_side(1, 9) == 1 and W.chunk_size(3, 10, 20) == (3, 20, 40)
    assert W.format_shape((3, 4)) == "3 x 4"
    text = spark.createDataFrame([("a\x00b\x0bc\td￾e\U0001f642",)], "t string").select(W.xml_safe(F.col("t")).alias("t")).first().t
    assert text == "abc\tde\U0001f642"
    px = spark.createDataFrame([(k, 0, 0, 0, k) for k in range(4)], "c long, level long, y long, x long, v long")
    assert [r.channel for r in W.named_channels(px, "HnE").orderBy("c").collect()] == ["r", "g", "b"]
    assert [r.channel for r in W.named_channels(px, "mIF").orderBy("c").collect()] == ["c0", "c1", "c2", "c3"]
    assert W.named_channels(px, "mono").count() == 1 and W.channel_view(px, 2).first().v == 2
    assert W.preloaded(px, [0]).count() == 4
    with pytest.raises(ValueError):
        W.named_channels(px, "other")


def test_slides_are_sampled_by_group(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    step = lambda df: df.select("image", "x", "y", (F.col("x") > 13).cast("long").alias("label"))
    patches = step(spark.createDataFrame([("a", x, y) for x in range(4, 25, 8) for y in (4, 12)], "image string, x long, y long")).selectExpr("image", "x - 4 AS xmin", "y - 4 AS ymin", "label", "x * 100 + y AS row_idx")
    out = E.sample_slides(patches, "label", step, 17, 25, [[1], [0]], initial=8, patch=8, least=[4, 8], threshold=0.05, most_epochs=2)
    rows = out.collect()
    assert len(rows) > patches.count() and all(r.label == (r.x > 13) for r in rows if r.label >= 0)
    with pytest.raises(ValueError):
        E.sample_slides(patches, "label", step, 17, 25, [[1], [0]], least=[4])


def test_labels_around_places(spark, slide):
    image, tiles = slide
    model = FrequencyRankedKMeans(k=2, normalise=False, centroids=[[100.0, 110.0, 120.0, 255, 255, 255], [0.0] * 6])
    places = spark.createDataFrame([("a", 40, 40), ("a", 2, 3), ("a", 500, 500)], "image string, x long, y long")
    got = {(r.x, r.y): r.label for r in E.coordinate_labeler(tiles, E.channel_means, model, patch=16)(places).collect()}
    assert got[500, 500] == 1 and got[40, 40] == 0 and (2, 3) in got
