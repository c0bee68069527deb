"""Registered queries that read whole tables: rows outside any id range count."""

import numpy as np

from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_event_is_painted(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").collect()
    want = {}
    for i, value in events:
        cx, cy = round(i * 37 % 900 / 16), round(i * 91 % 700 / 16)
        for y in range(max(cy - 3, 0), min(cy + 3, 49)):
            for x in range(max(cx - 3, 0), min(cx + 3, 59)):
                want[y, x] = max(want.get((y, x), value), value)
    got = {(r.y, r.x): r.v for r in catalogue.QUERIES["patch_max_raster_whole"](spark, SF).collect()}
    assert len(got) == 50 * 60 and got == {k: want.get(k, 0.0) for k in got}


def test_distances_count_every_embedding(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "embedding").collect()
    names = sorted({r.label for r in rows})
    means = np.stack([np.mean([r.embedding for r in rows if r.label == k], axis=0) for k in names])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    got = {(r.i, r.j): r.distance for r in catalogue.QUERIES["cosine_distances_labels"](spark, SF).collect()}
    assert got.keys() == {(i, j) for j in range(len(names)) for i in range(j)}
    assert all(abs(got[i, j] - (1 - means[i] @ means[j])) < 2e-6 for i, j in got)


def test_union_keeps_every_row(spark):
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    got = [(r.row_idx, r.extra) for r in catalogue.QUERIES["union_tables_whole"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted([(i, None) for i in ids] + [(i, 2 * i) for i in ids], key=str)
