import random

from pyspark.sql import functions as F

from tessella.operators import selection


def test_a_hot_tied_score_is_split_and_ranked(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i, 5.0 if rng.random() < 0.6 else float(rng.randint(0, 12))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "table_name string, row_idx long, score double")
    order = sorted((r for r in rows if r[2] > 0), key=lambda r: (-r[2], r[0], r[1]))
    got = selection.top_rows(frame, min_score=0.0, take_every=7).orderBy("_feature_rank").collect()
    assert [(r.table_name, r.row_idx, r.score) for r in got] == order[::7]
    keys = selection.tie_ranges(frame, "score")
    largest = frame.withColumns(dict(keys)).groupBy([n for n, _ in keys]).count().agg(F.max("count")).first()[0]
    assert largest < 300  # of 1,800 tied rows and more
