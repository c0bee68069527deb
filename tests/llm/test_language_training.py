import numpy as np

from tessella.llm import language_id

WORDS = {"aa": "lorem ipsum dolor sit amet consectetur ", "zy": "qwx zzk vvq jjx kqz xxw ", "zz": "ощё раз это слово "}


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_label_is_learned(spark):
    rows = [(70 * n + k, f"word{k:02d} " * 12, f"l{k:02d}") for k in range(70) for n in range(6)]
    net = language_id.train(rows_of(spark, rows), sample_docs=2, epochs=1)
    assert net.labels == [f"l{k:02d}" for k in range(70)]
    _, _, labels = language_id.training_windows(rows_of(spark, rows), 5, 0, 2, 4, "doc_id", "text", "lang", window_budget=140)
    assert max(labels.count(x) for x in set(labels)) == 2 and len(set(labels)) == 70


def test_languages_of_short_texts_are_learned(spark):
    rows = [(i, (WORDS["aa"] * 8)[i % 7 :], "aa") for i in range(60)] + [(100 + i, WORDS["zy"][i % 5 :], "zy") for i in range(60)] + [(200 + i, (WORDS["zz"] * 8)[i % 7 :], "zz") for i in range(60)]
    net = language_id.train(rows_of(spark, rows), sample_docs=40)
    found = language_id.pooled([WORDS["zy"], "qwx zzk", WORDS["aa"], WORDS["zz"], WORDS["aa"] * 5], net)
    assert [f[0] for f in found] == ["zy", "zy", "aa", "zz", "aa"]


def test_repeated_rows_take_no_other_language_s_windows(spark):
    rows = [(1 + i, WORDS["aa"] * (2 + i), "aa") for i in range(6)] * 500 + [(50 + i, WORDS["zz"] * 4, "zz") for i in range(9)]
    data, used, labels = language_id.training_windows(rows_of(spark, rows), 5, 0, 2, 4, "doc_id", "text", "lang")
    assert labels == ["aa"] * 8 + ["zz"] * 8 and data.shape == (16, language_id.WIDTH) and (used > 0).all()


def test_padding_has_no_slope():
    net = language_id.Network(["a", "b"])
    data = np.frombuffer(b"abc" + b" " * 61, dtype=np.uint8).reshape(1, -1)
    gold, weight = np.array([1]), np.array([1.0])
    before, slopes = net.slopes(data, gold, weight, np.array([3]))
    net.p["w"][3, 1] += 1e-5
    after, _ = net.slopes(data, gold, weight, np.array([3]))
    assert abs((after - before) / 1e-5 - slopes["w"][3, 1]) < 1e-4
    assert before != net.slopes(data, gold, weight)[0]
