import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessella.llm import katz

SF = "/root/testdata/sf0.001"


def brute(rows, folds=5, held=1):
    """Katz scores with plain dictionaries."""
    docs = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % folds == held, [*words, None]))
    uni, pair, context = Counter(), Counter(), defaultdict(dict)
    for _, out, tokens in docs:
        if not out:
            uni.update(tokens)
            pair.update(zip([1, *tokens[:-1]], tokens))
    for (a, b), r in pair.items():
        context[a][b] = r
    low = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.TOP + 2)]
    d1, d2 = katz.discounts(low(uni)), katz.discounts(low(pair))
    n = sum(uni.values())
    disc = lambda r, d: r * d[r] if r <= katz.TOP else r
    mass = sum(disc(r, d1) for r in uni.values())
    m = n if mass < n else n + 1
    p1 = lambda w: disc(uni[w], d1) / m if uni.get(w) else 1 - mass / m
    cached = {}

    def of(a):
        if a not in cached:
            seen = context[a]
            total, kept = sum(seen.values()), sum(disc(r, d2) for r in seen.values())
            div = total + (kept >= total * (1 - 1e-12))
            cached[a] = (1 - kept / div) / (1 - sum(p1(w) for w in seen)), div
        return cached[a]

    def p2(a, w):
        if a not in context:
            return p1(w)
        alpha, div = of(a)
        return disc(context[a][w], d2) / div if w in context[a] else alpha * p1(w)

    out = {}
    for i, held_out, tokens in docs:
        base = sum(math.log10((uni.get(t, 0) + 0.5) / (n + 0.5 * (len(uni) + 1))) for t in tokens)
        score = sum(math.log10(p2(a, b)) for a, b in zip([1, *tokens[:-1]], tokens))
        out.setdefault(i, (held_out, len(tokens), sum(t in uni for t in tokens), n, base, score))
    return out, p1, p2, uni, context


@pytest.mark.parametrize("chunk_bytes", [1 << 23, 20000])
def test_katz_equals_brute_force(spark, chunk_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(901, None), (902, ""), (903, "never seen words zzzz"), (904, "the " * 50000), (None, "null id")], "doc_id long, text string")
    docs = docs.union(extra).selectExpr("*", "'x' AS chunk", "'y' AS ids")
    want, *_ = brute([(r.doc_id, r.text) for r in docs.collect()])
    scores, _ = katz.katz_scores(docs, chunk_bytes=chunk_bytes)
    got = {r.doc_id: tuple(r[1:]) for r in scores.collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4] == pytest.approx(w[4], rel=1e-9) and got[i][5] == pytest.approx(w[5], rel=1e-9), i


def test_probabilities_sum_to_one(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _, p1, p2, uni, context = brute(rows)
    for a in [1, *list(context)[:20], "zzzz never"]:
        assert sum(p2(a, w) for w in uni) + p2(a, "zzzz never") == pytest.approx(1)
    # the corpus model is better than the base on held-out text
    scores = katz.katz_scores(spark.read.parquet(f"{SF}/documents.parquet"))[0].where("held_out").groupBy().sum("base_score", "score").first()
    assert scores[1] > scores[0]


def test_katz_small(spark):
    one = katz.katz_scores(spark.createDataFrame([(None, None)], "doc_id long, text string"))[0].collect()
    assert len(one) == 1 and one[0].n_tokens == 1
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    held_id = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    none = katz.katz_scores(spark.createDataFrame([(held_id, "a b")], "doc_id long, text string"))[0].collect()
    assert none[0].score == 0 and none[0].base_score == 0
