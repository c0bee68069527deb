"""Every operator with nulls, repeated rows, a very long text, columns of clashing names, and an empty table."""

import struct

import numpy as np
import pytest
import zstandard

from tessella.llm import exact_dedup, katz, language_id, packing, pii, quality, secrets, sentencepiece_codec, simhash, url_filter

LONG = "word " * 60_000 + "é" * 70_000 + "\n" + "x" * 150_000
ROWS = [(1, "plain text here", "en"), (1, "plain text here", "en"), (2, None, None), (3, "", "en"), (None, "null id text", "fr"), (4, LONG, "en"), (5, " \n\t ", "fr"), (None, None, None)]
CLASH = "page_id url ids words body chunk kind shard key print first more node part local_start doc_tokens held_out score spans base_sha256 n_added host kept n_words parity round_trip label order mark n at bound whole size several row_no length".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", *range(len(CLASH))) for r in ROWS], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASH))


OPERATORS = {
    "pii": pii.detect,
    "katz": lambda d: katz.katz_scores(d)[0],
    "packing": packing.pack,
    "language": lambda d: language_id.predict(d, language_id.train(d, folds=10**6, epochs=1)),
    "exact": exact_dedup.exact_dedup,
    "secrets": secrets.scan,
    "quality": quality.judge,
    "simhash": simhash.near_duplicates,
    "sentencepiece": sentencepiece_codec.encode,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    rows = OPERATORS[name](docs).collect()
    plain = OPERATORS[name](docs.select("doc_id", "text", "lang", "source")).collect()
    if name == "packing":
        assert sum(r.length for r in rows if r.start == 0) <= sum(r.length for r in rows)
        assert sorted({r.doc_id for r in rows if r.doc_id}) == [1, 2, 3, 4, 5] and sum(r.start == 0 for r in rows) == len(ROWS)
    else:
        assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in ROWS), key=str)
        hide = {"sequence_id", "offset"}
        show = lambda rs: sorted(str([r[c] for c in r.__fields__ if c not in hide]) for r in rs)
        assert show(rows) == show(plain)
    twice = [r for r in rows if r.doc_id == 1]
    assert len(twice) == 2
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://www.example.com/en/" + "a" * 200_000), (2, None), (2, None), (3, ""), (4, "x://"), (None, "https://a.net/fr/x")]
    pages = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], "page_id long, url string, key int, host string, size int, host_size int, verdict string")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect() if r.page_id != 2)
    assert got == [("1", "www.example.com/en/", "allow"), ("3", None, "allow"), ("4", None, "allow"), ("None", "net/fr/", "block")]
    assert url_filter.judge_urls(pages).count() == 6 and url_filter.judge_urls(pages.limit(0)).count() == 0


def test_katz_tables_are_normalised(spark):
    """What the staged tables give each context sums to one over all known words and the unknown class."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, model = katz.katz_scores(frame, chunk_bytes=30_000)
    counts = {katz.BEGIN: model.n_docs, katz.END: model.n_docs}
    for r in model.words.where("kind = 'model'").collect():
        (size,) = struct.unpack_from("<q", r.body)
        ids, n = katz.unpack(bytes(r.body[8 + size :]))
        assert len(zstandard.decompress(bytes(r.body[8 : 8 + size])).split()) == len(ids)
        counts |= dict(zip(ids.tolist(), n.tolist()))
    seen: dict[int, dict[int, int]] = {}
    facts: dict[int, np.ndarray] = {}
    for r in model.pairs.where("kind = 'model'").collect():
        names, sizes, second, totals, *more = katz.unpack(bytes(r.body))
        at = 0
        for k, (name, size) in enumerate(zip(names.tolist(), sizes.astype(int).tolist())):
            seen.setdefault(name, {}).update(zip(second[at : at + size].tolist(), totals[at : at + size].tolist()))
            facts[name] = facts.get(name, 0) + np.array([float(f[k]) for f in more])
            at += size
    known = np.array([n for i, n in counts.items() if n and i != katz.BEGIN])
    unknown = model.unigram.probability(np.array([0]))[0]
    assert model.unigram.probability(known).sum() + unknown == pytest.approx(1)
    tried = 0
    for name, pairs in seen.items():
        if not counts.get(name) or not any(pairs.values()):
            continue
        weight, divisor = (x[0] for x in katz.backoff([np.array([f]) for f in facts[name]], np.array([float(counts[name])]), model.d))
        with_count = {w: n for w, n in pairs.items() if n}
        mass = katz.discounted(np.array(list(with_count.values())), model.d).sum() / divisor
        below = model.unigram.probability(np.array([counts[w] for w in with_count])).sum()
        assert mass + weight * (1 - below) == pytest.approx(1)
        tried += 1
    assert tried > 100


def test_fast_steps_equal_plain_ones():
    net = language_id.Network(["a", "b", "c"], seed=4)
    rng = np.random.default_rng(3)
    for p in net.p.values():
        p += rng.normal(0, 0.3, p.shape)
    data = rng.integers(0, 256, (5, 64)).astype(np.uint8)
    logits = net.run(data)[0]
    share = np.exp(logits - logits.max(axis=2, keepdims=True))
    share /= share.sum(axis=2, keepdims=True)
    assert np.allclose(net.stepped(data).transpose(1, 2, 0), share)
