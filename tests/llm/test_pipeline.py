import re

import corpus_pipeline
from tessella.llm import packing, quality, secrets, simhash

SF = "/root/testdata/sf0.001"


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "too short", None), (None, "w " * 50, "b"), (4, " ".join(f"word{i}" for i in range(60)), "b"), (4, " ".join(f"word{i}" for i in range(60)), "b"),
    (None, " ".join(f"null{i}" for i in range(40)), None), (None, " ".join(f"null{i}" for i in range(40)), None), (5, " ".join(f"word{i}" for i in range(60)) + " ", "c"), (6, "x" * 200_000 + " y" * 10 + " ".join(f"long{i}" for i in range(30000)), "c"),
    (7, " ".join(f"key{i}" for i in range(30)) + " password=Abcdefgh12345678", "c"),
]
CLASHING = "host own_sha gone_id gone_sha number __host __gone __sha __text_sha __gone_sha __k print first node HOST_ key several text_sha256 keep_id kept".split()


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in ROWS], "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHING))
    for name, function in corpus_pipeline.STAGES[:-1]:
        left = function(spark, docs, None)
        assert left.columns == docs.columns, name
        assert function(spark, docs.limit(0), None).count() == 0, name
        for r in left.collect():
            assert [r[c] for c in CLASHING] == list(range(len(CLASHING)))
        docs = spark.createDataFrame(left.collect(), docs.schema)
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in docs.collect()), key=str) == sorted([(5, "word0"), (None, "null0"), (6, "xxxxx"), (7, "key0 ")], key=str)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, None)
    assert {p.doc_id for p in pieces.collect()} == {5, None, 6, 7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), None).count() == 0


def test_quality_without_a_source(spark):
    docs = spark.createDataFrame([(1, "w x y z " * 3), (2, " ".join(f"a{i}" for i in range(30)))], "doc_id long, text string")
    assert [r.doc_id for r in quality.drop_low_quality(spark, docs).collect()] == [2]


def test_pipeline_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fails, hosts = {}, {}
    for r in rows:
        m = quality.measure(r.text)
        fails[r.doc_id] = quality.base_fails(m[0], m[4])
        n, f = hosts.get(r.source, (0, 0))
        hosts[r.source] = n + 1, f + quality.rule_fails(m[0], m[2], m[3], m[4], m[5])
    total, bad = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    mean = bad / total
    spread = max(sum(f * f / n for n, f in hosts.values()) / total - mean * mean, 0)
    strength = min(max(mean * (1 - mean) / spread - 1, 2), 1000) if spread else 1000
    rejected = {h for h, (n, f) in hosts.items() if (f + mean * strength) / (n + strength) > 0.5}
    kept = [r for r in rows if not fails[r.doc_id] and r.source not in rejected]
    first = {}
    for r in sorted(kept, key=lambda r: (-len(r.text), r.doc_id)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), r)
    kept = sorted(first.values(), key=lambda r: r.doc_id)
    prints = [simhash.wide_fingerprint(r.text) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sum((x ^ y).bit_count() for x, y in zip(prints[i], prints[j])) <= simhash.WIDE_DISTANCE:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    pieces = corpus_pipeline.run(spark, SF).collect()
    left = {p.doc_id for p in pieces}
    # no document goes that has no near copy, each group keeps its first, and pairs without a common key are few
    first_of_group = {r.doc_id for i, r in enumerate(kept) if group[i] == i}
    assert first_of_group <= left <= {r.doc_id for r in kept} and len(left) <= 1.03 * len(first_of_group)
    kept = [r for r in kept if r.doc_id in left]
    encode = packing.public_encoder()
    want = {r.doc_id: len(encode(secrets.redacted(r.text))) // 4 + 1 for r in kept}
    assert {p.doc_id: p.doc_tokens for p in pieces} == want
    assert sum(p.length for p in pieces) == sum(want.values())
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 1024 + p.offset == at
        at += p.length
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
