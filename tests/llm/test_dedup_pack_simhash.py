import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessella.llm import exact_dedup, packing, simhash
from tessella.llm._components import connected_components

ROWS = [
    (1, "a b\tc", "x"), (2, "abc", "x"), (3, "ab c ", "x"), (4, "", "y"), (5, None, None), (6, " \n", "z"), (7, "other text", "z"), (7, "other text", "z"),
    (8, "word " * 30000, "long"), (9, "word  " * 30000, "long"), (None, "null id", "q"), (10, "é è", "u"), (11, "éè", "u"),
]
SCHEMA = "doc_id long, text string, kept string"


def brute(rows):
    groups = {}
    for at, (doc_id, text, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, at, doc_id))
    out = []
    for text, members in groups.items():
        first = min(members)
        out += [(m[4], first[4], len(members), m[3] == first[3], hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_composition():
    f = exact_dedup.Fingerprinter(chunk=16)
    data = bytes(np.random.default_rng(1).integers(0, 256, 1000, dtype=np.uint8))
    direct = [0, 0]
    for x in data:
        direct = [(h * b + x + 1) % m for h, b, m in zip(direct, exact_dedup.BASES, exact_dedup.MODULI)]
    assert f(data) == direct[0] << 31 | direct[1] == exact_dedup.Fingerprinter(chunk=64)(data)


@pytest.mark.parametrize("moduli", [exact_dedup.MODULI, (3, 2)])
def test_exact_dedup(spark, moduli):
    rows = ROWS + [(20 + i, f"pair {i % 7:02d} {i % 9:02d}", "p") for i in range(60)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), fingerprint=exact_dedup.Fingerprinter(moduli, 16)).collect()
    got = sorted([tuple(r) for r in got], key=str)
    want = brute(rows)
    # which of two wholly equal rows is kept is not told apart
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_exact_copies(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = exact_dedup.drop_exact_copies(spark, docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(x[0]) for x in brute(ROWS) if x[3])


def test_cached_ids_equal_tokenizers(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "\n", "a\n\nb", "a \nb", "a\n b", "a  b", "\ta b", "it's we'll I'd", "x y z", "日本語 テキスト 中文", "a\r\nb c", "tail ", "tail\n", "<|endoftext|> z", "a <|endoftext|> b", "x<|endoftext|>", "<|endof text|>", "12,5 ½ ² x", "é ü", "🙂 ok", "\x1c a", "a \x85b", "word" * 3000]
    encode = packing.public_encoder()
    for text in texts:
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("window", [1024, 7])
def test_pack(spark, window):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    pieces = packing.pack(docs, window=window).collect()
    encode = packing.public_encoder()
    whole = sorted((str(i), encode(t) + b"\0\0\0\0") for i, t, _ in ROWS)
    by_doc, stream = {}, {}
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.offset + p.length <= window
        stream[p.sequence_id, p.offset] = p.length
        by_doc.setdefault((str(p.doc_id), p.sequence_id * window + p.offset - p.start), []).append((p.start, bytes(p.ids)))
    got = sorted((k[0], b"".join(x for _, x in sorted(v))) for k, v in by_doc.items())
    assert got == whole
    at = 0
    for (sequence, offset), length in sorted(stream.items()):
        assert (sequence, offset) == divmod(at, window)
        at += length
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(range(len(prints)))
    values = np.array(prints, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = ids[i], ids[j]
            if a != b:
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


def test_golay_keys_cover_two_bits():
    code, rng = simhash.golay(), np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        other = words.copy()
        for k in range(flips):
            other ^= 1 << rng.integers(0, 23, 3000)
        a, b = code.keys(words), code.keys(other)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))
    filled = (code.errors >= 0).sum(axis=1)
    assert sorted(np.unique(filled).tolist()) == [1, 6] and (filled == 6).sum() == 1771


@pytest.mark.parametrize("block", [2048, 3])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [int(x) for x in base]
    for x in base[:20]:
        for _ in range(12):
            y = int(x)
            for bit in rng.integers(0, 64, rng.integers(1, 7)):
                y ^= 1 << int(bit)
            prints.append(y)
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    labels = connected_components(simhash.print_links(spark.createDataFrame([(x,) for x in signed], "print long"), block=block)).collect()
    root = {r.node: r.root for r in labels}
    want = brute_components(prints)
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(root.get(x, x))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_near_duplicates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (903, "ONE  two")], "doc_id long, text string")
    docs = docs.union(extra)
    rows = docs.collect()
    prints = [brute_print(r.text) for r in rows]
    groups = brute_components(prints)
    names = {g: min(r.doc_id for r, x in zip(rows, groups) if x == g) for g in set(groups)}
    want = sorted((r.doc_id, f"{p:016x}", names[g]) for r, p, g in zip(rows, prints, groups))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def jaccard(a, b):
    a, b = (set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def test_the_stage_finds_near_copies_and_leaves_others(spark):
    """Copies with some words changed: over a similarity of 0.8 in five-word shingles at least 0.8 of them go, over 0.9 nearly all."""
    rng = np.random.default_rng(4)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text and 150 < len(set(r.text.split())) < 3000]
    seen, plain = set(), []
    for t in texts:  # documents that share no shingle with an earlier one
        own = set(zip(*(t.lower().split()[i:] for i in range(5))))
        if not own & seen:
            plain.append(t)
        seen |= own
    rows, planted = [(i, t) for i, t in enumerate(plain)], {}
    for k, t in enumerate(plain * 2):
        words = t.split(" ")
        for at in rng.integers(0, len(words), max(1, round(len(words) * rng.uniform(0.002, 0.024)))):
            words[at] = f"changed{rng.integers(1000)}"
        rows.append((1000 + k, " ".join(words)))
        planted[1000 + k] = jaccard(t, rows[-1][1])
    left = {r.doc_id for r in simhash.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(plain) > 50 and set(range(len(plain))) <= left
    found = lambda least, most: [i not in left for i, j in planted.items() if least <= j < most]
    near, closer = found(0.8, 0.9), found(0.9, 2)
    print(len(near), np.mean(near), len(closer), np.mean(closer))
    assert len(near) > 15 and np.mean(near) >= 0.75 and len(closer) > 15 and np.mean(closer) >= 0.95


def test_near_copies_with_shared_and_missing_ids(spark):
    """Rows that share an id, or have none, are judged by their own text."""
    copy, alone, other = "a b c d e f g h", "nothing like it at all in here", "some third text of its own"
    rows = [(3, copy), (7, copy), (7, alone), (None, copy), (None, other), (None, other), (9, "x"), (9, "x"), (11, None)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, first string")
    left = simhash.drop_near_copies(spark, docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(3, copy), (7, alone), (None, other), (9, "x"), (11, None)], key=str)
    assert simhash.drop_near_copies(spark, docs.limit(0)).count() == 0


def test_exact_copies_with_one_id(spark):
    """The longest text stays, not any."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a  b"), (1, "ab"), (2, "c"), (2, "c"), (None, "d"), (None, "d ")], "doc_id long, text string")
    left = exact_dedup.drop_exact_copies(spark, docs)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, "a  b"), (2, "c"), (None, "d ")], key=str)
