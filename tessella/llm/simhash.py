"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints are 64 majority bits of the XXH64 hashes of four-word shingles. A fingerprint is read as three
segments of 23, 23 and 18 bits (the last one padded with zeros to 23). The perfect binary Golay code puts every
23-bit word within three bits of exactly one of 4096 codewords, and a word three bits away from it is also
within four bits of five others; the indices of all codewords within four bits, one or six, are the segment's
keys. Two words at most two bits apart always share one: the codeword nearest to a word between them is within
four bits of both. With four differing bits in all, at most one of the three segments can have three or more,
so two fingerprints that link share keys in two segments: the keys that are joined are pairs of segment keys.

Equal fingerprints are merged first, candidates are verified by their Hamming distance, a bucket gives a
spanning forest of its links and never all its pairs, and components come from alternating star contractions.
Of a bucket that is larger than one block, pairs of blocks are compared in tasks dealt by (key, block).

A wide fingerprint has a second word of 64 bits, from the same shingles under another seed: keys come from the
first word, verification takes both. The pipeline's stage uses it with five-word shingles and ``WIDE_DISTANCE`` of
128 bits, which stands for a Jaccard similarity of 0.8: shingle sets of similarity J have fingerprints that differ
in a share acos(2J / (1 + J)) / pi of their bits. Keys of pairs over four bits apart are shared by chance: 0.96 of
them at 7 bits, 0.82 at 9, 0.51 at 12.

Defined results: null and empty texts, and texts without words, have fingerprint zero, which links like any
other; fewer than four words make one shingle; repeated rows and ties share a component; null ids are never
a component's name unless all its ids are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, arrow_rows, documents, fresh, map_columns, release_shuffles, small_batches, stage
from ._components import UnionFind, connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # (shift, bits)
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, fixed by the code
BLOCK = 2048
#: Pair keys of a fingerprint, about, and of a task.
KEYS_OF_PRINT, TASK_KEYS = 85, 4_000_000


#: Differing bits of 128 that link two wide fingerprints: 19.4 are expected at a similarity of 0.8, 64 of unrelated texts.
WIDE_DISTANCE, WIDE_SHINGLE, MORE_SEED = 24, 5, 43
MIX = np.uint64(0x9E3779B97F4A7C15)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def shingled(text: str | None, k: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(k)))] if len(words) > k else [b" ".join(words)] if words else []


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    shingles = shingled(text, words_per_shingle)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))) if shingles else 0


def wide_fingerprint(text: str | None, words_per_shingle: int = WIDE_SHINGLE) -> tuple[int, int]:
    """Two words of majority bits over the distinct shingles."""
    shingles = set(shingled(text, words_per_shingle))
    digest = xxhash.xxh64_intdigest
    first, more = (majority(np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64, count=len(shingles))) if shingles else 0 for seed in (SEED, MORE_SEED))
    return first, more


def ids_of(prints: np.ndarray) -> np.ndarray:
    """One signed number for each row of words: the fingerprint itself where it has one word."""
    out = prints[:, 0].copy()
    for i in range(1, prints.shape[1]):
        out ^= prints[:, i] * MIX
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", wide: bool = False) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long); wide ones have ``more``, ``node`` and the text's SHA-256 too."""

    def batch(columns: dict) -> dict:
        if not wide:
            return {"doc_id": columns["doc_id"], "print": np.array([fingerprint(t) for t in columns["text"]], dtype=np.uint64).view(np.int64)}
        prints = np.array([wide_fingerprint(t) for t in columns["text"]], dtype=np.uint64).reshape(-1, 2)
        sha = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "print": prints[:, 0].copy().view(np.int64), "more": prints[:, 1].copy().view(np.int64), "node": ids_of(prints), "text_sha256": sha}

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_columns(rows, batch, "doc_id long, print long" + ", more long, node long, text_sha256 string" * wide)


class Golay:
    """Keys of 23-bit words: indices of the codewords within four bits."""

    def __init__(self):
        steps = []
        for i in range(23):
            word = 1 << i
            for bit in range(i, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            steps.append(word)
        self.syndrome = np.zeros(1 << 23, dtype=np.uint16)
        for i, s in enumerate(steps):
            self.syndrome[1 << i : 2 << i] = self.syndrome[: 1 << i] ^ np.uint16(s)
        self.errors = np.full((2048, 6), -1, dtype=np.int64)
        filled = np.zeros(2048, dtype=np.int64)
        for weight in range(5):
            for at in combinations(range(23), weight):
                error = sum(1 << i for i in at)
                s = int(self.syndrome[error])
                if weight < 4 or self.errors[s, 0].item().bit_count() == 3:
                    self.errors[s, filled[s]] = error
                    filled[s] += 1

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices, -1 where a word has one key only."""
        errors = self.errors[self.syndrome[words]]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def pair_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every pair key of uint64 fingerprints."""
    code = golay()
    segments = [code.keys((prints >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)) for shift, bits in SEGMENTS]
    rows, keys = [], []
    for number, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        both = (segments[a][:, :, None] << 12) | segments[b][:, None, :]
        usable = (segments[a][:, :, None] >= 0) & (segments[b][:, None, :] >= 0)
        at = np.nonzero(usable)
        rows.append(at[0])
        keys.append(both[at] | (number << 24))
    return np.concatenate(rows), np.concatenate(keys)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, their words along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) if a.shape[-1] > 1 else np.bitwise_count(a[..., 0] ^ b[..., 0])


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two blocks of fingerprints that differ in at most ``distance`` bits."""
    found = []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(differing(a[at : at + 512, None], b[None, :]) <= distance)
        found.append((i + at, j))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block_no", pa.int64()), ("block", pa.binary())])


def _edge_batch(a: list, b: list) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=EDGES)


def bucket_links(batches: Iterator[pa.RecordBatch], distance: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, words of a fingerprint) sorted by key in; links and, of buckets over one block, the blocks out.

    Runs that lie within a batch are compared all at once by their distance in the sorted order; a run that
    reaches a batch's end is carried over, and cut into blocks of bounded size.
    """
    joined = UnionFind()

    def links(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = joined.add(ids_of(a).tolist(), ids_of(b).tolist())
        if new:
            yield _edge_batch([x[0] for x in new], [x[1] for x in new])

    def within(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All runs of a sorted piece; long ones as one matrix."""
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        for s, e in zip(starts[ends - starts > 32].tolist(), ends[ends - starts > 32].tolist()):
            i, j = close_pairs(prints[s:e], prints[s:e], distance)
            i, j = i[i < j], j[i < j]
            yield from links(prints[s:e][i], prints[s:e][j])
        size = np.repeat(ends - starts, ends - starts)
        keys, prints = keys[size <= 32], prints[size <= 32]
        for step in range(1, 32):
            same = keys[step:] == keys[:-step]
            if not same.any():
                break
            a, b = prints[step:][same], prints[:-step][same]
            near = differing(a, b) <= distance
            yield from links(a[near], b[near])

    def whole(key: int, number: int, prints: np.ndarray, alone: bool) -> Iterator[pa.RecordBatch]:
        if len(prints) > 1:
            yield from within(np.full(len(prints), key), prints)
        if not alone:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([number], pa.int64()), pa.array([prints.tobytes()], pa.binary())], schema=EDGES)

    kept = np.zeros((0, 1), dtype=np.uint64)
    key, number = None, 0
    for batch in batches:
        keys = batch.column(0).to_numpy()
        prints = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)
        if not len(keys):
            continue
        if key is not None:
            n = int(np.searchsorted(keys, key, "right"))
            kept, keys, prints = np.concatenate([kept, prints[:n]]), keys[n:], prints[n:]
            while len(kept) > block:
                yield from whole(key, number, kept[:block], False)
                kept, number = kept[block:], number + 1
            if not len(keys):
                continue
            yield from whole(key, number, kept, not number)
        tail = int(np.searchsorted(keys, keys[-1], "left"))
        yield from within(keys[:tail], prints[:tail]) if tail else ()
        key, number, kept = int(keys[-1]), 0, prints[tail:]
        while len(kept) > block:
            yield from whole(key, number, kept[:block], False)
            kept, number = kept[block:], number + 1
    if key is not None:
        yield from whole(key, number, kept, not number)


def print_links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (print, or print and more) at most ``distance`` bits apart.

    Buckets are read in their keys' order and held block by block; tasks grow with the number of keys. The pairs of
    a large bucket's blocks are dealt to tasks by (key, block).
    """
    from pyspark.sql.types import StructType

    spark = prints.sparkSession
    words = [c for c in ("print", "more") if c in prints.columns]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                rows, keys = pair_keys(part[:, 0].copy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(part[rows, i]) for i in range(len(words)))], names=["key", *words])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count() * KEYS_OF_PRINT // TASK_KEYS)
    keys = prints.select(*words).mapInArrow(keyed, "key long, " + ", ".join(f"{w} long" for w in words))
    schema = StructType.fromDDL("a long, b long, key long, block_no long, block binary")
    found = keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda x: bucket_links(x, distance, block), schema)
    with arrow_rows(spark, 20000):
        found = stage(found, "simhash-links")
    blocks = found.where("key IS NOT NULL").select("key", "block_no", "block")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = (np.frombuffer(z, dtype=np.uint64).reshape(-1, len(words)) for z in (x, y))
                i, j = close_pairs(x, y, distance)
                new = UnionFind().add(ids_of(x[i]).tolist(), ids_of(y[j]).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in new], pa.int64()), pa.array([e[1] for e in new], pa.int64())], names=["a", "b"])

    small_batches(spark)
    # pairs of block numbers first: each block's partners are dealt by (key, block), not by the key alone
    last = blocks.groupBy("key").agg(F.max("block_no").alias("last"))
    numbers = last.select("key", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("x_no"), "last")
    numbers = numbers.select("key", "x_no", F.explode(F.sequence(F.col("x_no") + 1, F.col("last"))).alias("y_no"))
    x = blocks.select("key", F.col("block_no").alias("x_no"), F.col("block").alias("x"))
    y = blocks.select("key", F.col("block_no").alias("y_no"), F.col("block").alias("y"))
    more = numbers.join(x, ["key", "x_no"]).join(y, ["key", "y_no"]).select("x", "y").mapInArrow(across, "a long, b long")
    return found.where("key IS NULL").select("a", "b").unionByName(more).distinct()


def named_rows(rows: DataFrame, own, distance: int, block: int) -> DataFrame:
    """``rows`` (with print, or print, more and node) and ``first``: the smallest ``own``, an expression over a row, in each row's component."""
    spark = rows.sparkSession
    wide = "more" in rows.columns
    node = "node" if wide else "print"
    words = [F.first(c).alias(c) for c in ("print", "more")] if wide else []
    classes = stage(rows.groupBy(node).agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("size"), *words), "simhash-classes")
    labels = connected_components(print_links(classes, distance, block))
    release_shuffles(spark)
    linked = classes.select(node, "first").join(labels.withColumnRenamed("node", "__node"), F.col(node) == F.col("__node"))
    linked = linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select(node, "least")
    named = classes.select(node, "first", "size").join(linked, node, "left").where("size > 1 OR least IS NOT NULL")
    # a table of its own: the join is broadcast where it is small, else Spark may split a class that holds many rows
    named = stage(named.select(node, F.coalesce("least", "first").alias("first")), "simhash-names")
    small_batches(spark)
    joined = rows.join(named.withColumn("several", F.lit(True)), node, "left")
    return joined.withColumn("first", F.when(F.col("several"), F.col("first")).otherwise(own)).drop("several")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable by links)."""
    rows = stage(fingerprints(docs, id_column, text_column), "simhash-prints")
    named = named_rows(rows, F.col("doc_id"), distance, block)
    return named.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None, distance: int = WIDE_DISTANCE) -> DataFrame:
    """Pipeline stage: of each component one document stays, the one with the smallest id; columns as they came.

    Links follow wide fingerprints of five-word shingles. Documents are told apart by id and text, so rows that
    share an id, or have none, are judged each by its own component: null ids come after all others, equal ids are
    ordered by the text's SHA-256, and of repeated rows one stays. Null and empty texts are one component.
    """
    rows = stage(fingerprints(docs, wide=True), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    named = named_rows(rows, order, distance, BLOCK)
    named = stage(named.select("doc_id", "text_sha256", order.eqNullSafe(F.col("first")).alias("stays")), "simhash-named")
    own, gone_id, gone_sha = fresh(docs, "own_sha", "gone_id", "gone_sha")
    gone = named.where("NOT stays").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    left = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    kept = left.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_sha)), "left_anti")
    if named.where("stays").groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.drop(own)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
