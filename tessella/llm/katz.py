"""Katz backoff scoring with Good-Turing discounts (bigrams over unigrams over one unknown class).

Documents are split into words once and staged as compressed chunks of bounded size: a chunk's own vocabulary, in
the order of the words' digests, and its tokens as places in that vocabulary. Words, and later word pairs, are
counted in each chunk first and go to shards as packed arrays: what a chunk sends is at once its counts and its
request, and a shard answers with the merged counts in the order of the request. A shard of words is a range of
digests, so its answers are a stretch of the vocabulary. The merged tables, partitioned by shard, stay as the
model. Three passes over the chunks:

1. words: shards give every word an id and its count in training documents;
2. pairs: shards, by context word, merge pair counts and keep for each context what its backoff weight takes
   (the summed lower-order probability of its seen words, and how many were seen 1..5 times);
3. scores: every token is evaluated by recursion, pair if seen, else backoff weight times the word's
   probability, else the unknown class.

Discounts: d_r = (r*/r - A) / (1 - A) for r up to 5, with r* = (r+1) n_{r+1} / n_r and A = 6 n_6 / n_1; where
counts of counts don't give 0 < d_r < 1, all are (r - 0.5) / r. A context that would leave no mass is divided
by its count plus one. Backoff weights are (1 - seen mass) / (1 - lower-order mass of the seen words), so each
context's probabilities over all known words and the unknown class sum to one.

Contexts with over a thousandth of all tokens (under a thousand such, by arithmetic) are spread over all shards
by the following word; their sums are added up and are the only model rows the driver sees.

Defined results: null and empty texts are one end token; repeated rows train and score again; a null id counts
as empty text for the folds; without any training document every token has probability one of the unknown
class; an empty table gives no rows; other columns are not read; very long texts are chunks by themselves.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, documents, release_shuffles, small_batches, stage

TOP = 5  # counts up to this are discounted
CHUNK_BYTES = 8 << 20
#: Distinct pairs of a shard, about, and compressed bytes of the words sent to one.
SHARD_PAIRS, SHARD_WORD_BYTES = 1_500_000, 4 << 20
#: Chunks that one task scores, one after the other.
TASK_CHUNKS = 4
BEGIN, END, FIRST_ID = 0, 1, 2
HOT_SHARE = 1000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as compressed byte planes."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)
        out.append(struct.pack("<cqq", a.dtype.char.encode(), len(a), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<cqq", data, at)
        at += struct.calcsize("<cqq")
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(zstandard.decompress(data[at : at + size]) if n else b"", dtype=np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += size
    return out


class Numbers(dict):
    """Words to numbers in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def in_training(doc_id: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != held


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words in the order of their digests, words a text, places of all tokens)."""
    numbers = Numbers()
    parts = []
    for text in texts:
        words = text.split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
    words = list(numbers)
    order = np.argsort(digests(words), kind="stable")
    place = np.empty(len(words), dtype=np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return [words[i] for i in order.tolist()], np.array([len(p) for p in parts], dtype=np.uint32), place[tokens]


def digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def shard_of(digest: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of digests."""
    return ((digest >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunked(docs: DataFrame, chunk_bytes: int, id_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size, number, part = 0, 0, TaskContext.get().partitionId()

        def chunk() -> pa.RecordBatch:
            words, sizes, tokens = numbered(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | number]), pa.array([ids], pa.list_(pa.int64())), pa.array([zstandard.compress(b" ".join(words), 3)]), pa.array([pack(sizes, tokens)])],
                names=["chunk", "ids", "words", "body"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
                if texts and size + len(data) > chunk_bytes:
                    yield chunk()
                    ids, texts, size, number = [], [], 0, number + 1
                    give_back()
                ids.append(doc_id)
                texts.append(data)
                size += len(data)
        if texts:
            yield chunk()
        ids, texts = [], []
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "chunk long, ids array<long>, words binary, body binary")


class Chunk:
    """One chunk's documents as one array of word numbers, with what follows from it."""

    def __init__(self, ids: list, body: bytes, folds: int, held: int):
        self.ids = ids
        sizes, tokens = unpack(body)
        self.sizes, self.tokens = sizes.astype(np.int64), tokens.astype(np.int64)
        self.n_words = int(self.tokens.max()) + 1 if len(self.tokens) else 0
        self.train = np.array([in_training(i, folds, held) for i in ids], dtype=bool)

    def counts(self) -> np.ndarray:
        """Each word's count in the chunk's training documents."""
        return np.bincount(self.tokens[np.repeat(self.train, self.sizes)], minlength=self.n_words).astype(np.uint64)

    def take_words(self, answers: dict[int, bytes]) -> None:
        """ids and corpus counts of the words, from the shards' answers in the order of shards."""
        got = [unpack(answers[shard]) for shard in sorted(answers)]
        self.word_ids, self.word_counts = (np.concatenate([np.zeros(0, np.uint64), *(g[i] for g in got)]) for i in (0, 1))

    def pair_up(self, shards: int, n_train_docs: int, n_tokens: int) -> None:
        """Distinct pairs, their training counts and shards. Local numbers: words, then begin and end."""
        n = self.n_words
        ends = np.cumsum(self.sizes + 1) - 1
        after = np.full(len(self.tokens) + len(self.ids), n + 1, dtype=np.int64)
        inner = np.ones(len(after), dtype=bool)
        inner[ends] = False
        after[inner] = self.tokens
        before = np.r_[n, after[:-1]] if len(after) else after
        before[np.r_[0, ends[:-1] + 1]] = n
        keys = before * (n + 2) + after
        # one sort gives the distinct pairs and each token's place among them
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
        self.distinct = ordered[new]
        self.place = np.empty(len(keys), dtype=np.int32)
        self.place[order] = np.cumsum(new) - 1
        self.doc_of = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes + 1)
        self.pair_counts = np.bincount(self.place[np.repeat(self.train, self.sizes + 1)], minlength=len(self.distinct)).astype(np.uint64)
        self.all_ids = np.r_[self.word_ids, np.array([BEGIN, END], dtype=np.uint64)]
        self.all_counts = np.r_[self.word_counts, np.array([n_train_docs] * 2, dtype=np.uint64)]
        self.first, self.second = np.divmod(self.distinct, n + 2)
        self.hot = is_hot(self.all_counts, n_tokens)
        by = np.where(self.hot[self.first], self.all_ids[self.second], self.all_ids[self.first])
        self.pair_shard = ((by * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def is_hot(counts: np.ndarray, n_tokens: int) -> np.ndarray:
    return counts > np.uint64(n_tokens // HOT_SHARE)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(values)])


PACKED = "shard long, chunk long, kind string, body binary"
NAMES = ["shard", "chunk", "kind", "body"]


def rows_out(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())], names=NAMES)


def send_words(batches: Iterator[pa.RecordBatch], shards: int, folds: int, held: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, ids, packed, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words, counts = zstandard.decompress(packed).split(), Chunk(ids, body, folds, held).counts()
            shard = shard_of(digests(words), shards)
            rows = []
            for start, size in zip(*runs(shard)):
                part = zstandard.compress(b" ".join(words[start : start + size]), 1)
                rows.append((int(shard[start]), number, "words", struct.pack("<q", len(part)) + part + pack(counts[start : start + size])))
            yield from rows_out(rows).to_batches()


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """The rows of each shard, from batches sorted by shard."""
    now, chunks, bodies = None, [], []
    for batch in batches:
        for shard, chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if shard != now:
                if chunks:
                    yield now, chunks, bodies
                now, chunks, bodies = shard, [], []
            chunks.append(chunk)
            bodies.append(body)
    if chunks:
        yield now, chunks, bodies


def histogram(counts: np.ndarray) -> np.ndarray:
    """Number of items counted 1..TOP+1 times, number counted at all, and the sum of counts."""
    low = np.bincount(np.minimum(counts, TOP + 2).astype(np.int64), minlength=TOP + 3)[1 : TOP + 2]
    return np.r_[low, (counts > 0).sum(), counts.sum()].astype(np.uint64)


def merge_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for shard, chunks, bodies in by_shard(batches):
        numbers = Numbers()
        asked, counted = [], []
        for body in bodies:
            (size,) = struct.unpack_from("<q", body)
            words = zstandard.decompress(body[8 : 8 + size]).split()
            asked.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
            counted.append(unpack(body[8 + size :])[0])
        counts = np.bincount(np.concatenate(asked), weights=np.concatenate(counted).astype(np.float64), minlength=len(numbers)).astype(np.uint64)
        ids = (np.arange(len(numbers)) * shards + shard + FIRST_ID).astype(np.uint64)
        yield from rows_out([(shard, chunk, "answer", pack(ids[a], counts[a])) for chunk, a in zip(chunks, asked)]).to_batches()
        model = zstandard.compress(b" ".join(numbers), 1)
        yield from rows_out([(shard, -1, "totals", pack(histogram(counts))), (shard, -1, "model", struct.pack("<q", len(model)) + model + pack(ids, counts))]).to_batches()


def answers_of(table: pa.Table, kind: str) -> dict[int, bytes]:
    return {s: b for s, k, b in zip(table["shard"].to_pylist(), table["kind"].to_pylist(), table["body"].to_pylist()) if k == kind}


def send_pairs(left: pa.Table, right: pa.Table, shards: int, folds: int, held: int, n_docs: int, n_tokens: int) -> pa.Table:
    rows = []
    for number, ids, body in zip(*(left[c].to_pylist() for c in ("chunk", "ids", "body"))):
        chunk = Chunk(ids, body, folds, held)
        chunk.take_words(answers_of(right, "answer"))
        chunk.pair_up(shards, n_docs, n_tokens)
        order = np.argsort(chunk.pair_shard, kind="stable")
        for start, size in zip(*runs(chunk.pair_shard[order])):
            mine = order[start : start + size]
            firsts, lengths = runs(chunk.first[mine])
            context = chunk.first[mine][firsts]
            second = chunk.second[mine]
            rows.append((int(chunk.pair_shard[mine[0]]), number, "pairs", pack(chunk.all_ids[context], lengths.astype(np.uint64), chunk.all_ids[second], chunk.all_counts[second], chunk.pair_counts[mine])))
    return rows_out(rows)


def merge_pairs(batches: Iterator[pa.RecordBatch], unigram: Unigram) -> Iterator[pa.RecordBatch]:
    for shard, chunks, bodies in by_shard(batches):
        sent = [unpack(b) for b in bodies]
        first = np.concatenate([np.repeat(s[0], s[1].astype(np.int64)) for s in sent])
        second, lower, counts = (np.concatenate([s[i] for s in sent]) for i in (2, 3, 4))
        order = np.lexsort((second, first))
        first, second, lower = first[order], second[order], lower[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(counts[order], starts)
        merged = np.empty(len(order), dtype=np.uint64)
        merged[order] = totals[np.cumsum(new) - 1]
        # contexts
        contexts, sizes = runs(first[starts])
        seen = totals > 0
        below = np.where(seen, unigram.probability(lower[starts]), 0.0)
        facts = [np.add.reduceat(below, contexts)] + [np.add.reduceat((totals == r).astype(np.uint64), contexts) for r in range(1, TOP + 1)]
        facts.append(np.add.reduceat(np.where(totals > TOP, totals, 0).astype(np.uint64), contexts))
        names = first[starts][contexts]
        at = 0
        rows = []
        for chunk, s in zip(chunks, sent):
            place = np.searchsorted(names, s[0])
            n = int(s[1].sum())
            rows.append((shard, chunk, "pairs", pack(merged[at : at + n], *(f[place] for f in facts))))
            at += n
        yield from rows_out(rows).to_batches()
        yield from rows_out([(shard, -1, "totals", pack(histogram(totals))), (shard, -1, "model", pack(names, sizes.astype(np.uint64), second[starts], totals, *facts))]).to_batches()


def discounts(low: list[int]) -> np.ndarray:
    """d_0..d_TOP from the numbers of items counted 1..TOP+1 times; d_0 is unused."""
    d = np.ones(TOP + 1)
    n = [0, *low]
    if all(n[r] > 0 for r in range(1, TOP + 2)):
        a = (TOP + 1) * n[TOP + 1] / n[1]
        for r in range(1, TOP + 1):
            d[r] = ((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a) if a < 1 else 0
    if not all(0 < x < 1 for x in d[1:]) or not all(n[r] > 0 for r in range(1, TOP + 2)):
        d[1:] = [(r - 0.5) / r for r in range(1, TOP + 1)]
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= TOP, d[np.minimum(counts, TOP).astype(np.int64)], 1.0)


class Unigram:
    """Discounted probabilities of words by count, and the rest for the unknown class."""

    def __init__(self, totals: np.ndarray):
        low, self.vocabulary, self.tokens = [int(x) for x in totals[: TOP + 1]], int(totals[-2]), int(totals[-1])
        self.d = discounts(low)
        small = sum(r * low[r - 1] for r in range(1, TOP + 1))
        mass = sum(self.d[r] * r * low[r - 1] for r in range(1, TOP + 1)) + self.tokens - small
        self.divisor = self.tokens if mass < self.tokens else self.tokens + 1
        self.unknown = 1 - mass / self.divisor

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.divisor, self.unknown)


def backoff(facts: list[np.ndarray], counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, divisor) of contexts; one and zero for contexts never seen."""
    below, low, high = facts[0], facts[1 : TOP + 1], facts[TOP + 1]
    mass = high.astype(np.float64) + sum(d[r] * r * low[r - 1] for r in range(1, TOP + 1))
    divisor = counts + (mass >= counts * (1 - 1e-12))
    weight = (1 - mass / np.maximum(divisor, 1)) / np.maximum(1 - below, 1e-300)
    return np.where(counts > 0, weight, 1.0), np.where(counts > 0, divisor, 0.0)


def score_chunk(left: pa.Table, right: pa.Table, shards: int, folds: int, held: int, n_docs: int, unigram: Unigram, d: np.ndarray, hot: dict[int, tuple[float, ...]]) -> pa.Table:
    out: list[list] = [[] for _ in range(7)]
    for ids, body in zip(left["ids"].to_pylist(), left["body"].to_pylist()):
        chunk = Chunk(ids, body, folds, held)
        chunk.take_words(answers_of(right, "answer"))
        chunk.pair_up(shards, n_docs, unigram.tokens)
        merged = np.zeros(len(chunk.distinct), dtype=np.uint64)
        n = len(chunk.all_ids)
        facts = [np.zeros(n) for _ in range(TOP + 2)]
        answers = answers_of(right, "pairs")
        order = np.argsort(chunk.pair_shard, kind="stable")
        for start, size in zip(*runs(chunk.pair_shard[order])):
            mine = order[start : start + size]
            got = unpack(answers[int(chunk.pair_shard[mine[0]])])
            merged[mine] = got[0]
            context = chunk.first[mine][runs(chunk.first[mine])[0]]
            for f, g in zip(facts, got[1:]):
                f[context] = g
        for i in np.flatnonzero(chunk.hot).tolist():
            for f, value in zip(facts, hot.get(int(chunk.all_ids[i]), (0.0,) * (TOP + 2))):
                f[i] = value
        weight, divisor = backoff(facts, chunk.all_counts.astype(np.float64), d)
        below = unigram.probability(chunk.all_counts)
        seen = merged > 0
        pair = np.log10(np.where(seen, discounted(merged, d) / np.maximum(divisor[chunk.first], 1), weight[chunk.first] * below[chunk.second]))
        place = chunk.place
        token = chunk.second[place]
        base = np.log10((chunk.all_counts + 0.5) / (unigram.tokens + 0.5 * (unigram.vocabulary + 1)))
        docs = len(ids)
        known = chunk.all_counts > 0
        out[0] += ids
        out[1] += (~chunk.train).tolist()
        out[2] += (chunk.sizes + 1).tolist()
        out[3] += np.bincount(chunk.doc_of, weights=known[token], minlength=docs).astype(np.int64).tolist()
        out[4] += [unigram.tokens] * docs
        out[5] += np.bincount(chunk.doc_of, weights=base[token], minlength=docs).tolist()
        out[6] += np.bincount(chunk.doc_of, weights=pair[place], minlength=docs).tolist()
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def summed(table: DataFrame) -> np.ndarray:
    """The shards' totals added up: TOP + 3 numbers a shard, added in Spark."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOP + 3, dtype=np.uint64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                total = total + unpack(body)[0]
        yield pa.RecordBatch.from_arrays([pa.array(range(TOP + 3), pa.int64()), pa.array(total.astype(np.int64))], names=["k", "n"])

    rows = table.where("kind = 'totals'").select("body").mapInArrow(numbers, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TOP + 3, dtype=np.uint64)
    for r in rows:
        out[r.k] = r.n
    return out


def trimmed(function: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right)
        give_back()
        return out

    return run


class KatzModel:
    """Staged model tables and the few global numbers."""

    def __init__(self, words: DataFrame, pairs: DataFrame, unigram: Unigram, d: np.ndarray, hot: dict, n_docs: int):
        self.words, self.pairs, self.unigram, self.d, self.hot, self.n_docs = words, pairs, unigram, d, hot, n_docs


def katz_scores(docs: DataFrame, folds: int = 5, held: int = 1, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, KatzModel]:
    """Scores of all documents under a model of those whose id's crc32 modulo ``folds`` is not ``held``."""
    spark = docs.sparkSession
    chunks = stage(chunked(docs, chunk_bytes, id_column, text_column), "katz-chunks")
    trains = ~F.coalesce(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == held, F.lit(False))
    facts = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words")).alias("bytes")).first()
    n_docs = chunks.select(F.explode("ids").alias("id")).where(trains).count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_shards = max(least, (facts.bytes or 0) // SHARD_WORD_BYTES)
    shards = max(least, -(-facts.n * min(chunk_bytes, CHUNK_BYTES) // 10 // SHARD_PAIRS))
    tasks = max(least, facts.n // TASK_CHUNKS)

    sent = chunks.mapInArrow(lambda b: send_words(b, word_shards, folds, held), PACKED)
    words = stage(sent.repartition(word_shards, "shard").sortWithinPartitions("shard", "chunk").mapInArrow(lambda b: merge_words(b, word_shards), PACKED), "katz-words")
    end = np.r_[histogram(np.array([n_docs], dtype=np.uint64))]
    unigram = Unigram(summed(words) + end)
    release_shuffles(spark)

    def tables(answers: DataFrame):
        """Each chunk beside its answers; tasks grow with the number of chunks, and the texts' words stay behind."""
        numbers = chunks.select("chunk", "ids", "body")
        return numbers.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))

    answers = words.where("kind = 'answer'")
    send = partial(send_pairs, shards=shards, folds=folds, held=held, n_docs=n_docs, n_tokens=unigram.tokens)
    sent = tables(answers).applyInArrow(trimmed(send), PACKED)
    pairs = stage(sent.repartition(shards, "shard").sortWithinPartitions("shard", "chunk").mapInArrow(lambda b: merge_pairs(b, unigram), PACKED), "katz-pairs")
    d = discounts([int(x) for x in summed(pairs)[: TOP + 1]])
    hot = hot_contexts(pairs, unigram.tokens, words, n_docs)
    release_shuffles(spark)

    evaluate = partial(score_chunk, shards=shards, folds=folds, held=held, n_docs=n_docs, unigram=unigram, d=d, hot=hot)
    both = answers.unionByName(pairs.where("kind = 'pairs'"))
    scores = tables(both).applyInArrow(trimmed(evaluate), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores, KatzModel(words, pairs, unigram, d, hot, n_docs)


def hot_contexts(pairs: DataFrame, n_tokens: int, words: DataFrame, n_docs: int) -> dict[int, tuple[float, ...]]:
    """Facts of the contexts that are spread over shards; fewer than HOT_SHARE + 1 by their counts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                (size,) = struct.unpack_from("<q", body)
                ids, counts = unpack(body[8 + size :])
                yield pa.RecordBatch.from_arrays([pa.array(ids[is_hot(counts, n_tokens)].astype(np.int64))], names=["id"])

    names = {r.id for r in words.where("kind = 'model'").select("body").mapInArrow(find, "id long").collect()}
    names |= {BEGIN} if n_docs > n_tokens // HOT_SHARE else set()
    wanted = np.array(sorted(names), dtype=np.uint64)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                parts = unpack(body)
                mine = np.isin(parts[0], wanted)
                yield pa.RecordBatch.from_arrays([pa.array(parts[0][mine].astype(np.int64)), *(pa.array(f[mine].astype(np.float64)) for f in parts[4:])], names=["id", *columns])

    columns = [f"f{i}" for i in range(TOP + 2)]
    rows = pairs.where("kind = 'model'").select("body").mapInArrow(facts, "id long, " + ", ".join(f"{c} double" for c in columns))
    return {r[0]: tuple(r[1:]) for r in rows.groupBy("id").agg(*(F.sum(c).alias(c) for c in columns)).collect()}


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))[0]
