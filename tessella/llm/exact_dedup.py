"""Exact dedup by composable polynomial fingerprints.

A text is normalised (ASCII white space deleted), cut into chunks of bytes, and each chunk is hashed as a
polynomial modulo two primes. Chunk hashes are independent, so they are computed side by side as one matrix
product, and combine by length-shifted arithmetic: ``hash(xy) = hash(x) * base**len(y) + hash(y)``.
Rows with equal (length, fingerprint) are candidates; the chunks at each place of a group are then compared,
the least with the greatest. A group with differing chunks, a true collision, is split by SHA-256.

Defined results: a null text counts as empty, and all empty texts are one group; rows with the same text and
the same id (repeated rows) are one group in which a single row is kept; null ids sort after all others;
an empty table gives no rows; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WHITESPACE, documents, fresh, map_columns, release_shuffles, small_batches, stage

MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1664525007)
CHUNK = 1 << 14


def powers(base: int, modulus: int, count: int) -> np.ndarray:
    out = np.ones(count, dtype=np.uint64)
    done = 1
    while done < count:
        step = min(done, count - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += step
    return out


class Fingerprinter:
    """Fingerprints of byte strings. ``moduli`` may be weakened in tests to force collisions."""

    def __init__(self, moduli: tuple[int, int] = MODULI, chunk: int = CHUNK):
        self.moduli, self.chunk = moduli, chunk
        # the last byte of a chunk has exponent 0
        self.tables = [powers(b % m, m, chunk)[::-1].copy() for b, m in zip(BASES, moduli)]

    def chunk_hashes(self, data: bytes) -> list[tuple[int, list[int]]]:
        """(length, hash by modulus) of each chunk, all full chunks at once."""
        full, rest = divmod(len(data), self.chunk)
        values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        out = []
        if full:
            rows = values[: full * self.chunk].reshape(full, self.chunk)
            hashes = [(rows @ t) % np.uint64(m) for t, m in zip(self.tables, self.moduli)]
            out += [(self.chunk, [int(h[i]) for h in hashes]) for i in range(full)]
        if rest:
            tail = values[full * self.chunk :]
            out.append((rest, [int(np.dot(tail, t[-rest:])) % m for t, m in zip(self.tables, self.moduli)]))
        return out

    def combine(self, left: tuple[int, list[int]], right: tuple[int, list[int]]) -> tuple[int, list[int]]:
        n = right[0]
        return left[0] + n, [(a * pow(b % m, n, m) + c) % m for a, c, b, m in zip(left[1], right[1], BASES, self.moduli)]

    def __call__(self, data: bytes) -> int:
        total = (0, [0, 0])
        for part in self.chunk_hashes(data):
            total = self.combine(total, part)
        return total[1][0] << 31 | total[1][1]


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITESPACE)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fingerprint: Fingerprinter | None = None) -> DataFrame:
    """doc_id, n_points, n_bytes, print, text_sha256 of every row; one scan, no shuffle."""
    function = fingerprint or Fingerprinter()

    def batch(columns: dict) -> dict:
        out = {"doc_id": columns["doc_id"], "n_points": [], "n_bytes": [], "print": [], "text_sha256": []}
        for text in columns["text"]:
            data = normalised(text)
            out["n_points"].append(len(text or ""))
            out["n_bytes"].append(len(data))
            out["print"].append(function(data))
            out["text_sha256"].append(hashlib.sha256(data).hexdigest())
        return out

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_columns(rows, batch, "doc_id long, n_points long, n_bytes long, print long, text_sha256 string")


def colliding_groups(docs: DataFrame, multiple: DataFrame, text_column: str, function: Fingerprinter) -> DataFrame:
    """(n_bytes, print) of groups whose rows differ in some chunk."""
    size = function.chunk

    def cut(columns: dict) -> dict:
        out: dict = {"n_bytes": [], "print": [], "chunk_no": [], "chunk": []}
        for text in columns["text"]:
            data = normalised(text)
            key = len(data), function(data)
            for k, at in enumerate(range(0, len(data), size)):
                for name, value in zip(out, (*key, k, data[at : at + size])):
                    out[name].append(value)
        return out

    rows = docs.select(F.col(text_column).alias("text"))
    # the length in bytes is cheap to know before anything is shuffled: most texts have no partner of their length
    length = F.octet_length(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", ""))
    lengths = multiple.select(F.col("n_bytes").alias("length")).distinct()
    rows = rows.withColumn("length", length.cast("long")).join(lengths, "length", "left_semi").select("text")
    chunks = map_columns(rows, cut, "n_bytes long, print long, chunk_no long, chunk binary")
    chunks = stage(chunks.join(multiple.select("n_bytes", "print"), ["n_bytes", "print"], "left_semi").select("n_bytes", "print", "chunk_no", "chunk"), "dedup-chunks")
    # every copy of a chunk is compared where it is read; a task sends on at most two for each place in a group
    ends = chunks.groupBy("n_bytes", "print", "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return ends.where("least <> most").select("n_bytes", "print").distinct()


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fingerprint: Fingerprinter | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays.
    """
    function = fingerprint or Fingerprinter()
    spark = docs.sparkSession
    prints = fingerprints(docs, id_column, text_column, function).withColumn("row_no", F.monotonically_increasing_id())
    prints = stage(prints, "dedup-prints")
    groups = prints.groupBy("n_bytes", "print").agg(F.count(F.lit(1)).alias("group_size"))
    multiple = stage(groups.where("group_size > 1 AND n_bytes > 0"), "dedup-groups")
    collisions = stage(colliding_groups(docs, multiple, text_column, function), "dedup-collisions")
    release_shuffles(spark)
    # '' is the class of every row whose group held under comparison
    collided = collisions.withColumn("collided", F.lit(True))
    keyed = prints.join(collided, ["n_bytes", "print"], "left").withColumn("split", F.when(F.col("collided"), F.col("text_sha256")).otherwise(F.lit("")))
    key = ["n_bytes", "print", "split"]
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "row_no")
    final = keyed.groupBy(key).agg(F.min_by(F.struct("doc_id", "row_no"), order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # a table of its own: the join is broadcast where it is small, else Spark may split a group that holds many rows
    final = stage(final.where("group_size > 1"), "dedup-final")
    out = keyed.join(final, key, "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row_no") == F.col("keep.row_no"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: documents without the rows that exact_dedup drops; columns as they came, whatever their names.

    Null and empty texts are equal, so one of them stays. Of equal texts with one id the row with the most code
    points stays.
    """
    verdicts = stage(exact_dedup(docs.select("doc_id", "text")), "dedup-verdicts")
    own, gone_id, gone_sha, number = fresh(docs, "own_sha", "gone_id", "gone_sha", "number")
    gone = verdicts.where("NOT kept AND NOT doc_id <=> keep_id").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary"), 256)
    left = docs.withColumn(own, sha)
    kept = left.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_sha)), "left_anti")
    repeated = verdicts.where("NOT kept AND doc_id <=> keep_id").limit(1).count()
    if repeated:  # equal texts with one id; the limit by group is taken before the shuffle
        longest = Window.partitionBy("doc_id", own).orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc())
        kept = kept.withColumn(number, F.row_number().over(longest)).where(F.col(number) == 1).drop(number)
    return kept.drop(own)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
