"""Packing by concatenate and cut.

Documents are tokenised once; their ids, as packed 32-bit integers, are staged with the partition they came
from and their place in it. Two passes of prefix sums, inside each partition and over the partitions' totals,
give each document its offset in the one long stream of ids, and fixed windows of that stream are the
sequences. A document that crosses a window's end gets one boundary record (piece) for each window.
Only the last sequence is padded, so padding is under one window for the whole corpus.

Ids are those of the untouched ``tokenizers`` file without added special tokens: a special token's own string in
a text is that token. A text is cut at single spaces and line ends, where the vocabulary's pre-tokeniser always
cuts, and each distinct chunk is encoded once: by tiktoken from the same vocabulary as ranks, or by ``tokenizers``
itself where a chunk has characters whose classes the two libraries might take from different Unicode versions.
Texts with a special token's string, and those that can't be cut so, go through ``tokenizers`` whole.

Defined results: a null or empty text is its end id alone; repeated rows are packed again; ties don't arise,
as every row has its own place; an empty table gives no pieces; clashing column names are not read.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, map_columns, small_batches, stage

WINDOW = 1024
END_ID = 0
#: Bytes, about, of the chunks kept in a worker; past it the memory is emptied. Longer chunks are not kept.
CACHE_BYTES, ENTRY_BYTES, LONG_CHUNK = 160 << 20, 200, 200
#: Chunks with code points below this are classed alike by every Unicode version either library may use.
SETTLED = chr(0x0250)


class CachedEncoder:
    """Byte-level BPE ids of whole texts as little-endian uint32 bytes."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        owner = self

        class Chunks(dict):
            held = 0

            def __missing__(self, chunk: str) -> bytes | None:
                found = owner.chunk_ids(chunk)
                if len(chunk) <= LONG_CHUNK:
                    self.held += ENTRY_BYTES + len(chunk) + len(found or b"")
                    if self.held > CACHE_BYTES:
                        self.clear()
                        self.held = 0
                    self[chunk] = found
                return found

        self.chunks = Chunks()

    def whole(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk_ids(self, chunk: str) -> bytes | None:
        """None if white space stands next to white space here: then cuts may move."""
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if body.split() != [body]:  # empty, or with white space of any kind
            return None
        piece = chunk if body is not chunk else " " + chunk
        if not piece.isascii() and max(piece) >= SETTLED:
            return self.whole(piece)
        ids = self.fast.encode_ordinary(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or any(token in text for token in self.special):
            return self.whole(text)
        try:
            if any(c.isspace() for c in first):
                return self.whole(text)
            head = self.whole(first)
            return head + b"".join(map(self.chunks.__getitem__, rest))
        except TypeError:  # a None: adjacent white space somewhere
            return self.whole(text)


_encoders: dict[tuple, CachedEncoder] = {}


def public_encoder() -> Callable[[str | None], bytes]:
    """The installed byte_bpe_50k vocabulary; one encoder a worker process."""
    import public_tokenizers as P

    key = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    if key not in _encoders:
        _encoders[key] = CachedEncoder(*key)
    return _encoders[key]


def tokenised(docs: DataFrame, encoder: Callable[[], Callable[[str | None], bytes]], id_column: str, text_column: str) -> DataFrame:
    """doc_id, part, local_start, doc_tokens, ids: in file order, with the prefix sum inside the partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id long, part long, local_start long, doc_tokens long, ids binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids = [encode(text) + end for text in batch.column(1).to_pylist()]
            sizes = [len(x) // 4 for x in ids]
            starts = [at, *(at + np.cumsum(sizes)).tolist()]
            at = starts.pop()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], schema=arrow)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, window: int = WINDOW, encoder: Callable = public_encoder, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    spark = docs.sparkSession
    table = stage(tokenised(docs, encoder, id_column, text_column), "pack-ids")
    # one row for each partition of the scan, whatever it holds: 16 bytes each on the driver and in the broadcast
    totals = sorted((r["part"], r["total"]) for r in table.groupBy("part").agg(F.sum("doc_tokens").alias("total")).collect())
    offsets, at = [], 0
    for part, total in totals:
        offsets.append((part, at))
        at += total
    placed = table.join(F.broadcast(spark.createDataFrame(offsets, "part long, part_start long")), "part")
    placed = placed.select("doc_id", "doc_tokens", (F.col("part_start") + F.col("local_start")).alias("at"), "ids")

    def cut(columns: dict) -> dict:
        out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for doc_id, n, place, ids in zip(columns["doc_id"], columns["doc_tokens"], columns["at"], columns["ids"]):
            start = 0
            while start < n:
                sequence, offset = divmod(place + start, window)
                length = min(window - offset, n - start)
                piece = ids[4 * start : 4 * (start + length)]
                for name, value in zip(out, (doc_id, start, length, zlib.crc32(piece), n, sequence, offset, piece)):
                    out[name].append(value)
                start += length
        return out

    return map_columns(placed, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: the documents' pieces in sequences of at most 1024 ids, by digest.

    Null and empty texts are their end id alone, repeated rows and shared or null ids are packed row by row, an
    empty table gives no rows; only the columns doc_id and text are read, whatever others are called.
    """
    return pack(docs).drop("ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir))
