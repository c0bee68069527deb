"""SentencePiece encoding and decoding on a tokenizers-library backend.

The model's protobuf is parsed here, without the sentencepiece library, and rebuilt as a ``tokenizers`` model:
unigram pieces with their scores, or BPE with merges ordered by score; byte fallback; the normaliser with its
character map, dummy prefix and white-space rules; and the metaspace marker. Where no piece of the vocabulary
crosses from another character to the marker, and none holds a line end, a text's ids are those of its chunks,
cut before single markers and line ends; each distinct chunk is then encoded once, the chunks that a batch
misses in one multithreaded call. A model for which that doesn't hold is encoded text by text.

Parity with the sentencepiece library is verified on every distinct chunk (or text), and so is the way back.

Defined results: a null or empty text has no ids; a marker character in a text decodes to a space, so
``round_trip`` is false there; repeated rows each get a row; very long texts are encoded whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, map_columns, small_batches

MARK = "\u2581"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks learned together, and bytes, about, of the chunks kept between batches; past them the memory is emptied.
LEARNED_AT_ONCE, CACHE_BYTES, ENTRY_BYTES = 200_000, 320 << 20, 300


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at : at + size]
        at += size


class Model:
    """What the protobuf says: pieces with score and type, trainer and normaliser settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.remove_extra, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap = spec.get(2, b"")
                self.dummy_prefix, self.remove_extra, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @property
    def separable(self) -> bool:
        """Whether ids of chunks are ids of the text."""
        plain = not self.charsmap and not self.remove_extra and self.dummy_prefix and self.escape and self.byte_fallback
        crossing = re.compile(f"[^{MARK}]{MARK}|\n")
        return plain and not any(crossing.search(p) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((-self.pieces[i][1], i, left, right, piece[:cut], piece[cut:]))
        return [(x[4], x[5]) for x in sorted(found)]

    def tokenizer(self, prefixed: bool = True):
        """``prefixed``: whether texts still need the normaliser's prefix and marks."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            built = Tokenizer(models.BPE(vocabulary, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            built = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if prefixed:
            from tokenizers import Regex

            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] if self.remove_extra else []
            steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
            steps += [normalizers.Replace(" ", MARK)]
        if steps:
            built.normalizer = normalizers.Sequence(steps)
        built.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return built


class Codec:
    """Batch encoder with memory of chunks; texts give (ids as uint32 bytes, parity, round trip)."""

    def __init__(self, path: str, threads: int = 2):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.separable = self.model.separable
        self.backend = self.model.tokenizer(prefixed=not self.separable)
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.newline = self.peer.encode("\n")
        self.bare_prefix = self.peer.piece_to_id(MARK)
        self.memory: dict[str, bytes] = {}
        #: Known chunks whose ids aren't the library's, and those that don't decode to themselves.
        self.unlike: set[str] = set()
        self.one_way: set[str] = set()
        self.held = 0

    def chunks(self, text: str | None) -> list[str]:
        """The text's chunks with marks in place; one item where it can't be cut."""
        if not text:
            return []
        if not self.separable:
            return [text]
        if MARK in text or "  " in text or text[0] == " ":
            return re.findall(f"{MARK}+[^{MARK}\n]*|\n?[^{MARK}\n]+|\n", MARK + text.replace(" ", MARK))
        return [c if c[:1] == "\n" else MARK + c for c in text.replace("\n", " \n").split(" ")] if "\n" in text else [MARK + c for c in text.split(" ")]

    def peer_ids(self, chunks: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids. It puts a prefix before every text, which chunks after a line end lack."""
        if not self.separable:
            return self.peer.encode(chunks, num_threads=1)
        whole = self.peer.encode([c[1:] if c[0] == MARK else c for c in chunks], num_threads=1)
        whole = [ids if c != MARK else [self.bare_prefix] for c, ids in zip(chunks, whole)]  # a prefix by itself
        return [ids if c[0] == MARK else ids[1:] if ids[:1] == [self.bare_prefix] else [-1] for c, ids in zip(chunks, whole)]

    def learn(self, wanted: set[str]) -> None:
        missing = [c for c in wanted if c not in self.memory]
        if not missing:
            return
        encoded = [e.ids for e in self.backend.encode_batch_fast(missing, add_special_tokens=False)]
        back = self.backend.decode_batch(encoded, skip_special_tokens=False)
        lead = " " * self.model.dummy_prefix
        for chunk, ids, peer, text in zip(missing, encoded, self.peer_ids(missing), back):
            self.memory[chunk] = struct.pack(f"<{len(ids)}I", *ids)
            self.held += ENTRY_BYTES + 2 * len(chunk) + 4 * len(ids)
            if ids != peer:
                self.unlike.add(chunk)
            if text != (chunk.replace(MARK, " ") if self.separable else lead + chunk):
                self.one_way.add(chunk)

    def forget(self) -> None:
        for known in (self.memory, self.unlike, self.one_way):
            known.clear()
        self.held = 0

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        out: list[tuple[bytes, bool, bool]] = []
        cut = [self.chunks(t) for t in texts]
        at = 0
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and a full memory is dear to search for them
        try:
            while at < len(cut):  # as many texts as fit in memory together; one very long text by itself
                wanted: set[str] = set()
                end = at
                while end < len(cut) and (end == at or len(wanted) < LEARNED_AT_ONCE):
                    wanted.update(cut[end])
                    end += 1
                self.learn(wanted)
                known = self.memory.__getitem__
                for text, chunks in zip(texts[at:end], cut[at:end]):
                    like = not self.unlike or self.unlike.isdisjoint(chunks)
                    back = (not self.one_way or self.one_way.isdisjoint(chunks)) and MARK not in (text or "")
                    out.append((b"".join(map(known, chunks)), like, back))
                at = end
                if self.held > CACHE_BYTES:
                    self.forget()
        finally:
            if collecting:
                gc.enable()
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, rows: list[list[int]]) -> list[str]:
        texts = self.backend.decode_batch(rows, skip_special_tokens=False)
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in texts]


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    import public_tokenizers as P

    path = path or P.path("piece_bpe_32k.model")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids, parity, round_trip. One scan, no shuffle."""

    def batch(columns: dict) -> dict:
        rows = codec(path).encode(columns["text"])
        return {"doc_id": columns["doc_id"], "ids": [np.frombuffer(r[0], dtype="<u4").astype(np.int32) for r in rows], "parity": [r[1] for r in rows], "round_trip": [r[2] for r in rows]}

    small_batches(docs.sparkSession)
    return map_columns(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), batch, "doc_id long, ids array<int>, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id, text. Null ids give a null text."""

    def batch(columns: dict) -> dict:
        rows = columns["ids"]
        texts = codec(path).decode_all([list(ids or ()) for ids in rows])
        return {"doc_id": columns["doc_id"], "text": [None if ids is None else t for ids, t in zip(rows, texts)]}

    small_batches(encoded.sparkSession)
    return map_columns(encoded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids")), batch, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), parity, round_trip of every document."""

    def batch(columns: dict) -> dict:
        rows = codec().encode(columns["text"])
        return {"doc_id": columns["doc_id"], "n_ids": [len(r[0]) // 4 for r in rows], "ids_crc32": [zlib.crc32(r[0]) for r in rows], "parity": [r[1] for r in rows], "round_trip": [r[2] for r in rows]}

    small_batches(spark)
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_columns(docs, batch, "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean")
