import random

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing


def same(texts):
    exact, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.public_encoder()
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for text, want in zip(some, exact.encode_batch(some, add_special_tokens=False)):
            assert encode(text) == np.array(want.ids, dtype="<u4").tobytes(), text[:80]


def test_every_document_of_a_table():
    same([t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()])


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(seed):
    rng = random.Random(seed)
    signs = [" ", " ", " ", "\n", "\t", "\r", "  ", "\x85", "\xa0", "\u2003", "\x1c", "'s", "'LL", "<|endoftext|>", "<|", "a", "B", "zz", "7", "\u00bd", "!", "--", "\u00e9", "\u00df", "\u0130", "\u03a9", "\u4e2d", "\U0001f642", "\u0300", "e\u0301", "\ufeff"]
    same(["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(3000)])


def test_the_memory_is_bounded(monkeypatch):
    encode = packing.CachedEncoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(packing, "CACHE_BYTES", 5000)
    text = " ".join(f"w{i}" for i in range(300)) + " " + "x" * 500
    assert encode(text) == encode.whole(text)
    assert len(encode.chunks) < 30 and not any(len(c) > packing.LONG_CHUNK for c in encode.chunks)
