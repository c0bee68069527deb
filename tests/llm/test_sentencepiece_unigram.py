"""The unigram path against the sentencepiece library, on models written by hand: pieces with set scores, nothing trained."""

import random
import struct

import pytest
import sentencepiece

from tessella.llm import sentencepiece_codec as C


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def written(path, byte_fallback, remove_extra, dummy_prefix, seed=1):
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if byte_fallback else []
    body = ["▁", *"abcdeé.", "▁a", "ab", "abc", "bcd", "▁the", "de", "cde", "▁ab", "ea", "dé", "e."]
    body += ["".join(rng.choices("abcde", k=rng.randint(2, 5))) for _ in range(40)]
    pieces += [(p, -rng.uniform(1, 12) / (1 + len(p) / 4), 1) for p in dict.fromkeys(body)]
    data = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, -1 & (1 << 64) - 1))
    data += field(3, field(1, "identity") + field(3, int(dummy_prefix)) + field(4, int(remove_extra)) + field(5, 1))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize(("byte_fallback", "remove_extra", "dummy_prefix"), [(True, False, True), (True, False, False), (False, False, True), (True, True, True)])
def test_unigram_equals_the_library(tmp_path, byte_fallback, remove_extra, dummy_prefix):
    path = written(tmp_path / "m.model", byte_fallback, remove_extra, dummy_prefix)
    peer, own = sentencepiece.SentencePieceProcessor(model_file=path), C.Codec(path)
    assert own.model.kind == C.UNIGRAM and own.separable == (byte_fallback and not remove_extra and dummy_prefix)
    rng = random.Random(7)
    texts = ["", "a", "the abc", "cde. ab", "dé ea"] + ["".join(rng.choices("abcdeé. ", k=rng.randint(1, 60))) for _ in range(400)]
    texts += ["zq", "日本 ab", "🙂", "a\nb", "x\ty"] if byte_fallback else []
    for text, (ids, parity, back) in zip(texts, own.encode(texts)):
        want = peer.encode(text)
        assert list(memoryview(ids).cast("I")) == want and parity, text
        if back:
            assert own.decode(want) == text
        assert back or remove_extra or not byte_fallback or not dummy_prefix, text


def test_scores_decide(tmp_path):
    """The best path by summed scores, not the longest piece."""
    pieces = [("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -1.0, 1), ("b", -1.0, 1), ("c", -1.0, 1), ("ab", -9.0, 1), ("bc", -1.5, 1)]
    data = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in pieces)
    (tmp_path / "s.model").write_bytes(data + field(2, field(3, 1) + field(40, 0)) + field(3, field(1, "identity") + field(3, 1) + field(4, 0) + field(5, 1)))
    own = C.Codec(str(tmp_path / "s.model"))
    ids = list(memoryview(own.encode(["abc"])[0][0]).cast("I"))
    assert [own.model.pieces[i][0] for i in ids] == ["▁", "a", "bc"]


def test_the_memory_is_bounded(tmp_path, monkeypatch):
    own = C.Codec(written(tmp_path / "m.model", True, False, True))
    monkeypatch.setattr(C, "CACHE_BYTES", 20_000)
    for i in range(20):
        own.encode([f"ab{'c' * (i + k)}{k} " * 3 for k in range(50)])
        assert own.held <= 20_000 and len(own.memory) < 200
