import random
import string
import time

import pytest

from tessella.llm import secrets as S

LETTERS = string.ascii_letters


def timed(function, *args):
    began = time.perf_counter()
    out = function(*args)
    return out, time.perf_counter() - began


@pytest.mark.parametrize("text", ["A-" * 200 + "a1b", "A-" * 20_000 + "a1b", "A" * 50_000 + "-a1b", "a-" * 20_000 + "=" * 20_000, "A1" * 30_000, "/_" * 40_000 + "x"])
def test_long_runs_take_linear_time(text):
    S.token_count("warm")
    assert timed(S.random_spans, text, [])[1] < 2


def test_many_spans_take_linear_time():
    rng = random.Random(4)
    words = ["".join(rng.choices("0123456789abcdef", k=16)) + " " + "".join(rng.choices(LETTERS + string.digits, k=24)) for _ in range(20_000)]
    text = " ".join(words)
    base = S.base_spans(text)
    assert len(base) >= 20_000
    found, took = timed(S.random_spans, text, base)
    assert took < 6 and len(found) > 19_000


@pytest.mark.parametrize(("alphabet", "length", "least"), [
    (LETTERS + string.digits, 16, 0.98), (LETTERS + string.digits, 20, 0.98), (LETTERS + string.digits, 32, 0.98),
    (LETTERS, 16, 0.95), (LETTERS, 32, 0.97), (string.ascii_lowercase + string.digits, 16, 0.88), (string.ascii_lowercase + string.digits, 32, 0.95),
])
def test_recall_on_random_strings(alphabet, length, least):
    rng = random.Random(length)
    some = ["".join(rng.choices(alphabet, k=length)) for _ in range(400)]
    hit = sum(bool(S.base_spans(x) or S.random_spans(x, [])) for x in some) / len(some)
    assert hit >= least, hit


@pytest.mark.parametrize("word", ["getElementByIdAndName", "Unwahrscheinlichkeit", "INTERNALCONFIGURATION", "path/to/some/longer/file-name", "2024-01-02/report-final-17", "internationalization"])
def test_names_stay(word):
    assert not S.random_spans(word, [])
