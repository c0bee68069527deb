import numpy as np

from tessella.llm import pii


def test_the_middle_of_a_long_word_has_features():
    word = ",".join(["name"] * 40 + ["x@y.org", "(743)555-3824"] + ["name"] * 40)
    assert {"n=10", "mixed", "has@", "has-", "has("} <= set(pii.word_features(*pii.signature(word)))
    field = pii.Field(*pii.trained())
    short = ",".join(["name", "x@y.org", "(743)555-3824"])
    assert field.numbers([word, short, word]).tolist() == [field.set_of(pii.word_features(*pii.signature(w))) for w in (word, short, word)]
    assert not any(len(w) > pii.LONG_WORD for w in field.words)


def test_runs_of_the_padded_width_are_followed_by_other():
    field = pii.Field(*pii.trained())
    rng = np.random.default_rng(3)
    filling = np.array([0] + [-1e9] * (len(pii.LABELS) - 1), dtype=np.float32)
    for n in (1, 3, 4, 5, 8, 16, 32, 63, 64, 65, 128):
        for _ in range(40):
            scores = np.concatenate([rng.normal(0, 1, (n, len(pii.LABELS))), filling[None]]).astype(np.float32)
            want = field.viterbi(scores[None])[0][:n]
            labels = np.zeros(n + 1, dtype=np.int8)
            field.decode(scores, labels, np.array([0]), np.array([n]))
            assert labels[:n].tolist() == want.tolist(), n
