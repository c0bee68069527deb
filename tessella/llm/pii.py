"""Personal data by a linear-chain conditional random field over word-shape features.

The base patterns of the contract come first and their spans stay. The field is trained on the driver from a
small labelled table (made below from templates by a fixed seed) by gradient ascent on the exact conditional
likelihood, forward-backward in numpy. Decoding is Viterbi in numpy batches and gives the best path of the whole
text: words that are 'other' on every best path, by a bound on moves, part it into runs that are decoded side by
side, and a long run is decoded by blocks whose totals are joined exactly. A word's features depend on its shape,
so distinct feature sets are few and their scores are looked up. Each run of words that the field labels, less what
base spans cover and signs at its edges, is a span if it passes the check of its kind, or else of another (a Luhn
sum, a number of digits, an at and a dot); of a run that passes none, the parts that have a form of the kind are.

One scan, no shuffle; all patterns take linear time on long runs.

Defined results: a null or empty text has no spans; repeated rows each get their row; spans that start together
are ordered by kind as listed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, map_columns, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Words of a block of a long run (a power of two), and of the runs that are decoded at once.
BLOCK, STEP = 64, 1 << 18
CACHE_ENTRIES = 200_000
#: Longer words are not kept in caches, so these are bounded in bytes: 200,000 times 200.
LONG_WORD = 200

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def only_digits(run: str) -> str:
    return re.sub("[^0-9]", "", run)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and apart by kind."""
    found = []
    at = text.find("@")
    free = 0  # where the last match ended
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            free = match.end()
            found.append((start, 0, free))
        else:
            free = max(free, at + 1)  # no later start can cross this sign
        at = text.find("@", max(at + 1, free))
    for match in DOTTED.finditer(text):
        places = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", match[0])]
        for k in range(0, len(places) - 3, 4):
            four = places[k : k + 4]
            if all(len(p := x[2].lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                found.append((match.start() + four[0][0], 1, match.start() + four[3][1]))
    for match in CARD.finditer(text):
        digits = only_digits(match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    for match in PHONE.finditer(text):
        if 10 <= len(only_digits(match[0])) <= 15:
            found.append((match.start(), 3, match.end()))
    return sorted(found)


# ---- features

SHAPES = bytes(ord("X") if 65 <= i <= 90 else ord("x") if 97 <= i <= 122 or i > 127 else ord("d") if 48 <= i <= 57 else i for i in range(256))
LETTERS = re.compile(rb"(X)X+|(x)x+")
CUES = frozenset(("tel", "phone", "call", "mobile", "fax", "email", "mail", "card", "visa", "ip", "host", "address", "at", "dot"))
EDGES = ".,;:!?\"'()[]{}<>*&%$#|"


def signature(word: str) -> tuple[str, str]:
    """(shape with runs of letters as one sign, cue word or nothing): all that features depend on."""
    data = word.encode("utf-8", "surrogatepass")
    shape = LETTERS.sub(rb"\1\2", data.translate(SHAPES)).decode("ascii")
    cue = word.strip(EDGES).lower()
    return shape, cue if cue in CUES else ""


def word_features(shape: str, cue: str) -> tuple[str, ...]:
    """Features of one word's signature: shape, number of digits, signs and cue word."""
    core = shape.strip(EDGES)
    short = re.sub(r"(.)\1{4,}", r"\1\1\1\1+", core)
    digits = core.count("d")
    out = [f"n={min(digits, 14)}", f"shape={short if digits else core}"]
    if digits and all(c in "d()+-./" for c in core):
        out.append("numeric")
    if digits and ("x" in core or "X" in core):
        out.append("mixed")
    out += [f"has{c}" for c in "@-.():/+" if c in shape]
    if cue:
        out.append(f"cue={cue}")
        if shape[:1] in "[(" and cue in ("at", "dot"):
            out.append("bracket=" + cue)
    if shape[-1:] in ",;!?":
        out.append("ends")
    return tuple(out)


# ---- the labelled table


def labelled_table(rows: int = 600, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Sentences of (word, label number): forms of each kind among words, numbers, dates, prices and hex."""
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def plain() -> str:
        w = word()
        return rng.choice([w, w, w, w.capitalize(), w.upper(), w + ",", w + ".", w + "é", w + rng.choice(["&&&", "***", "###", "!!"])])

    def distractor() -> str:
        return rng.choice([
            digits(rng.randint(1, 6)), digits(4), f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}:{digits(2)}",
            f"{digits(1)}.{digits(1)}.{digits(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), f"({digits(4)})", f"[{digits(2)}]", f"{digits(3)}-{digits(2)}", f"{word()}{digits(2)}", f"{digits(16)}", f"{digits(12)}", f"@{word()}", f"{word()}@", f"({digits(3)})", f"#{digits(5)}", f"{digits(3)},{digits(3)}", f"{digits(5)}-{digits(4)}",
        ])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([[f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"], ["+1", f"({a})", f"{b}-{c}"], [f"+44", digits(4), digits(6)], [f"1-{a}-{b}-{c}"]])

    def entity(kind: int) -> list[str]:
        if kind == 1:
            name, host = word(), f"{word()}.{rng.choice(['com', 'org', 'net'])}"
            return rng.choice([[f"{name}@{host}"], [f"{name}.{digits(2)}@{host}"], [name, rng.choice(["[at]", "(at)"]), word(), rng.choice(["[dot]", "(dot)"]), "com"], [name + (at := rng.choice(["(at)", "[at]"])) + word() + at.replace("at", "dot") + "org"]])
        if kind == 2:
            return [rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))])]
        if kind == 3:
            four = [digits(4) for _ in range(4)]
            return rng.choice([four, ["-".join(four)], [".".join(four)], [digits(4), digits(6), digits(5)]])
        return phone()

    table = []
    for _ in range(rows):
        sentence: list[tuple[str, int]] = [(plain(), 0) for _ in range(rng.randint(2, 7))]
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.6:
                kind = rng.randint(1, 4)
                parts = [(w, kind) for w in entity(kind)]
                if rng.random() < 0.3:
                    parts[-1] = (parts[-1][0] + rng.choice(",.;"), kind)
                if rng.random() < 0.3:
                    cue = {1: "email", 2: "host", 3: "card", 4: "tel"}[kind]
                    sentence.append((rng.choice([cue, cue + ":"]), 0))
                sentence += parts
            else:
                sentence += [(distractor(), 0)]
            sentence += [(plain(), 0) for _ in range(rng.randint(1, 5))]
        table.append(sentence)
    return table


# ---- the field

ROLES = ("", "before:", "after:")


class Field:
    """Weights by (role, feature), transitions, and start weights."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.known = {n.removeprefix("before:").removeprefix("after:") for n in names}
        self.sets: dict[tuple[str, ...], int] = {}
        self.words: dict[str, int] = {}
        self.signatures: dict[tuple[str, str], int] = {}
        self.scores = np.zeros((3, 0, len(LABELS)), dtype=np.float32)
        self.rows: list[np.ndarray] = []
        self.empty = self.set_of(())

    def set_of(self, features: tuple[str, ...]) -> int:
        """Number of a set of features; those that the model never saw weigh nothing and make no set."""
        features = tuple(f for f in features if f in self.known)
        if features not in self.sets:
            row = np.zeros((3, len(LABELS)), dtype=np.float32)
            for role, prefix in enumerate(ROLES):
                for f in features:
                    i = self.names.get(prefix + f)
                    if i is not None:
                        row[role] += self.weights[i]
            self.sets[features] = len(self.rows)
            self.rows.append(row)
        return self.sets[features]

    def signed(self, key: tuple[str, str]) -> int:
        found = self.signatures.get(key)
        if found is None:
            if len(self.signatures) > CACHE_ENTRIES:
                self.signatures.clear()
            found = self.signatures[key] = self.set_of(word_features(*key))
        return found

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > CACHE_ENTRIES:
            known.clear()
        get = known.get
        out = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            if len(w) > LONG_WORD:
                out[i] = self.set_of(word_features(*signature(w)))
                continue
            if w not in known:
                known[w] = self.signed(signature(w))
            out[i] = known[w]
        return out

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        if self.scores.shape[1] != len(self.rows):
            self.scores = np.stack(self.rows, axis=1)
        out = self.scores[0][numbers]
        out[1:] += self.scores[1][numbers[:-1]]
        out[:-1] += self.scores[2][numbers[1:]]
        return out

    def forward(self, scores: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers and best totals by last label, from (words, labels, sequences) scores and first totals."""
        t, k, b = scores.shape
        back = np.zeros((t, k, b), dtype=np.int8)
        for i in range(1, t):
            new = np.empty_like(best)
            for j in range(k):
                top = best[0] + self.moves[0, j]
                for m in range(1, k):
                    other = best[m] + self.moves[m, j]
                    better = other > top
                    back[i, j][better] = m
                    np.maximum(top, other, out=top)
                new[j] = top
            best = new + scores[i]
        return back, best

    @staticmethod
    def backward(back: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(sequences, words) labels that end in ``last``."""
        t, _, b = back.shape
        labels = np.zeros((b, t), dtype=np.int8)
        labels[:, -1] = last
        rows = np.arange(b)
        for i in range(t - 1, 0, -1):
            labels[:, i - 1] = back[i, labels[:, i], rows]
        return labels

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of (sequences, words, labels) scores, all sequences side by side."""
        by_label = np.ascontiguousarray(scores.transpose(1, 2, 0))  # whole arrays for each label: no short axes
        back, best = self.forward(by_label, by_label[0].copy())
        return self.backward(back, best.argmax(axis=0))

    def viterbi_long(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of one long sequence: blocks step side by side from every label that may stand before them.

        The number of words is a multiple of ``BLOCK``. A block's best totals by (label before, last label) join
        to the next block's as matrices do, so the result is the best path of the whole.
        """
        k = scores.shape[1]
        blocks = np.ascontiguousarray(scores.reshape(-1, BLOCK, k).transpose(1, 2, 0))  # (words, labels, blocks)
        n = blocks.shape[2]
        runs = [self.forward(blocks, blocks[0] + self.moves[before][:, None]) for before in range(k)]
        best = self.forward(blocks[:, :, :1], blocks[0, :, :1])[1][:, 0]
        came = np.zeros((n, k), dtype=np.int8)
        for i in range(1, n):
            total = np.stack([best[before] + runs[before][1][:, i] for before in range(k)])
            came[i], best = total.argmax(axis=0), total.max(axis=0)
            best = best - best.max()
        last = np.zeros(n, dtype=np.int8)
        last[-1] = best.argmax()
        for i in range(n - 1, 0, -1):
            last[i - 1] = came[i, last[i]]
        labels = np.zeros((n, BLOCK), dtype=np.int8)
        before = np.r_[0, last[:-1]]
        for label in range(k):
            mine = np.flatnonzero(before == label)
            if len(mine):
                labels[mine] = self.backward(runs[label][0][:, :, mine], last[mine])
        first = self.forward(blocks[:, :, :1], blocks[0, :, :1])[0]
        labels[0] = self.backward(first, last[:1])[0]
        return labels.reshape(-1)

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of the words of each text, on the best path of the whole text."""
        sizes = [len(t) for t in texts]
        gap = np.full(1, self.empty)  # texts stand apart by an empty word
        parts = [gap]
        for t in texts:
            parts += [self.numbers(t), gap]
        numbers = np.concatenate(parts)
        scores = self.emissions(numbers)
        labels = np.zeros(len(numbers), dtype=np.int8)
        wall = np.zeros(len(numbers), dtype=bool)
        wall[np.r_[0, np.cumsum(np.array(sizes, dtype=np.int64) + 1)]] = True
        # what 'other' can lose in moves against another label, whatever stands beside it or if nothing does
        moves = self.moves
        loss = np.maximum((moves - moves[:, :1]).max(axis=0), 0) + np.maximum((moves - moves[:1]).max(axis=1), 0)
        # a word whose lead is over that is 'other' on every best path: such words part the text into runs that are decoded by themselves
        lead = (scores[:, :1] - scores[:, 1:] - loss[1:]).min(axis=1)
        opened = (lead <= 1e-3) & ~wall
        edges = np.flatnonzero(np.diff(np.r_[False, opened, False]))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            scores[starts] += np.where(wall[starts - 1], np.float32(0), np.float32(1))[:, None] * moves[0]
            # 'other' follows each run as filling; where nothing does, what the move to it adds is taken away
            scores[ends - 1] -= np.where(wall[ends], np.float32(1), np.float32(0))[:, None] * moves[:, 0]
            self.decode(scores, labels, starts, ends)
        out, at = [], 1
        for n in sizes:
            out.append(labels[at : at + n])
            at += n + 1
        return out

    def decode(self, scores: np.ndarray, labels: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Labels of the runs [start, end), each followed by 'other'; runs of about one length side by side."""
        filling = np.full(len(LABELS), -1e9, dtype=np.float32)
        filling[0] = 0
        lengths, width = ends - starts, 4
        while width <= BLOCK:  # one filling word at least
            mine = np.flatnonzero((lengths >= width // 2 if width > 4 else lengths > 0) & (lengths < width))
            for at in range(0, len(mine), STEP // width):
                some = mine[at : at + STEP // width]
                place = starts[some][:, None] + np.arange(width)[None, :]
                inside = place < ends[some][:, None]
                place = np.minimum(place, len(scores) - 1)
                found = self.viterbi(np.where(inside[:, :, None], scores[place], filling))
                labels[place[inside]] = found[inside]
            width *= 2
        for i in np.flatnonzero(lengths >= BLOCK).tolist():
            run = scores[starts[i] : ends[i]]
            run = np.concatenate([run, np.tile(filling, (BLOCK - len(run) % BLOCK, 1))])
            labels[starts[i] : ends[i]] = self.viterbi_long(run)[: lengths[i]]


def train(table: list[list[tuple[str, int]]], rounds: int = 120, rate: float = 0.25, penalty: float = 1e-5) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Weights that maximise the conditional likelihood (with a squared penalty), by Adam over the whole table."""
    names: dict[str, int] = {}
    longest = max(len(s) for s in table)
    width = 3 * max(len(word_features(*signature(w))) for s in table for w, _ in s)
    n, k = len(table), len(LABELS)
    index = np.zeros((n, longest, width), dtype=np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    gold = np.zeros((n, longest), dtype=np.int64)
    names["pad"] = 0
    for i, sentence in enumerate(table):
        features = [word_features(*signature(w)) for w, _ in sentence]
        for t, (_, label) in enumerate(sentence):
            found = [names.setdefault(role + f, len(names)) for role, at in zip(ROLES, (t, t - 1, t + 1)) if 0 <= at < len(sentence) for f in features[at]]
            index[i, t, : len(found)] = found
            mask[i, t], gold[i, t] = True, label
    weights, moves = np.zeros((len(names), k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    hot = np.eye(k)[gold] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)

    def norm(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        weights[0] = 0
        scores = weights[index].sum(axis=2)
        ahead = np.zeros((longest, n, k))
        ahead[0] = scores[:, 0]
        for t in range(1, longest):
            new = norm(ahead[t - 1][:, :, None] + moves, 1) + scores[:, t]
            ahead[t] = np.where(mask[:, t, None], new, ahead[t - 1])
        total = norm(ahead[-1], 1)
        behind = np.zeros((n, k))
        expected_moves = np.zeros((k, k))
        marginal = np.zeros((n, longest, k))
        for t in range(longest - 1, -1, -1):
            marginal[:, t] = np.exp(ahead[t] + behind - total[:, None]) * mask[:, t, None]
            if t:
                after = scores[:, t] + behind
                pair = np.exp(ahead[t - 1][:, :, None] + moves + after[:, None, :] - total[:, None, None]) * mask[:, t, None, None]
                expected_moves += pair.sum(axis=0)
                behind = np.where(mask[:, t, None], norm(moves + after[:, None, :], 2), behind)
        error = (hot - marginal).reshape(-1, k)
        slope = np.stack([np.bincount(index.reshape(-1), weights=np.repeat(error[:, j], width), minlength=len(names)) for j in range(k)], axis=1) / n - penalty * weights
        slope_moves = (gold_moves - expected_moves) / n - penalty * moves
        for at, (value, g) in enumerate(((weights, slope), (moves, slope_moves))):
            m, v = state[2 * at], state[2 * at + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return names, weights.astype(np.float32), moves.astype(np.float32)


def table_of(rows: DataFrame, most_words: int = 1_000_000) -> list[list[tuple[str, int]]]:
    """A labelled table for ``train`` from rows (sentence, place, word, label: a kind or 'other'); small by its meaning."""
    some = rows.select("sentence", "place", "word", "label").limit(most_words + 1).collect()
    if len(some) > most_words:
        raise ValueError(f"the labelled table has over {most_words} words")
    sentences: dict = {}
    for r in sorted(some, key=lambda r: (str(r.sentence), r.place)):
        sentences.setdefault(r.sentence, []).append((r.word, LABELS.index(r.label)))
    return list(sentences.values())


@cache
def trained() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    return train(labelled_table())


FORMS = (
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]+\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z]{2,}", re.I),
    re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    re.compile(r"(?<![0-9])[0-9]+(?:[\x20./-][0-9]+)*"),
    re.compile(r"(?<![0-9+])(?:1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)


AT = re.compile(r"@|[\[({<]at[\])}>]|\x20at\x20", re.I)
DOT = re.compile(r"\.|[\[({<]dot[\])}>]|\x20dot\x20", re.I)
IPV6 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
NUMBER = re.compile(r"[+(]?[0-9][0-9()\x20./-]*[0-9]")
EDGE_SIGNS = ".,;:!?\"'<>{}*#|"


def plausible(kind: int, run: str) -> bool:
    """The check of a kind for a whole run."""
    if kind == 0:
        at = [m.end() for m in AT.finditer(run)]
        return len(at) == 1 and DOT.search(run, at[0]) is not None and re.search("[A-Za-z]", run[at[0] :]) is not None
    if kind == 1:
        return IPV6.fullmatch(run) is not None and (run.count("::") == 1 or run.count(":") == 7 and "" not in run.split(":"))
    digits = only_digits(run)
    if not NUMBER.fullmatch(run):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15 and len(digits) < len(run)


def trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """[start, stop) without white space, signs and lone brackets at its edges."""
    while start < stop:
        run = text[start:stop]
        first, last = run[0], run[-1]
        if first.isspace() or first in EDGE_SIGNS or (first in "([" and run.count(first) > run.count(")]"["([".index(first)])):
            start += 1
        elif last.isspace() or last in EDGE_SIGNS or (last in ")]" and run.count(last) > run.count("(["[")]".index(last)])):
            stop -= 1
        else:
            break
    return start, stop


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places that the spans (sorted by start) cover, apart and in order."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def field_spans(text: str, labels: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the field's runs of one label add to the spans taken (sorted by start)."""
    places = [m.span() for m in WORD.finditer(text)]
    covered = merged(taken)
    starts = [s for s, _ in covered]
    found = []
    edges = np.flatnonzero(np.diff(np.r_[0, labels, 0])).tolist()
    for at, end in zip(edges, edges[1:]):
        if not labels[at]:
            continue
        kind, start, stop = int(labels[at]) - 1, places[at][0], places[end - 1][1]
        k = max(bisect_right(starts, start) - 1, 0)
        while start < stop:
            while k < len(covered) and covered[k][1] <= start:
                k += 1
            free = min(stop, covered[k][0]) if k < len(covered) else stop
            s, e = trimmed(text, start, max(start, free))
            if s < e:
                right = next((k for k in (kind, *range(len(KINDS))) if plausible(k, text[s:e])), None)
                if right is not None:
                    found.append((s, right, e))
                else:
                    found += [(s + m.start(), kind, s + m.end()) for m in FORMS[kind].finditer(text[s:e]) if kind != 2 or plausible(kind, m[0])]
            start = max(free, covered[k][1]) if k < len(covered) else stop
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_fields: list[Field] = []


def find(texts: list[str | None], model: tuple) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    if not _fields:
        _fields.append(Field(*model))
    words = [WORD.findall(t or "") for t in texts]
    out = []
    for text, labels in zip(texts, _fields[0].label(words)):
        base = base_spans(text or "")
        out.append((base, field_spans(text, labels, base) if labels.any() else []))
    return out


def detect(docs: DataFrame, model: tuple | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), n_added, base_sha256, spans."""
    model = model or trained()

    def batch(columns: dict) -> dict:
        out: dict = {"doc_id": columns["doc_id"], **{f"n_{k}": [] for k in KINDS}, "n_added": [], "base_sha256": [], "spans": []}
        for base, added in find(columns["text"], model):
            counts = [sum(k == n for _, k, _ in base) for n in range(4)]
            for name, value in zip(list(out)[1:], (*counts, len(added), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)))):
                out[name].append(value)
        return out

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_columns(rows, batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
