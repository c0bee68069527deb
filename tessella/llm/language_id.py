"""Language identification by a bidirectional gated recurrent network over bytes.

Texts, lower-cased in ASCII, are cut into windows of ``WIDTH`` bytes; a forward and a backward gated unit read
each window and label every position. A document's probabilities are the mean over all its positions. Windows
are of one length, so thousands of them from many documents step side by side in numpy, whole texts in bounded
memory.

The network is trained in numpy by backpropagation through time (Adam) on the driver from a bounded sample of
windows: at most ``SAMPLE_DOCS`` labelled documents of the training folds for each language, those with the
smallest hashes of their ids, and ``SAMPLE_WINDOWS`` windows of each: its padded end, as prediction cuts it, and
others at places drawn over the whole text. Every language is learned; all share ``WINDOW_BUDGET`` windows, so
many languages have fewer each, but one at least. Repeated rows count once, and texts without a letter, which are
``und`` in any case, not at all. The bounds are parameters. Language, source and id of a document are never inputs.

Defined results: a null text and one without a letter are ``und`` with score 0; without labelled training
documents all are ``und``; repeated rows are predicted alike; ties go to the label that sorts first; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import LOWER, crc_fold, documents, map_columns, small_batches

WIDTH, HIDDEN = 64, 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
WINDOW_BUDGET = 102_400
#: Labels up to which blocks have their full size; more labels make them smaller, so that memory stays bounded.
FULL_LABELS = 64
ASCII_LETTER = re.compile("[A-Za-z]")
UNDETERMINED = "und"


def block_size(full: int, labels: int) -> int:
    return max(1, min(full, full * FULL_LABELS // max(labels, 1)))


class Network:
    """Both directions in one state: columns are (forward, backward) for each of update, reset, candidate."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        h = hidden
        scale = 1 / np.sqrt(h)
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)),  # by direction and byte, biases included
            "u": rng.uniform(-scale, scale, (2, h, 3 * h)),
            "c": np.zeros((2, h)),  # inside the reset gate
            "w": rng.normal(0, 0.3, (2 * h, len(labels))),
            "b": np.zeros(len(labels)),
        }

    def run(self, data: np.ndarray, keep: bool = False):
        """Logits of every position of (windows, width) bytes; with what training needs."""
        p, h = self.p, self.hidden
        n, width = data.shape
        states = np.zeros((2, width + 1, n, h), dtype=p["x"].dtype)
        kept = []
        for d in (0, 1):
            u, c, table = p["u"][d], p["c"][d], p["x"][d]
            state = states[d, 0]
            for t in range(width):
                column = data[:, t if d == 0 else width - 1 - t]
                x = table[column]
                y = state @ u
                gates = 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + y[:, : 2 * h])) + 0.5
                update, reset = gates[:, :h], gates[:, h:]
                inner = y[:, 2 * h :] + c
                candidate = np.tanh(x[:, 2 * h :] + reset * inner)
                if keep:
                    kept.append((column, gates, inner, candidate))
                state = candidate + update * (state - candidate)
                states[d, t + 1] = state
        both = np.concatenate([states[0, 1:], states[1, :0:-1]], axis=2)  # (width, n, 2h)
        return both @ p["w"] + p["b"], both, states, kept

    def slopes(self, data: np.ndarray, gold: np.ndarray, weight: np.ndarray, used: np.ndarray | None = None) -> tuple[float, dict]:
        """Loss and its slopes; with ``used``, over the first positions of each window only."""
        p, h = self.p, self.hidden
        n, width = data.shape
        spread = np.tile(weight, (width, 1))
        if used is not None:
            spread *= np.arange(width)[:, None] < used
        spread /= spread.sum()
        logits, both, states, kept = self.run(data, keep=True)
        logits -= logits.max(axis=2, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=2, keepdims=True)
        rows = np.arange(n)
        loss = -(np.log(share[:, rows, gold] + 1e-12) * spread).sum()
        share[:, rows, gold] -= 1
        error = share * spread[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"] = np.tensordot(both, error, axes=([0, 1], [0, 1]))
        g["b"] = error.sum(axis=(0, 1))
        into = error @ p["w"].T
        for d in (0, 1):
            u = p["u"][d]
            carry = np.zeros((n, h))
            for t in range(width - 1, -1, -1):
                column, gates, inner, candidate = kept[d * width + t]
                before = states[d, t]
                carry = carry + into[t if d == 0 else width - 1 - t][:, d * h : (d + 1) * h]
                update, reset = gates[:, :h], gates[:, h:]
                to_candidate = carry * (1 - update) * (1 - candidate**2)
                to_update = carry * (before - candidate) * update * (1 - update)
                to_reset = to_candidate * inner * reset * (1 - reset)
                to_x = np.concatenate([to_update, to_reset, to_candidate], axis=1)
                to_y = np.concatenate([to_update, to_reset, to_candidate * reset], axis=1)
                np.add.at(g["x"][d], column, to_x)
                g["u"][d] += before.T @ to_y
                g["c"][d] += to_y[:, 2 * h :].sum(axis=0)
                carry = carry * update + to_y @ u.T
        return loss, g

    def fit(self, data: np.ndarray, gold: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.01, seed: int = 3, used: np.ndarray | None = None) -> Network:
        rng = np.random.default_rng(seed)
        counts = np.bincount(gold, minlength=len(self.labels))
        weights = (len(gold) / np.maximum(counts, 1) / len(self.labels))[gold]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        batch = block_size(batch, len(self.labels))
        steps = max(1, epochs * -(-len(data) // batch))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(data), batch):
                mine = order[at : at + batch]
                _, g = self.slopes(data[mine], gold[mine], weights[mine], None if used is None else used[mine])
                step += 1
                size = np.sqrt(sum((x**2).sum() for x in g.values()))
                for k in self.p:
                    x = g[k] * min(1, 1 / (size + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def small(self) -> Network:
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        return self

    def stepped(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities (labels, width, windows): both directions side by side, in place, gates by halved tanh."""
        p, h = self.p, self.hidden
        n, width = data.shape
        kind = p["x"].dtype
        gate_x, gate_u = 0.5 * p["x"][:, :, : 2 * h], 0.5 * p["u"][:, :, : 2 * h]
        near_x, near_u, near_c = p["x"][:, :, 2 * h :].copy(), 0.5 * p["u"][:, :, 2 * h :], 0.5 * p["c"][:, None, :]
        gate_x, gate_u = np.ascontiguousarray(gate_x), np.ascontiguousarray(gate_u)
        columns = np.ascontiguousarray(data.T).astype(np.intp)
        states = np.empty((width + 1, 2, n, h), dtype=kind)
        states[0] = 0
        gates, x_gates = np.empty((2, n, 2 * h), kind), np.empty((2, n, 2 * h), kind)
        near, x_near = np.empty((2, n, h), kind), np.empty((2, n, h), kind)
        for t in range(width):
            state, new = states[t], states[t + 1]
            for d, column in ((0, columns[t]), (1, columns[width - 1 - t])):
                np.take(gate_x[d], column, axis=0, out=x_gates[d], mode="clip")
                np.take(near_x[d], column, axis=0, out=x_near[d], mode="clip")
            np.matmul(state, gate_u, out=gates)
            gates += x_gates
            np.tanh(gates, out=gates)
            gates += 1
            np.matmul(state, near_u, out=near)
            near += near_c
            near *= gates[:, :, h:]
            near += x_near
            np.tanh(near, out=near)
            np.subtract(state, near, out=new)
            new *= gates[:, :, :h]
            new *= 0.5
            new += near
        forward, backward = states[1:, 0].reshape(-1, h), states[:0:-1, 1].reshape(-1, h)
        out = p["w"][:h].T @ forward.T
        out += p["w"][h:].T @ backward.T
        out += p["b"][:, None]
        out -= out.max(axis=0)
        np.exp(out, out=out)
        out /= out.sum(axis=0)
        return out.reshape(len(self.labels), width, n)

    def shares(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities (windows, width, labels) of every position."""
        block = block_size(1024, len(self.labels))
        return np.concatenate([self.stepped(data[at : at + block]).transpose(2, 1, 0) for at in range(0, len(data), block)])

    def totals(self, data: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Label probabilities summed over the first ``used`` positions of each window."""
        parts = []
        block = block_size(1024, len(self.labels))
        for at in range(0, len(data), block):
            shares = self.stepped(data[at : at + block])
            shares *= np.arange(data.shape[1])[:, None] < used[at : at + block]
            parts.append(shares.sum(axis=1).T)
        return np.concatenate(parts)


def windows_of(data: bytes, width: int = WIDTH) -> np.ndarray:
    count = -(-len(data) // width)
    return np.frombuffer(data.ljust(count * width, b" "), dtype=np.uint8).reshape(count, width)


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def pooled(texts: list[str | None], net: Network | None, most_windows: int = 16384) -> list[tuple[str, float]]:
    """Label and score of each text; windows of many texts step together, at most ``most_windows`` at once."""
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if net is None:
        return out
    most_windows = block_size(most_windows, len(net.labels))
    sums = np.zeros((len(texts), len(net.labels)))
    sizes = np.zeros(len(texts))
    waiting: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not held:
            return
        data, owner = np.concatenate(waiting), np.concatenate(owners)
        total = net.totals(data[:, :WIDTH], data[:, WIDTH].astype(np.int64) + 1)  # the last column: positions that are text, less one
        for k in range(len(net.labels)):
            sums[:, k] += np.bincount(owner, weights=total[:, k], minlength=len(texts))
        waiting.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        if not has_letter(text):
            continue
        data = lowered(text)
        sizes[i] = len(data)
        cut = windows_of(data)
        last = np.full((len(cut), 1), WIDTH - 1, dtype=np.uint8)
        last[-1] = (len(data) - 1) % WIDTH
        cut = np.concatenate([cut, last], axis=1)
        for at in range(0, len(cut), most_windows):
            part = cut[at : at + most_windows]
            if held + len(part) > most_windows:
                flush()
            waiting.append(part)
            owners.append(np.full(len(part), i))
            held += len(part)
    flush()
    for i in np.flatnonzero(sizes).tolist():
        share = sums[i] / sizes[i]
        best = int(share.argmax())
        out[i] = net.labels[best], float(min(1.0, share[best]))
    return out


def training_windows(docs: DataFrame, folds: int, held: int, sample_docs: int, sample_windows: int, id_column: str, text_column: str, label_column: str, window_budget: int = WINDOW_BUDGET) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows (WIDTH bytes), their positions that are text, and labels; every label has its share of the budget."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & (crc_fold("id", folds) != held))
    languages = rows.select("label").distinct().count()
    share = max(1, min(sample_docs * sample_windows, window_budget // max(languages, 1)))
    sample_windows = min(sample_windows, share)
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumns({"order": F.xxhash64("id", F.octet_length("text")), "mark": F.xxhash64("text")})
    by_label = Window.partitionBy("label").orderBy("order", "mark")
    # the chosen few by their hashes alone: texts are not sorted, and repeated rows are one
    hashes, most = rows.select("label", "order", "mark").distinct(), share // sample_windows
    # a bound first, from a sketch of each label's hashes that partial aggregates merge: about four times the wanted at most
    # (or a few ten thousandths of the label) are numbered, wherever a third of all rows may lie
    parts = [2.0**-k for k in range(14)]
    sketch = hashes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("order", parts, 10_000).alias("at"))
    enough = F.greatest(F.lit(0), F.least(F.lit(13), F.floor(-F.log2(2.0 * most / F.col("n") + 2e-4)))).cast("int")
    bounds = sketch.select("label", F.element_at("at", enough + 1).alias("bound"), (enough == 0).alias("whole"))
    hashes = hashes.join(bounds, "label").where(F.col("whole") | (F.col("order") <= F.col("bound"))).drop("bound", "whole")
    chosen = hashes.withColumn("k", F.row_number().over(by_label)).where(F.col("k") <= most).drop("k")

    def draw(columns: dict) -> dict:
        out: dict = {"label": [], "place": [], "body": [], "used": []}
        for i, text, label in zip(columns["id"], columns["text"], columns["label"]):
            data = lowered(text)
            rng = np.random.default_rng(zlib.crc32(str(i).encode()))
            places = rng.integers(0, max(len(data) - WIDTH, 0) + 1, sample_windows).tolist()
            if sample_windows > 1:
                places[-1] = (len(data) - 1) // WIDTH * WIDTH
            for k, at in enumerate(places):
                body = data[at : at + WIDTH]
                out["label"].append(label)
                out["place"].append(f"{i}:{k}")
                out["body"].append(body.ljust(WIDTH, b" "))
                out["used"].append(len(body))
        return out

    small_batches(docs.sparkSession)
    few = rows.join(F.broadcast(chosen), ["label", "order", "mark"], "left_semi").select("id", "text", "label")
    # repeated rows draw the same windows
    drawn = map_columns(few, draw, "label string, place string, body binary, used int").distinct().orderBy("label", "place", "body").collect()
    data = np.frombuffer(b"".join(bytes(r.body) for r in drawn), dtype=np.uint8).reshape(-1, WIDTH)
    return data, np.array([r.used for r in drawn], dtype=np.int64), [r.label for r in drawn]


def train(docs: DataFrame, folds: int = 5, held: int = 0, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, epochs: int = 10, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", window_budget: int = WINDOW_BUDGET) -> Network | None:
    data, used, labels = training_windows(docs, folds, held, sample_docs, sample_windows, id_column, text_column, label_column, window_budget)
    if not labels:
        return None
    names = sorted(set(labels))
    index = {x: i for i, x in enumerate(names)}
    return Network(names).fit(data, np.array([index[x] for x in labels]), epochs=epochs, used=used).small()


def predict(docs: DataFrame, net: Network | None, folds: int = 5, held: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score. One scan, no shuffle."""

    def batch(columns: dict) -> dict:
        found = pooled(columns["text"], net)
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("held_out", crc_fold("doc_id", folds) == held)
    return map_columns(rows, batch, "doc_id long, held_out boolean, lang_pred string, score double")


def position_labels(texts: list[str | None], net: Network) -> list[list[tuple[str, int, int]]]:
    """Runs (label, start, end) of equal labels over the positions (bytes) of each text."""
    out = []
    for text in texts:
        data = lowered(text or "")
        best = net.shares(windows_of(data)).argmax(axis=2).reshape(-1)[: len(data)] if data else np.zeros(0, int)
        cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else [0]
        out.append([(net.labels[best[a]], a, b) for a, b in zip(cuts, cuts[1:])])
    return out


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs))
