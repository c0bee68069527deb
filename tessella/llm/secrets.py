"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A run of 16 or more key characters with letters is a candidate; where base spans cover part of it, each
rest of that length is one. Text of any language packs several characters into a token of a public vocabulary, a
random string few: under ``MOST_CHARS`` characters a token (``MOST_CHARS_SHORT`` under 20 characters or without a digit) the
candidate is reported, unless it is a known kind of digest or identifier (hex of a digest's length, a UUID, a name with a
number, words of one case, numbers alone). Where the whole isn't reported, its parts between separators are tested alike.

Base kinds are those of the contract; their spans are whole matches in code points. One scan, no shuffle.
All patterns take linear time on long runs.

Defined results: a null or empty text has no spans; very long texts are scanned whole; repeated rows each get
their row; spans that start together are ordered by kind as listed, found ones last; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, map_columns, map_rows, small_batches

KINDS = ("assign", "access", "hex", "random")


def either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile(f"""({either_case("password")}|{either_case("passwd")}|{either_case("secret")}|{either_case("token")}|{either_case("api")}_?{either_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
LEAST = 16
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PART = re.compile("[A-Za-z0-9+]{%d,}" % LEAST)
#: Hex lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile("[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
HEX_ONLY = re.compile("[0-9A-Fa-f]+")
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: Words and numbers joined by signs: file names, paths, slugs, dates.
#: A part matches one alternative only, so a run is read once.
NAME = re.compile("[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[+/_=-]*|(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]+")
#: Characters a token; prose of the four languages is over 2.2, base-62 noise at 1.3 to 1.7.
MOST_CHARS = 2.0
#: The same for runs of under ``SHORT`` characters and for letters alone: under 1.75, 99.5 % of random base-62 runs of 16 to 19
#: characters (93.5 % in lower case) are found, and 9 of 166 such words in Python library files, two of them keys.
MOST_CHARS_SHORT, SHORT = 1.75, 20


@cache
def ranks_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(run: str) -> int:
    import public_tokenizers as P

    return len(ranks_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end)."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def apart(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of [start, end) the sorted places don't cover."""
    out = []
    for s, e in taken:
        if s > start:
            out.append((start, min(s, end)))
        start = max(start, e)
        if start >= end:
            return out
    return [*out, (start, end)]


def is_random(run: str, most_chars: float, most_chars_short: float) -> bool:
    if len(run) < LEAST or not LETTER.search(run) or NAME.fullmatch(run):
        return False
    if UUID.fullmatch(run) or len(run) in DIGESTS and HEX_ONLY.fullmatch(run):
        return False
    strict = len(run) < SHORT or not DIGIT.search(run)
    return len(run) < (most_chars_short if strict else most_chars) * token_count(run)


def random_spans(text: str, taken: list[tuple[int, int, int]], most_chars: float = MOST_CHARS, most_chars_short: float = MOST_CHARS_SHORT) -> list[tuple[int, int, int]]:
    found, base, at = [], sorted((s, e) for s, _, e in taken), 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        end = at
        while end < len(base) and base[end][0] < m.end():
            end += 1
        for start, stop in apart(m.start(), m.end(), base[at:end]):
            run = text[start:stop]
            if is_random(run, most_chars, most_chars_short):
                found.append((start, 3, stop))
            else:
                found += [(start + part.start(), 3, start + part.end()) for part in PART.finditer(run) if part[0] != run and is_random(part[0], most_chars, most_chars_short)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, most_chars: float = MOST_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""

    def batch(columns: dict) -> dict:
        out: dict = {"doc_id": columns["doc_id"], **{k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}}
        for text in columns["text"]:
            base = base_spans(text or "")
            more = random_spans(text or "", base, most_chars)
            counts = [sum(k == n for _, k, _ in base) for n in range(3)]
            for name, value in zip(list(out)[1:], (*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))):
                out[name].append(value)
        return out

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_columns(rows, batch, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each group of overlapping spans replaced by a mark."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for start, _, end in sorted(base + random_spans(text, base)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: every document stays; its secrets are masked and n_chars counted anew where it has one."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch.column(at).to_pylist()
        after = [redacted(t) for t in before]
        columns = batch.columns
        columns[at] = pa.array(after, batch.schema.field(at).type)
        if size is not None:
            sizes = [len(b) if a != b else n for a, b, n in zip(before, after, batch.column(size).to_pylist())]
            columns[size] = pa.array(sizes, batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, mask)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
