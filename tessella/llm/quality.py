"""Host-level quality rules.

Each document is measured once; documents that fail a rule are counted by host, hosts' failure rates are shrunk
towards the corpus rate with a beta prior fitted to all hosts by the method of moments, and a host whose shrunk
rate is over the limit is rejected with all its documents. Counts by host are combined before the shuffle, so a
host with a third of all rows is a few rows; verdicts are one row a host and join back by a plain equi-join,
which Spark broadcasts only while its measured size is small.

Rules of a document: the base rules (under 20 words; over 30 % of words in repeated windows of eight), symbols
over a tenth of the words, and over 30 % of the lines with a word equal to an earlier line.

Defined results: a null or empty text has no words and fails; a document without a host (null) is judged by its
own rules alone; repeated rows count each; without hosts, or where their rates don't vary, the prior's strength
is ``most_strength``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITESPACE, documents, fresh, map_columns, map_rows, small_batches, stage

SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS = 8, 20
#: A host is rejected when its shrunk rate of failing documents is over this.
HOST_LIMIT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window (of a power of two words) that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) == len(words):
        return 0
    width = 1
    while width < window:  # ids of 2-, 4-, 8-word windows from pairs of the ids before: exact, no hashing
        pairs = ids[: len(ids) - width] * (len(words) + 1) + ids[width:]
        _, ids = np.unique(pairs, return_inverse=True)
        width *= 2
    often = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(often), 1)
    np.add.at(covered, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the number of lines with a word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    white = len(data) - len(data.translate(None, WHITESPACE))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - white, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > 30 * n_words


def rule_fails(n_words: int, n_symbols: int, n_dup: int, n_repeat: int, n_lines: int) -> bool:
    return base_fails(n_words, n_repeat) or 10 * n_symbols > n_words or 10 * n_dup > 3 * n_lines


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    def batch(columns: dict) -> dict:
        rows = [measure(t) for t in columns["text"]]
        out = {name: [r[k] for r in rows] for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
        out |= {"doc_id": columns["doc_id"], "host": columns["host"], "base_failed": [base_fails(r[0], r[4]) for r in rows]}
        out["failed"] = [rule_fails(r[0], r[2], r[3], r[4], r[5]) for r in rows]
        return out

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(host_column).cast("string").alias("host"))
    return map_columns(rows, batch, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, failed boolean")


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_kept.

    With host rates r_i = f_i / n_i: m = sum f / sum n, v = sum n (r - m)^2 / sum n, strength = m (1 - m) / v - 1
    within fixed bounds, rate = (f + m strength) / (n + strength).
    """
    hosts = measured.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    totals = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"))
    m = F.col("f") / F.col("n")
    v = F.greatest(F.col("ff") / F.col("n") - m * m, F.lit(0.0))
    strength = F.coalesce(F.least(F.greatest(F.try_divide(m * (1 - m), v) - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH))
    prior = totals.where("n > 0").select(m.alias("m"), strength.alias("strength"))  # one row
    rate = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= limit).alias("host_kept"))


def judge(docs: DataFrame, limit: float = HOST_LIMIT, **columns: str) -> DataFrame:
    """Measures of each document, base_failed, host, host_rate and kept."""
    measured = stage(measures(docs, **columns), "quality-measures")
    # a table of its own: the join is broadcast where it is small, else Spark may split a host that holds many rows
    hosts = stage(host_verdicts(measured, limit).select("host", F.col("rate").alias("host_rate"), "host_kept"), "quality-verdicts")
    joined = measured.join(hosts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: without the documents that fail the base rules and those of rejected hosts.

    Null and empty texts fail (under 20 words); repeated rows and shared or null ids are judged row by row; a null
    source, or no such column, is no host; columns stay as they came, whatever they are called.
    """
    known = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    (host,) = fresh(docs, "host")
    rejected = stage(host_verdicts(measures(known.select("doc_id", "text", "source"))).where("NOT host_kept").select(F.col("host").alias(host)), "quality-hosts")
    at = docs.columns.index("text")

    def passing(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = (measure(t) for t in batch.column(at).to_pylist())
        return batch.filter(pa.array([not base_fails(r[0], r[4]) for r in rows], pa.bool_()))

    kept = map_rows(docs, passing)
    return kept.join(rejected, kept["source"].cast("string") == rejected[host], "left_anti") if known is docs else kept


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row_no, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, text FROM d
),
flat AS (SELECT row_no, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
grams AS (
  SELECT row_no, pos, count(*) OVER f AS width,
         string_agg(word, ' ') OVER f AS gram
  FROM flat
  WINDOW f AS (PARTITION BY row_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
),
twice AS (SELECT row_no, pos, width = 8 AND count(*) OVER (PARTITION BY row_no, gram, width) > 1 AS often FROM grams),
covered AS (SELECT row_no, max(often::INT) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeated AS (SELECT row_no, sum(hit)::BIGINT AS n FROM covered GROUP BY row_no),
lines AS (
  SELECT row_no, count(*)::BIGINT AS n, count(DISTINCT line)::BIGINT AS n_distinct
  FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no
),
m AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n - lines.n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM d JOIN w USING (row_no) LEFT JOIN repeated USING (row_no) LEFT JOIN lines USING (row_no)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
r AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM r WHERE source IS NOT NULL GROUP BY source),
p0 AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q FROM h),
p AS (SELECT m, CASE WHEN greatest(q - m * m, 0) > 0 THEN least(greatest(m * (1 - m) / greatest(q - m * m, 0) - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM p0),
v AS (SELECT source, (f + m * s) / (n + s) <= 0.5 AS host_kept FROM h, p)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_kept, TRUE) AS kept
FROM r LEFT JOIN v USING (source)
"""
