"""URL filter as a sort-merge range join.

A host's canonical key is its characters reversed, with a dot at the end: the hosts that a rule's host covers
are then one interval of keys, those that its key is a prefix of, and intervals of two rules are nested or
apart. URLs are range-partitioned and sorted by key (ties by id, so one hot host or URL spreads over many
partitions), the rules are sorted too, and one sweep along both keeps a stack of the rules whose interval holds
the current key. Of the stacked rules whose path starts the URL's path, the longest wins.

At most ``RULES_A_SWEEP`` rules are in a worker's memory at once; a longer list is swept in parts, each improving
on the last, so no size of list is refused or cut.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; without a rule the
verdict is ``allow``; rules tie by length in favour of the longer host, equal rules in favour of ``block``;
repeated rows each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
RULES_A_SWEEP = 200_000
DEFAULT = "allow"


def canonical(host: str) -> str:
    return host[::-1] + "."


class Sweep:
    """The sorted rules, and the stack of those whose interval holds the last key."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        hosts: dict[str, dict[str, str]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: r[0], reverse=True):  # block over allow
            hosts.setdefault(canonical(host), {}).setdefault(path, verdict) if verdict != "block" else hosts.setdefault(canonical(host), {}).__setitem__(path, verdict)
        self.keys = sorted(hosts)
        self.paths = [sorted(((p, v) for p, v in hosts[k].items()), key=lambda x: -len(x[0])) for k in self.keys]
        self.index = [({p: v for p, v in x}, sorted({len(p) for p, _ in x}, reverse=True)) for x in self.paths]
        self.next = 0
        self.stack: list[int] = []

    def move(self, key: str) -> None:
        """Keys come in ascending order."""
        keys, stack = self.keys, self.stack
        while self.next < len(keys) and keys[self.next] <= key:
            while stack and not keys[self.next].startswith(keys[stack[-1]]):
                stack.pop()
            stack.append(self.next)
            self.next += 1
        while stack and not key.startswith(keys[stack[-1]]):
            stack.pop()

    def best(self, path: str) -> tuple[int, int, str, str] | None:
        """(length, host length, rule, verdict)."""
        found = None
        for at in reversed(self.stack):
            paths, lengths = self.index[at]
            n = len(self.keys[at]) - 1
            for size in lengths:
                if size <= len(path) and (verdict := paths.get(path[:size])):
                    if found is None or (n + size, n) > found[:2]:
                        found = (n + size, n, self.keys[at][-2::-1] + path[:size], verdict)
                    break
        return found


def split_url(url: str = "url") -> tuple:
    """Columns host and path."""
    rest = F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) ELSE '' END")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER_CASE), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url", default: str = DEFAULT, rules_a_sweep: int = RULES_A_SWEEP) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"))
    host, path = split_url()
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat(F.reverse("host"), F.lit(".")))
    rows = rows.repartitionByRange("key", "page_id").sortWithinPartitions("key")
    rows = rows.select("page_id", "host", "path", "key", F.lit(0).alias("size"), F.lit(0).alias("host_size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    ordered = sorted(rules, key=lambda r: canonical(r[1]))
    for at in range(0, len(ordered), rules_a_sweep):
        rows = swept(rows, ordered[at : at + rules_a_sweep])
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def swept(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(rules)
        for batch in batches:
            columns = batch.to_pydict()
            for i, (key, path) in enumerate(zip(columns["key"], columns["path"])):
                sweep.move(key)
                found = sweep.best(path)
                if found and (found[0], found[1], found[3] == "block") > (columns["size"][i], columns["host_size"][i], columns["verdict"][i] == "block"):
                    columns["size"][i], columns["host_size"][i], columns["rule"][i], columns["verdict"][i] = found
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in batch.schema], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP10_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT row_number() OVER () AS row_no, page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
p AS (
  SELECT row_no, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
f AS (
  SELECT p.row_no, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.row_no ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.row_no = f.row_no AND f.k = 1
"""
