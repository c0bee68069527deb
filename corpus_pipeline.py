"""A corpus pipeline of five stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm._common import documents, stage
from tessella.llm.exact_dedup import drop_exact_copies
from tessella.llm.packing import pack_documents
from tessella.llm.quality import drop_low_quality
from tessella.llm.secrets import redact_secrets
from tessella.llm.simhash import drop_near_copies

STAGES = [
    ("quality_rules", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_documents),
]

#: SimHash components and byte-level BPE ids are beyond SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
