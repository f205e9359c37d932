"""The corpus pipeline: clean, deduplicate, decontaminate, mix and tokenize all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, with any further columns that docs has, whatever their
names. Null texts are empty ones. An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontaminate, mixing, quality, simhash, token_files
from pagemill.llm.common import stored, table
from pagemill.llm.queries import END_ID, tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failed lines go, and documents that fail or lose too much, null and empty ones among them. Equal rows fare alike."""
    return quality.cleaned(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: one row of each group stays, that with the least doc_id (nulls last), also of equal rows and equal or null ids."""
    return simhash.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go, with all rows of their doc_id."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: rows come as often as the mix takes them, up to three times; a null source is a source."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, by ascending doc_id, nulls first, repeated ids each by itself; returns what is read back from them."""
    return token_files.encoded_and_read(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality rules", clean),
    ("near-dedup", deduplicate),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
    ("token files", tokenize),
]

#: Near-duplicate groups, the knapsack and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
