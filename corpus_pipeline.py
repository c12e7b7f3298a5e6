"""Documents to token files: clean, keep one of near copies, drop benchmark passages, mix, write token files.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. `run` writes each stage's rows to the shared folder and reads them
back, so a lost executor costs a re-read and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm.common import prepared, table, written
from flowspark.llm.decontaminate import without_passages
from flowspark.llm.mixing import mix
from flowspark.llm.near_copies import keep_one
from flowspark.llm.quality_lines import kept_documents
from flowspark.llm.token_files import default_tokenizer, read_token_files, write_token_files

# Near copies: shingles of so many words, so many hundredths of them common.
SHINGLE_WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    prepared(spark)
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id."""
    return keep_one(docs, width=SHINGLE_WORDS, percent=PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return without_passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    prepared(spark)
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: doc_id, start, n_tokens, ids_crc32 of each."""
    return read_token_files(write_token_files(docs.select("doc_id", "text"), default_tokenizer()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

# No SQL knows the tokenizer; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
