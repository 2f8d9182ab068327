"""A corpus pipeline: toxicity, exact and near de-duplication, decontamination, packing.

Every stage takes the documents its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartlake.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from chartlake.llm.common import read_table, scratch
from chartlake.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaked(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_leaked), ("packing", pack)]

#: Compression lengths, samples of hashed k-mers and tokenizer ids have no SQL form; the tests hold brute-force versions.
ORACLE_SQL = None


def _after(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """What the first n stages keep. Their own tables, and those of the stages before, are removed once it is written."""
    if not n:
        return read_table(spark, sf_dir, "documents")
    with scratch() as keep:
        return keep(STAGES[n - 1][1](spark, _after(spark, sf_dir, n - 1), sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = len(STAGES) - 1
    return STAGES[last][1](spark, _after(spark, sf_dir, last), sf_dir)
