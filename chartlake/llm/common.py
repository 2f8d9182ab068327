"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.sources.staging import scratch, shared_dir, shared_path, staged

__all__ = ["documents_of", "fold_of", "mix", "read_table", "reshuffled", "scratch", "shared_dir", "shared_path", "slices", "staged"]

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reshuffled(df: DataFrame) -> DataFrame:
    """df dealt by all its columns.

    A join with an aggregate takes over the aggregate's partitions, and then a hot key of the other side cannot be split.
    With this step between, the join reads both sides from shuffles of its own, whose skewed partitions Spark splits.
    """
    return df.repartition(*df.columns)


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column can clash; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold_of(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), on unsigned arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """Cut record batches so that one slice holds about max_bytes of text at most (one longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
