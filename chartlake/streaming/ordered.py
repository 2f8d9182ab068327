"""Keyed streams replayed in event order, with state that expires.

Rows of a key wait until the watermark has passed them and are then handled in order, so late rows (within the watermark's delay) and equal
times give what the batch form gives. A key that has been idle for the time to live loses its state. The session needs RocksDB as its
state store (``use_expiring_state``), which keeps states on the executors' disks and their changes in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What waits, as whole numbers: microseconds, the order among equal times, an id, 1 where there is a value, and the value or 0.
WAITING = 5


def use_expiring_state(spark: SparkSession) -> None:
    """Queries started after this keep their states in RocksDB."""
    spark.conf.set(STORE, ROCKSDB)


def in_order(step: Callable[[tuple | None, tuple], tuple[tuple, tuple | None]], n_memory: int, output: list[str], ttl: int) -> Callable:
    """The function of a key that hands its rows to ``step`` in the order (at, kind, id), once the watermark has passed them.

    step(memory, row) -> (memory, output row or None) sees the key's memory, a tuple of longs or None at first or after it expired.
    A task holds what one key has waiting: its rows of the watermark's delay. One timer a key: at its earliest waiting row, or, where none
    waits, at the end of its time to live. State comes and goes with the rows, many keys at once, so a key costs no calls of its own.
    """

    def replay(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        kept, memory = None, None
        if state.exists:
            kept, at, *known = state.get
            memory = None if at is None else (at, *known)
        new = [np.stack(f["row"].to_numpy()) for f in frames if len(f)]
        waiting = np.concatenate([np.frombuffer(kept or b"", np.int64).reshape(-1, WAITING), *new])
        waiting = waiting[np.lexsort((waiting[:, 2], waiting[:, 1], waiting[:, 0]))]
        ready = int(np.searchsorted(waiting[:, 0], passed, side="right"))
        out = []
        for at, kind, i, some, value in waiting[:ready].tolist():
            if memory and at > memory[0] + ttl:
                memory = None
            after, result = step(memory and memory[1:], (at, kind, i, value if some else None))
            memory = (at, *after)
            if result is not None:
                out.append((*key, *result))
        rest = waiting[ready:]
        if memory and memory[0] + ttl < passed:
            memory = None
        if len(rest) or memory:
            state.update((rest.tobytes(), *(memory or (None,) * (n_memory + 1))))
            # a timer goes off behind its millisecond: that before the one in which the row is passed
            wake = int(rest[0, 0]) if len(rest) else memory[0] + ttl + 1
            state.setTimeoutTimestamp(max(-(-wake // 1000) - 1, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=output, dtype=object)

    return replay


def replayed(df: DataFrame, keys: list[str], step: Callable, memory: str, output: str, ttl: str) -> DataFrame:
    """The step's output rows (keys, at and what output names) in append mode.

    df: keys, ts with its watermark, kind, id, value. An output row has at (microseconds) as its first value.
    """
    spark = df.sparkSession
    ttl_us = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {ttl})").head()[0]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "at long", output])
    names = [c.split()[0] for c in schema.split(", ")]
    value = F.col("value").cast("long")
    row = [F.unix_micros("ts"), F.col("kind").cast("long"), F.col("id").cast("long"), value.isNotNull().cast("long"), F.coalesce(value, F.lit(0).cast("long"))]
    rows = df.select(*keys, "ts", F.array(*row).alias("row"))
    replay = in_order(step, len(memory.split(", ")), names, ttl_us)
    out = rows.groupBy(*keys).applyInPandasWithState(replay, schema, f"waiting binary, at long, {memory}", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("ts", F.timestamp_micros("at")).drop("at")


def drained(stream: DataFrame, what: str = "stream") -> DataFrame:
    """What the stream gives on all that its source holds now, in append mode, with sink and checkpoint in the shared folder."""
    from chartlake.sources.staging import shared_path

    spark = stream.sparkSession
    out, state = shared_path(spark, what), shared_path(spark, f"{what}-state")
    old = spark.conf.get(STORE)
    use_expiring_state(spark)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, old)
    return spark.read.schema(stream.schema).parquet(out)
