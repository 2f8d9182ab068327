"""Structured Streaming forms of the log operators; each equals its batch form on closed sessions or windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chartlake.operators.sessions import SKETCH_K
from chartlake.streaming.ordered import replayed


def stream_sessions(events: DataFrame, ttl: str = "1 hour", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Closed sessions, in append mode behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), key).agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("last_seen")).drop("w")


def stream_spend(turns: DataFrame, key: str = "user_id") -> DataFrame:
    """Running tokens and turns per key, in update or complete mode."""
    return turns.groupBy(key).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(~F.col("failed")).alias("turns"))


def stream_usage(calls: DataFrame, by: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Closed tumbling windows, in append mode."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *by).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")).select(F.col("w.start").alias("window_start"), *by, "calls", "tokens_in", "tokens_out")


def stream_rollover(uploads: DataFrame, most: int = 2, key: str = "user_id") -> DataFrame:
    """Consultation number and notice of every upload of a key, with the count kept as state for good: for keys that end, as a session's id does."""

    def assign(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values("ts")
            at = range(n, n + len(f))
            n += len(f)
            yield pd.DataFrame({key: f[key].to_numpy(), "ts": f["ts"].to_numpy(), "consultation": [i // most for i in at], "notice": [i % most > 0 for i in at]})
        state.update((n,))

    return uploads.groupBy(key).applyInPandasWithState(assign, f"{key} long, ts timestamp, consultation long, notice boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def stream_session_rollover(uploads: DataFrame, most: int = 2, ttl: str = "1 hour", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Consultation number and notice of every upload in its session, in append mode behind the watermark.

    uploads: the key, ts, event_id. A session ends after an idle time strictly longer than the ttl, and its count expires with it. Equals ``rollover``
    over ``sessionize``d uploads for all rows that the watermark has passed; uploads of one time are taken by event_id.
    """

    def step(memory: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        n = memory[0] if memory else 0
        return (n + 1,), (row[0], row[2], n // most, n % most > 0)

    rows = uploads.withWatermark("ts", late).select(key, "ts", F.lit(0).alias("kind"), F.col("event_id").alias("id"), F.lit(0).alias("value"))
    return replayed(rows, [key], step, "n long", "event_id long, consultation long, notice boolean", ttl)


def stream_ground_turns(events: DataFrame, ttl: str = "1 hour", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Every turn with the latest analysis at or before it in its session, in append mode behind the watermark.

    events: the key, ts, event_id, analysis_id (null for a turn). Turns wait until the watermark has passed them, so an analysis that comes late
    still counts; of one time, analyses come before turns, and the one with the largest event_id is the latest. Analyses expire with their session.
    """

    def step(memory: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        if row[1] == 0:
            return (1, row[3]), None
        known = memory or (0, 0)
        return known, (row[0], row[2], known[1] if known[0] else None, known[0] == 1)

    rows = events.withWatermark("ts", late).select(key, "ts", F.when(F.col("analysis_id").isNull(), 1).otherwise(0).alias("kind"), F.col("event_id").alias("id"), F.col("analysis_id").alias("value"))
    return replayed(rows, [key], step, "known int, latest long", "event_id long, analysis_id long, grounded boolean", ttl)


def stream_session_spend(turns: DataFrame, ttl: str = "1 hour", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Tokens and turns of closed sessions, in append mode: a session's sums leave the state when it ends. A failed turn adds tokens but no turn."""
    return turns.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), key).agg(F.min("ts").alias("started"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(~F.col("failed")).alias("turns")).drop("w")


def stream_latency(calls: DataFrame, by: list[str], window: str = "1 hour", late: str = "1 hour", k: int = SKETCH_K) -> DataFrame:
    """Latency sketches of closed tumbling windows, in append mode; they merge as those of ``latency_sketches`` do."""
    per = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *by).agg(F.count("*").alias("calls"), F.kll_sketch_agg_double(F.col("took").cast("double"), F.lit(k)).alias("sketch"))
    return per.select(F.col("w.start").alias("window_start"), *by, "calls", "sketch")


def stream_latency_counts(calls: DataFrame, by: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls per latency of closed tumbling windows, in append mode, as ``latency_counts`` has them: the state holds a row per different latency."""
    per = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *by, F.col("took").cast("double").alias("took")).agg(F.count("*").alias("calls"))
    return per.select(F.col("w.start").alias("window_start"), *by, "took", "calls")
