"""Exact quantiles of many latencies."""

import datetime as dt
import math

from pyspark.sql import functions as F

from chartlake.operators import sessions


def test_quantiles_of_many_latencies_are_exact(spark):
    many = spark.range(50_000).select((F.col("id") % 2).cast("string").alias("model"), F.timestamp_seconds(F.col("id") * 7 + 1_700_000_000).alias("ts"), (F.hash("id") % 40_000 / 7).alias("took"))
    odd = spark.createDataFrame([("none", dt.datetime(2024, 1, 1), None), (None, dt.datetime(2024, 1, 1), 3.0), (None, dt.datetime(2024, 1, 2), None)], "model string, ts timestamp, took double")
    got = {x["model"]: x for x in sessions.exact_quantiles(sessions.latency_counts(many.unionAll(odd), ["model"]), ["model"]).collect()}
    for m in ("0", "1"):
        values = sorted(x["took"] for x in many.where(F.col("model") == m).collect())
        assert got[m]["calls"] == len(values)
        assert [got[m][n] for n in sessions.QUANTILES] == [values[math.ceil(round(q * len(values), 7)) - 1] for q in sessions.QUANTILES.values()]
    assert tuple(got["none"])[1:] == (1, None, None, None)
    assert tuple(got[None])[1:] == (2, 3.0, 3.0, 3.0)
