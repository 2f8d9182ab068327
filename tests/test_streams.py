"""Streams whose state expires, over several batches with late and equal times, against the batch forms; what is left in the state."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from chartlake.operators import sessions
from chartlake.streaming import consult, ordered

T = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    old = spark.conf.get(ordered.STORE)
    ordered.use_expiring_state(spark)
    yield
    spark.conf.set(ordered.STORE, old)


def events(n=160, seed=2):
    """Events in batches: times within a batch and up to 50 minutes between batches are out of order, some are equal."""
    r, rows = random.Random(seed), []
    for i in range(n):
        rows.append((r.randrange(4), T + dt.timedelta(minutes=10 * i + r.choice([0, 10, 30, 50])), i, i if r.random() < 0.3 else None))
    return [rows[:50], rows[50:51], rows[51:120], rows[120:]]


def run(spark, make, batches, schema, name):
    """The output of the stream over one file a batch, and the rows that its state holds at the end."""
    path, at = tempfile.mkdtemp(prefix="spark-stream-") + "/in", tempfile.mkdtemp(prefix="spark-stream-")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        q = make(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    kept = [s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"]]
    return spark.read.parquet(f"{at}/out"), sum(kept)


SCHEMA = "user_id long, ts timestamp, event_id long, analysis_id long"


def both_forms(spark, batches):
    rows = [r for b in batches for r in b]
    end = max(r[1] for r in rows)
    closing = [[(99, end + dt.timedelta(days=2), 10_000, None)], [(98, end + dt.timedelta(days=4), 10_001, None)]]
    return spark.createDataFrame(rows, SCHEMA), [*batches, *closing]


def test_grounding_in_sessions(spark):
    df, batches = both_forms(spark, events())
    got, kept = run(spark, lambda s: consult.stream_ground_turns(s, "40 minutes", "1 hour"), batches, SCHEMA, "ground")
    numbered = sessions.sessionize(df, "40 minutes")
    keys = ("user_id", "session_no")
    want = sessions.ground_turns(numbered.where("analysis_id is null"), numbered.where("analysis_id is not null"), keys)
    have = got.where("user_id < 98").select("user_id", "event_id", "ts", "analysis_id", "grounded")
    assert sorted(map(str, have.collect())) == sorted(map(str, want.select(*have.columns).collect()))
    assert have.where("grounded").count() > 5 and have.where("not grounded").count() > 5
    assert kept < 8  # of the last key only: its waiting row, its timer


def test_rollover_in_sessions(spark):
    df, batches = both_forms(spark, events(seed=7))
    got, kept = run(spark, lambda s: consult.stream_session_rollover(s, 2, "40 minutes", "1 hour"), batches, SCHEMA, "roll")
    plain, n = [], {}
    last = {}
    for u, ts, e, _ in sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1], r[2])):
        n[u] = n.get(u, -1) + 1 if u in last and ts <= last[u] + dt.timedelta(minutes=40) else 0
        last[u] = ts
        plain.append((u, e, ts, n[u] // 2, n[u] % 2 > 0))
    have = got.where("user_id < 98").select("user_id", "event_id", "ts", "consultation", "notice")
    assert sorted(map(tuple, have.collect())) == sorted(plain)
    assert kept < 8


def test_spend_and_latency_of_closed_windows(spark):
    r = random.Random(4)
    rows = [(u, t, e, 10 * e, e, e % 3 == 0, float(r.randrange(90))) for b in events() for u, t, e, _ in b]
    schema = "user_id long, ts timestamp, event_id long, tokens_in long, tokens_out long, failed boolean, took double"
    df = spark.createDataFrame(rows, schema)
    closing = [(99, max(x[1] for x in rows) + dt.timedelta(days=2), 0, 0, 0, False, None)]
    got, _ = run(spark, lambda s: consult.stream_session_spend(s, "40 minutes"), [rows, closing], schema, "spend")
    want = sessions.sessionize(df, "40 minutes").groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(~F.col("failed")).alias("turns")).drop("session_no")
    # minutes are whole and the ttl is 40: a window that ends where the next begins parts rows 40 minutes apart, so users' sums are compared
    sums = lambda d: {x["user_id"]: tuple(x[1:]) for x in d.groupBy("user_id").agg(*[F.sum(c) for c in ("tokens_in", "tokens_out", "turns")]).collect()}
    assert sums(got.where("user_id < 98")) == sums(want)
    assert got.where("user_id < 98").count() >= want.count()
    hours, _ = run(spark, lambda s: consult.stream_latency(s, ["user_id"]), [rows, closing], schema, "latency")
    have = sessions.latency_quantiles(hours).where("user_id < 98")
    batch = sessions.latency_quantiles(sessions.latency_sketches(df, ["user_id"]))
    assert sorted(map(tuple, have.collect())) == sorted(map(tuple, batch.select(*have.columns).collect()))


def test_a_key_costs_no_calls_of_its_own(spark):
    """Values beyond doubles stay whole; the state of a key is one row, whatever it has waiting and remembers."""
    rows = [(u, T + dt.timedelta(minutes=i), 10 * u + i, 2**53 + 1 if i == 0 else None) for u in range(300) for i in range(4)]
    closing = [(999, T + dt.timedelta(hours=1, minutes=2), 9999, None)]
    got, kept = run(spark, lambda s: consult.stream_ground_turns(s, "40 minutes", "1 hour"), [rows, closing], SCHEMA, "many")
    want = {(u, 10 * u + i, T + dt.timedelta(minutes=i), 2**53 + 1, True) for u in range(300) for i in (1, 2)}
    assert {tuple(r) for r in got.select("user_id", "event_id", "ts", "analysis_id", "grounded").collect()} == want
    assert kept == 301
