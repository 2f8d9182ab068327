"""Running sums and numbers over range partitions, against windows over whole groups."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.operators import scan, sessions, vectors


def rows(spark, n, hot=0.5, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(None if i % 41 == 0 else "hot" if r.random() < hot else f"k{r.randrange(9)}", r.randrange(50), i, None if i % 17 == 0 else r.randrange(-5, 100), r.random() < 0.2) for i in range(n)], "k string, ts int, id long, v int, failed boolean").repartition(6)


@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sums_by_key(spark, hot, inclusive):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = rows(spark, 500, hot)
        w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count("v").over(w).alias("n"))
        got = scan.running(df, {"s": "v", "n": F.col("v").isNotNull().cast("int")}, ["ts", "id"], ("k",), inclusive)
        assert sorted(map(tuple, got.select("id", "s", "n").collect())) == sorted(map(tuple, want.collect()))
        assert got.columns == [*df.columns, "s", "n"]
        parts = [x["ts"] for x in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("ts")).collect()]
        assert max(parts) < 400  # no task holds the hot key
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_all_rows(spark):
    df = rows(spark, 300)
    want, total = {}, 0
    for r in sorted(df.collect(), key=lambda r: (r["ts"], -r["id"])):
        total += r["v"] or 0
        want[r["id"]] = total
    got = scan.running(df, {"s": "v"}, ["ts", F.desc("id")])
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_numbers_and_nothing(spark):
    df = rows(spark, 200)
    assert [r["id"] for r in scan.numbered(df.select("id"), [F.desc("id")], "no").orderBy("no").collect()] == list(range(199, -1, -1))
    none = df.where("false")
    assert scan.numbered(none, ["id"], "no").count() == 0
    assert scan.running(none, {"s": "v"}, ["id"], ("k",)).count() == 0
    assert scan.running(none, {"s": "v"}, ["id"]).count() == 0
    ids = vectors.stable_ids(spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "chunk_id string, x int")).orderBy("id").collect()
    assert [tuple(r) for r in ids] == [("a", 2, 0), ("b", 1, 1), ("c", 3, 2)]


def test_admission_by_replay(spark):
    df = rows(spark, 400).selectExpr("coalesce(k, '-') AS user_id", "ts", "id AS event_id", "abs(coalesce(v, 0)) AS tokens", "failed")
    spent, per, turns, want = 0, {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["ts"], r["event_id"])):
        u = r["user_id"]
        own = "turns" if turns.get(u, 0) >= 30 else "tokens" if per.get(u, 0) >= 900 else None
        want[r["event_id"]] = "process" if spent >= 4000 else own
        spent += 0 if own else r["tokens"]
        per[u] = per.get(u, 0) + r["tokens"]
        turns[u] = turns.get(u, 0) + (not r["failed"])
    got = sessions.budget_admission(df, 900, 4000, 30)
    assert {r["event_id"]: r["reason"] for r in got.collect()} == want
    assert {"turns", "tokens", "process", None} == set(want.values())


def test_plans_hold_no_day_and_no_python(spark):
    df = spark.createDataFrame([(1, 1, "2020-01-01 00:00:00", 5, False)], "user_id long, event_id long, ts string, tokens int, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    plan = sessions.budget_admission(df, 1, 1, 1)._jdf.queryExecution().toString() + vectors.stable_ids(df.select(F.lit("a").alias("chunk_id")))._jdf.queryExecution().toString()
    assert "date_trunc" not in plan and "Python" not in plan
