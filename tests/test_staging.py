"""Shuffle files of staged tables."""

import os

from pyspark.sql import functions as F

from chartlake.sources import staging


def test_shuffle_files_go_when_a_table_is_staged(spark):
    def files():
        return {f for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before, kept = files(), spark.conf.get(staging._CLEANUP, None)
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    df = rows.repartition("id").join(rows.groupBy("k").agg(F.sum("id").alias("s")).hint("merge"), "k")
    tables = [staging.staged(df), staging.staged(df)]  # the same frame twice
    assert not files() - before
    assert [t.agg(F.count("*"), F.sum("id")).head()[:] for t in tables] == [(1000, 499500)] * 2
    assert spark.conf.get(staging._CLEANUP, None) == kept
