"""The mean over thresholds equals the evaluations at each, without a row per prediction and threshold."""

import pytest
from pyspark.sql import functions as F

from chartlake.operators import datasets


def test_levels_are_sorted_once(spark):
    i = F.col("id")
    box = [((i * 7) % 30).cast("double").alias("x1"), ((i * 5) % 20).cast("double").alias("y1"), ((i * 7) % 30 + 20.0 + i % 3).alias("x2"), ((i * 5) % 20 + 30.0).alias("y2")]
    preds = spark.range(240).select((i % 12).alias("image_id"), i.alias("det_id"), (i % 2).cast("int").alias("class_id"), ((i * 37 % 101) / 101).alias("raw_score"), *box)
    truth = preds.where("det_id % 4 > 0").selectExpr("image_id", "det_id", "class_id", "x1 + det_id % 5 AS x1", "y1", "x2 + det_id % 5 AS x2", "y2")
    got = datasets.mean_ap(preds, truth, (0.5, 0.8))
    each = [{x["class_id"]: x["ap"] for x in datasets.detection_eval(preds, truth, t).collect()} for t in (0.5, 0.8)]
    assert {x["class_id"]: x["map"] for x in got.collect()} == {c: pytest.approx((each[0][c] + each[1][c]) / 2, abs=2e-6) for c in (0, 1)}
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()
