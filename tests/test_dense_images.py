"""Images with more boxes than a detector gives: grid cells and rounds give what the fold gives."""

import random

import numpy as np
import pandas as pd
import pytest

from chartlake.operators import boxes, fusion

BOX = "image_id int, det_id int, class_id int, x1 double, y1 double, x2 double, y2 double, raw_score double"


def many(n, spread, seed=1, image=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = r.uniform(-spread, spread), r.uniform(-spread, spread), 2 ** r.uniform(0, 4), 2 ** r.uniform(0, 4)
        out.append((image, i, i % 3, x, y, x + w, y + h, r.randrange(50) / 50))
    return out


def frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in BOX.split(", ")]), BOX)


def found(df):
    return sorted((r["image_id"], r["det_id"]) for r in df.collect())


@pytest.mark.parametrize(("spread", "threshold"), [(4, 0.7), (4, 0.1), (30, 0.5), (4, 0.0)])
def test_rounds_equal_the_fold(spark, spread, threshold):
    rows = many(220, spread) + many(60, spread, 2, 2) + [(3, i, 0, 0.0, 0.0, 8.0, 8.0, 0.5) for i in range(90)] + [(3, 200, 0, 1.0, 1.0, 1.0, 5.0, 0.9), (3, 201, 0, 1.0, 1.0, 1.0, 5.0, 0.9)]
    df = frame(spark, rows)
    want = found(boxes.nms(df, ["image_id"], threshold, small=10_000))
    assert found(boxes.nms(df, ["image_id"], threshold, small=70, batch=64)) == want
    assert found(boxes.nms(df, ["image_id"], threshold, small=0, batch=10_000)) == want


def test_rounds_by_several_keys_and_repeated_rows(spark):
    rows = many(90, 5) + many(90, 5)
    df = frame(spark, rows)
    want = found(boxes.nms(df, ["image_id", "class_id"], 0.5, small=10_000))
    assert found(boxes.nms(df, ["image_id", "class_id"], 0.5, small=20, batch=50)) == want


def test_overlapping_pairs_meet_once(spark):
    a, b = many(150, 10, 3) + [(1, 900, 0, -100.0, -100.0, 100.0, 100.0, 0.1), (1, 901, 0, 1.0, 1.0, 1.0, 1.0, 0.1)], many(150, 10, 4)
    got = boxes.overlapping(frame(spark, a), frame(spark, b), ["image_id"]).select("a.det_id", "b.det_id").collect()
    inner = lambda p, q: min(p[5], q[5]) > max(p[3], q[3]) and min(p[6], q[6]) > max(p[4], q[4])
    assert sorted((r[0], r[1]) for r in got) == sorted((p[1], q[1]) for p in a for q in b if inner(p, q))


def test_lesions_of_a_dense_image(spark):
    teeth = frame(spark, many(120, 12, 5) + many(20, 12, 6, 2)).selectExpr("*", "det_id % 32 AS fdi", "concat('t', det_id) AS anatomy")
    lesions = frame(spark, many(80, 12, 7) + many(15, 12, 8, 2) + many(5, 12, 9, 3) + [(1, 500, 0, 900.0, 900.0, 901.0, 901.0, 0.5), (1, 501, 0, 1.0, 1.0, 1.0, 1.0, 0.5)])
    cols = ("image_id", "det_id", "containment", "tooth_fdi", "tooth_anatomy", "raw_score")
    rows = lambda small: sorted(map(str, fusion.assign_lesions(lesions, teeth, small=small).select(*cols).collect()))
    assert rows(50) == rows(10_000) and len(rows(50)) == 102


def test_dense_images_are_reported(spark):
    df = frame(spark, many(40, 5) + many(10, 5, 2, 2))
    assert [tuple(r) for r in boxes.dense_groups(df, ["image_id"], 20).collect()] == [(1, 40)]


def test_an_image_of_many_boxes(spark):
    n = 30_000
    rows = many(n, 400, 11)
    got = {r["det_id"] for r in boxes.nms(frame(spark, rows), ["image_id"], 0.5, batch=10_000).select("det_id").collect()}
    f = pd.DataFrame(rows, columns=["image_id", "det_id", "class_id", "x1", "y1", "x2", "y2", "s"]).sort_values(["s", "det_id"], ascending=[False, True])
    f["_rank"] = np.arange(n)
    assert got == set(boxes._survivors(f, 0.5)["det_id"])
