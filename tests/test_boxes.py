"""Facts about boxes and fusion on hand-made rows."""

import pytest

from chartlake.functions import fdi
from chartlake.operators import boxes, fusion

BOX = "image_id int, det_id int, class_id int, x1 double, y1 double, x2 double, y2 double, raw_score double"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def box(spark, *items):
    return spark.createDataFrame([(1, i, c, *map(float, b), s) for i, c, b, s in items], BOX)


def test_contained_lesion_has_full_containment_and_low_iou(spark):
    a, b = box(spark, (1, 0, (10, 10, 20, 20), 0.9)), box(spark, (2, 0, (0, 0, 100, 100), 0.9))
    assert rows(boxes.containment_pairs(a, b), "containment") == [(1.0,)]
    assert rows(boxes.iou_pairs(a, b), "iou")[0][0] < 0.1


def test_class_aware_suppression(spark):
    b = box(spark, (1, 5, (0, 0, 10, 10), 0.9), (2, 6, (1, 0, 11, 10), 0.8), (3, 6, (1, 0, 11, 10), 0.7))
    assert rows(boxes.class_aware_nms(b, 0.5), "det_id") == [(1,), (2,)]


def test_inverse_letterbox_clips_after_scaling(spark):
    b = box(spark, (1, 0, (110, 120, 210, 220), 0.9), (2, 0, (0, 0, 9000, 9000), 0.9)).selectExpr("*", "0.5D AS ratio", "10 AS pad_x", "20 AS pad_y", "1000 AS w", "800 AS h")
    assert rows(boxes.unletterbox(b), "x1", "y1", "x2", "y2") == [(0.0, 0.0, 1000.0, 800.0), (200.0, 200.0, 400.0, 400.0)]


def test_letterbox(spark):
    df = spark.createDataFrame([(800, 400)], "w int, h int")
    assert rows(boxes.letterbox_geometry(df), "ratio", "pad_x", "pad_y") == [(0.8, 0, 160)]


def test_class_count_mismatch_fails(spark):
    df = spark.createDataFrame([([0.1] * 4,)], "cls_scores array<double>")
    with pytest.raises(Exception, match="expected 2"):
        boxes.check_class_count(df, 2).collect()


def test_float_threshold_is_met_as_float(spark):
    df = spark.createDataFrame([(0.2,)], "raw_score float")
    assert boxes.confidence_filter(df, 0.2).count() == 1


def fused(spark, fdi_boxes, lesions=()):
    b = box(spark, *fdi_boxes).selectExpr("*", "'fdi' AS model")
    if lesions:
        b = b.unionByName(box(spark, *lesions).selectExpr("*", "'lesion' AS model"))
    return fusion.fuse(b, fdi.class_map(spark))


ID = {label: i for i, _, _, _, label in fdi.class_rows()}


def test_restorations_are_exempt_from_dedup(spark):
    teeth, rest, _ = fused(spark, [(1, ID["T44"], (0, 0, 10, 10), 0.9), (2, ID["Crown"], (0, 0, 10, 10), 0.8)])
    assert (teeth.count(), rest.count()) == (1, 1)


def test_dedup_ranks_by_raw_score(spark):
    teeth, _, _ = fused(spark, [(1, ID["T43"], (0, 0, 10, 10), 0.81), (2, ID["T44"], (0, 0, 10, 11), 0.97)])
    assert rows(teeth, "fdi", "score") == [(44, 1.0)]


def test_attribution_and_no_lost_lesion(spark):
    _, _, found = fused(spark, [(1, ID["T37"], (100, 100, 200, 220), 0.9)], [(7, 0, (110, 120, 130, 140), 0.9), (8, 0, (500, 500, 520, 520), 0.8)])
    assert rows(found, "det_id", "tooth_fdi", "tooth_anatomy", "containment") == [(7, 37, "lower_left_second_molar", 1.0), (8, None, None, 0.0)]


def test_ambiguous_numbers(spark):
    teeth, rest, found = fused(spark, [(1, ID["T37"], (0, 0, 10, 10), 0.9), (2, ID["T37"], (500, 0, 510, 10), 0.8)])
    assert fusion.ambiguous_fdi(teeth).head()["ambiguous"] == [37]
    assert "ambiguous for 37" in fusion.summary_text(teeth, rest, found).head()["summary"]
