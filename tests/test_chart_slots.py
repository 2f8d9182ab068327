"""The 32 slots are dealt out after the joins of an image, so no join or shuffle carries them."""

from chartlake.operators import chart


def test_slots_come_last(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    teeth = spark.createDataFrame([(1, 11, 5), (1, 11, 6), (1, 48, 7), (2, None, 8)], "image_id long, fdi int, det_id long")
    found = spark.createDataFrame([(1, 1, 0.5, 11, "Wisdom"), (1, 2, 0.4, 11, "Infection"), (1, 3, 0.9, 11, "Wisdom"), (2, 4, 0.9, 21, "Cavities"), (2, 5, 0.9, None, "Cavities")], "image_id long, det_id long, score double, tooth_fdi int, label string")
    got = chart.annotate_chart(images, teeth, found)
    rows = {(x["image_id"], x["fdi"]): (x["present"], x["findings"], x["ambiguous"]) for x in got.collect()}
    assert len(rows) == 96
    assert rows[1, 11] == (True, ["Infection", "Wisdom", "Wisdom"], True) and rows[1, 48] == (True, [], False) and rows[2, 21] == (False, ["Cavities"], False)
    assert sum(v != (False, [], False) for v in rows.values()) == 3
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Cartesian" if "Cartesian" in plan else "NestedLoop") < min(plan.find(j) for j in ("SortMergeJoin", "HashJoin") if j in plan)
    assert "tooth_fdi" not in plan.split("NestedLoop")[0] and plan.count("HashJoin") + plan.count("SortMergeJoin") == 1
