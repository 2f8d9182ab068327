"""Vector search over all queries against brute force, and the query set of the bindings."""

import numpy as np

from chartlake.operators import vectors
from chartlake.plans import bindings as B


def test_query_set_grows_with_the_table(spark):
    spark.range(1000).selectExpr("id AS vec_id", "array(1.0f) AS embedding", "0 AS label").createOrReplaceTempView("embeddings")
    got = {r["query_id"] for r in spark.sql(B.QUERIES).collect()}
    assert set(range(0, 1000, 100)) | set(range(20)) == got


def test_search_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 50)
    r = np.random.default_rng(1)
    e = r.integers(-9, 9, (300, 4)).astype(float) / 16
    e[100:180] = e[100]  # many equal vectors: ties by the least id
    rows = [(i, e[i].tolist(), "abc"[0 if i % 5 else i % 3]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, status string").repartition(5)
    q = v.where("id % 10 = 0").selectExpr("id AS query_id", "embedding")
    hits = {(x["query_id"], x["rank"]): x["id"] for x in vectors.search_global(q, v).collect()}
    slots = {}
    for x in sorted(vectors.search_slots(q, v, total=4).collect(), key=lambda x: x["rank"]):
        slots.setdefault(x["query_id"], []).append(x["id"])
    for i in range(0, 300, 10):
        ranked = sorted((j for j in range(300) if j != i), key=lambda j: (-round(float(e[i] @ e[j]), 6), j))
        assert [hits[i, n] for n in range(1, 6)] == ranked[:5]
        per = [j for s in "abc" for j in [j for j in ranked if rows[j][2] == s][:2]]
        best = per + [j for j in ranked if j not in per][: max(0, 4 - len(per))]
        assert slots[i] == sorted(best, key=ranked.index)[:4]


def test_similarity_is_rounded_like_the_reference(spark):
    values = [0.4795, 0.0625, 0.1875, -0.4795, -0.0001, 0.0005, 0.9995, 1.0, 0.0, 0.712] + [n / 2000 for n in range(-1999, 2000, 2)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", vectors.F.format_string("%.3f", vectors._thousandths(vectors.F.col("x"))).alias("s"))
    assert {r["i"]: r["s"] for r in got.collect()} == {i: f"{x:.3f}" for i, x in enumerate(values)}
