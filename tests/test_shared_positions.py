"""Many rows at a few positions: positions meet once, and the first places of each are listed."""

import time

from pyspark.sql import functions as F

from chartlake.operators import enrich


def test_nearby_of_crowded_positions(spark):
    n, k = 60_000, 6
    rows = lambda name: spark.range(n).select(F.col("id").alias(name), (50.0 + 0.01 * (F.col("id") % k)).alias("lat"), F.lit(8.0).alias("lon"))
    began = time.time()
    got = enrich.nearby(rows("city_id"), rows("place_id"), 2_000, 5).where(f"city_id < {k} or city_id >= {n - k}").collect()
    assert time.time() - began < 90  # every city with every place: 1,600,000,000 pairs
    have = {}
    for x in got:
        have.setdefault(x["city_id"], []).append((x["rank"], x["place_id"]))
    own = {i: [i % k + k * j for j in range(5)] for i in have}
    assert len(have) == 2 * k and all(sorted(v) == list(enumerate(own[i], 1)) for i, v in have.items())


def test_nearby_fills_up_from_further_positions(spark):
    cities = spark.createDataFrame([(1, 50.0, 8.0), (1, 50.0, 8.0), (2, 50.0, 8.0), (3, 0.0, 0.0)], "city_id int, lat double, lon double")
    places = spark.createDataFrame([(9, 50.0, 8.0), (4, 50.0, 8.0), (7, 50.001, 8.0), (2, 49.999, 8.0), (1, 50.001, 8.0), (5, 50.01, 8.0), (6, -0.0, 0.0)], "place_id int, lat double, lon double")
    got = sorted((x["city_id"], x["rank"], x["place_id"]) for x in enrich.nearby(cities, places, 10_000, 4).collect())
    assert got == [(1, 1, 4), (1, 2, 4), (1, 3, 9), (1, 4, 9), (2, 1, 4), (2, 2, 9), (2, 3, 1), (2, 4, 2), (3, 1, 6)]
