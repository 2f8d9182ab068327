"""Indicators from all orders; cells without a point."""

import math
import random
import unicodedata

from chartlake.operators import enrich
from chartlake.plans import bindings as B


def test_every_order_is_a_point(spark):
    spark.createDataFrame([(k, 1, "1-URGENT", f"199{k % 8}-01-01", 1.0 * k) for k in range(1, 200)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string, o_totalprice double").createOrReplaceTempView("orders")
    spark.createDataFrame([(1, 7)], "c_custkey long, c_nationkey int").createOrReplaceTempView("customer")
    points = spark.sql(B.POINTS)
    assert points.count() == 199
    assert [tuple(r) for r in enrich.latest_indicator(points).collect()] == [("1-URGENT", 7, 7.0)]


def test_cells_without_a_point_say_no_data(spark):
    countries, indicators = spark.createDataFrame([(1,), (2,)], "country int"), spark.createDataFrame([("a",), ("b",)], "indicator string")
    points = spark.createDataFrame([(5, "a", 1, 2001, 3.0), (4, "a", 1, 2001, 9.0), (6, "a", 1, None, 1.0)], "id long, indicator string, country int, year int, value double")
    got = enrich.indicator_grid(countries, indicators, enrich.latest_indicator(points)).orderBy("country", "indicator").collect()
    assert [tuple(r) for r in got] == [(1, "a", "9.00", 1), (1, "b", "no data", 1), (2, "a", "no data", 0), (2, "b", "no data", 0)]


def distance(a, b):
    d = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        d.append([i + 1])
        for j, y in enumerate(b):
            d[-1].append(min(d[i][j + 1] + 1, d[-1][j] + 1, d[i][j] + (x != y)))
    return d[-1][-1]


def test_names_resolve_as_by_brute_force(spark):
    r = random.Random(5)
    known = ["France", "Espagne", "Italia", "ab", "a", "", "Österreich", "x" * 33, "x" * 34, "x" * 36, "long name " * 6, "long nome " * 6, "ordinary state of some length, number two"]
    known += ["".join(r.choices("abc", k=r.randint(0, 8))) for _ in range(40)] + ["".join(r.choices("ab", k=r.randint(30, 45))) for _ in range(15)]
    names = ["Rance", "Éspagne", "ESPAGNE", "Itali", "zzzzzz", None, "x" * 35, "osterreich", "long name " * 5 + "long nme"]
    for k in known:
        s = list(k)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(s) + 1)
            s[at : at + r.randint(0, 1)] = r.choices("abcx", k=r.randint(0, 1))
        names.append("".join(s))
    got = enrich.resolve_country(spark.createDataFrame([(n,) for n in names + names[:3]], "name string"), spark.createDataFrame([(k, i) for i, k in enumerate(known)] + [(None, 99)], "country string, code int"))
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    want = {None: None}
    for n in set(names) - {None}:
        best = min((distance(fold(n), fold(k)), i) for i, k in enumerate(known))
        want[n] = best[1] if best[0] <= 2 else None
    assert {x["name"]: x["code"] for x in got.collect()} == want
    assert got.count() == len(set(names))
    assert (want["Rance"], want["Éspagne"], want["zzzzzz"]) == (0, 1, None)


def test_no_names_or_no_countries(spark):
    names, none = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "country string, code int")
    assert [tuple(x) for x in enrich.resolve_country(names, none).collect()] == [("a", None)]
    assert enrich.resolve_country(names.where("false"), none).count() == 0


def test_nearby_is_whole_on_all_the_globe(spark):
    r = random.Random(2)
    spots = [(90, 0), (-90, 50), (80, 20), (10, 179.99), (10, -179.99), (0, 0), (-45, 100), (89.99, -180)]
    points = [(a + r.uniform(-0.1, 0.1), b + r.uniform(-0.1, 0.1) / max(0.01, math.cos(math.radians(a)))) for a, b in spots for _ in range(12)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(40)]
    points = [(min(90.0, max(-90.0, a)), b) for a, b in points] + [(80.0, 20.45), (80.0, 20.0), (10.0, 179.99), (10.0, -179.99)]

    def metres(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * enrich.EARTH_M * math.asin(math.sqrt(min(h, 1)))

    frame = lambda name: spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(900, None, 1.0)], f"{name} int, lat double, lon double")
    for radius in (10_000, 400_000, 30_000_000):
        got = {}
        for x in enrich.nearby(frame("city_id"), frame("place_id"), radius, 1000).collect():
            got.setdefault(x["city_id"], set()).add(x["place_id"])
        for i, a in enumerate(points):
            far = {j: metres(a, b) for j, b in enumerate(points)}
            edge = {j for j, d in far.items() if abs(d - radius) < 0.01}
            assert got[i] - edge == {j for j, d in far.items() if d <= radius} - edge


def test_pairs_of_names_are_not_kept(spark):
    """Names meet as a stream: only the deletions of names and the least code of each name are grouped, never pairs."""
    names = spark.createDataFrame([("abce",), ("abzz",)], "n string")
    known = spark.createDataFrame([("abcd", 1), ("abxy", 2)], "k string, code int")
    close = enrich._close(names, known, 2)
    assert {tuple(r) for r in close.collect()} == {("abce", 1), ("abce", 2), ("abzz", 1), ("abzz", 2)}
    plan = close._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [n#" not in plan.split("Join")[0]


def test_keys_of_names_are_never_broadcast(spark):
    """A small table of names has hundreds of keys a name, which its size does not tell."""
    names = spark.range(50).selectExpr("concat('name of some length ', id) as n")
    known = spark.range(50).selectExpr("concat('name of same length ', id) as k", "id as code")
    close = enrich._close(names, known, 2)
    joins = [line for line in close._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in j for j in joins) == 2 and all("LeftSemi" in j for j in joins if "Broadcast" in j)
    assert {(r["n"], r["code"]) for r in close.collect()} >= {(f"name of some length {i}", i) for i in range(50)}
