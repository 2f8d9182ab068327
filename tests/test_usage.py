"""Latency sketches against sorted lists, history costs against a replay, groundings, marks of pages, bands."""

import bisect
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from chartlake.operators import chart, corpus, sessions


def test_quantiles_are_exact_on_few_and_close_on_many(spark):
    r = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [("few", start + dt.timedelta(minutes=i), float(r.randrange(50))) for i in range(180)] + [("none", start, None)]
    many = spark.range(120_000).select(F.lit("many").alias("model"), F.timestamp_seconds(F.col("id") * 7 + 1_700_000_000).alias("ts"), F.exp(F.rand(4) * 9).alias("took"))
    calls = spark.createDataFrame(rows, "model string, ts timestamp, took double").unionAll(many)
    hours = sessions.latency_sketches(calls, ["model"])
    got = {x["model"]: x for x in sessions.latency_quantiles(sessions.latency_rollup(hours, ["model"])).collect()}
    nth = lambda v, q: sorted(v)[math.ceil(round(q * len(v), 7)) - 1]
    for name, q in sessions.QUANTILES.items():
        assert got["few"][name] == nth([v for m, _, v in rows if m == "few"], q)
    assert (got["none"]["calls"], got["none"]["p50"]) == (1, None)
    values = sorted(x["took"] for x in many.select("took").collect())
    for name, q in sessions.QUANTILES.items():
        assert abs(bisect.bisect_right(values, got["many"][name]) / len(values) - q) <= sessions.SKETCH_ERROR
    assert got["many"]["calls"] == 120_000
    empty = calls.where("false")
    assert sessions.latency_quantiles(sessions.latency_rollup(sessions.latency_sketches(empty, ["model"]), ["model"])).count() == 0


@pytest.mark.parametrize("keep", [0, 1, 3])
def test_history_by_replay(spark, keep):
    r = random.Random(keep)
    rows = []
    for c in (None, 1, 2, 3):
        for turn in range(0, 80 if c == 2 else 9, 1 if c != 3 else 4):
            rows += [(c, turn, r.choice([None, 0, 1, 5, 40]), r.choice([True, False, None]))] * r.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "conv_id long, turn int, tokens long, is_result boolean").repartition(4)
    want = {}
    for c, turn in {(c, t) for c, t, _, _ in rows}:
        sent = [(t, n or 0, bool(x)) for d, t, n, x in rows if d == c and t <= turn]
        results = sorted({t for t, _, x in sent if x})
        full = set(results[-keep:]) if keep else set()
        want[c, turn] = (sum(n for _, n, _ in sent), sum(2 if x and t not in full else n for t, n, x in sent))
    got = {(x["conv_id"], x["turn"]): (x["full_sent"], x["pruned_sent"]) for x in sessions.history_by_turn(df, keep).collect()}
    assert got == want
    totals = {x["conv_id"]: x["pruned_sent"] for x in sessions.history_totals(sessions.history_by_turn(df, keep)).collect()}
    assert totals[2] == sum(p for (c, _), (_, p) in want.items() if c == 2)


def test_exchanges_grounded_by_a_tool(spark):
    answers = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0)], "conv_id long, exchange long")
    calls = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "a", 3), (1, 1, "a", 0), (1, 1, "b", None), (3, 0, "a", 9)], "conv_id long, exchange long, tool string, result_count int")
    assert sorted(map(tuple, sessions.grounded_by_tool(answers, calls).collect())) == [("a", 2, 1), ("b", 1, 0)]


def test_marks_of_pages(spark):
    pages = {1: ["FOREWORD", "by us"], 2: ["A Preface to it"], 3: ["x" * 200, "Preface"], 4: ["Acknowledgements"], 5: ["Contents", "  Chapter 1", "more"], 6: ["body", "1"], 7: ["Chapter 10"], 8: ["11", "1 Introduction"], 9: ["Discontents", None]}
    rows = [("d", p, i, t, i % 2) for p, lines in pages.items() for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc string, page long, line_no int, text string, direction int").repartition(3)
    got = {r["page"]: (r["mark"], r["n_lines"], r["rotated_lines"]) for r in corpus.page_marks(df).collect()}
    assert {p: m for p, (m, _, _) in got.items()} == {1: "front_matter", 2: "front_matter", 3: None, 4: None, 5: "chapter_one", 6: "chapter_one", 7: None, 8: None, 9: None}
    assert got[5][1:] == (3, [1])
    assert [tuple(r) for r in corpus.layout_profile(df).collect()] == [("d", len(rows), sum(i % 2 for _, _, i, _, _ in rows), 2, 2)]


def test_white_space_of_any_kind_goes(spark):
    pages = spark.createDataFrame([("d", 1, " \x1f a b\x85\n　\n\r")], "doc string, page long, text string")
    assert [r["line"] for r in corpus.lines_from_pages(pages).collect()] == ["a b"]
    assert pages.select(corpus.normalize_whitespace(F.col("text")).alias("t")).head()["t"] == "a b"


def test_line_rules_by_parity(spark):
    lines = spark.createDataFrame([("de", p, 0, "x") for p in range(4)], "doc string, page long, line_no int, line string")
    rules = spark.createDataFrame([("de", 1, "even", 0)], "doc string, rule_no int, reason string, parity int")
    assert {r["page"]: r["reason"] for r in corpus.drop_line_rules(lines, rules).collect()} == {0: "even", 1: None, 2: "even", 3: None}


def test_bands_of_images_without_findings(spark):
    found = spark.createDataFrame([(1, 0.5), (1, 0.6), (1, 0.6)], "image_id long, score double")
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    got = {(r["image_id"], r["band"]): (r["n"], r["percent"]) for r in chart.confidence_bands(found, images).collect()}
    assert len(got) == 8 and got[1, "0.40-0.55"] == (1, 33) and got[1, "0.55-0.70"] == (2, 67) and all(v == (0, 0) for (i, _), v in got.items() if i == 2)
