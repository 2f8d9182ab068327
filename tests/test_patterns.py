"""Many terms in many texts, against a scan of every term in every text."""

import random

import pytest

from chartlake.operators import patterns, vectors


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
@pytest.mark.parametrize("fold", [True, False])
def test_terms_against_a_plain_scan(spark, fold, block_bytes):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("aAbBé ") for _ in range(n))
    terms = [word(r.randrange(1, 5)) for _ in range(40)] + ["ab", "AB", "abab", "b", "", None]
    texts = [(i, word(r.randrange(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "ab" * 50_000), (5, "again AB"), (5, "again AB")]
    t = spark.createDataFrame(texts, "id long, text string").repartition(5)
    w = spark.createDataFrame([(x,) for x in terms + terms[:9]], "term string")
    low = str.lower if fold else str
    want = sorted((i, x) for i, s in texts for x in {x for x in terms if x} if s and low(x) in low(s))
    got = patterns.find_terms(t, w, ["id"], fold=fold, block_bytes=block_bytes)
    assert got.columns == ["id", "term"]
    assert sorted(map(tuple, got.collect())) == want


def test_without_terms_or_texts(spark):
    t = spark.createDataFrame([(1, "a")], "id long, text string")
    w = spark.createDataFrame([("a",), (None,)], "term string")
    for texts, terms in ((t, w.where("term is null")), (t.where("false"), w), (t, w.where("false"))):
        got = patterns.find_terms(texts, terms, ["id"])
        assert got.columns == ["id", "term"] and got.count() == 0


def test_mentions_in_replies(spark):
    replies = spark.createDataFrame([(1, "see Guide A and Guide AB"), (2, "guide a"), (3, None)], "turn_id long, text string")
    sources = spark.createDataFrame([("Guide A",), ("Guide AB",), ("Other",)], "source string")
    named = vectors.named_sources(replies, sources)
    assert sorted(map(tuple, named.collect())) == [(1, "Guide A"), (1, "Guide AB")]
    found = spark.createDataFrame([(1, "Guide A")], "turn_id long, source string")
    assert [tuple(r) for r in vectors.citation_grounding(named, found).collect()] == [(1, "Guide AB")]
