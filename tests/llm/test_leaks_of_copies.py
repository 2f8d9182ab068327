"""Verbatim copies of items that have no usable template."""

import pytest

from chartlake.llm import decontamination

DOCS = "doc_id long, text string"
ITEMS = {0: "What is the largest city here?", 1: "12 14 19 23 31 45 57 68 71 83 97 101", 2: "Anna Berta Carla Dora Emma Frida Greta Hanna Irma Jana", 3: "7 8", 4: "a plain question of more than eight words that goes on for a while"}


@pytest.mark.parametrize("handed", [0, 1000])
def test_copies_always_match(spark, handed):
    texts = {
        0: "Questions\nWhat is the largest city here?\nAnswers",
        1: "a table row: 12 14 19 23 31 45 57 68 71 83 97 101 and more",
        2: "those present were Anna Berta Carla Dora Emma Frida Greta Hanna Irma Jana and no others",
        3: "we take 7 8 then",
        4: "A Plain Question of more than eight words that goes on for a while",
        10: "What is the smallest city here? 12 14 19 23 31 46 57 68 72 83 97 102 and Anna Berta Carla Dora",
    }
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    for n, item in ITEMS.items():
        bench = spark.createDataFrame([(n, item)], "item_id long, text string")
        got = decontamination.find_leaks(docs, bench, handed=handed).collect()
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(n, n)], item
        assert 0.5 <= got[0]["coverage"] <= 1 and not got[0]["changed_slots"]


def test_templates_keep_their_measure(spark):
    """Windows without a template do not lower the coverage of a question asked with other numbers."""
    item = "how many apples does the farmer sell if 12 14 19 23 31 45 57 68 71 83 97 101 113 are sold"
    asked = item.replace("113", "115").replace("12 14", "13 15").replace("71", "73")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = decontamination.find_leaks(spark.createDataFrame([(0, asked)], DOCS), bench).collect()
    assert [(r["doc_id"], r["coverage"], r["changed_slots"]) for r in got] == [(0, 1.0, True)]


@pytest.mark.parametrize("handed", [0, 1000])
def test_runs_need_one_mapping(spark, handed):
    """Two runs of an item that give one value two values count for the longer one only; two whole copies are found."""
    item = "the first farmer has 12 red apples in a big basket today while the second farmer sold all of the 12 green pears he had"
    parted = item.replace("12 red", "30 red").replace("12 green", "45 green").replace("basket today while the second", "basket . So it is that while the second")
    half = " ".join(item.split()[:11]) + " and then nothing"
    texts = {0: parted, 1: item.replace("12", "7") + " . And again: " + item.replace("12", "9"), 2: half, 3: None, 4: ""}
    bench = spark.createDataFrame([(0, item), (0, item)], "item_id long, text string")
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], DOCS).selectExpr("*", "1 AS hash", "2 AS item_id", "3 AS pairs")
    got = {r["doc_id"]: r for r in decontamination.find_leaks(docs, bench, handed=handed, coverage=0.01).collect()}
    assert set(got) == {0, 1, 2} and got[1]["coverage"] == 1.0 and got[1]["changed_slots"]
    assert got[0]["windows"] < 0.6 * got[0]["item_windows"]
