"""Facts about text, sessions and sources, and streaming forms against batch forms."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from chartlake.functions import fdi
from chartlake.operators import corpus, sessions
from chartlake.sources import readers
from chartlake.streaming import consult


def text_of(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("t")).head()["t"]


def test_sides_and_names(spark):
    df = spark.createDataFrame([("T26", 16), ("Crown", 46), ("T99", 26)], "name string, f int")
    got = df.select(fdi.viewer_side(F.col("f")), fdi.fdi_from_class_name(F.col("name"))).collect()
    assert [tuple(r) for r in got] == [("left", 26), ("left", None), ("right", None)]
    assert fdi.chart_slots(spark).count() == 32


def test_unwrap_looks_at_the_paragraph_so_far(spark):
    assert text_of(spark, corpus.unwrap_paragraphs, "a line\nthat goes on.\nNext\n• bullet") == "a line that goes on.\nNext\n• bullet"


def test_hyphens_follow_the_corpus(spark):
    pages = spark.createDataFrame([("d", 1, "evidence- based treat-\nment and evidence-based evidence-based")], "doc string, page int, text string")
    assert corpus.repair_hyphenation(pages, corpus.build_vocab(pages)).head()["text"] == "evidence-based treatment and evidence-based evidence-based"


def lines(spark, *texts):
    return spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "doc string, page long, line_no int, line string")


def test_numbered_sections(spark):
    got = corpus.sectionize_numbered(lines(spark, "intro", "1", "Scope of the work This part", "3", "small code", "2", "Terms"))
    assert [(r["section_no"], r["label"], r["line"]) for r in got.orderBy("line_no").collect()] == [(0, "Front matter", "intro"), (1, "Clause 1 Scope of the work", "This part"), (1, "Clause 1 Scope of the work", "3 small code")]


def test_sentinel_sections(spark):
    got = corpus.sectionize_sentinel(lines(spark, "a", "@@H1@@ Chapter", "@@H1@@ Caries", "b", "@@H2@@ Signs", "c"))
    assert [(r["label"], r["line"]) for r in got.orderBy("line_no").collect()] == [("", "a"), ("Caries", "b"), ("Caries — Signs", "c")]


def test_inline_markers(spark):
    got = corpus.sectionize_inline_markers(lines(spark, "x [H1] Head words. more text", "y"))
    assert [(r["label"], r["line"]) for r in got.orderBy("line_no", "part").collect()] == [("Front matter", "x"), ("Head words", ". more text"), ("Head words", "y")]


def test_windows_cover_all_words(spark):
    df = spark.createDataFrame([([3] * 500, 0)], "costs array<int>, label_cost int")
    got = [(r["first"], r["last"]) for r in corpus.token_windows(df, target=302, overlap=10).collect()]
    assert got[0] == (0, 100) and got[-1][1] == 500 and all(b[0] <= a[1] for a, b in zip(got, got[1:], strict=False))


def test_third_upload_opens_a_new_consultation(spark):
    t = dt.datetime(2024, 1, 1)
    up = spark.createDataFrame([(1, 1, t + dt.timedelta(minutes=i)) for i in range(3)], "user_id long, session_no long, ts timestamp")
    assert [(r["consultation"], r["notice"]) for r in sessions.rollover(up).orderBy("ts").collect()] == [(0, False), (0, True), (1, False)]
    assert [r["consultation"] for r in sessions.rollover(up, adopt=False).orderBy("ts").collect()] == [0, 0, 1]


def test_budgets(spark):
    t = dt.datetime(2024, 1, 1)
    turns = spark.createDataFrame([(1, i, t + dt.timedelta(minutes=i), 400, False) for i in range(4)], "user_id long, event_id long, ts timestamp, tokens long, failed boolean")
    reason = lambda **k: [r["reason"] for r in sessions.budget_admission(turns, **k).orderBy("event_id").collect()]
    assert reason(session_cap=1000, process_cap=5000, max_turns=9) == [None, None, None, "tokens"]
    assert reason(session_cap=9999, process_cap=5000, max_turns=3) == [None, None, None, "turns"]
    assert reason(session_cap=9999, process_cap=800, max_turns=9) == [None, None, "process", "process"]


def test_label_files_and_uploads(spark):
    top = tempfile.mkdtemp()
    os.makedirs(f"{top}/val/labels")
    with open(f"{top}/val/labels/a.txt", "w") as f:
        f.write("3 0.5 0.5 0.1 0.2\n\n7 0 0 1 0 1 1\n")
    got = [(r["split"], r["image"], r["class_id"], len(r["coords"])) for r in readers.read_annotations(spark, top).orderBy("line_no").collect()]
    assert got == [("val", "a", 3, 4), ("val", "a", 7, 6)]
    files = tempfile.mkdtemp()
    for name, size in (("e", 0), ("s", 5), ("l", 50)):
        with open(f"{files}/{name}", "wb") as f:
            f.write(b"x" * size)
    assert sorted(r["outcome"] for r in readers.read_uploads(spark, files, 10).collect()) == ["empty", "ok", "too_large"]


def _drain(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams_equal_batches(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(u, t + dt.timedelta(minutes=m), i * 10, i, m % 2 == 0) for i, (u, m) in enumerate([(1, 0), (1, 20), (1, 200), (2, 5), (2, 300), (9, 100_000)])]
    path = tempfile.mkdtemp() + "/ev"
    spark.createDataFrame(rows, "user_id long, ts timestamp, tokens_in long, tokens_out long, failed boolean").write.parquet(path)
    batch = spark.read.parquet(path)
    read = lambda: spark.readStream.schema(batch.schema).parquet(path)
    _drain(consult.stream_sessions(read()), "append", "ses")
    want = sessions.session_table(batch).where("user_id <> 9").select("user_id", "started", "last_seen", "n_events")
    assert sorted(map(tuple, spark.sql("select user_id, started, last_seen, n_events from ses where user_id <> 9").collect())) == sorted(map(tuple, want.collect()))
    _drain(consult.stream_spend(read()), "complete", "spend")
    got = sessions.spend_totals(batch).where("user_id is not null").select("user_id", "tokens_in", "tokens_out", "turns")
    assert sorted(map(tuple, spark.sql("select user_id, tokens_in, tokens_out, turns from spend").collect())) == sorted(map(tuple, got.collect()))
    _drain(consult.stream_usage(read(), ["user_id"]), "append", "usage")
    hours = sessions.usage_report(batch.selectExpr("*", "0L AS cache_read", "0D AS took"), ["user_id"]).where("user_id <> 9").select("window_start", "user_id", "calls", "tokens_in", "tokens_out")
    assert sorted(map(tuple, spark.sql("select window_start, user_id, calls, tokens_in, tokens_out from usage where user_id <> 9").collect())) == sorted(map(tuple, hours.collect()))
    _drain(consult.stream_rollover(read().select("user_id", "ts")), "append", "roll")
    up = sessions.rollover(batch.selectExpr("user_id", "1L AS session_no", "ts")).select("user_id", "ts", "consultation", "notice")
    assert sorted(map(tuple, spark.sql("select * from roll").collect())) == sorted(map(tuple, up.collect()))


def test_clause_titles_go_once(spark):
    got = corpus.sectionize_numbered(lines(spark, "1", "Scope This Scope applies to Scope notes"))
    assert [(r["line"], r["label"]) for r in got.collect()] == [("This Scope applies to Scope notes", "Clause 1 Scope")]


def test_captions_and_bibliography_headings(spark):
    rows = [(1, 11.0, "BIBLIOGRAPHY AND NOTES"), (2, 10.0, "an entry"), (3, 11.0, "Next"), (4, 10.0, "Figure 3 shows the result"), (5, 10.0, "Flowchart 1.2 steps"), (6, 10.0, "tables 4.1"), (7, 10.0, "Fig. 1.2")]
    df = spark.createDataFrame([("d", 1, n, size, t) for n, size, t in rows], "doc string, page long, line_no int, size double, text string")
    got = {r["line_no"]: r["kind"] for r in corpus.classify_font_band(df).collect()}
    assert got == {1: "bibliography_heading", 2: "bibliography", 3: "h2", 4: "body", 5: "caption", 6: "caption", 7: "body"}


def test_hyphens_join_or_stay(spark):
    pages = spark.createDataFrame([("d", 1, "the treatment and evidence-based care, traité général"), ("d", 2, "treat-\nment is evidence- based; trai- té, géné-\n ral")], "doc string, page long, text string")
    got = {r["page"]: r["text"] for r in corpus.repair_hyphenation(pages, corpus.build_vocab(pages.where("page = 1"))).collect()}
    assert got[2] == "treatment is evidence-based; traité, général"


def test_packed_sections_keep_headings(spark):
    rows = [(1, "A — One", "w " * 340), (2, "A — Two words", "x y"), (3, "A — Three", "z " * 9), (4, "B — Four", "q")]
    df = spark.createDataFrame([("d", n, label, t.strip()) for n, label, t in rows], "doc string, section_no long, label string, text string")
    got = {r["section_no"]: (r["label"], r["text"].split("\n")[1:]) for r in corpus.packed_sections(df).collect()}
    assert got == {1: ("A — One", ["Two words:", "x y", "Three:", "z " * 8 + "z"]), 4: ("B — Four", [])}


def test_line_rules_by_place_or_length(spark):
    lines_ = spark.createDataFrame([("d", 3, n, x, t) for n, x, t in [(1, 100.0, "x" * 80), (2, 250.0, "short"), (3, 250.0, "x" * 80)]], "doc string, page long, line_no int, x0 double, line string")
    rules = spark.createDataFrame([("d", 1, "diagram", 200.0, 60, True)], "doc string, rule_no int, reason string, max_x double, max_length int, either boolean")
    hit = lambda r: [x["line_no"] for x in corpus.drop_line_rules(lines_, r).where("reason is not null").orderBy("line_no").collect()]
    assert hit(rules) == [1, 2] and hit(rules.withColumn("either", F.lit(False))) == []


def test_broken_hyphens_beside_whole_ones(spark):
    rows = [("d", 1, "evidence-based evidence-based well-known"), ("d", 2, "all-evidence- based, treat- ment\u0002 evidence-\n\tbased treat- ment; x"), (None, 3, "evidence- based"), ("d", 4, None), ("d", 5, "no break")]
    pages = spark.createDataFrame(rows, "doc string, page long, text string")
    got = {r["page"]: r["text"] for r in corpus.repair_hyphenation(pages, corpus.build_vocab(pages)).collect()}
    assert got == {1: rows[0][2], 2: "all-evidence-based, treatment\u0002 evidence-based treatment; x", 3: "evidence-based", 4: None, 5: "no break"}
    seen = {(r["left"], r["right"]): r["keep"] for r in corpus.hyphen_decisions(pages, corpus.build_vocab(pages)).collect()}
    assert seen == {("evidence", "based"): True, ("treat", "ment"): False}


def test_unwrapped_paragraphs_equal_the_fold(spark):
    """Against the fold in plain Python, and in time that grows with the lines: 60,000 lines of one paragraph each."""
    import random
    import re

    apart = [corpus.BULLET, corpus.HEADING, corpus.SENTINEL, corpus.NUMBER_ONLY]
    after = [corpus.SENTINEL, corpus.NUMBER_ONLY, corpus.HEADING, corpus.SENTENCE_END]

    def fold(text):
        out = []
        for line in text.split("\n"):
            if not out or any(re.search(p, line) for p in apart) or any(re.search(p, out[-1]) for p in after):
                out.append(line)
            else:
                out[-1] += " " + line
        return "\n".join(out)

    r = random.Random(3)
    parts = ["A", "AB", "CD", "ABC", "A-", "12", "1.2", "", " ", "words", "end.", "end. ", "”", ".”", "• b", "1. x", "[H1] t", "@@H2@@ t", "(A", "a) b", "x?'", "Z"]
    texts = ["\n".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(400)] + [None, ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", corpus.unwrap_paragraphs(F.col("t")).alias("t")).collect()
    assert {x["i"]: x["t"] for x in got} == {i: None if t is None else fold(t) for i, t in enumerate(texts)}
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("line "), i, F.lit("."))), "\n").alias("t"))
    assert long.select(F.length(corpus.unwrap_paragraphs(F.col("t"))) == F.length("t")).head()[0]
