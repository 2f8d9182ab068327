"""Toxicity scores against a plain run of the same model, on awkward rows, and the bounds of the sample."""

import math
import random
import zlib

import pytest
import zstandard

from chartlake.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["vilgrum", "snarkjob", "dreckpot"]


def words(r, n):
    return ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def corpus(spark, n=160):
    r = random.Random(50)
    rows = []
    for i in range(n):
        w = words(r, r.randint(20, 80))
        for _ in range(3 if i % 4 == 0 else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w), "en", "s", 1))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int"), rows


def plainly(model, text):
    """Score of one text, window by window, with compressors made anew."""
    w = text.lower().split()
    found = [" ".join(w[i : i + 8]).encode() for i in range(0, len(w), 8)] or [b""]
    gain = [len(toxicity._compressor(model.ordinary).compress(x)) - len(toxicity._compressor(model.toxic).compress(x)) for x in found]
    n, over = len(gain), [sum(g >= k for g in gain) for k in (1, 2, 3, 4)]
    x = [1.0, *(math.log1p(v) for v in over), min(max(gain), 12), over[1] / n, over[2] / n, min(2, max(-2, sum(gain) / n)), math.log1p(n)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def test_scores_equal_a_plain_run(spark):
    docs, labels, rows = corpus(spark)
    odd = [(None, "no id", "en", "s", 1), (7, None, "en", "s", 1), (7, "", None, None, None), (900, "thon " * 60_000 + "vilgrum snarkjob", "en", "s", 1)] + [rows[0]] * 2
    df = docs.union(spark.createDataFrame(odd, DOCS)).selectExpr("*", "1 AS score", "2 AS predicted", "3 AS held_out", "4 AS label")
    model = toxicity.fit(df, labels)
    got = [r.asDict() for r in toxicity.score(df, model).collect()]
    want = sorted((i is None, i or 0, round(plainly(model, t or ""), 9)) for i, t, *_ in rows + odd)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, round(x["score"], 9)) for x in got) == want
    assert all(x["predicted"] == (x["score"] >= 0.7) and x["held_out"] == (None if x["doc_id"] is None else zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)
    kept = [r.asDict() for r in toxicity.keep_clean(df, labels).collect()]
    clean = sorted((i is None, i or 0, t or "") for i, t, *_ in rows + odd if plainly(model, t or "") < 0.7)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in kept) == clean and toxicity.keep_clean(df, labels).columns == df.columns


def test_the_sample_is_bounded_in_bytes(spark):
    docs, labels, rows = corpus(spark)
    size = {t: len(t.encode()) for _, t, *_ in rows}
    got = toxicity.labelled_sample(docs, labels, "toxic", {0: 1000, 1: 1000}, most_bytes=2000)
    for y in (0, 1):
        own = [size[t] for t, label in got if label == y]
        assert 1 <= len(own) and sum(own) <= 2000 < sum(own) + max(size.values())
    assert len(toxicity.labelled_sample(docs, labels, "toxic", {0: 1000, 1: 1000}, most_bytes=1)) == 2
    assert len(toxicity.labelled_sample(docs, labels, "toxic", {0: 10, 1: 5})) == 15


def test_the_oldest_byte_of_a_dictionary_is_found():
    """A word before 30 KB of other text still shortens a window that holds it."""
    r = random.Random(51)
    rest = " ".join(words(r, 5000)).encode()[:30_000]
    with_word, without = (toxicity._compressor(x + rest) for x in (b"abominable ", b"zzzzzzzzzzz"))
    assert isinstance(with_word, zstandard.ZstdCompressor) and len(with_word.compress(b"so abominable it")) < len(without.compress(b"so abominable it"))


def test_the_sample_stays_off_the_driver(spark, monkeypatch):
    """A task trains the model that the sample gives; no text of it is collected."""
    docs, labels, _ = corpus(spark)
    sample = toxicity.labelled_sample(docs, labels.where(toxicity.fold_of("doc_id", 3) != 1), "toxic", {0: toxicity.SAMPLE_ORDINARY, 1: toxicity.SAMPLE_TOXIC})
    want = toxicity.train(sample)

    def never(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "labelled_sample", never)
    got = toxicity.fit(docs, labels)
    assert (got.ordinary, got.toxic) == (want.ordinary, want.toxic) and got.weights == pytest.approx(want.weights, abs=1e-9)
    assert toxicity.fit(docs.limit(0), labels) is None and toxicity.fit(docs, labels.where("toxic = 0")) is None
