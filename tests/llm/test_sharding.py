"""Shards along the curve on awkward tables, and against an order worked out row by row."""

import random
import tempfile
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chartlake.llm import hilbert

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict() for r in df.collect()]


def docs(spark, texts, source=lambda i: "s", lang=lambda i: "en", ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, lang(i), source(i), 1) for i, t in enumerate(texts)], DOCS)


def even(got, n, shards=8):
    by = defaultdict(list)
    for x in got:
        by[x["shard"]].append(x["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("n", [0, 1, 20])
def test_small_and_constant_tables(spark, n):
    even(rows(hilbert.assign_shards(docs(spark, ["same"] * n))), n)
    even(rows(hilbert.assign_shards(docs(spark, [None] * n, lambda i: None, lambda i: None, [None] * n))), n)


def test_repeated_rows_and_clashing_columns(spark):
    df = docs(spark, ["a", "b", "a", None] * 5, lambda i: None if i % 3 else "x", ids=[1, 2, 1, 3] * 5)
    df = df.selectExpr("*", "1 AS rank", "2 AS hilbert", "3 AS total", "4 AS __part", "'z' AS size", "5 AS shard", "6 AS slot", "7 AS digest")
    even(rows(hilbert.assign_shards(df)), 20)
    path = tempfile.mkdtemp() + "/s"
    files = rows(hilbert.write_shards(df, path, shards=3, max_rows_per_file=4))
    assert sum(f["rows"] for f in files) == 20 and max(f["rows"] for f in files) <= 4
    back = rows(spark.read.parquet(path))
    assert sorted((x["doc_id"], x["text"] or "", x["hilbert"], x["shard"]) for x in back) == sorted((i, t or "", 2, 5) for i, t in [(1, "a"), (2, "b"), (1, "a"), (3, None)] * 5)


def test_strings_count_whole(spark):
    """Values that agree in their first bytes still lie in cells of their own."""
    names = [f"https://example.org/a/very/long/prefix/{i:03d}" for i in range(32)]
    df = docs(spark, [f"text {i}" for i in range(320)], lambda i: names[i % 32])
    cuts = hilbert.boundaries(df, ["source"], 5)[0]
    assert cuts == ["\x01" + x for x in names[:-1]]
    skewed = docs(spark, ["t"] * 100, lambda i: "hot" if i < 70 else f"v{i}")
    cuts = hilbert.boundaries(skewed, ["source"], 2)[0]
    assert cuts == ["\x01hot", "\x01v74"]


def test_equal_texts_lie_together(spark):
    r = random.Random(30)
    texts = [r.choice(["copy one", "copy two", f"own {i}"]) if i % 2 else f"text {i}" for i in range(400)] + ["hot " * 500] * 200
    df = docs(spark, texts, lambda i: f"source {i % 7}", lambda i: r.choice(["en", "de", None])).repartition(5)
    got = sorted(rows(hilbert.assign_shards(df, shards=6)), key=lambda x: (x["shard"], x["slot"]))
    even(got, 600, 6)
    order = [texts[x["doc_id"]] for x in got]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) + 1 == len(set(order))
    parted = sum(len({x["shard"] for x in got if texts[x["doc_id"]] == t}) > 1 for t in set(texts))
    assert parted <= 5


def skilling(x, bits):
    """Place on the curve of one cell, bit by bit."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    return sum(((v ^ t) >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i, v in enumerate(x))


def test_order_equals_brute_force(spark):
    r = random.Random(31)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    source, lang = [r.choice(["x", "y", "zz", None]) for _ in texts], [r.choice(["en", "de"]) for _ in texts]
    df = docs(spark, texts, lambda i: source[i], lambda i: lang[i])
    rowset = spark.createDataFrame([(s, la, len(t) + 1) for s, la, t in zip(source, lang, texts, strict=True)], "source string, lang string, size long")
    cuts = hilbert.boundaries(rowset, ["source", "lang", "size"])
    code = lambda v: float(v) if isinstance(v, int) else "" if v is None else "\x01" + v
    first = {t: i for i, t in reversed(list(enumerate(texts)))}

    def key(i):
        lead = first[texts[i]]
        cell = [sum(code(v) > c for c in cut) for v, cut in zip((source[lead], lang[lead], len(texts[lead]) + 1), cuts, strict=True)]
        return skilling(cell, 5), zlib.crc32(texts[i].encode()), i

    got = sorted(rows(hilbert.assign_shards(df, shards=7)), key=lambda x: (x["shard"], x["slot"]))
    assert [x["doc_id"] for x in got] == sorted(range(len(texts)), key=key)


def test_very_long_texts(spark):
    texts = ["x" * 3_000_000, "é" * 1_000_000, "short"]
    got = {x["doc_id"]: (x["size"], x["text_crc32"]) for x in rows(hilbert.assign_shards(docs(spark, texts)))}
    assert got == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)}
    assert rows(hilbert.assign_shards(docs(spark, texts).withColumn("source", F.lit("fixed"))).agg(F.count("*").alias("n"))) == [{"n": 3}]
