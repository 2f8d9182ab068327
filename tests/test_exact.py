"""Operators whose results have no SQL form, against plain Python; reports against what they must say."""

import json
import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chartlake.functions import fdi
from chartlake.operators import chart, corpus, fusion, vectors
from chartlake.sources import readers


def plain_text(t):
    for c in range(0x2000, 0x200B):
        t = t.replace(chr(c), " ")
    t = t.replace("\u00a0", " ")
    t = "".join(c for c in t if c in "\n\t" or ord(c) > 31)
    return unicodedata.normalize("NFKC", t)


def test_unicode_against_plain_python(spark):
    texts = ["", None, "a\u00a0b\u2003c\u200ad", "x\x00\x07\ty\n\x1bz", "ﬁne ½ Ⅳ ｆｕｌｌ", "é Å ① … ﷺ", "　wide thin​", "日本ｶﾞ", "x" * 70000 + "ﬀ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["text"] for r in corpus.normalize_unicode(df).collect()}
    assert got == {i: None if t is None else plain_text(t) for i, t in enumerate(texts)}


def murmur3(data: bytes, seed: int = 42) -> int:
    """The published 32-bit hash."""
    m, rot = 0xFFFFFFFF, lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    word = lambda k: rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h = (rot(h ^ word(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & m
    if whole < len(data):
        h ^= word(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def test_embeddings_against_plain_python(spark):
    texts = ["Red teeth and red gums", "gums recede", "", None, "teeth", "çà et là", "red red red red"]
    got = {r["i"]: r["embedding"] for r in vectors.embed_text(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), 64).collect()}
    counts = [Counter(murmur3(w.encode()) % 64 for w in re.split(r"\s", (t or "").lower())) for t in texts]
    df = Counter(k for c in counts for k in c)
    for i, c in enumerate(counts):
        raw = [c[k] * math.log((len(texts) + 1) / (df[k] + 1)) for k in range(64)]
        size = math.sqrt(sum(x * x for x in raw))
        assert got[i] == pytest.approx([x / size if size else 0.0 for x in raw], abs=1e-12)


def test_chunk_numbers_stay_whole(spark):
    words = " ".join(["word"] * 12)
    s = spark.range(10_002).select(F.lit("A b.PDF").alias("doc"), F.col("id").alias("section_no"), F.lit("Part").alias("label"), F.lit(words).alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    ids = [r["chunk_id"] for r in corpus.emit_chunks(s).select("chunk_id").collect()]
    assert len(set(ids)) == 10_002 and {"a-b#0000", "a-b#9999", "a-b#10001"} <= set(ids)


TOOTH = "image_id long, det_id long, class_id int, fdi int, anatomy string, raw_score double, score double, x1 double, y1 double, x2 double, y2 double"


def reports(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    teeth = spark.createDataFrame([(1, 1, 0, 26, "upper_left_first_molar", 0.9, 0.95, *box), (1, 2, 0, 26, "upper_left_first_molar", 0.4, 0.625, *box), (1, 3, 0, 48, "", 0.6, 0.746, *box), (1, 4, 0, 11, None, 0.5, 0.5, *box)], TOOTH)
    rest = spark.createDataFrame([(1, 9, "Crown", 0.5, 0.5, *box)], "image_id long, det_id long, kind string, raw_score double, score double, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([(1, 5, "Cavities", 26, "upper_left_first_molar", 0.8, 0.9, 0.5, *box), (1, 6, "Infection", 26, "upper_left_first_molar", 0.3, 0.4, 0.5, *box), (1, 7, "Damage", None, None, 0.8, 0.8, 0.0, *box), (1, 8, "Wisdom", 38, "x", 0.8, 0.8, 0.7, *box)], "image_id long, det_id long, label string, tooth_fdi int, tooth_anatomy string, raw_score double, score double, containment double, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(1, 640, 480), (2, 100, 50)], "image_id long, image_width int, image_height int")
    slots = chart.annotate_chart(images, teeth, found)
    counts = chart.condition_counts(images, chart.tooth_status(slots), teeth, rest, found)
    a = fusion.assemble_analysis(images, teeth, rest, found).join(fusion.summary_text(teeth, rest, found), "image_id", "left")
    return {r["image_id"]: json.loads(r["report"]) for r in readers.export_report(a, chart.tooth_view(slots, teeth), counts, "none").collect()}


def test_reports_say_what_is_seen(spark):
    got = reports(spark)
    one = got[1]
    assert one["image_size"] == {"width": 640, "height": 480} and one["disclaimer"] == "none"
    # tooth 38 bears a finding but was not detected: it is not in the list, and no wisdom tooth counts
    assert one["counts"] == {"healthy": 2, "caries": 0, "infection": 1, "wisdom": 0, "detected": 4, "missing": 1, "restorations": 1, "lesions": 1}
    assert [(t["fdi"], t["name"], t["arch"], t["side"], t["status"], t["condition"], t["confidence"], t["findings"], t["ambiguous"]) for t in one["teeth"]] == [
        (11, "Upper Right Central Incisor", "Upper", "Right", "Healthy", "Good", 50, [], False),
        (26, "Upper Left First Molar", "Upper", "Left", "Infection", "Periapical", 63, ["Infection", "Cavities"], True),
        (48, "Lower Right Third Molar", "Lower", "Right", "Healthy", "Good", 75, [], False),
    ]
    assert [f["label"] for f in one["unattributed_findings"]] == ["Damage"] and [r["kind"] for r in one["restorations"]] == ["Crown"] and one["ambiguous_fdi"] == [26]
    assert one["summary"].startswith("4 teeth detected; restorations: Crown\n")
    two = got[2]
    assert two["image_size"] == {"width": 100, "height": 50} and two["teeth"] == two["unattributed_findings"] == two["restorations"] == two["ambiguous_fdi"] == []
    assert set(two["counts"].values()) == {0} and "summary" not in two


def test_all_slots_are_seen(spark):
    images = spark.createDataFrame([(7,)], "image_id long")
    none = spark.createDataFrame([], TOOTH)
    found = spark.createDataFrame([], "image_id long, det_id long, label string, tooth_fdi int, score double")
    view = chart.tooth_view(chart.annotate_chart(images, none, found), none).orderBy("slot").collect()
    assert [r["fdi"] for r in view] == list(fdi.VIEWER_ORDER) and {(r["status"], r["condition"], r["confidence"]) for r in view} == {("Undetected", "Not detected", 0)}
