"""Recall of the near-duplicate classes, ids with several texts, and what is left behind."""

import os
import random

import numpy as np
import pytest

from chartlake.llm import common, exact_dedup, near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def edited(r, text, share):
    out = []
    for w in text:
        x = r.random()
        if x >= share:
            out.append(w)
        elif x < share * 0.7:
            out.append(words(r, 1)[0])
        elif x < share * 0.85:
            out += [w, words(r, 1)[0]]
    return out


@pytest.mark.parametrize(("n", "tries"), [(12, 600), (30, 300), (60, 600), (100, 600), (250, 300), (1500, 80)])
def test_recall_by_length_and_similarity(n, tries):
    """In each class of length and band of similarity, from the threshold on, 0.9 of the pairs share a bucket."""
    r, known, bands = random.Random(40), near_dedup.WordHashes(), {}
    for _ in range(tries):
        a = words(r, n)
        share = r.uniform(0, 0.24)
        x, y = (near_dedup.word_hashes(" ".join(t), known) for t in (a, [words(r, 1)[0] if r.random() < share else w for w in a]))
        alike = near_dedup.similarity(x, y)
        # two edits among twelve words can leave no run of five words alike, and then nothing to find
        if alike >= near_dedup.SIMILARITY and np.intersect1d(near_dedup.kmers(x), near_dedup.kmers(y)).size:
            band = bands.setdefault(min(3, int((alike - 0.8) / 0.05 + 1e-9)), [0, 0])
            band[0] += bool(np.intersect1d(near_dedup.bucket_keys(x), near_dedup.bucket_keys(y)).size)
            band[1] += 1
    assert all(found >= 0.9 * pairs for found, pairs in bands.values()) and sum(p for _, p in bands.values()) >= 30, bands


def test_recall_after_inserted_and_lost_words():
    r = random.Random(40)
    for n, share in ((12, 0.05), (30, 0.06), (60, 0.08), (250, 0.08), (1500, 0.08), (6000, 0.08)):
        known, found, pairs = near_dedup.WordHashes(), 0, 0
        for _ in range(60 if n < 1000 else 20):
            a = words(r, n)
            x, y = (near_dedup.word_hashes(" ".join(t), known) for t in (a, edited(r, a, share)))
            if near_dedup.similarity(x, y) >= near_dedup.SIMILARITY:
                pairs += 1
                found += bool(np.intersect1d(near_dedup.bucket_keys(x), near_dedup.bucket_keys(y)).size)
        assert pairs >= 10 and found >= 0.9 * pairs, (n, found, pairs)


def test_labels_of_first_occurrences_are_alike():
    """A k-mer keeps its label whether or not another one of its text is repeated."""
    h = near_dedup.mix(np.arange(1, 9, dtype=np.uint64))
    again = np.concatenate([h, h[:2]])
    assert near_dedup.labelled(h).tolist() == near_dedup.labelled(again)[:8].tolist()
    assert len(set(near_dedup.labelled(again).tolist())) == 10


def test_similarity_is_edit_similarity_of_words():
    known = near_dedup.WordHashes()
    of = lambda t: near_dedup.word_hashes(t, known)
    assert near_dedup.similarity(of("a b c d e f g h i j"), of("a b c x e f g h i j")) == 0.9
    assert near_dedup.similarity(of("a b c d e"), of("a b c x y")) == 0.0
    assert near_dedup.similarity(of(""), of("")) == 1.0


def test_one_id_with_several_texts(spark):
    r = random.Random(41)
    a, b = (" ".join(words(r, 60)) for _ in range(2))
    near = b.replace(b.split()[30], "changed", 1)
    df = docs(spark, [a, b, a, near, None, "other words of a lone row"], [5, 5, 5, 6, None, None])
    got = rows(near_dedup.deduplicate(df))
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in got) == sorted([(5, a), (5, b), (0, ""), (0, "other words of a lone row")])
    classes = {(x["doc_id"], x["class_id"]) for x in rows(near_dedup.classify(df))}
    assert classes == {(5, 5), (6, 5), (None, None)}


def test_very_long_and_clashing(spark):
    r = random.Random(42)
    long = words(r, 40_000)
    texts = [" ".join(long), " ".join(edited(r, long, 0.03)), "x" * 2_000_000, "short one"]
    df = docs(spark, texts).selectExpr("*", "1 AS copy", "2 AS id", "3 AS words", "4 AS class_id", "5 AS text_md5", "6 AS row")
    got = {x["doc_id"]: x["class_id"] for x in rows(near_dedup.classify(df))}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    assert near_dedup.deduplicate(df).columns == df.columns


def test_tables_made_on_the_way_are_removed(spark):
    folder = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    out = near_dedup.classify(docs(spark, ["a b c d e f"] * 3))
    left = [x for x in set(os.listdir(folder)) - before if not x.startswith(".")]
    assert len(left) == 1 and left[0].startswith("result") and out.count() == 3


def test_exact_copies_of_one_id_with_several_texts(spark):
    df = docs(spark, ["a", "b", "c", "a", "a", None], [5, 5, 6, 5, 4, None])
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in rows(exact_dedup.deduplicate(df))) == [(0, ""), (5, "a"), (5, "b"), (6, "c")]
    long = docs(spark, ["x" * 3_000_000, "x" * 3_000_000, "y"])
    assert sorted((x["doc_id"], x["keep_id"]) for x in rows(exact_dedup.classify(long, budget=1000))) == [(0, 1), (1, 1), (2, 2)]


def test_stars_are_known_without_one_more_round(spark, monkeypatch):
    """A task's edges become stars at once, so that a chain in one task needs no round of joins; stars are told from all else."""
    import pyarrow as pa

    frame = lambda edges: spark.createDataFrame(edges, "u long, v long")
    for edges, want in (([], True), ([(3, 1), (2, 1), (3, 1)], True), ([(3, 2), (2, 1)], False), ([(3, 1), (3, 2)], False)):
        assert near_dedup._all_stars(frame(edges)) == want
    monkeypatch.setattr(near_dedup, "HELD", 4)
    cut = [tuple(r.values()) for b in near_dedup._contracted(pa.record_batch({"u": [i + 1], "v": [i]}) for i in range(20)) for r in b.to_pylist()]
    assert len(cut) == 20 and {v for _, v in cut} == {0, 5, 10, 15}
    joins, staged = [], near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, what="staged": joins.append("Join" in df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, what))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(r["id"], r["component"]) for r in near_dedup.components(chain.coalesce(1)).collect()} == {(i, 0) for i in range(301)}
    assert joins == [False]
    assert {(r["id"], r["component"]) for r in near_dedup.components(chain.repartition(7)).collect()} == {(i, 0) for i in range(301)}
    assert any(joins)


def test_steps_without_new_links_merge_nothing(spark, monkeypatch):
    seen, staged = [], near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, what="staged": seen.append(what) or staged(df, what))
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "quite another text")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.classify(docs).collect())) == [(1, 1, 1, True), (2, 2, 1, False), (3, 3, 3, True)]
    assert "late" not in seen


def test_marks_tell_texts_apart():
    """Words are four bytes: bit sets of their upper bits alone would be one bit each, and every pair would pass."""
    r, known = random.Random(43), near_dedup.WordHashes()
    x, y = (near_dedup.labelled(near_dedup._wide(near_dedup.short_hashes(near_dedup.word_hashes(" ".join(words(r, 300)), known)).view(np.int32))).astype(np.int64) for _ in range(2))
    a, b = (int.from_bytes(near_dedup.marks_of(g)) for g in (x, y))
    assert (a & ~b).bit_count() > 60 and (b & ~a).bit_count() > 60


def test_only_pairs_with_a_common_bucket_leave_the_last_step(spark):
    """Texts of one bag of words pass all filters of words; of them only those of one bucket are pairs."""
    r, known = random.Random(44), near_dedup.WordHashes()
    bag = words(r, 40)
    texts = [near_dedup.short_hashes(near_dedup.word_hashes(" ".join(r.sample(bag, 40)), known)).view(np.int32).tolist() for _ in range(24)]
    placed = spark.createDataFrame([(i // 4, i, 40, i) for i in range(24)], "bucket long, id long, n int, component long")
    held = spark.createDataFrame(list(enumerate(texts)), "id long, words array<int>")
    got = {(x["a"], x["b"]) for x in rows(near_dedup._outsiders(placed, near_dedup.SIMILARITY, held))}
    assert got == {(a, b) for a in range(24) for b in range(a) if a // 4 == b // 4}
