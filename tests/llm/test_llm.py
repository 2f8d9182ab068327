"""Every corpus operator against brute force, exact round trips or held-out figures, and on awkward tables."""

import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from chartlake.llm import decontamination, exact_dedup, hilbert, near_dedup, packing, quality, token_count, toxicity, url_filter, warc
from chartlake.llm.common import fold_of
from chartlake.llm.tokens import ByteBpe

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "one", "a  b", "a \n b", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b <|endoftext|", "é ü  z", " lead", "trail ", "日本 語。x", "don't I'll", "a   b c", "word " * 3000]


def words(r, n):
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, texts, ids=None, extra=False):
    df = spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)
    return df.selectExpr("*", "'x' AS digest", "1 AS keep_id", "2 AS rank", "'y' AS hash", "3 AS score") if extra else df


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_byte_bpe_equals_tokenizers():
    t = Tokenizer.from_file(BPE)
    r = random.Random(1)
    texts = [x or "" for x in ODD] + [words(r, 200).replace(" th", r.choice([" th", "\nth", " \tth", "\u00a0 th"])) for _ in range(40)]
    ids, ends = ByteBpe(BPE).encode(texts)
    for i, text in enumerate(texts):
        assert ids[ends[i - 1] if i else 0 : ends[i]].tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("budget", [1, 2000])
def test_exact_dedup_at_any_memory(spark, budget):
    r = random.Random(2)
    texts = [words(r, r.randint(0, 30)) for _ in range(40)]
    texts = [r.choice(texts) for _ in range(300)] + [None, "", None]
    got = {x["doc_id"]: x for x in rows(exact_dedup.classify(table(spark, texts, extra=True).repartition(3), budget=budget))}
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[t or ""].append(i)
    for group in by.values():
        for i in group:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(group), len(group), i == max(group))
    assert sorted(x["doc_id"] for x in rows(exact_dedup.deduplicate(table(spark, texts)))) == sorted(map(max, by.values()))


def test_exact_dedup_edges(spark):
    assert exact_dedup.classify(table(spark, []).limit(0)).count() == 0
    got = rows(exact_dedup.classify(table(spark, ["a", "a", "a"], [5, 5, None])))
    assert sorted((x["doc_id"] or 0, x["kept"], x["group_size"]) for x in got) == [(0, False, 3), (5, True, 3), (5, True, 3)]
    assert exact_dedup.deduplicate(table(spark, ["a", "a", "b"], [5, 5, 6])).count() == 2


def test_exact_dedup_compares_contents():
    t = exact_dedup.ContentTable()
    t.add(b"d" * 32, b"a", 1, 1)
    with pytest.raises(ValueError, match="share the digest"):
        t.add(b"d" * 32, b"b", 2, 1)


def test_hilbert_curve_visits_neighbours(spark):
    df = spark.range(512).selectExpr("id & 7 x", "shiftright(id, 3) & 7 y", "shiftright(id, 6) z", "id & 7 a", "shiftright(id, 3) & 7 b", "shiftright(id, 6) c")
    got = sorted((r["hilbert"], r["a"], r["b"], r["c"]) for r in rows(hilbert.hilbert_index(df, ["x", "y", "z"], 3)))
    assert [g[0] for g in got] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:], strict=True)) == 1 for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("n", [0, 5, 203])
def test_shards_are_even_and_gapless(spark, n):
    r = random.Random(n)
    texts = [r.choice([None, "", words(r, r.randint(1, 50))]) for _ in range(n)]
    df = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("doc_id").cast("string")))
    got = rows(hilbert.assign_shards(df))
    by = defaultdict(list)
    for x in got:
        by[x["shard"]].append(x)
        text = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
    sizes = [len(by[s]) for s in range(8)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    order = sorted(got, key=lambda x: (x["shard"], x["slot"]))
    assert [x["hilbert"] for x in order] == sorted(x["hilbert"] for x in order)


def test_written_shards_hold_all_rows(spark):
    files = rows(hilbert.write_shards(table(spark, [words(random.Random(i), 5) for i in range(50)]), tempfile.mkdtemp() + "/s", max_rows_per_file=4))
    assert sum(f["rows"] for f in files) == 50 and max(f["rows"] for f in files) <= 4


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.b.com", "", "block"), ("com", "/fr/x/longer/than/host", "block"), ("", "/", "block"), (None, "/", "block")]


def judged(url, rules, default="allow"):
    if not url or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: len(x[0])) if fit else (None, default)
    return host, path, *best


@pytest.mark.parametrize("parts", ["7"])
def test_url_rules(spark, parts):
    r = random.Random(3)
    urls = [None, "", "nothing", "http://", "x://ORG", "http://org", "http://a.org?x/y", "http://EXAMPLE.org/es/#f", "http://notexample.org/es/"]
    urls += [f"http://{r.choice(['', 'www.', 'm.x.'])}{r.choice(['example.org', 'b.com', 'a.b.com', 'com', 'org', 'xorg', 'a..org'])}{r.choice(['', '/', '/es/1', '/en/12', '/fr/', '/fr/x/longer/than/hosts', '?q=/es/'])}" for _ in range(300)] + ["http://hot.example.org/es/"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' AS host", "'z' AS rule", "1 AS pid")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in rows(url_filter.judge(pages, rules))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: judged(u, RULES) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {x["verdict"] for x in rows(url_filter.judge(pages, rules.limit(0), default="block"))} == {"block"}


def test_warc_round_trip(spark):
    big = "é" * 60
    html = [big, None, "", big, "small", "small", "x" * 100, "x" * 100, "x" * 99, "x" * 99, "a\r\n\r\nWARC/1.1\r\n" * 20]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i % 2 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(pages, path, max_records=3)
    records = warc.read_archives(spark, path)
    got = {x["page_id"]: x for x in rows(warc.resolved(records))}
    import hashlib

    for i, h in enumerate(html):
        data = (h or "").encode()
        first = min(j for j, o in enumerate(html) if (o or "").encode() == data) if len(data) >= 100 else i
        assert got[i] == {"page_id": i, "payload_bytes": len(data), "payload_digest": hashlib.sha256(data).hexdigest(), "record_type": "response" if first == i else "revisit", "refers_to": None if first == i else first}
    assert {x["page_id"]: x["url"] for x in rows(records)} == {i: f"http://h/{i}" if i % 2 else None for i in range(len(html))}
    warc.write_archives(pages.limit(0), path + "0")
    warc.write_archives(spark.createDataFrame([(1, None, big), (1, None, big), (None, None, big)], pages.schema), path + "2")
    assert sorted((x["page_id"] or 0, x["record_type"], x["refers_to"]) for x in rows(warc.resolved(warc.read_archives(spark, path + "2")))) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


def test_packing_places_everything_once(spark):
    r = random.Random(4)
    texts = ODD + [words(r, r.randint(1, 900)) for _ in range(60)] + ["same text"] * 20
    got = rows(packing.pack(table(spark, texts, extra=True).repartition(3), BPE))
    t = Tokenizer.from_file(BPE)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for x in got:
        by_seq[x["sequence_id"]].append((x["offset"], x["length"]))
        by_doc[x["doc_id"]].append(x)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and sum(p["length"] for p in pieces) == len(ids)
        assert all(p["length"] == 1024 for p in pieces[1:])
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)
    assert len(by_seq) <= 1.1 * sum(x["length"] for x in got) / 1024 + 1
    assert packing.pack(table(spark, []).limit(0), BPE).count() == 0


def test_plans_of_random_histograms():
    for seed in range(20):
        r = random.Random(seed)
        cap = r.choice([16, 64, 256])
        hist = {r.randint(1, cap): r.randint(1, 400) for _ in range(r.choice([1, 5, 40]))}
        runs, n = packing.plan(hist, cap, groups=r.choice([2, 8]))
        seqs, seen = defaultdict(list), Counter()
        for length, rank, count, first, offset in runs:
            for i in range(count):
                seen[length, rank + i] += 1
                seqs[first + i].append((offset, length))
        assert set(seen.values()) == {1} and len(seen) == sum(hist.values()) and len(seqs) == n
        assert all(sum(x[1] for x in s) <= cap for s in seqs.values())


def test_unigram_counts_equal_tokenizers(spark):
    vocab = token_count.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    r = random.Random(5)
    texts = ODD + ["▁x", "x▁▁y", "<s> a", "🙂🙂 x", words(r, 300)]
    got = {x["doc_id"]: x["n_tokens"] for x in rows(token_count.count_tokens(table(spark, texts, extra=True), public_tokenizers.path("piece_bpe_32k.model")))}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_unigram_ties_equal_tokenizers():
    r = random.Random(6)
    for _ in range(40):
        vocab = [("<unk>", 0.0)] + [(p, float(r.randint(-3, -1))) for p in sorted({"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))) for _ in range(8)})]
        t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        c = token_count.PieceCounter(vocab, byte_fallback=False)
        for _ in range(30):
            x = "".join(r.choice("abc ") for _ in range(r.randint(1, 12)))
            assert c.batch([x])[0][0] == len(t.encode(x, add_special_tokens=False).ids)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_is_exact_within_its_band():
    r = random.Random(7)
    for _ in range(800):
        a = [r.randint(0, 6) for _ in range(r.randint(1, 20))]
        b = [r.randint(0, 6) if r.random() < 0.2 else x for x in a if r.random() < 0.9] or [1]
        best = lcs(a, b)
        assert near_dedup.banded_lcs(a, b, len(a) + len(b) - 2 * best) == best


def test_near_copies_share_a_class_and_others_do_not(spark):
    r = random.Random(8)
    base = [words(r, n) for n in (9, 30, 120, 800, 3000)]
    passage = words(r, 60)
    texts, want = [], []
    for k, b in enumerate(base):
        for _ in range(8):
            w = b.split()
            for _ in range(len(w) // 120):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w) + ("" if len(w) < 100 else " tail"))
            want.append(k)
    for _ in range(30):
        texts.append(words(r, 150) + " " + passage + " " + words(r, 150))
        want.append(len(texts) + 100)
    texts += [None, "", "  ", "A b, c", "a B c"]
    want += [-1, -1, -1, -2, -2]
    got = {x["doc_id"]: x for x in rows(near_dedup.classify(table(spark, texts, extra=True).repartition(3), small=3))}
    classes = defaultdict(set)
    for i, k in enumerate(want):
        classes[k].add(got[i]["class_id"])
    assert all(len(v) == 1 for v in classes.values()) and len({next(iter(v)) for v in classes.values()}) == len(classes)
    assert sum(x["kept"] for x in got.values()) == len(classes) == near_dedup.deduplicate(table(spark, texts)).count()
    assert near_dedup.classify(table(spark, []).limit(0)).count() == 0
    assert [x["kept"] for x in rows(near_dedup.classify(table(spark, ["a b", "a b"], [None, 3])).orderBy("doc_id"))] == [True, True]


def test_large_buckets_lose_no_link(spark):
    r = random.Random(20)
    texts = []
    for _ in range(4):
        chain = words(r, 60).split()
        for _ in range(14):  # edits add up along a chain: its ends are no near copies, its neighbours are
            chain[r.randrange(60)] = words(r, 1)
            texts.append(" ".join(chain))
    shared = words(r, 5)
    texts += [shared + " " + words(r, r.randint(0, 3)) for _ in range(40)]
    seen = near_dedup.WordHashes()
    mers = [near_dedup.word_hashes(t, seen) for t in texts]
    keys = [set(near_dedup.bucket_keys(h).tolist()) for h in mers]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and near_dedup.similarity(mers[i], mers[j]) >= near_dedup.SIMILARITY:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = {x["doc_id"]: x["class_id"] for x in rows(near_dedup.classify(table(spark, texts).repartition(3), small=2))}
    assert [got[i] for i in range(len(texts))] == label and 4 < len(set(label)) < len(texts)


def test_rare_first_join_meets_every_link(spark):
    r = random.Random(21)
    common, texts = words(r, 200).split(), []
    for n in (1, 3, 5, 6, 9, 20, 60, 150):
        base = words(r, n).split() + common[: n // 2]
        for _ in range(12):
            texts.append(" ".join(w for w in base if r.random() > 0.015) or base[0])
    seen = near_dedup.WordHashes()
    mers = [near_dedup.word_hashes(t, seen) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similarity(mers[i], mers[j]) >= near_dedup.SIMILARITY}
    placed = spark.createDataFrame([(0, i, len(h), i) for i, h in enumerate(mers)], "bucket long, id long, n int, component long")
    held = spark.createDataFrame([(i, near_dedup.short_hashes(h).view(np.int32).tolist()) for i, h in enumerate(mers)], "id long, words array<int>")
    got = near_dedup._outsiders(placed, near_dedup.SIMILARITY, held)
    pairs = {(x["a"], x["b"]) for x in rows(got.distinct())}
    assert want <= pairs and len(want) > 100 and len(pairs) < len(texts) * (len(texts) - 1) / 4


def test_components_of_random_graphs(spark):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in rows(near_dedup.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


ITEMS = ["A train leaves the old station at 12 km per hour and travels for 30 minutes towards the coast before Maria stops it there again", "how long does the river take to reach the sea below the tall grey mountains near the lake"]


@pytest.mark.parametrize("handed", [0, 1 << 20])
def test_leaks_found_with_other_parameters(spark, handed):
    r = random.Random(10)
    swapped = ITEMS[0].replace("12", "95").replace("30", "7").replace("Maria", "Ahmed")
    broken = "we saw 5 red cars and 5 blue cars at the gate near 5 houses by the road"
    texts = [words(r, 40) + ". " + ITEMS[0] + " " + words(r, 9), words(r, 30) + ". " + swapped, words(r, 200), None, "", ITEMS[1][:40], words(r, 5000) + " " + ITEMS[1], broken.replace("5", "8"), "we saw 5 red cars and 6 blue cars at the gate near 7 houses by the road"]
    bench = spark.createDataFrame([*enumerate([*ITEMS, broken, "two words", "", None])], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["changed_slots"] for x in rows(decontamination.find_leaks(table(spark, texts, extra=True), bench, handed=handed))}
    assert got == {(0, 0): False, (1, 0): True, (6, 1): False, (7, 2): True}
    assert sorted(x["doc_id"] for x in rows(decontamination.drop_leaked(table(spark, texts), bench))) == [2, 3, 4, 5, 8]
    assert decontamination.find_leaks(table(spark, texts), bench.limit(0)).count() == 0
    assert decontamination.find_leaks(table(spark, []).limit(0), bench).count() == 0


def labelled(spark, r, n, mark):
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = words(r, r.randint(30, 120)).split()
        if bad:
            w = mark(r, w)
        texts.append(" ".join(w))
        labels.append(int(bad))
    return table(spark, texts), labels


def held_out_accuracy(got, labels):
    rest = [x for x in got if x["held_out"]]
    return sum(x["predicted"] == labels[x["doc_id"]] for x in rest) / len(rest)


def test_toxicity_on_held_out_rows(spark):
    def mark(r, w):
        for _ in range(4):
            w.insert(r.randrange(len(w)), r.choice(["vilgrum", "snarkjob", "dreckpot"]) + r.choice(["", "s", "ful"]))
        return w

    docs, labels = labelled(spark, random.Random(11), 400, mark)
    lab = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.score(docs, toxicity.fit(docs, lab)))
    assert len(got) == 400 and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)
    assert held_out_accuracy(got, labels) > 0.9
    model = toxicity.fit(docs, lab)
    odd = rows(toxicity.score(table(spark, ODD, extra=True), model))
    assert len(odd) == len(ODD) and all(0 <= x["score"] <= 1 for x in odd)
    assert {x["predicted"] for x in rows(toxicity.score(docs, toxicity.fit(docs, lab.where("toxic = 0"))))} == {0}
    assert toxicity.keep_clean(docs, lab).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, random.Random(12), 400, lambda r, w: [x + r.choice(["***", "%%%", "$$$"]) for x in w])
    lab = spark.createDataFrame([(i, 1 - y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = rows(quality.classify(docs, lab))
    assert held_out_accuracy(got, [1 - y for y in labels]) > 0.95
    stats = quality.with_statistics(docs)
    model = quality.fit(stats, lab)
    assert 0 < len(model.rules) < 200
    odd = rows(quality.score(quality.with_statistics(table(spark, ODD, extra=True)), model))
    assert len(odd) == len(ODD) and all(0 <= x["score"] <= 1 for x in odd)
    assert {x["score"] for x in rows(quality.score(stats, quality.fit(stats, lab.limit(0))))} == {0.5}
    assert quality.classify(docs.limit(0), lab).count() == 0


def test_folds_are_crc_remainders(spark):
    got = rows(spark.range(50).select("id", fold_of("id", 4).alias("f")))
    assert all(x["f"] == zlib.crc32(str(x["id"]).encode()) % 4 for x in got)


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    d = tempfile.mkdtemp()
    r = random.Random(13)
    texts = [words(r, 80) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", ITEMS[1], None]
    table(spark, texts).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*enumerate(ITEMS)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = {x["doc_id"] for x in rows(corpus_pipeline.run(spark, d))}
    assert got == set(range(1, 41)) | {43} | set() and corpus_pipeline.ORACLE_SQL is None
