"""The three searches over vectors and bags, against brute force, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from chartlake.llm import centroids, lexical_search, topk_search

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, extra string, cluster int, score long, text string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], VECTORS)


def made(n, dims, seed=0, groups=5):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(groups, dims))
    v = mid[r.integers(groups, size=n)] + 0.3 * r.normal(size=(n, dims))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def scaled(v):
    return [[math.floor(256 * float(x)) for x in row] for row in v]


# ---- clustering


def brute_clusters(rows, k, rounds):
    c = [v for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in rows:
            own.setdefault(near(v)[1], []).append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    placed = [(i, *near(v)[::-1]) for i, v in rows]
    per = {}
    for _, j, d in placed:
        per[j] = per.get(j, 0) + d
    return sorted((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in placed)


@pytest.mark.parametrize(("n", "dims", "k"), [(300, 8, 12), (5, 4, 12), (60, 1, 7)])
def test_clusters_equal_brute_force(spark, n, dims, k):
    v = made(n, dims)
    v[n // 2 :] = v[: n - n // 2]  # repeated vectors tie everywhere
    found = centroids.cluster(vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)]), k, 3, dims)
    assert sorted(map(tuple, found.collect())) == brute_clusters(list(enumerate(scaled(v))), k, 3)


def test_only_whole_vectors_cluster(spark):
    rows = [(1, [0.5, 0.5]), (2, None), (3, [0.5, None]), (4, [NAN, 0.1]), (5, [INF, 0.1]), (6, [0.5]), (7, [0.5, 0.5, 0.5]), (None, [0.1, 0.1]), (1, [0.5, 0.5]), (8, [])]
    found = centroids.cluster(vectors(spark, rows), 3, 2, 2).collect()
    assert sorted((r["vec_id"] or 0) for r in found) == [0, 1, 1]
    assert {r["inertia"] for r in found} == {0}
    assert centroids.cluster(vectors(spark, rows[1:3]), 3, 2, 2).count() == 0
    assert centroids.cluster(vectors(spark, []), 3, 2, 2).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(1, [3e6, -3e6]), (2, [3e6, 3e6]), (3, [-3e6, 0.25]), (4, [3e6, -2e6])]
    found = sorted(map(tuple, centroids.cluster(vectors(spark, rows), 2, 2, 2).collect()))
    assert found == brute_clusters([(i, v) for (i, _), v in zip(rows, scaled([r[1] for r in rows]), strict=True)], 2, 2)
    with pytest.raises(Exception, match="component too large"):
        centroids.cluster(vectors(spark, [(1, [3e38, 0.0])]), 2, 2, 2).count()


def test_the_search_stops_before_all_distances():
    v = np.array(scaled(made(200, 3, groups=40)))
    c = np.array(scaled(made(40, 3, seed=1, groups=40)))
    lists, seen = centroids.Lists(c), []
    lists.c = type("Counted", (np.ndarray,), {"__getitem__": lambda s, i: (seen.append(np.size(i)), np.ndarray.__getitem__(s, i))[1]})(c.shape, c.dtype, c.copy())
    number, best = lists.nearest(v)
    far = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert number.tolist() == far.argmin(axis=1).tolist() and best.tolist() == far.min(axis=1).tolist()
    assert sum(seen) < 0.7 * far.size


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_ranks(docs, items, k):
    of = lambda t: TERM.findall((t or "").translate(UPPER))
    bags = [(i, of(t)) for i, t in docs if of(t)]
    n, words = len(bags), sum(len(b) for _, b in bags)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(of(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            s, m = 0, 100 - 50 + (50 * len(b) * n) // words
            for w in terms & set(b):
                df = sum(w in set(x) for _, x in bags)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * b.count(w)) // (1000 * b.count(w) + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def texts(spark, rows, name):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], f"{name} long, text string, score string, m int, rank int")


WORDS = "the cat Über naïve 42 a-b x_y Zoo ZOO zoo été 東京 dog.cat mat".split()


def some_docs(n, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 30)))) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(80)] + [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, " .,! \n\x00"), (None, "cat cat"), (None, "cat cat"), (3, rows[3][1]), (2 * n + 3, "cat " * 60_000)]


ITEMS = [(1, "The cat, the ZOO"), (2, "naïve 42 東京?"), (3, None), (4, ""), (5, "unheard words"), (6, "x_y été"), (6, "dog"), (None, "mat zoo"), (8, "cat")]


@pytest.mark.parametrize(("k", "vocabulary"), [(5, 1 << 20), (60, 1 << 20), (9, 150)])
def test_ranks_equal_brute_force(spark, k, vocabulary):
    docs = some_docs(60)
    found = lexical_search.search(texts(spark, docs, "doc_id").repartition(5), texts(spark, ITEMS, "item_id"), k, vocabulary)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_ranks(docs, ITEMS, k)


def test_a_search_of_nothing(spark):
    none, docs, items = texts(spark, [], "doc_id"), texts(spark, [(1, "cat")], "doc_id"), texts(spark, [(1, "cat")], "item_id")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, texts(spark, [], "item_id")).count() == 0
    assert lexical_search.search(texts(spark, [(1, None), (2, "!")], "doc_id"), items).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (1000000000 // 3000))]


def test_leading_hashes_by_a_shuffle(spark, monkeypatch):
    docs = some_docs(40)
    monkeypatch.setattr(lexical_search, "HASHES", 0)
    monkeypatch.setattr(lexical_search, "SUMS", 7)
    found = lexical_search.search(texts(spark, docs, "doc_id"), texts(spark, ITEMS, "item_id"), 6)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_ranks(docs, ITEMS, 6)


# ---- top-k search


def brute_top(rows, k, every):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    asking = {}
    for i, v in rows:
        if i is not None and i % every == 0:
            asking[i] = min(asking.get(i, v), v)
    out = []
    for q, a in asking.items():
        best = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i is None, i or 0) for i, v in rows if i != q and len(v) == len(a))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best[:k])]
    return sorted(out)


def top(df, *args, **kw):
    return sorted(map(tuple, topk_search.search(df, *args, **kw).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize(("block", "query_block"), [(4096, 512), (64, 8), (7, 3)])
def test_top_equals_brute_force(spark, block, query_block):
    v = made(400, 16)
    v[200:300] = v[100]  # a hundred copies tie
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert top(vectors(spark, rows).repartition(3), 5, 10, block=block, query_block=query_block) == brute_top(rows, 5, 10)


def test_top_of_odd_rows(spark):
    rows = [(0, [0.5, 0.5]), (50, [0.1, -0.2]), (50, [0.1, -0.3]), (1, None), (2, [0.5, None]), (3, [NAN, 0.1]), (4, [INF, 0.1]), (5, [0.5]), (100, [0.5]), (150, []), (6, []), (None, [0.5, 0.5]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [0.5, 0.5]), (200, [0.0, 0.0]), ((1 << 60) + 1, [0.5, 0.5]), ((1 << 60) + 3, [0.5, 0.5])]
    assert top(vectors(spark, rows)) == brute_top(rows, 5, 50)
    assert top(vectors(spark, [])) == [] and top(vectors(spark, [(0, [0.5])])) == [] and top(vectors(spark, [(1, [0.5]), (3, [0.5])])) == []


def test_large_products_stay_exact(spark):
    rows = [(0, [7e6, -7e6, 1.0]), (1, [7e6, 7e6, 3.0]), (2, [6e6, -7e6, 2.0]), (3, [6e6, -7e6, 3.0]), (50, [0.25, 0.0, 0.0])]
    assert top(vectors(spark, rows), 3) == brute_top(rows, 3, 50)


def test_outsiders_are_left_out_early():
    v = np.array(scaled(made(4000, 8, groups=50)), float)
    q = v[:20]
    own = np.arange(20)[:, None] == np.arange(4000)
    exact = np.where(own, -np.inf, q @ v.T)
    floor = np.sort(exact[:, :1000], axis=1)[:, -5]
    found = topk_search.qualified(q, v, 5, floor, own)
    for i, f in enumerate(found):
        assert set(np.argsort(-exact[i], kind="stable")[:5]) <= set(f)
    assert sum(map(len, found)) <= 20 * 40
