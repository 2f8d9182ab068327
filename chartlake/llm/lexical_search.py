"""Ranked lexical search over classes of documents that are the same bag to the items.

Of a document only the items' vocabulary matters, and its length by way of m. Documents with the same term frequencies over
that vocabulary and the same m have the same score for every item: they are grouped by a hash and compared in full, every class
is scored once, and the classes that lead are expanded into their documents by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.llm.common import documents_of, scratch, staged

# Fixed values of the score: its scales and the shares of the length.
WEIGHT, SCALE, FLAT, SLOPED = 1000, 1_000_000_000, 50, 50
#: Bytes of vocabulary that are handed to the tasks at once; items with more are searched in blocks, each over all documents.
VOCABULARY = 32 << 20
#: Class hashes that are handed to the tasks to find the members of leading classes; more are joined by a shuffle.
HASHES = 250_000
#: Sums of a slice of classes that one task holds at once.
SUMS = 2_000_000

#: ASCII letters and digits are parts of terms, as is every byte of a longer UTF-8 character; the rest separates. Only A-Z change.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct; items: item_id, text."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                own = sorted(set(terms_of(text.as_buffer().to_pybytes()))) if text.is_valid else []
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(own), batch.schema.field("item_id").type), pa.array(own, pa.binary())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, term binary").distinct()


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with at least one term: n counts all terms, the arrays hold the vocabulary's, ascending."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], [], [0], [], []

            def made() -> pa.RecordBatch:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_buffer().to_pybytes())
                if not words:
                    continue
                own = sorted((vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary)
                ids.append(ident)
                sizes.append(len(words))
                terms += [t for t, _ in own]
                tfs += [c for _, c in own]
                ends.append(len(terms))
                if len(terms) > SUMS:
                    yield made()
                    ids, sizes, ends, terms, tfs = [], [], [0], [], []
            yield made()

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class _Leaders:
    """The k best classes of every item so far: by score, then by the least id of a member."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.floor = k, [np.empty((0, 4), np.int64)], np.ones(items, np.int64)
        self.held, self.most = 0, 100_000 + 2 * items * k

    def add(self, scores: np.ndarray, first: np.ndarray, cid: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.floor)
        self.rows.append(np.stack([item, scores[at, item], first[at], cid[at]], axis=1))
        self.held += len(at)
        if self.held > self.most:
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate(self.rows)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - start
        last = place == self.k - 1
        self.floor[rows[last, 0]] = rows[last, 1]
        rows = rows[place < self.k]
        self.rows, self.held = [rows], len(rows)
        return rows


def _score(classes: DataFrame, weights: np.ndarray, ptr: np.ndarray, holders: np.ndarray, items: int, k: int) -> DataFrame:
    """(item, score, first, cid): of every task the k best classes of every item. Term t is in the items holders[ptr[t]:ptr[t + 1]]."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Leaders(items, k)
        for batch in batches:
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy()
            base, ends = ends[0], ends - ends[0]
            terms = lists.values.to_numpy()[base : base + ends[-1]]
            at = batch.column("tfs").offsets.to_numpy()[0]
            tfs = batch.column("tfs").values.to_numpy()[at : at + ends[-1]].astype(np.int64)
            m, first, cid = (batch.column(c).to_numpy() for c in ("m", "first", "cid"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            gain = weights[terms] * ((SCALE * tfs) // (1000 * tfs + 20 * m[row]))
            many = ptr[terms + 1] - ptr[terms]
            work = np.concatenate(([0], np.cumsum(many)))[ends]
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, min(lo + max(1, SUMS // items), int(np.searchsorted(work, work[lo] + SUMS, side="right")) - 1))
                a, b = ends[lo], ends[hi]
                n = many[a:b]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                item = holders[np.repeat(ptr[terms[a:b]], n) + inner]
                total = np.zeros((hi - lo) * items, np.int64)
                np.add.at(total, np.repeat(row[a:b] - lo, n) * items + item, np.repeat(gain[a:b], n))
                best.add(total.reshape(hi - lo, items), first[lo:hi], cid[lo:hi])
                lo = hi
        rows = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0], pa.int32()), *[pa.array(np.ascontiguousarray(rows[:, i])) for i in (1, 2, 3)]], names=["item", "score", "first", "cid"])

    return classes.select("m", "terms", "tfs", "first", "cid").mapInArrow(score, "item int, score long, first long, cid long")


def _best(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank; a task passes on k rows of a group at most."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _search(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame | None:
    """The leaders of items whose (item_id, term) rows are few enough for every task, or none."""
    spark = docs.sparkSession
    pairs = wanted.toArrow()  # bounded by VOCABULARY
    idents = pairs.column("item_id").to_pylist()
    names, words = pairs.column("term").to_pylist(), {}
    for w in sorted(set(names)):
        words[w] = len(words)
    items = {x: i for i, x in enumerate(dict.fromkeys(idents))}
    if not items:
        return None
    term, item = np.array([words[w] for w in names]), np.array([items[x] for x in idents])
    order = np.lexsort((item, term))
    holders, ptr = item[order], np.searchsorted(term[order], np.arange(len(words) + 1))

    found = staged(bags(docs, words), "bags")
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).head()
    if not n_docs:
        return None
    df = np.zeros(len(words), np.int64)
    held = found.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row per term of the vocabulary
    df[held.column("t").to_numpy()] = held.column("count").to_numpy()
    weights = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    m = F.lit(100 - FLAT) + F.call_function("div", SLOPED * F.col("n") * F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long"))
    own = ["m", "terms", "tfs"]
    held = found.where(F.size("terms") > 0).withColumn("m", m).select("doc_id", F.xxhash64(*own).alias("hash"), *own)
    # grouped by the hash and by the whole content: rows of one class are verified equal
    first = F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1))
    classes = staged(held.groupBy("hash", *own).agg(first.alias("first")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    led = _best(_score(classes, weights, ptr, holders, len(items), k), "item", [F.desc("score"), "first", "cid"], k).drop("rank")
    led = staged(led, "led")
    leading = led.select("cid").distinct()
    # at most k rows an item
    chosen = staged(classes.join(leading, "cid").select("cid", "hash", *own), "chosen")
    few = chosen.select("hash").distinct()
    held = held.join(F.broadcast(few) if chosen.count() <= HASHES else few, "hash", "left_semi")
    members = held.join(chosen, ["hash", *own]).select("cid", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(32)).alias("part"))
    # of the copies in a class only the k least ids can rank; a class of many copies is cut part by part first
    ids = F.col("doc_id").asc_nulls_last()
    members = members.withColumn("at", F.row_number().over(Window.partitionBy("cid", "part").orderBy(ids))).where(F.col("at") <= k).drop("at", "part")
    members = _best(members, "cid", [ids], k).drop("rank")
    ranked = _best(led.join(members, "cid"), "item", [F.desc("score"), ids], k)
    kind = wanted.schema["item_id"].dataType.simpleString()
    known = spark.createDataFrame([(i, x) for x, i in items.items()], f"item int, item_id {kind}")
    return ranked.join(known, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, ties by ascending doc_id.

    docs: doc_id, text; items: item_id, text; other columns are not read, so that none can clash. A null or empty text has no
    terms: such a document counts nowhere, such an item gives no rows. A null doc_id ranks last among equal scores, a null item_id is an
    item of its own. Repeated document rows are documents of their own; rows of one item_id are one item with the terms of all of
    them. Texts count whole, however long. Empty tables give no rows.

    A vocabulary beyond the given bytes is cut into blocks of whole items, each searched over all documents.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    with scratch() as keep:
        wanted = staged(item_terms(items.withColumn("text", F.col("text").cast("string"))), "wanted")
        size = wanted.agg(F.sum(F.octet_length("term") + 16)).head()[0] or 0
        n = max(1, -(-size // vocabulary))
        blocks = [wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)] if n > 1 else [wanted]
        done = [keep(x) for b in blocks if (x := _search(documents_of(docs), b, k)) is not None]
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
