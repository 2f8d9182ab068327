"""Toxicity by compression distance.

Two zstandard dictionaries are built from a bounded sample of labelled texts: one trained on ordinary text, and one
that holds the same text and, before it, the words that toxic texts use far more often. (A dictionary trained on toxic
texts alone holds mostly their ordinary words, and finds far fewer of them: README.) Every text is cut into
windows of a few words; each window is compressed with both, and the bytes that the toxic dictionary saves are
its gain. As the dictionaries differ in nothing else, ordinary windows gain nothing. Counts of windows over
calibrated gains, fitted on labelled texts that the dictionaries did not see, give the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm.common import documents_of, fold_of, slices

WINDOW, BASE_BYTES, CLASS_BYTES = 8, 12_288, 16_384
#: Bounds of the labelled sample, in documents of each class; half of it makes the dictionaries, half calibrates.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 3000, 4500
#: Bound of the sample's texts of each class in bytes: whole texts are taken in the order of their hash while they fit.
SAMPLE_BYTES = 24 << 20
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def windows(text: str, n: int = WINDOW) -> list[bytes]:
    """Runs of n lower-case words that cover the text; one empty window for a text without words."""
    w = text.lower().split()
    return [" ".join(w[i : i + n]).encode() for i in range(0, len(w), n)] or [b""]


def _compressor(dictionary: bytes):
    """A compressor whose search tables hold a place for every byte of the dictionary, its oldest ones too."""
    import zstandard as z

    level = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=4, target_length=24, strategy=z.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=level)


def gains(pair: tuple, found: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves on every window."""
    ordinary, toxic = pair
    return np.array([len(ordinary.compress(w)) for w in found], np.int32) - np.array([len(toxic.compress(w)) for w in found], np.int32)


def features(gain: np.ndarray) -> list[float]:
    n = len(gain)
    over = [int((gain >= k).sum()) for k in (1, 2, 3, 4)]
    return [1.0, *(math.log1p(x) for x in over), min(int(gain.max()), 12), over[1] / n, over[2] / n, float(np.clip(gain.mean(), -2, 2)), math.log1p(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def score_texts(self, texts: list[str]) -> list[float]:
        pair = (_compressor(self.ordinary), _compressor(self.toxic))
        x = np.array([features(gains(pair, windows(t))) for t in texts]).reshape(len(texts), -1)
        return (1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))).tolist()


def marked_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words that toxic texts hold far more often than ordinary ones, the plainest last (a dictionary's end is nearest)."""
    in_toxic = Counter(w for t in toxic for w in set(_WORD.findall(t.lower())))
    in_ordinary = Counter(w for t in ordinary for w in set(_WORD.findall(t.lower())))
    nt, no = len(toxic), len(ordinary)

    def excess(w: str) -> float:
        expected = nt * (in_ordinary[w] + in_toxic[w] + 1) / (nt + no)
        return (in_toxic[w] - expected) / math.sqrt(expected)

    ratio = lambda w: (in_toxic[w] + 0.5) * (no + 1) / ((in_ordinary[w] + 0.5) * (nt + 1))
    scored = sorted((excess(w), w) for w, c in in_toxic.items() if c >= 3 and len(w) >= 3 and ratio(w) > 3)
    if not scored:
        return []
    least = max(4.5, 0.15 * scored[-1][0])
    return [w for x, w in scored if x >= least]


def train(sample: list[tuple[str, int]], window: int = WINDOW) -> Model | None:
    """A model from (text, label) rows; None without both labels. Of equal texts one counts."""
    import zstandard as z

    rows = list(dict.fromkeys(sample))
    by = {y: [t for t, label in rows if label == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return None
    dict_rows, cal_rows = {y: t[::2] for y, t in by.items()}, {y: t[1::2] or t for y, t in by.items()}
    plain = [w for t in dict_rows[0] for w in windows(t, window)]
    try:
        base = z.train_dictionary(BASE_BYTES, plain, level=3).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself
        base = b" ".join(plain)[-BASE_BYTES:]
    marked = b""
    for w in reversed(marked_words(dict_rows[1], dict_rows[0])):  # the plainest first, whole words
        if len(marked) + len(w.encode()) >= CLASS_BYTES:
            break
        marked = w.encode() + b" " * bool(marked) + marked
    model = Model(base or b" " * 8, marked + b" " + (base or b" " * 8), ())
    pair = (_compressor(model.ordinary), _compressor(model.toxic))
    x = np.array([features(gains(pair, windows(t, window))) for y in (0, 1) for t in cal_rows[y]])
    y = np.array([y for y in (0, 1) for _ in cal_rows[y]], float)
    return Model(model.ordinary, model.toxic, tuple(fit_logistic(x, y)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, label of at most most[label] documents and most_bytes of text of each label, those whose id hashes lowest.

    A first text longer than the bound is taken alone.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value, n in most.items():
        part = one.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    rows = documents_of(docs).join(F.broadcast(picked.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")
    # the sample's rows are few; the sums run over their sizes
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sized = rows.withColumns({"upto": F.sum(F.octet_length("text").cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(before)})
    return sized.where((F.col("upto") <= most_bytes) | (F.col("place") == 1)).select("doc_id", "text", "label")


def in_order(rows: Iterable[tuple[int, str, int]]) -> list[tuple[str, int]]:
    """(text, label) of rows (doc_id, text, label), in the order in which a model is trained on them."""
    return [(text, label) for _, text, label in sorted(rows, key=lambda r: (hash_id(r[0]), r[0], r[1]))]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """sampled as a list, in order."""
    return in_order(map(tuple, sampled(docs, labels, label, most, most_bytes).collect()))


def hash_id(i: int) -> int:
    return (int(i) * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFF


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = train(in_order(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True)))
    if model:
        yield pa.RecordBatch.from_arrays([pa.array([model.ordinary], pa.binary()), pa.array([model.toxic], pa.binary()), pa.array([list(map(float, model.weights))], pa.list_(pa.float64()))], names=["ordinary", "toxic", "weights"])


def _scorer(model: Model | None, default: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = model.score_texts(b.column("text").to_pylist()) if model else [default] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_ordinary: int = SAMPLE_ORDINARY) -> Model | None:
    """Train on labelled documents outside the held-out fold (crc32 of the id as text, modulo 3, is 1).

    A task trains on the bounded sample; only the model, some 50 KB, reaches the driver.
    """
    rows = sampled(docs, labels.where(fold_of("doc_id", 3) != 1), "toxic", {0: sample_ordinary, 1: sample_toxic})
    found = rows.coalesce(1).mapInArrow(_trained, "ordinary binary, toxic binary, weights array<double>").collect()
    return Model(bytes(found[0][0]), bytes(found[0][1]), tuple(found[0][2])) if found else None


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, default: float = 0.0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty; an empty text has one empty window. Very long texts are scored whole, window by window; equal
    texts get equal scores. Without a model (no labels of both kinds)
    every score is ``default``. Repeated rows are scored each; a null id is kept, its held_out is null; an empty table
    gives no rows; other columns are not read.
    """
    scored = documents_of(docs).mapInArrow(_scorer(model, default), "doc_id long, score double")
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their columns, in one pass without a shuffle.

    Null and empty texts stay unless an empty window scores at the threshold; every row is judged, repeated ones and rows
    without an id too; a score at the threshold is rejected. Without a model all stay; an empty table gives no rows; other
    columns, whatever their names, are kept as they are.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if model is None:
                yield b
                continue
            scores = np.array(model.score_texts([t or "" for t in b.column("text").to_pylist()]))
            yield b.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
