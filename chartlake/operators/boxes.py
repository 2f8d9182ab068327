"""Detector output: decoding, box algebra and greedy suppression.

Boxes are columns x1, y1, x2, y2; thresholds take the type of the column they meet, so a float score is
compared as float.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.operators.scan import running
from chartlake.sources.staging import staged

BOX = ("x1", "y1", "x2", "y2")


def _like(df: DataFrame, name: str, value: float) -> Column:
    return F.lit(value).cast(dict(df.dtypes)[name])


def argmax_class(df: DataFrame, scores: str = "cls_scores") -> DataFrame:
    """class_id and raw_score of the best class; the first index wins ties."""
    best = F.array_max(scores)
    return df.withColumns({"class_id": (F.array_position(scores, best) - 1).cast("int"), "raw_score": best})


def confidence_filter(df: DataFrame, threshold: float = 0.2, score: str = "raw_score") -> DataFrame:
    return df.where(F.col(score) >= _like(df, score, threshold))


def xywh_to_xyxy(df: DataFrame) -> DataFrame:
    half = lambda c, s, sign: F.col(c) + sign * F.col(s) / 2
    return df.withColumns({"x1": half("cx", "w", -1), "y1": half("cy", "h", -1), "x2": half("cx", "w", 1), "y2": half("cy", "h", 1)})


def boost_scores(df: DataFrame, passes: int = 1, raw: str = "raw_score", gain: float = 1.25) -> DataFrame:
    """score = raw score raised by the gain and capped at 1, `passes` times over."""
    score = F.col(raw)
    for _ in range(passes):
        score = F.least(score * gain, F.lit(1.0).cast(dict(df.dtypes)[raw]))
    return df.withColumn("score", score)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(x2 - x1, zero) * F.greatest(y2 - y1, zero)


def box_area(df: DataFrame) -> DataFrame:
    return df.withColumn("area", area(*map(F.col, BOX)))


def overlap(a: list[Column], b: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def iou(a: list[Column], b: list[Column]) -> Column:
    inter = overlap(a, b)
    union = area(*a) + area(*b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(a: list[Column], b: list[Column]) -> Column:
    """Share of a that lies in b."""
    own = area(*a)
    return F.when(own > 0, overlap(a, b) / own).otherwise(0.0)


def _sided(df: DataFrame, alias: str) -> tuple[DataFrame, list[Column]]:
    return df.alias(alias), [F.col(f"{alias}.{c}") for c in BOX]


def iou_pairs(a: DataFrame, b: DataFrame, by: str = "image_id", key: str = "det_id") -> DataFrame:
    """Overlap of every pair of boxes of one image."""
    (l, lb), (r, rb) = _sided(a, "l"), _sided(b, "r")
    return l.join(r, F.col(f"l.{by}") == F.col(f"r.{by}")).select(F.col(f"l.{by}").alias(by), F.col(f"l.{key}").alias("a_id"), F.col(f"r.{key}").alias("b_id"), iou(lb, rb).alias("iou"))


def containment_pairs(a: DataFrame, b: DataFrame, by: str = "image_id", key: str = "det_id") -> DataFrame:
    (l, lb), (r, rb) = _sided(a, "l"), _sided(b, "r")
    return l.join(r, F.col(f"l.{by}") == F.col(f"r.{by}")).select(F.col(f"l.{by}").alias(by), F.col(f"l.{key}").alias("a_id"), F.col(f"r.{key}").alias("b_id"), containment(lb, rb).alias("containment"))


def dense_groups(df: DataFrame, by: list[str], most: int = 20_000) -> DataFrame:
    """Groups with more boxes than a detector gives (by, count)."""
    return df.groupBy(*by).count().where(F.col("count") > most)


def split_dense(df: DataFrame, by: list[str], most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The groups of at most that many boxes and the larger ones, named only where there are any."""
    dense = staged(dense_groups(df, by, most).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]), "dense")
    if not dense.take(1):
        return df, None
    same = reduce(Column.__and__, [df[c].eqNullSafe(dense[f"_by{i}"]) for i, c in enumerate(by)])
    return df.join(dense, same, "left_anti"), df.join(dense, same, "left_semi")


def _celled(df: DataFrame, by: list[str], top: str | int) -> DataFrame:
    """A row per grid cell that a box of positive area covers, packed: by, _row, _level, _z, _cx, _cy.

    A level's cells have sides of 2**level; a box belongs to the first level whose cells are no smaller than it, and is dealt to that one and the
    levels above, up to its group's top level (a column) or so many more (a number).
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    level = F.ceil(F.log2(side)).cast("int")
    rows = df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn("_level", level)
    upto = F.col(top) if isinstance(top, str) else F.col("_level") + top
    rows = rows.select(*by, F.struct(*[c for c in df.columns if c != top]).alias("_row"), "_level", F.explode(F.sequence("_level", F.greatest(upto, "_level"))).alias("_z"))
    cell = lambda c: F.floor(F.col(f"_row.{c}") / F.pow(F.lit(2.0), "_z"))
    return rows.withColumn("_cx", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("_cy", F.explode(F.sequence(cell("y1"), cell("y2"))))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], up: int | None = None) -> DataFrame:
    """(a, b): every pair of boxes of one group with a common inner point, each once, packed as structs.

    Boxes meet in grid cells, at the level of the larger one; of the cells that both cover, only that of the corner where the overlap begins
    counts. With ``up`` only pairs are promised whose levels differ by that much at most.
    """
    if up is None:
        side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
        both = a.select(*by, side.alias("s")).union(b.select(*by, side.alias("s"))).where("s > 0")
        tops = both.groupBy(*by).agg(F.ceil(F.log2(F.max("s"))).cast("int").alias("_top"))
        a, b, top = a.join(tops, by), b.join(tops, by), "_top"
    else:
        top = up
    l, r = (_celled(x, by, top).select(*[F.col(c).alias(f"_{n}{i}") for i, c in enumerate(by)], F.col("_row").alias(n), F.col("_level").alias(f"_{n}level"), F.col("_z").alias(f"_{n}z"), F.col("_cx").alias(f"_{n}x"), F.col("_cy").alias(f"_{n}y")) for n, x in (("a", a), ("b", b)))
    keys = [*[f"{i}" for i in range(len(by))], "z", "x", "y"]
    scale = F.pow(F.lit(2.0), "_az")
    begins = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / scale)
    met = reduce(Column.__and__, [F.col(f"_a{k}") == F.col(f"_b{k}") for k in keys])
    inner = lambda lo, hi: F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}")) > F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}"))
    once = inner("x1", "x2") & inner("y1", "y2") & (F.col("_az") == F.greatest("_alevel", "_blevel")) & (F.col("_ax") == begins("x1")) & (F.col("_ay") == begins("y1"))
    return l.join(r, met).where(once).select("a", "b")


#: Boxes of a group that are folded as one array; boxes of a larger one that are folded at once.
SMALL, BATCH = 256, 16_384


def nms(df: DataFrame, by: list[str], threshold: float, score: str = "raw_score", key: str = "det_id", small: int = SMALL, batch: int = BATCH) -> DataFrame:
    """Greedy suppression per group: best score first (ties by least key), a box goes if it overlaps a kept one by more than the threshold.

    A group of at most ``small`` boxes, as detectors give, is decided in one task, many groups at once. Larger groups are ranked by a running count
    and decided ``batch`` ranks at a time: a round drops what the boxes kept before overlap, met in grid cells, and folds the rest of
    its batch. So no task holds more than a batch of a group, however many boxes it has. Coordinates are finite numbers.
    """
    if threshold < 0:
        raise ValueError("a threshold below 0 would suppress boxes that do not overlap")
    usual, dense = split_dense(df, by, small)
    out = _fold(usual, by, threshold, score, key)
    return out if dense is None else out.unionByName(_in_rounds(dense, by, threshold, score, key, batch))


def _fold(df: DataFrame, by: list[str], threshold: float, score: str, key: str) -> DataFrame:
    """The rows that stay, of groups that fit into memory: groups come whole and sorted to a task, which decides a batch of them at once."""
    limit = float(df.sparkSession.range(1).select(_like(df, score, threshold).cast("double")).head()[0])
    names = df.columns
    best = Window.partitionBy(*by).orderBy(-F.col(score), key, F.struct(*names))
    flat = df.select("*", F.row_number().over(best).alias("_rank"), *[F.col(c).cast("double").alias(f"_{c}") for c in BOX])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            box = [t.column(f"_{c}").to_numpy(zero_copy_only=False).astype(np.float64) for c in BOX]
            kept = _stays(t.column("_rank").to_numpy(zero_copy_only=False), box, limit)
            yield from t.select(names).filter(pa.array(kept)).combine_chunks().to_batches()

    return flat.mapInArrow(stay, df.schema)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups: what the last group of a batch may still get waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column("_rank").to_numpy(zero_copy_only=False) == 1)
        if not len(starts):
            held.append(b)
            continue
        cut = int(starts[-1])
        if held or cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _stays(rank: np.ndarray, box: list[np.ndarray], limit: float) -> np.ndarray:
    """Which boxes of groups in order (rank 1 starts one) stay: the n-th boxes of all groups drop the later ones that they overlap, n by n.

    A missing coordinate is passed over, as Spark's least and greatest do.
    """
    n = len(rank)
    start = np.flatnonzero(rank == 1)
    size = np.diff(np.append(start, n))
    end = np.repeat(start + size, size)
    x1, y1, x2, y2 = box
    area = np.fmax(x2 - x1, 0.0) * np.fmax(y2 - y1, 0.0)
    alive = np.ones(n, dtype=bool)
    for step in range(int(size.max(initial=1)) - 1):
        k = start[size > step + 1] + step
        k = k[alive[k]]
        left = end[k] - k - 1
        # rows after k in its group: k + 1, k + 2, ...
        a = np.repeat(k, left)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
        inter = np.fmax(np.fmin(x2[a], x2[b]) - np.fmax(x1[a], x1[b]), 0.0) * np.fmax(np.fmin(y2[a], y2[b]) - np.fmax(y1[a], y1[b]), 0.0)
        union = area[a] + area[b] - inter
        share = np.divide(inter, union, out=np.zeros(len(a)), where=union > 0)
        alive[b[share > limit]] = False
    return alive


def _in_rounds(df: DataFrame, by: list[str], threshold: float, score: str, key: str, batch: int) -> DataFrame:
    spark = df.sparkSession
    limit = float(spark.range(1).select(_like(df, score, threshold).cast("double")).head()[0])
    groups = [f"_g{i}" for i in range(len(by))]
    packed = df.select(F.struct(*df.columns).alias("_row"), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).alias(g) for c, g in zip(by, groups, strict=True)], (-F.col(score)).alias("_s"), F.col(key).alias("_k"), *BOX)
    ranked = staged(running(packed, {"_rank": F.lit(1)}, ["_s", "_k", "_row"], tuple(groups)), "ranked")
    lean = ranked.select(*groups, "_rank", *BOX)
    # overlap above the threshold bounds how much the larger side can exceed the smaller one
    up = max(1, math.ceil(-math.log2(threshold))) if threshold > 0 else None
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.schema)
    kept, last = None, ranked.agg(F.max("_rank")).head()[0]
    for start in range(0, last, batch):
        due = lean.where((F.col("_rank") > start) & (F.col("_rank") <= start + batch))
        if kept is not None:
            pairs = overlapping(due, kept, groups, up).where(iou([F.col(f"b.{c}") for c in BOX], [F.col(f"a.{c}") for c in BOX]) > F.lit(limit))
            due = due.join(pairs.select("a.*").select(*groups, "_rank").distinct(), [*groups, "_rank"], "left_anti")
        won = staged(due.groupBy(*groups).applyInPandas(lambda f: _survivors(f, limit), kind), "kept")
        kept = won if kept is None else kept.unionByName(won)
    return ranked.join(kept.select(*groups, "_rank"), [*groups, "_rank"]).select("_row.*")


def _survivors(f: pd.DataFrame, limit: float) -> pd.DataFrame:
    """The fold over one batch: each box that stays drops the later ones that it overlaps."""
    f = f.sort_values("_rank")
    x1, y1, x2, y2 = (f[c].to_numpy() for c in BOX)
    span = lambda lo, hi: np.maximum((hi - lo).astype(np.float64), 0.0)
    size = span(x1, x2) * span(y1, y2)
    left, stay = np.arange(len(f)), []
    while len(left):
        k, rest = left[0], left[1:]
        stay.append(k)
        inter = span(np.maximum(x1[k], x1[rest]), np.minimum(x2[k], x2[rest])) * span(np.maximum(y1[k], y1[rest]), np.minimum(y2[k], y2[rest]))
        union = size[k] + size[rest] - inter
        share = np.divide(inter, union, out=np.zeros(len(rest)), where=union > 0)
        left = rest[share <= limit]
    return f.iloc[stay]


def class_aware_nms(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Suppression within a class of an image, never across classes."""
    return nms(df, ["image_id", "class_id"], threshold)


def letterbox_geometry(df: DataFrame, size: int = 640, scale_up: bool = True, w: str = "w", h: str = "h") -> DataFrame:
    """ratio, pad_x, pad_y of fitting w x h into a square; halves go to even, odd pixels to the far side."""
    ratio = F.least(size / F.col(h), size / F.col(w))
    if not scale_up:
        ratio = F.least(ratio, F.lit(1.0))
    pad = lambda side: F.bround((size - F.bround(F.col(side) * ratio, 0)) / 2 - 0.1, 0).cast("int")
    return df.withColumns({"ratio": ratio, "pad_x": pad(w), "pad_y": pad(h)})


def unletterbox(df: DataFrame) -> DataFrame:
    """Boxes back in the image's frame: subtract the pad, divide by the ratio, then clip (columns ratio, pad_x, pad_y, w, h)."""
    back = lambda c, pad, top: F.greatest(F.lit(0.0), F.least((F.col(c) - F.col(pad)) / F.col("ratio"), F.col(top).cast("double")))
    return df.withColumns({"x1": back("x1", "pad_x", "w"), "y1": back("y1", "pad_y", "h"), "x2": back("x2", "pad_x", "w"), "y2": back("y2", "pad_y", "h")})


def class_count_violations(df: DataFrame, n: int, scores: str = "cls_scores") -> DataFrame:
    """Rows, and rows whose score array has another length than there are class names."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.size(scores) != n).alias("violations"))


def check_class_count(df: DataFrame, n: int, scores: str = "cls_scores") -> DataFrame:
    """df, or an error at the first row with another number of class scores."""
    return df.where(F.assert_true(F.size(scores) == n, F.lit(f"expected {n} class scores")).isNull())


def decode(predictions: DataFrame, images: DataFrame, n_classes: int, conf: float = 0.2, overlap_at: float = 0.8, passes: int = 1) -> DataFrame:
    """Raw predictions (image_id, det_id, cx, cy, w, h, cls_scores) to boxes in image pixels."""
    p = xywh_to_xyxy(confidence_filter(argmax_class(check_class_count(predictions, n_classes)), conf)).drop("cx", "cy", "w", "h", "cls_scores")
    return unletterbox(boost_scores(class_aware_nms(p, overlap_at), passes).join(letterbox_geometry(images), "image_id")).drop("ratio", "pad_x", "pad_y", "w", "h")


def polygon_to_bbox(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Bounding box (centre and size, six decimals) of alternating x, y coordinates."""
    axis = lambda k: F.filter(coords, lambda v, i: i % 2 == k)
    lo_x, hi_x, lo_y, hi_y = F.array_min(axis(0)), F.array_max(axis(0)), F.array_min(axis(1)), F.array_max(axis(1))
    return df.withColumn("bbox", F.format_string("%.6f %.6f %.6f %.6f", (lo_x + hi_x) / 2, (lo_y + hi_y) / 2, hi_x - lo_x, hi_y - lo_y))
