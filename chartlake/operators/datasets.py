"""Dataset tables: class distributions, splits and detection metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.operators.boxes import BOX, iou
from chartlake.sources.staging import staged


def class_distribution(annotations: DataFrame, classes: DataFrame, splits: DataFrame) -> DataFrame:
    """Instances and percent of every class in every split, zero included. Classes and splits are short tables."""
    grid = splits.select("split").crossJoin(F.broadcast(classes.select("class_id")))
    n = annotations.groupBy("split", "class_id").agg(F.count("*").alias("n"))
    full = grid.join(n, ["split", "class_id"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("split"))
    return full.select("split", "class_id", "n", F.when(total > 0, F.round(100 * F.col("n") / total, 6)).otherwise(0.0).alias("percent"))


def split_inventory(images: DataFrame, labels: DataFrame) -> DataFrame:
    i, l = images.groupBy("split").agg(F.count("*").alias("images")), labels.groupBy("split").agg(F.count("*").alias("labels"))
    return i.join(l, "split", "full").na.fill(0, ["images", "labels"])


def dominant_class(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Most frequent class of each image with a label file; a tie goes to the first met, an empty file to -1."""
    per = annotations.groupBy("image_id", "class_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    best = per.groupBy("image_id").agg(F.max_by("class_id", F.struct("n", -F.col("first"))).alias("dominant"))
    return images.select("image_id").join(best, "image_id", "left").select("image_id", F.coalesce("dominant", F.lit(-1)).alias("dominant"))


def stratified_split(df: DataFrame, stratum: str, order: str, share: float = 0.1) -> DataFrame:
    """split: per stratum max(1, floor(n * share)) rows val, as many test, the rest train, in the given (seeded hash) order."""
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(stratum)) * share))
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return df.withColumns({"_n": n, "_k": k}).withColumn("split", F.when(F.col("_n") <= F.col("_k"), "val").when(F.col("_n") <= 2 * F.col("_k"), "test").otherwise("train")).drop("_n", "_k")


def split_reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = old.agg(F.sum("n").alias("old_total")), new.agg(F.sum("n").alias("new_total"))
    return o.join(n, F.lit(True)).withColumn("difference", F.col("new_total") - F.col("old_total"))


#: Score ranges per class whose sums and maxima are carried to the next one.
RANGES = 64
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def match_detections(preds: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every prediction with hit: by falling score it takes the free truth box of its image and class that it overlaps most, from the threshold on."""
    return match_levels(preds, truth, (threshold,)).withColumn("hit", F.col("hits")[0]).drop("hits")


def match_levels(preds: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Every prediction with hits, a flag per threshold. Overlaps are worked out once, matches are folded per image, class and threshold."""
    l, r = preds.alias("l"), truth.alias("r")
    over = iou([F.col(f"l.{c}") for c in BOX], [F.col(f"r.{c}") for c in BOX])
    pairs = l.join(r, (F.col("l.image_id") == F.col("r.image_id")) & (F.col("l.class_id") == F.col("r.class_id"))).select("l.image_id", "l.class_id", "l.det_id", "l.raw_score", F.col("r.det_id").alias("truth_id"), over.alias("iou")).where(F.col("iou") >= min(thresholds))
    options = pairs.groupBy("image_id", "class_id", "det_id", "raw_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), F.col("truth_id").alias("t")))).alias("opts"))
    group = options.groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("raw_score")).alias("s"), F.col("det_id").alias("d"), F.col("opts").alias("opts")))).alias("ps"))
    zero = F.expr("named_struct('used', cast(array() as array<bigint>), 'hits', cast(array() as array<bigint>))")

    def fold(threshold: float) -> Column:
        def step(a, p):
            free = F.get(F.filter(p["opts"], lambda o: (-o["o"] >= threshold) & ~F.array_contains(a["used"], o["t"])), F.lit(0))
            return F.when(free.isNull(), a).otherwise(F.named_struct(F.lit("used"), F.array_append(a["used"], free["t"].cast("long")), F.lit("hits"), F.array_append(a["hits"], p["d"].cast("long"))))

        only = F.get("ps", F.lit(0))  # of one prediction, its best option decides
        alone = F.when(-F.get(only["opts"], F.lit(0))["o"] >= threshold, F.array(only["d"].cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size("ps") == 1, alone).otherwise(F.aggregate("ps", zero, step)["hits"])

    found = group.select("image_id", "class_id", *[fold(t).alias(f"h{i}") for i, t in enumerate(thresholds)], F.explode(F.transform("ps", lambda p: p["d"])).alias("det_id"))
    found = found.select("image_id", "class_id", "det_id", F.array(*[F.array_contains(f"h{i}", F.col("det_id")) for i in range(len(thresholds))]).alias("hits"))
    none = F.array(*[F.lit(False)] * len(thresholds))
    return preds.join(found, ["image_id", "class_id", "det_id"], "left").withColumn("hits", F.coalesce("hits", none))


def _curves(matched: DataFrame, n_truth: DataFrame, by: list[str], levels: int = 1) -> DataFrame:
    """ap, precision and recall per group (by) and level of matched predictions (hits, a flag per level), by 101 recall points under the falling precision hull.

    Two levels of order: a group's score ranges are windows of their own, and a row per range carries the sums of the ranges
    before it and the greatest precision of those after it, so that no task holds a group. The predictions are staged and sorted once for all
    levels; only rows at which a recall point is reached, 101 a group and level at most, leave their range.
    """
    ids, each = ["raw_score", "image_id", "det_id"], range(levels)
    ranged = matched.select(*by, *ids, F.floor(F.least(F.greatest(F.col("raw_score"), F.lit(0.0)), F.lit(1.0)) * (RANGES - 1)).alias("_range"), *[F.col("hits")[i].cast("int").alias(f"_h{i}") for i in each])
    ranged = staged(ranged, "matched")
    per = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_k"), *[F.sum(f"_h{i}").alias(f"_t{i}") for i in each])
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*by, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("_k", *[f"_t{i}" for i in each])])
    inner = Window.partitionBy(*by, "_range").orderBy(F.desc("raw_score"), "image_id", "det_id")
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    c = ranged.select("*", F.row_number().over(inner).alias("_n"), *[F.sum(f"_h{i}").over(run).alias(f"_s{i}") for i in each])
    # between hits precision falls, so hits alone make the hull
    c = c.where(" OR ".join(f"_h{i} = 1" for i in each)).join(F.broadcast(base.join(n_truth, by)), [*by, "_range"])
    tp = [F.col(f"_t{i}0") + F.col(f"_s{i}") for i in each]
    at = lambda n: F.floor(100 * n / F.col("n_truth") + 1e-9)
    # a recall point is reached first at the row where recall passes it
    points = [F.when(F.col(f"_h{i}") == 1, at(tp[i]) - at(tp[i] - 1) + F.when(tp[i] == 1, 1).otherwise(0)).otherwise(0) for i in each]
    c = c.select(*by, *ids, "_range", *[F.when(F.col(f"_h{i}") == 1, tp[i] / (F.col("_k0") + F.col("_n"))).alias(f"_p{i}") for i in each], *[points[i].alias(f"_n{i}") for i in each])
    back = Window.partitionBy(*by, "_range").orderBy("raw_score", F.desc("image_id"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.select(*by, "_range", *[f"_p{i}" for i in each], *[f"_n{i}" for i in each], *[F.max(f"_p{i}").over(back).alias(f"_ph{i}") for i in each])
    tops = c.groupBy(*by, "_range").agg(*[F.max(f"_p{i}").alias(f"_top{i}") for i in each], *[F.collect_list(F.when(F.col(f"_n{i}") > 0, F.struct(F.col(f"_n{i}").alias("n"), F.col(f"_ph{i}").alias("p")))).alias(f"_pts{i}") for i in each])
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    h = tops.select(*by, *[f"_pts{i}" for i in each], *[F.max(f"_top{i}").over(lower).alias(f"_below{i}") for i in each])

    def hull(i: int) -> Column:
        return F.aggregate(f"_pts{i}", F.lit(0.0), lambda a, x: a + x["n"] * F.greatest(x["p"], F.col(f"_below{i}")))

    ap = h.groupBy(*by).agg(*[F.round(F.sum(hull(i)) / 101, 6).alias(_name("ap", i, levels)) for i in each])
    ends = per.groupBy(*by).agg(F.sum("_k").alias("_k"), *[F.sum(f"_t{i}").alias(f"_t{i}") for i in each]).join(n_truth, by)
    ends = ends.select(*by, *[c.alias(_name(n, i, levels)) for i in each for n, c in (("precision", F.round(F.col(f"_t{i}") / F.col("_k"), 6)), ("recall", F.round(F.col(f"_t{i}") / F.col("n_truth"), 6)))])
    out = n_truth.join(ap, by, "left").join(ends, by, "left")
    names = [_name(n, i, levels) for n in ("ap", "precision", "recall") for i in each]
    return out.select(*n_truth.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def _name(what: str, level: int, levels: int) -> str:
    return what if levels == 1 else f"{what}{level}"


def detection_eval(preds: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """precision, recall and average precision (101 recall points, falling precision hull) per class."""
    n_truth = truth.groupBy("class_id").agg(F.count("*").alias("n_truth"))
    return _curves(match_levels(preds, truth, (threshold,)), n_truth, ["class_id"])


def evaluation_report(preds: DataFrame, truth: DataFrame, splits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per split (image_id, split) and class: n_truth, ap, precision, recall, and a row with class_id null for the mean over the split's classes."""
    of = lambda df: df.join(splits, "image_id")
    n_truth = of(truth).groupBy("split", "class_id").agg(F.count("*").alias("n_truth"))
    per = staged(_curves(of(match_levels(preds, truth, (threshold,))), n_truth, ["split", "class_id"]), "curves")
    every = per.groupBy("split").agg(F.sum("n_truth").alias("n_truth"), *[F.round(F.avg(c), 6).alias(c) for c in ("ap", "precision", "recall")])
    return per.unionByName(every, allowMissingColumns=True)


def mean_ap(preds: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Mean of the average precision over overlap thresholds, per class; matched and sorted once."""
    n_truth = truth.groupBy("class_id").agg(F.count("*").alias("n_truth"))
    curves = _curves(match_levels(preds, truth, thresholds), n_truth, ["class_id"], len(thresholds))
    total = reduce(Column.__add__, [F.col(_name("ap", i, len(thresholds))) for i in range(len(thresholds))])
    return curves.select("class_id", F.round(total / len(thresholds), 6).alias("map"))


def metric_parity(a: DataFrame, b: DataFrame, keys: list[str], metric: str = "ap", tolerance: float = 0.002) -> DataFrame:
    """Two metric tables side by side; within tells whether they agree to the tolerance (false where one lacks a row)."""
    j = a.select(*keys, F.col(metric).alias("a")).join(b.select(*keys, F.col(metric).alias("b")), keys, "full")
    return j.withColumn("within", F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))
