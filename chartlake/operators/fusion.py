"""Fusing tooth boxes and lesion boxes into findings, charts of an image and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.functions.fdi import LESIONS
from chartlake.operators.boxes import BOX, SMALL, boost_scores, containment, nms, overlapping, split_dense
from chartlake.sources.staging import staged

DEDUP, CONTAINMENT = 0.7, 0.15


def dedup_teeth(boxes: DataFrame, classes: DataFrame, threshold: float = DEDUP) -> DataFrame:
    """Suppression across classes among tooth boxes, ranked by raw score; restorations pass through."""
    teeth_ids = F.broadcast(classes.where("type = 'tooth'").select("class_id"))
    teeth = boxes.join(teeth_ids, "class_id", "left_semi")
    other = boxes.join(teeth_ids, "class_id", "left_anti")
    return nms(teeth, ["image_id"], threshold).unionByName(other)


def assign_lesions(lesions: DataFrame, teeth: DataFrame, threshold: float = CONTAINMENT, small: int = SMALL) -> DataFrame:
    """Every lesion with the tooth that contains most of it.

    teeth has image_id, det_id, fdi, anatomy and the box. No lesion is lost: below the threshold, or without
    a tooth, tooth_fdi and tooth_anatomy are null while containment still reports the best value (0 without any). Ties go to
    the least det_id. An image's boxes meet only each other; in an image of more than ``small`` teeth, only those of common grid cells.
    """
    usual, dense = split_dense(teeth, ["image_id"], small) if threshold > 0 else (teeth, None)
    out = _assigned(lesions, teeth if dense is None else usual, threshold)
    if dense is None:
        return out
    crowded = staged(dense.select("image_id").distinct(), "crowded")
    out = _assigned(lesions.join(crowded, "image_id", "left_anti"), usual, threshold)
    own = lesions.join(crowded, "image_id", "left_semi")
    pairs = overlapping(own, dense.select("image_id", "det_id", "fdi", "anatomy", *BOX), ["image_id"])
    share = containment([F.col(f"a.{c}") for c in BOX], [F.col(f"b.{c}") for c in BOX])
    best = pairs.select("a.image_id", "a.det_id", share.alias("_share"), "b.fdi", "b.anatomy", F.col("b.det_id").alias("_tooth")).groupBy("image_id", "det_id").agg(_most_contained("_share", "fdi", "anatomy", "_tooth"))
    return out.unionByName(_decided(own.dropDuplicates(["image_id", "det_id"]).join(best, ["image_id", "det_id"], "left"), lesions.columns, threshold))


def _most_contained(share: str, fdi: str, anatomy: str, tooth: str) -> Column:
    return F.max_by(F.struct(F.col(share).alias("_share"), F.col(fdi).alias("_fdi"), F.col(anatomy).alias("_anatomy")), F.struct(share, -F.col(tooth))).alias("_best")


def _decided(best: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    value = F.coalesce("_best._share", F.lit(0.0))
    hit = value >= threshold
    return best.select(*cols, value.alias("containment"), F.when(hit, F.col("_best._fdi")).alias("tooth_fdi"), F.when(hit, F.col("_best._anatomy")).alias("tooth_anatomy"))


def _assigned(lesions: DataFrame, teeth: DataFrame, threshold: float) -> DataFrame:
    l, t = lesions.alias("l"), teeth.alias("t")
    share = containment([F.col(f"l.{c}") for c in BOX], [F.col(f"t.{c}") for c in BOX])
    pairs = l.join(t, F.col("l.image_id") == F.col("t.image_id"), "left").select("l.*", F.when(F.col("t.det_id").isNotNull(), share).alias("_share"), F.col("t.det_id").alias("_tooth"), F.col("t.fdi").alias("_fdi"), F.col("t.anatomy").alias("_anatomy"))
    best = pairs.groupBy("image_id", "det_id").agg(*[F.first(c).alias(c) for c in lesions.columns if c not in ("image_id", "det_id")], _most_contained("_share", "_fdi", "_anatomy", "_tooth"))
    return _decided(best, lesions.columns, threshold)


def split_chart(boxes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(teeth with fdi and anatomy, restorations with kind)."""
    named = boxes.join(F.broadcast(classes.select("class_id", "name", "fdi", "type", "label")), "class_id")
    teeth = named.where("type = 'tooth'").withColumnRenamed("name", "anatomy").drop("type", "label")
    return teeth, named.where("type <> 'tooth'").withColumnRenamed("label", "kind").drop("name", "fdi", "type")


def fuse(boxes: DataFrame, classes: DataFrame, conf: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(teeth, restorations, findings) of raw boxes of both models: duplicates go before lesions are assigned.

    The boxes are read once; the kept boxes and the findings are staged, so that what is derived from them does not suppress again.
    """
    strong = staged(boxes.where(F.col("raw_score") >= conf), "strong")
    kept = staged(boost_scores(dedup_teeth(strong.where("model = 'fdi'").withColumn("class_id", F.col("class_id").cast("int")), classes), passes=2), "kept")
    teeth, restorations = split_chart(kept, classes)
    lesions = strong.where("model = 'lesion'").withColumn("label", F.get(F.array(*map(F.lit, LESIONS)), F.col("class_id").cast("int")))
    return teeth, restorations, staged(assign_lesions(boost_scores(lesions, passes=1), teeth), "findings")


def ambiguous_fdi(teeth: DataFrame) -> DataFrame:
    """Per image the tooth numbers that more than one box carries, ascending."""
    return teeth.groupBy("image_id", "fdi").count().where("count > 1").groupBy("image_id").agg(F.sort_array(F.collect_list("fdi")).alias("ambiguous"))


def describe_finding(label: Column, fdi: Column, anatomy: Column) -> Column:
    return F.when(fdi.isNull(), F.concat(label, F.lit(" (unattributed — no containing tooth detected)"))).otherwise(F.concat(label, F.lit(" on tooth "), fdi.cast("string"), F.lit(" ("), anatomy, F.lit(")")))


def ordered_list(df: DataFrame, value: Column, order: list[Column], name: str, by: str = "image_id") -> DataFrame:
    """Per group the values in the given order."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["v"]).alias(name))


def summary_text(teeth: DataFrame, restorations: DataFrame, findings: DataFrame) -> DataFrame:
    """Text report per image, findings by falling score."""
    n = teeth.groupBy("image_id").agg(F.count("*").alias("n"))
    kinds = ordered_list(restorations, F.col("kind"), [-F.col("raw_score"), F.col("det_id")], "kinds")
    lines = ordered_list(findings, F.concat(F.lit("- "), describe_finding(F.col("label"), F.col("tooth_fdi"), F.col("tooth_anatomy"))), [-F.col("raw_score"), F.col("det_id")], "lines")
    every = n.join(kinds, "image_id", "full").join(lines, "image_id", "full").join(ambiguous_fdi(teeth), "image_id", "left")
    head = F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" teeth detected"), F.when(F.col("kinds").isNotNull(), F.concat(F.lit("; restorations: "), F.array_join("kinds", ", "))).otherwise(""))
    note = F.when(F.col("ambiguous").isNotNull(), F.array(F.concat(F.lit("- NOTE: FDI numbering is ambiguous for "), F.array_join(F.col("ambiguous").cast("array<string>"), ", "), F.lit(" (more than one tooth carries this number)")))).otherwise(F.array().cast("array<string>"))
    return every.select("image_id", F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>")), note), "\n").alias("summary"))


def attributed(findings: DataFrame, yes: bool = True) -> DataFrame:
    return findings.where(F.col("tooth_fdi").isNotNull() if yes else F.col("tooth_fdi").isNull())


def compact_analysis(teeth: DataFrame, restorations: DataFrame, findings: DataFrame) -> DataFrame:
    """Per image one JSON string: sorted keys, no spaces, values rounded to two decimals; containment and tooth only where attributed."""
    num = lambda c: F.regexp_replace(F.format_string("%.2f", F.col(c)), r"(\.\d)0$", "$1")
    entry = F.when(F.col("tooth_fdi").isNull(), F.concat(F.lit('{"confidence":'), num("score"), F.lit(',"label":"'), "label", F.lit('","tooth_fdi":null}'))).otherwise(F.concat(F.lit('{"confidence":'), num("score"), F.lit(',"containment":'), num("containment"), F.lit(',"label":"'), "label", F.lit('","tooth":"'), "tooth_anatomy", F.lit('","tooth_fdi":'), F.col("tooth_fdi").cast("string"), F.lit("}")))
    found = ordered_list(findings, entry, [-F.col("raw_score"), F.col("det_id")], "found")
    kinds = ordered_list(restorations, F.concat(F.lit('"'), "kind", F.lit('"')), [-F.col("raw_score"), F.col("det_id")], "kinds")
    present = teeth.groupBy("image_id").agg(F.sort_array(F.collect_list("fdi")).cast("array<string>").alias("present"))
    every = present.join(kinds, "image_id", "full").join(found, "image_id", "full").join(ambiguous_fdi(teeth), "image_id", "left")
    part = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    return every.select("image_id", F.concat(F.lit('{"ambiguous_fdi":['), part("ambiguous"), F.lit('],"findings":['), part("found"), F.lit('],"restorations":['), part("kinds"), F.lit('],"teeth_present":['), part("present"), F.lit("]}")).alias("analysis"))


def assemble_analysis(images: DataFrame, teeth: DataFrame, restorations: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested row per image (image_id, image_width, image_height)."""
    box = F.struct(*BOX).alias("box")
    t = ordered_list(teeth, F.struct("fdi", "anatomy", F.col("score").alias("confidence"), box), [F.col("fdi"), -F.col("raw_score"), F.col("det_id")], "teeth")
    r = ordered_list(restorations, F.struct("kind", F.col("score").alias("confidence"), box), [-F.col("raw_score"), F.col("det_id")], "restorations")
    f = ordered_list(findings, F.struct("label", F.col("score").alias("confidence"), "tooth_fdi", "tooth_anatomy", "containment", box), [-F.col("raw_score"), F.col("det_id")], "findings")
    return images.join(t, "image_id", "left").join(r, "image_id", "left").join(f, "image_id", "left").join(ambiguous_fdi(teeth).withColumnRenamed("ambiguous", "ambiguous_fdi"), "image_id", "left")


def findings_listing(findings: DataFrame, restorations: DataFrame) -> DataFrame:
    """Attributed findings, then unattributed ones, then restorations, with the image's total."""
    f = findings.select("image_id", "det_id", F.when(F.col("tooth_fdi").isNotNull(), "attributed").otherwise("unattributed").alias("kind"), "label", "tooth_fdi")
    r = restorations.select("image_id", "det_id", F.lit("restoration").alias("kind"), F.col("kind").alias("label"))
    return f.unionByName(r, allowMissingColumns=True).withColumn("total", F.count("*").over(Window.partitionBy("image_id")))
