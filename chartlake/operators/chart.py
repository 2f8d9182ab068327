"""Dense tooth charts, statuses, counts and confidence bands per image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.functions.fdi import arch, chart_slots, humanise_anatomy, patient_side

# How findings rank on a tooth, and the confidence bands.
RANK = {"Infection": 3, "Cavities": 2, "Wisdom": 1}
STATUS = {"Cavities": "Caries", "Infection": "Infection", "Wisdom": "Wisdom"}
CONDITION = {"Healthy": "Good", "Caries": "Caries", "Infection": "Periapical", "Wisdom": "Third molar", "Undetected": "Not detected"}
BANDS = (("0.40-0.55", 0.40, 0.55), ("0.55-0.70", 0.55, 0.70), ("0.70-0.85", 0.70, 0.85), ("0.85-1.00", 0.85, 1.01))


def _rank(label):
    out = F.lit(0)
    for name, value in RANK.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def annotate_chart(images: DataFrame, teeth: DataFrame, findings: DataFrame) -> DataFrame:
    """Every image with all 32 slots: present, findings (labels, worst first), ambiguous. The slots are 32 rows, broadcast.

    What is known of an image's slots is joined as one map, so that the slots are dealt out after the join, not before.
    """
    order = F.struct((-_rank(F.col("label"))).alias("r"), (-F.col("score")).alias("c"), F.col("det_id").alias("d"), F.col("label").alias("v"))
    present = teeth.groupBy("image_id", "fdi").agg(F.count("*").alias("n"), F.lit(None).cast("array<string>").alias("found"))
    found = findings.where("tooth_fdi is not null").groupBy("image_id", F.col("tooth_fdi").alias("fdi")).agg(F.lit(0).cast("long").alias("n"), F.array_sort(F.collect_list(order))["v"].alias("found"))
    both = present.unionAll(found).where("fdi is not null").groupBy("image_id", "fdi").agg(F.sum("n").alias("n"), F.first("found", ignorenulls=True).alias("found"))
    known = both.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("fdi", F.struct("n", "found")))).alias("known"))
    slots = F.broadcast(chart_slots(images.sparkSession).select("fdi", "slot"))
    out = images.select("image_id").join(known, "image_id", "left").crossJoin(slots).withColumn("own", F.try_element_at("known", F.col("fdi").cast(known.schema["known"].dataType.keyType)))
    n = F.coalesce("own.n", F.lit(0))
    return out.select("image_id", "fdi", "slot", (n > 0).alias("present"), F.coalesce("own.found", F.array().cast("array<string>")).alias("findings"), (n > 1).alias("ambiguous"))


def _status():
    worst = F.get("findings", F.lit(0))
    status = F.lit("Healthy")
    for label, name in STATUS.items():
        status = F.when(worst == label, name).otherwise(status)
    return F.when(~F.col("present"), "Undetected").otherwise(status)


def tooth_status(chart: DataFrame) -> DataFrame:
    """Status of every slot by its worst finding; an undetected tooth stays Undetected."""
    return chart.select("image_id", "fdi", _status().alias("status"))


def tooth_view(chart: DataFrame, teeth: DataFrame) -> DataFrame:
    """Every slot as a reader sees it: name, arch and side, status and its wording, confidence in percent (0 if undetected), findings, ambiguous.

    Of several boxes with one number the one with the lowest score counts, as the last of the list by falling score.
    """
    own = teeth.groupBy("image_id", "fdi").agg(F.min_by(F.struct("anatomy", "score"), F.struct("raw_score", -F.col("det_id"))).alias("own"))
    rows = chart.join(own, ["image_id", "fdi"], "left").withColumn("status", _status())
    wording = F.lit(None).cast("string")
    for name, text in CONDITION.items():
        wording = F.when(F.col("status") == name, text).otherwise(wording)
    percent = F.coalesce(F.floor(F.col("own.score") * 100 + 0.5), F.lit(0)).cast("long")
    fdi = F.col("fdi")
    return rows.select("image_id", "fdi", "slot", humanise_anatomy(F.col("own.anatomy"), fdi).alias("name"), F.initcap(arch(fdi)).alias("arch"), F.initcap(patient_side(fdi)).alias("side"), "status", wording.alias("condition"), percent.alias("confidence"), "findings", "ambiguous")


def condition_counts(images: DataFrame, status: DataFrame, teeth: DataFrame, restorations: DataFrame, findings: DataFrame) -> DataFrame:
    """Per image: boxes detected, slots by status, missing (Damage findings), restorations, lesions (caries and infection)."""
    slots = status.groupBy("image_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Healthy", "Caries", "Infection", "Wisdom")])
    boxes = teeth.groupBy("image_id").agg(F.count("*").alias("detected"))
    lost = findings.groupBy("image_id").agg(F.count_if(F.col("label") == "Damage").alias("missing"))
    fixed = restorations.groupBy("image_id").agg(F.count("*").alias("restorations"))
    every = images.select("image_id").join(slots, "image_id", "left").join(boxes, "image_id", "left").join(lost, "image_id", "left").join(fixed, "image_id", "left").na.fill(0)
    return every.withColumn("lesions", F.col("caries") + F.col("infection"))


def confidence_bands(findings: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per image and band the findings and their rounded percent of all findings; empty bands are listed.

    With images, those without a finding have all bands too, at 0 percent.
    """
    per = findings.groupBy("image_id").agg(F.count("*").alias("total"), *[F.count_if((F.col("score") >= lo) & (F.col("score") < hi)).alias(name) for name, lo, hi in BANDS])
    if images is not None:
        per = images.select("image_id").distinct().join(per, "image_id", "left").na.fill(0)
    long = per.unpivot(["image_id", "total"], [F.col(f"`{name}`") for name, _, _ in BANDS], "band", "n")
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("n") / F.col("total") + 0.5)).otherwise(0)
    return long.select("image_id", "band", "n", percent.cast("long").alias("percent"))


def condition_share(counts: DataFrame) -> DataFrame:
    """Non-zero conditions of an image and their share of the sum."""
    long = counts.unpivot(["image_id"], ["healthy", "caries", "infection", "wisdom", "missing"], "condition", "n").where("n > 0")
    return long.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("image_id")))
