"""Readers and writers: positioned lines, label files, uploads, the class list, stage tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.sources.folders import register, upload_rows

LINES = "doc string, page long, line_no int, x0 double, y0 double, page_width double, page_height double, size double, text string"


def read_text_lines(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Positioned lines as a page parser puts them out, with a stated schema."""
    return spark.read.schema(LINES).format(fmt).load(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """split, image, line_no, class_id, coords, corrupt of label files <path>/<split>/labels/<image>.txt; blank lines are skipped.

    A line whose first word is no whole number, or any other word no number, keeps its text in corrupt, with null class_id and coords.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("file"))
    named = rows.select(F.regexp_extract("file", r"([^/]+)/labels/[^/]+$", 1).alias("split"), F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("image"), "value")
    lines = named.select("split", "image", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    # a step a select, so that no line is cut into words twice
    words = lines.select("*", F.regexp_extract_all("line", F.lit(r"(\S+)"), 1).alias("words")).where(F.size("words") > 0)
    nums = words.select("split", "image", "line_no", "line", F.get("words", F.lit(0)).try_cast("int").alias("class"), F.transform(F.slice("words", F.lit(2), F.size("words")), lambda x: x.try_cast("double")).alias("nums"))
    bad = F.col("class").isNull() | F.exists("nums", lambda x: x.isNull())
    return nums.select("split", "image", "line_no", F.when(~bad, F.col("class")).alias("class_id"), F.when(~bad, F.col("nums")).alias("coords"), F.when(bad, F.col("line")).alias("corrupt"))


def read_uploads(spark: SparkSession, path: str, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """file, length, outcome (ok, too_large, empty) and the content of good files; empty files are listed, files over the limit are not read."""
    return upload_rows(spark, path, max_bytes)


def stream_uploads(spark: SparkSession, path: str, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """The rows of read_uploads as a stream: each file once, in the order in which files came."""
    register(spark)
    return spark.readStream.format("uploads").option("path", path).option("max_bytes", max_bytes).load()


def write_files(df: DataFrame, path: str, file: str = "file", content: str = "content", order: list[str] | None = None) -> None:
    """One file per value of ``file`` below path; the contents of its rows follow each other in the order."""
    register(df.sparkSession)
    by = [F.col(file), *[F.col(c) for c in order or []]]
    rows = df.repartition(file).sortWithinPartitions(*by).select(F.col(file).alias("file"), F.col(content).alias("content"))
    rows.write.format("named_files").mode("append").option("path", path).save()


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """The class list from JSON, with labels; an error where the ids are not 0..n-1."""
    m = spark.read.schema("id int, name string, fdi int, type string").option("multiLine", True).json(path)
    found = m.agg(F.max("id").alias("m"), F.count("*").alias("n"), F.countDistinct("id").alias("d")).head()
    if found["n"] and not found["m"] + 1 == found["n"] == found["d"]:
        raise ValueError("class ids are not contiguous")
    return m.withColumn("label", F.when(F.col("type") == "tooth", F.concat(F.lit("T"), F.col("fdi").cast("string"))).otherwise(F.initcap("name")))


def write_stage(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Persist a phase's output, by source if asked, and read it again: every phase can be run again on its own.

    With ``by`` only the sources that df has are replaced; those of earlier runs stay.
    """
    w = df.write.mode("overwrite")
    (w.partitionBy(by).option("partitionOverwriteMode", "dynamic") if by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def export_report(analyses: DataFrame, view: DataFrame, counts: DataFrame, disclaimer: str = "Screening aid, not a diagnosis.") -> DataFrame:
    """One JSON document per image: its size, counts by condition, the detected teeth with their status in viewer order, findings
    without a tooth, restorations, ambiguous numbers, summary.

    analyses: assembled analyses with a summary; view: the chart's slots as a reader sees them; counts: conditions per image.
    An image without teeth, findings or restorations has empty lists.
    """
    tooth = F.struct("slot", *[F.col(c) for c in view.columns if c not in ("image_id", "slot")])
    teeth = view.where("status <> 'Undetected'").groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(tooth)), lambda t: t.dropFields("slot")).alias("charted"))
    sums = counts.select("image_id", F.struct(*[F.col(c) for c in counts.columns if c != "image_id"]).alias("counts"))
    a = analyses.join(teeth, "image_id", "left").join(sums, "image_id", "left")
    listed = lambda c: F.coalesce(c, F.array())
    loose = F.filter("findings", lambda f: f["tooth_fdi"].isNull())
    size = F.struct(F.col("image_width").alias("width"), F.col("image_height").alias("height"))
    parts = [size.alias("image_size"), "counts", listed(F.col("charted")).alias("teeth"), listed(loose).alias("unattributed_findings"), listed(F.col("restorations")).alias("restorations"), listed(F.col("ambiguous_fdi")).alias("ambiguous_fdi"), "summary", F.lit(disclaimer).alias("disclaimer")]
    return a.select("image_id", F.to_json(F.struct("image_id", *parts)).alias("report"))
