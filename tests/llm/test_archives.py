"""WARC archives: empty tables, very long pages, clashing columns, revisits without their response."""

import tempfile

from pyspark.sql import functions as F

from chartlake.llm import warc

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def there_and_back(spark, pages):
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(pages, path)
    return warc.resolved(warc.read_archives(spark, path))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    out = there_and_back(spark, pages)
    assert tuple(out.columns) == COLUMNS and out.count() == 0


def test_long_pages_and_clashing_columns(spark):
    long = "é" * 3_000_000
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, None)], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("digest", "revisit", "to_page", "value", "bytes", "record_type", "refers_to_id", "__page")})
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in there_and_back(spark, pages).collect()}
    assert got == {1: (6_000_000, "response", None), 2: (6_000_000, "revisit", 1), 3: (0, "response", None)}


def test_a_revisit_without_its_response(spark):
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200)], "page_id long, url string, html string"), path)
    alone = warc.read_archives(spark, path).where("record_type = 'revisit'")
    assert [tuple(r) for r in warc.resolved(alone).collect()] == [(2, None, None, "revisit", None)]


def test_archives_are_parsed_once(spark):
    pages = spark.range(4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 200).alias("html"))
    plan = there_and_back(spark, pages)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "binaryFile" not in plan
