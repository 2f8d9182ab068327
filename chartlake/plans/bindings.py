"""Input tables of the operators, derived from the driver's tables. The SQL texts hold for Spark and for the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartlake.functions.fdi import LESIONS, VIEWER_ORDER, anatomy_name, class_rows
from chartlake.sources.staging import shared_path

BOXES = """
SELECT l_orderkey AS image_id, l_partkey*1000 + l_suppkey AS det_id,
  CASE WHEN l_returnflag='R' THEN 'lesion' ELSE 'fdi' END AS model,
  CASE WHEN l_returnflag='R' THEN l_suppkey % 4 ELSE l_partkey % 35 END AS class_id,
  CAST((l_partkey%3)*12 AS DOUBLE) AS x1, CAST((l_suppkey%3)*9 AS DOUBLE) AS y1,
  CAST((l_partkey%3)*12 AS DOUBLE) + CASE WHEN l_returnflag='R' THEN 8 ELSE 40 END + l_quantity/5 AS x2,
  CAST((l_suppkey%3)*9 AS DOUBLE) + CASE WHEN l_returnflag='R' THEN 8 ELSE 60 END + l_quantity/5 AS y2,
  (CAST(round(l_extendedprice*100) AS BIGINT) % 10007) / CAST(10007 AS DOUBLE) AS raw_score
FROM lineitem"""

#: Fixed values of the binding: images of a split, boxes of the truth table.
SPLIT = "CASE WHEN image_id % 10 = 0 THEN 'val' WHEN image_id % 10 = 1 THEN 'test' ELSE 'train' END"
TRUTH = f"SELECT image_id, det_id, class_id, x1 + det_id % 3 AS x1, y1 + det_id % 3 AS y1, x2 + det_id % 3 AS x2, y2 + det_id % 3 AS y2 FROM ({BOXES}) b WHERE det_id % 10 <> 0"

CLASSES = "(VALUES " + ", ".join(f"({i}, '{n}', {'NULL' if f is None else f}, '{t}', '{lab}')" for i, n, f, t, lab in class_rows()) + ") AS cls(class_id, name, fdi, type, label)"
SLOTS = "(VALUES " + ", ".join(f"({f}, '{anatomy_name(f)}', {i})" for i, f in enumerate(VIEWER_ORDER)) + ") AS slots(fdi, anatomy, slot)"
LESION_LABEL = "CASE class_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LESIONS)) + " END"

TURNS = """
SELECT event_id, user_id, ts, event_type, CAST(floor(value) AS BIGINT) AS tokens_in, CAST(floor(value/5) AS BIGINT) AS tokens_out,
  CAST(floor(value) AS BIGINT) AS tokens, event_type = 'error' AS failed, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value/2) AS BIGINT) ELSE 0 END AS cache_read, value AS took
FROM events WHERE event_type <> 'signup'"""
UPLOADS = "SELECT event_id, user_id, ts, event_id AS analysis_id FROM events WHERE event_type = 'signup'"

VECTORS = """
SELECT vec_id AS id, embedding, CASE WHEN label = 0 AND vec_id % 10 = 0 THEN 'normative_standard' WHEN label = 1 THEN 'peer_reviewed_research' WHEN label = 2 THEN 'policy_position' ELSE 'educational_textbook' END AS status
FROM embeddings"""
QUERIES = f"SELECT id AS query_id, embedding, status AS expected FROM ({VECTORS}) v WHERE id < 20 OR id % 100 = 0"

PAGES = "SELECT lang AS doc, doc_id AS page, text FROM documents"
MESSAGES = "SELECT conv_id, turn, role, text, CAST(ceil(length(text)/4.0) AS BIGINT) AS tokens, role = 'assistant' AND length(text) % 3 = 0 AS uses_tool FROM conversations"
POINTS = """
SELECT o_orderkey AS id, o_orderpriority AS indicator, c_nationkey AS country, year(o_orderdate) AS year, o_totalprice AS value
FROM orders JOIN customer ON o_custkey = c_custkey"""
PLACES = "SELECT c_custkey AS place_id, (c_custkey*37%1000)/CAST(1000 AS DOUBLE)+45 AS lat, (c_custkey*91%1000)/CAST(1000 AS DOUBLE)+4 AS lon FROM customer"
CITIES = "SELECT s_suppkey AS city_id, (s_suppkey*53%1000)/CAST(1000 AS DOUBLE)+45 AS lat, (s_suppkey*17%1000)/CAST(1000 AS DOUBLE)+4 AS lon FROM supplier"
STRATA = "SELECT doc_id, quality*2+toxic AS stratum, (doc_id*2654435761) % 4294967296 AS hash FROM labels"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SQL text over the driver's tables; only the tables it names are read."""
    import re

    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)}
    named = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(named, **used)


def streamed(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SQL text over the driver's tables as a stream of files, written once to the shared folder; ts gets the session's zone, which watermarks need."""
    rows = bind(spark, sf_dir, sql)
    path = shared_path(spark, "arrivals")
    rows.withColumn("ts", rows["ts"].cast("timestamp")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
