"""One query per operator, each over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.llm import centroids, decontamination, exact_dedup, hilbert, lexical_search, near_dedup, packing, quality, token_count, topk_search, toxicity, url_filter, warc
from chartlake.llm.common import read_table, shared_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read_table(spark, sf_dir, "pages"), rules)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign_shards(read_table(spark, sf_dir, "documents")).drop("hilbert")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_url_filters, op4_token_counts, op5_packing, op6_near_dedup, op7_quality, op8_exact_dedup, op9_sharding, op10_warc, op11_centroids, op12_lexical_search, op13_topk_search)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SCALED = "list_transform(embedding, lambda x: CAST(floor(256*CAST(x AS DOUBLE)) AS BIGINT))"


def _centroid_sql(rounds: int = 5) -> str:
    """The rounds written out one after the other."""
    steps = [f"v AS MATERIALIZED (SELECT vec_id, {_SCALED} AS v FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64)"]
    steps.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 40))")
    far = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1]-z[2])*(z[1]-z[2])))"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.v AS x, c.c, {far} AS d FROM v, c{i} c) GROUP BY vec_id)")
        if i < rounds:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"m{i} AS MATERIALIZED (SELECT c, list({floor} ORDER BY k) AS v FROM (SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM a{i}) GROUP BY c, k) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op11_centroids": _centroid_sql(),
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, len(ws) AS n, ws FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS w FROM benchmark),
f AS (SELECT doc_id, r, n, w, count(*) AS tf FROM (SELECT doc_id, r, n, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM i) GROUP BY ALL),
g AS (SELECT w, count(*) AS df FROM f GROUP BY w),
x AS (SELECT item_id, doc_id, r, CAST(sum(CAST(floor(1000*ln((2*docs+2)/(2*df+1))) AS BIGINT) * ((1000000000*tf) // (1000*tf + 20*(100-50+((50*n*docs) // words))))) AS BIGINT) AS score FROM i JOIN f USING (w) JOIN g USING (w), s GROUP BY item_id, doc_id, r)
SELECT item_id, row_number() OVER o AS rank, doc_id, score FROM x WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50""",
    "op13_topk_search": f"""
WITH v AS (SELECT vec_id, {_SCALED} AS v FROM embeddings WHERE {_WHOLE}),
x AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1]*z[2])) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.v) = len(v.v))
SELECT query_id, row_number() OVER o AS rank, vec_id, score FROM x WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 5""",
    "op3_url_filters": f"""
WITH r(rh, rp, rv) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT u.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY u.page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
}
