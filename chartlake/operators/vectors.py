"""Exact vector search with slots per source class, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.operators.patterns import find_terms
from chartlake.operators.scan import numbered

#: Rows of a block of queries and of vectors; a task holds one product of them.
QUERY_BLOCK, VECTOR_BLOCK = 512, 8192
#: Products this close can have equal scores after rounding.
NEAR = 2e-6


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def l2_normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    n = norm(col)
    return df.withColumn(col, F.transform(col, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def norm_check(df: DataFrame, col: str = "embedding", tolerance: float = 1e-3) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(norm(col) - 1) > tolerance).alias("off_norm"))


def token_limit_check(chunks: DataFrame, limit: int = 512, tokens: str = "n_tokens") -> DataFrame:
    return chunks.agg(F.max(tokens).alias("max_tokens"), F.round(F.avg(tokens), 6).alias("mean_tokens"), F.count_if(F.col(tokens) > limit).alias("over_limit"))


def require_token_limit(chunks: DataFrame, limit: int = 512, tokens: str = "n_tokens") -> DataFrame:
    """chunks, or an error at the first one over the limit."""
    return chunks.where(F.assert_true(F.col(tokens) <= limit, F.lit("chunk over the token limit")).isNull())


def stable_ids(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """id: dense number from 0 in key order."""
    return numbered(df, [key], "id")


def reconcile(index: DataFrame, sidecar: DataFrame, required: list[str]) -> DataFrame:
    """Counts of both sides, ids missing on either, and rows with a required field missing."""
    i, s = index.select("id", F.lit(True).alias("_i")), sidecar.withColumn("_s", F.lit(True))
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return i.join(s, "id", "full").agg(F.count("_i").alias("n_index"), F.count("_s").alias("n_sidecar"), F.count_if(F.col("_s").isNull()).alias("no_sidecar"), F.count_if(F.col("_i").isNull()).alias("no_vector"), F.count_if(F.col("_s") & bad).alias("incomplete"))


def _blocks(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Rows dealt by the hash of their key into blocks of about size rows, one array of rows each."""
    n = max(1, -(-df.count() // size))
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("_b"), F.struct(*df.columns).alias("_r"))
    # the pairs of blocks are as many tasks as the product of both sides' partitions: no empty ones
    return rows.groupBy("_b").agg(F.collect_list("_r").alias(name)).drop("_b").repartition(n)


def _leaders(pairs: Iterator[pa.RecordBatch], k: int, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    """The rows of each pair of blocks that can be among the k best of their query and status, with the exact product.

    A matrix product finds the k-th best; what is within rounding of it is multiplied again in the order of the dimensions.
    """
    for batch in pairs:
        for n in range(batch.num_rows):
            q, v = (batch.column(c)[n].values for c in ("q", "v"))
            q_id, v_id = q.field("query_id").to_numpy(zero_copy_only=False), v.field("id").to_numpy(zero_copy_only=False)
            qe, ve = (x.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) for x in (q, v))
            coded = v.field("status").dictionary_encode("encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            for c, status in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(code == c)
                own = own[np.argsort(v_id[own], kind="stable")]
                near = qe @ ve[own].T
                if exclude_self:
                    near[q_id[:, None] == v_id[own]] = -np.inf
                least = np.partition(near, len(own) - k, axis=1)[:, len(own) - k] if len(own) > k else np.full(len(q_id), -np.inf)
                a, b = np.nonzero((near >= (least - NEAR)[:, None]) & (near > -np.inf))
                score = np.zeros(len(a))
                for d in range(qe.shape[1]):
                    score = score + qe[a, d] * ve[own[b], d]
                order = np.lexsort((b, -score, a))
                a, b, score = a[order], b[order], score[order]
                # of one query's equal products the k least ids are enough
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (score[1:] != score[:-1])))[: len(a)]
                at = np.arange(len(a))
                use = at - np.maximum.accumulate(np.where(new, at, 0)) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_id[a[use]]), pa.array(v_id[own[b[use]]]), pa.array([status] * int(use.sum()), pa.string()), pa.array(score[use])], names=["query_id", "id", "status", "score"])


def scores(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, status, score): at least the k best vectors of every query in every status, ties by the least id.

    Both sides may grow: each is dealt into blocks, every pair of blocks is one small task that passes on only its leaders.
    Embeddings have one length; a row without one has no score and is left out.
    """
    q = _blocks(queries.select("query_id", "embedding").where("embedding is not null"), "query_id", QUERY_BLOCK, "q")
    v = _blocks(vectors.select("id", "status", "embedding").where("embedding is not null"), "id", VECTOR_BLOCK, "v")
    found = v.hint("shuffle_replicate_nl").crossJoin(q).mapInArrow(lambda b: _leaders(b, k, exclude_self), "query_id long, id long, status string, score double")
    return found.withColumn("score", F.round("score", 6))


def _by_score(*parts: str):
    return Window.partitionBy("query_id", *parts).orderBy(F.desc("score"), "id")


def search_global(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    return scores(queries, vectors, k).withColumn("rank", F.row_number().over(_by_score())).where(F.col("rank") <= k)


def search_slots(queries: DataFrame, vectors: DataFrame, per_status: int = 2, total: int = 8, known: tuple[str, ...] | None = None) -> DataFrame:
    """Best per_status hits of each known status, filled up to total by global rank, then cut to total by score.

    Only the best max(per_status, total) of a status can be chosen; the rest are pruned before the global rank.
    """
    s = scores(queries, vectors, max(per_status, total)).withColumn("in_status", F.row_number().over(_by_score("status"))).where(F.col("in_status") <= max(per_status, total))
    slot = F.col("in_status") <= per_status
    if known is not None:
        slot = slot & F.col("status").isin(list(known))
    s = s.withColumn("slot", slot).withColumn("n_slots", F.count_if("slot").over(Window.partitionBy("query_id")))
    s = s.withColumn("fill", F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "id")))
    chosen = s.where(F.col("slot") | (F.col("fill") <= total - F.col("n_slots")))
    return chosen.withColumn("rank", F.row_number().over(_by_score())).where(F.col("rank") <= total).select("query_id", "rank", "id", "status", "score")


def resolve_hits(hits: DataFrame, meta: DataFrame) -> DataFrame:
    return hits.join(meta, "id")


def retrieval_eval(queries: DataFrame, global_hits: DataFrame, slot_hits: DataFrame) -> DataFrame:
    """Rank of the expected status under both searches and whether the slots found it."""
    want = queries.select("query_id", "expected")
    best = lambda h, name: h.join(want, "query_id").where("status = expected").groupBy("query_id").agg(F.min("rank").alias(name))
    out = want.join(best(global_hits, "global_rank"), "query_id", "left").join(best(slot_hits, "slot_rank"), "query_id", "left")
    return out.withColumn("passed", F.col("slot_rank").isNotNull())


def leakage_probe(hits: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Hits that hold a forbidden term, whatever the case; any number of terms, in one pass over a hit's text."""
    return find_terms(hits, terms, ["id"], text)


def _thousandths(x: Column) -> Column:
    """x rounded to three places by its binary value, as printf and Python do; Java's %.3f rounds the decimal writing of x."""
    a = F.abs(x)
    low = F.floor(a * 1000).cast("double")
    high = a * 134217729.0 - (a * 134217729.0 - a)  # the upper half of the digits; its products are exact
    over = (high * 2000 - (2 * low + 1)) + (a - high) * 2000
    up = (over > 0) | ((over == 0) & (low % 2 == 1))
    return F.signum(x) * F.when(up, low + 1).otherwise(low) / 1000


def render_passages(queries: DataFrame, hits: DataFrame, most: int = 600) -> DataFrame:
    """Ranked text block per query; a query without hits says so. hits: query_id, rank, source, section, status, score, page_start, page_end, text."""
    from chartlake.operators.corpus import truncate_on_word

    page = F.when(F.col("page_end").isNull() | (F.col("page_start") == F.col("page_end")), F.concat(F.lit("p"), F.col("page_start").cast("string"))).otherwise(F.concat(F.lit("pp"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(" — "), F.coalesce("section", F.lit("")), F.lit(" ("), page, F.lit(")\n    status: "), "status", F.lit(" | similarity: "), F.format_string("%.3f", _thousandths(F.col("score"))), F.lit("\n"), truncate_on_word(F.trim("text"), most))
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("body"))
    out = queries.select("query_id", "query").join(per, "query_id", "left")
    return out.select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), F.concat(F.lit("No passages in the corpus matched: "), "query")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" passages for: "), "query", F.lit("\n"), "body")).alias("text"))


def named_sources(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """(turn_id, source) for each source whose name stands in a reply's text as written: the mentions that citation_grounding takes."""
    return find_terms(replies, sources, ["turn_id"], term="source", fold=False)


def citation_grounding(mentions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(turn_id, source) named in a reply but not retrieved in that turn."""
    return mentions.select("turn_id", "source").distinct().join(retrieved.select("turn_id", "source"), ["turn_id", "source"], "left_anti")


def embed_text(df: DataFrame, dims: int = 256, text: str = "text") -> DataFrame:
    """embedding: hashed word frequencies, weighted by rarity, of unit length. A given vector column can stand in its place."""
    words = Tokenizer(inputCol="_t", outputCol="_w").transform(df.withColumn("_t", F.coalesce(text, F.lit(""))))
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    return Normalizer(inputCol="_idf", outputCol="_n").transform(weighted).withColumn("embedding", vector_to_array("_n")).drop("_t", "_w", "_tf", "_idf", "_n")
