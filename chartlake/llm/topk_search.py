"""Exact top-k by inner product, without random access to the vectors while lists are read.

Vectors are dealt into blocks. Inside a block every dimension has a list of the vectors by value, read from its top for queries
with a positive component there and from its end for those with a negative one. After each stride every vector has a sum of
what was read and bounds of what was not: at best the list's frontier value, at worst the value at the list's other end. A query stops when the
vectors outside a small set have upper bounds below the k-th best lower bound; only that set's scores are then resolved.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.llm.centroids import integer_vectors
from chartlake.llm.common import scratch, staged

#: Queries and vectors of a block; a task holds a few arrays of their product.
QUERIES, VECTORS = 512, 4096
#: Parts of the lists that are read before the bounds are looked at again.
STRIDES = 8
#: Sums of products below this are exact as doubles.
EXACT = 1 << 53


def _matrix(rows: pa.Array, size: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), size)


def qualified(q: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Per query the vectors that can be among its k best with a score of floor or more; own marks the pairs that don't count.

    q, v: rows of numbers whose products sum exactly. Every vector left out is proven to be below k others, or below the floor.
    """
    n, dims = v.shape
    order = np.argsort(v, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(v, order, axis=0)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    lowest = np.where(own, -np.inf, 0).astype(q.dtype)
    worst_plus, worst_minus = plus * ordered[0], minus * ordered[-1]
    at, read, out = np.arange(len(q)), np.zeros((len(q), n), q.dtype), [None] * len(q)
    edges = sorted({n * i // STRIDES for i in range(1, STRIDES + 1)} - {0})
    done = 0
    for upto in edges:
        from_top, from_end = (rank >= n - upto) & (rank < n - done), (rank >= done) & (rank < upto)
        read += plus[at] @ np.where(from_top, v, 0).T + minus[at] @ np.where(from_end, v, 0).T
        left_top, left_end = (rank < n - upto).T.astype(v.dtype), (rank >= upto).T.astype(v.dtype)
        frontier_plus, frontier_minus = plus[at] * ordered[n - upto], minus[at] * ordered[upto - 1]
        upper = read + frontier_plus @ left_top + frontier_minus @ left_end + lowest[at]
        lower = read + worst_plus[at] @ left_top + worst_minus[at] @ left_end + lowest[at]
        least = floor[at].copy()
        if n >= k:
            least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
        can = (upper >= least[:, None]) & (upper > -np.inf)
        stop = (can.sum(axis=1) <= max(32, 4 * k)) | (upto == n)
        for i in np.flatnonzero(stop):
            out[at[i]] = np.flatnonzero(can[i])
        at, read, done = at[~stop], read[~stop], upto
        if not len(at):
            break
    return out


def _pairs(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of every pair of blocks the k best vectors of each query with their resolved scores."""
    for batch in batches:
        for i in range(batch.num_rows):
            size = batch.column("v_size")[i].as_py()
            if size != batch.column("q_size")[i].as_py():
                continue
            q, v = batch.column("q")[i].values, batch.column("v")[i].values
            qi, vi = _matrix(q.field("v"), size), _matrix(v.field("v"), size)
            most = lambda x: max(int(x.max()), -int(x.min())) if x.size else 0
            small = most(qi) * most(vi) * max(1, size) < EXACT
            qx, vx = (x.astype(np.float64 if small else object) for x in (qi, vi))
            q_id = q.field("query_id").to_numpy(zero_copy_only=False)
            v_id, known = v.field("vec_id").fill_null(0).to_numpy(), v.field("vec_id").is_valid().to_numpy(zero_copy_only=False)
            floor = np.array([-np.inf if x is None else x for x in q.field("floor").to_pylist()], qx.dtype)
            own = (q_id[:, None] == v_id) & known
            ids, scores, owners = [], [], []
            for j, found in enumerate(qualified(qx, vx, k, floor, own)):
                exact = (vx[found] * qx[j]).sum(axis=1) if size else np.zeros(len(found))
                best = np.lexsort((v_id[found], ~known[found], -exact))[:k]
                ids += [int(v_id[x]) if known[x] else None for x in found[best]]
                scores += [int(x) for x in exact[best]]
                owners += [int(q_id[j])] * len(best)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def _blocks(rows: DataFrame, n: int, name: str, *cols: str) -> DataFrame:
    """About n arrays of rows per length of vector; a block's rows are chosen by their place in the staged table, so that no id fills one."""
    dealt = rows.select(F.size("v").alias(f"{name}_size"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias(f"{name}_block"), F.struct(*cols).alias("r"))
    return dealt.groupBy(f"{name}_size", f"{name}_block").agg(F.collect_list("r").alias(name))


def _meet(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A small task per pair of a block of vectors and a block of queries of the same length."""
    pairs = vectors.hint("shuffle_replicate_nl").crossJoin(queries).select("v_size", "v", "q_size", "q")
    return pairs.mapInArrow(lambda b: _pairs(b, k), "query_id long, vec_id long, score long")


def search(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", col: str = "embedding", block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of every vector whose id is divisible by ``every``, ties by smaller vec_id.

    The score is the inner product of components as floor(256 * x). Vectors null or with null or non-finite components take
    no part; vectors of different lengths have no score. Rows with a query's id are its own and do not rank for it;
    of several rows with a query's id the least vector asks. Else repeated rows rank each, and equal scores of one id count by row. A null id is
    no query and ranks last among equals. An empty table gives no rows. Only the two named columns are read. A score
    beyond 64 bits ends the query with an error.

    The first block is searched first: its k-th best score is a floor below which no later block reads on.
    """
    with scratch() as keep:
        vectors = staged(integer_vectors(df, None, id_col, col), "vectors")
        n = max(1, -(-vectors.count() // block))
        asking = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v")
        asking = staged(asking, "queries")
        n_queries = max(1, -(-asking.count() // query_block))
        all_blocks = staged(_blocks(vectors, n, "v", "vec_id", "v"), "blocks")
        nothing = F.lit(None).cast("long")
        opening = staged(_meet(all_blocks.where("v_block = 0"), _blocks(asking.withColumn("floor", nothing), n_queries, "q", "query_id", "v", "floor").repartition(n_queries), k), "opening")
        floors = opening.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        queries = staged(asking.join(floors, "query_id", "left"), "floors")
        rest = _meet(all_blocks.where("v_block > 0").repartition(n), _blocks(queries, n_queries, "q", "query_id", "v", "floor").repartition(n_queries), k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        best = opening.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return keep(best.select("query_id", "rank", "vec_id", "score"))
