"""Centroid clustering in integers, each vector's nearest centroid found by the threshold algorithm.

Every dimension has a list of the centroids in the order of their values. A vector's search starts at its own value in each list
and walks outward, one centroid a list and step; centroids met for the first time get their exact distance. No centroid that is
still unmet can be nearer than the sum of the squared frontier distances, so the search ends when that sum is strictly above the
best distance (strictly, as an equal distance with a smaller number wins).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import shared_dir, staged

#: Vectors searched together; a task holds some arrays of this many times the dimensions.
ROWS = 1024
#: Products of integers below this stay exact in 64 bits for up to 2**13 components.
SMALL = 1 << 24


def integer_vectors(df: DataFrame, size: int | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(256 * x), of the vectors without null and non-finite components (and of the given length).

    A component of 2**62 or more after scaling ends the query with an error: it has no place in 64-bit sums.
    """
    fits = F.col(col).isNotNull() & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    if size is not None:
        fits = fits & (F.size(col) == size)
    scaled = lambda x: F.when(F.abs(x.cast("double") * 256) < float(1 << 62), F.floor(x.cast("double") * 256)).otherwise(F.raise_error(F.lit("component too large for 64-bit sums")).cast("long"))
    return df.where(fits).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(col, scaled).alias("v"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column as rows of integers: of 64 bits where squares and sums stay within, else Python's."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)
    return flat.astype(object) if flat.size and max(int(flat.max()), -int(flat.min())) >= SMALL else flat


class Lists:
    """Per dimension the centroids in the order of their values."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.ids = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.ids, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (ties: the smaller number) of every row of x, and its squared distance."""
        n, dims = x.shape
        k = len(self.c)
        if x.dtype == object or self.c.dtype == object:
            x, far, never = x.astype(object), 1 << 70, 1 << 200
        else:
            far, never = np.int64(1 << 29), np.iinfo(np.int64).max
        best, number = np.full(n, never, x.dtype), np.full(n, k)
        hi = np.empty((n, dims), np.int64)
        for d in range(dims):
            hi[:, d] = np.searchsorted(self.values[:, d], x[:, d])
        lo, met = hi - 1, np.zeros((n, k), bool)
        at, dim = np.arange(n), np.arange(dims)
        for _ in range(k):
            own, l, h = x[at], lo[at], hi[at]
            down = np.where(l >= 0, own - self.values[np.maximum(l, 0), dim], far)
            up = np.where(h < k, self.values[np.minimum(h, k - 1), dim] - own, far)
            first = down <= up
            place = np.where(first, l, h)
            new = np.zeros((len(at), k), bool)
            new[np.arange(len(at))[:, None], self.ids[place, dim]] = True
            new &= ~met[at]
            met[at] |= new
            rows, cents = np.nonzero(new)
            apart = own[rows] - self.c[cents]
            found = np.full((len(at), k), never, x.dtype)
            found[rows, cents] = (apart * apart).sum(axis=1)
            c = found.argmin(axis=1)
            d, old, same = found[np.arange(len(at)), c], best[at], number[at]
            use = (d < old) | ((d == old) & (c < same))
            best[at], number[at] = np.where(use, d, old), np.where(use, c, same)
            frontier = np.where(first, down, up)
            go = (frontier * frontier).sum(axis=1) <= best[at]
            lo[at], hi[at] = np.where(first, l - 1, l), np.where(first, h, h + 1)
            at = at[go]
            if not len(at):
                break
        return number, best


def _assigned(batches: Iterable[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    size = len(centroids[0])
    c = np.array(centroids, dtype=object).reshape(len(centroids), size)
    if all(abs(x) < SMALL for row in centroids for x in row):
        c = c.astype(np.int64)
    lists = Lists(c)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            x = matrix(part.column("v"), size)
            yield part, x, *lists.nearest(x)


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> list:
    """Rows per centroid and the sums of their components: added up in every task before they are shuffled."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = len(centroids), len(centroids[0])
        count, total = np.zeros(k, np.int64), np.zeros((k, size), object)
        for _, x, number, _ in _assigned(batches, centroids):
            for c in np.unique(number):
                own = x[number == c]
                count[c] += len(own)
                total[c] += own.sum(axis=0)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([count[c]]), pa.array([[str(int(s)) for s in total[c]]], pa.list_(pa.string()))], names=["cluster", "n", "s"])

    parts = vectors.mapInArrow(partial, "cluster int, n long, s array<string>")
    # a component of a cluster is a row; decimals hold sums of any number of 64-bit parts
    by = parts.select("cluster", "n", F.posexplode("s").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return by.collect()  # centroids times dimensions


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2") -> list[list[int]]:
    """Centroids (at most k rows) after the rounds; vectors as of integer_vectors, all of one length."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["v"]) for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        for r in _sums(vectors, centroids):
            centroids[r["cluster"]][r["d"]] = int(r["x"]) // r["n"]
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, best in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(best.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """One row per vector that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are the vectors of exactly ``size`` components, none null or non-finite; the others give no row. Rows with one id,
    or with equal vectors, are vectors of their own; ids that tie as starting centroids go by their vectors; a null id takes part and is
    the last choice for a start. Fewer vectors than k give fewer centroids, an empty table gives no rows. Equal distances go to
    the smaller number; a centroid that nothing is nearest to stays as it was. Only the two named columns are read, so
    that no other column can clash. The driver holds k centroids; a round sends k partial sums a task.
    """
    import hashlib

    spark = df.sparkSession
    shared_dir(spark)
    vectors = staged(integer_vectors(df, size, id_col, col), "vectors")
    centroids = fit(vectors, k, rounds)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = staged(assign(vectors, centroids), "assigned")
    per = placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    total = sum(r["s"] for r in per)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame([(r["cluster"], r["s"], total, sha[r["cluster"]]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
