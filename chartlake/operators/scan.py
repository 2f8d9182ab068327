"""Numbers and running sums in a total order, without a task that holds a whole group.

Rows are range-partitioned and sorted by the order; what precedes a partition comes from one row per partition, so the
driver's share grows with the partitions, not with rows or keys. The sorted rows are staged: both passes see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from chartlake.sources.staging import staged


def _dealt(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df in this order over its partitions, with a row's partition and its place there."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "sorted")


def numbered(df: DataFrame, order: list[str | Column], name: str = "id") -> DataFrame:
    """df with its gapless number from 0 in the order; rows that tie are numbered in some order."""
    rows = _dealt(df, order)
    before, starts = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("__part").agg(F.count("*")).collect())):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __base long")
    return rows.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__base") + F.col("__at")).alias(name))


def running(df: DataFrame, sums: dict[str, str | Column], order: list[str | Column], by: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """df with a column per name: the sum of the given column over the rows of the same ``by`` up to this one, or before it.

    A null counts as 0. A key of any size is spread over the partitions that its rows fall into; null keys are one key.
    """
    values = {f"__v{i}": F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for i, c in enumerate(sums.values())}
    rows = _dealt(df.withColumns(values), [*by, *order])
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    per = rows.groupBy("__part", key.alias("__key")).agg(F.max("__at").alias("at"), *[F.sum(v).alias(v) for v in values])
    ends = per.groupBy("__part").agg(F.min_by("__key", "at").alias("first"), F.max_by(F.struct("__key", *values), "at").alias("last")).collect()
    carried, starts = None, []
    for part, first, last in sorted(ends, key=lambda r: r["__part"]):
        own = [last["__key"], *[last[v] for v in values]]
        if carried and carried[0] == first:
            starts.append((part, *carried))
            if own[0] == first:  # the whole partition is one key
                own = [first, *[a + b for a, b in zip(carried[1:], own[1:], strict=True)]]
        carried = own
    schema = StructType([StructField("__p", LongType()), StructField("__k", per.schema["__key"].dataType), *[StructField(f"__base{v}", per.schema[v].dataType) for v in values]])
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, schema))
    w = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.join(offsets, (F.col("__part") == F.col("__p")) & key.eqNullSafe(F.col("__k")), "left")
    return out.select(*df.columns, *[(F.coalesce(F.sum(v).over(w), F.lit(0)) + F.coalesce(f"__base{v}", F.lit(0))).alias(n) for n, v in zip(sums, values, strict=True)])
