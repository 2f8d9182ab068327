"""Sharding along a Hilbert curve, with DataFrame functions only.

Every row gets coordinates from its metadata (equal-depth quantiles, so a hot value fills few cells), the
coordinates give the row's place on a Hilbert curve, a range sort by that place orders the table, and runs of
the order become shards or files whose per-column minima and maxima are narrow in every dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm.common import staged

BITS = 5


def code_of(df: DataFrame, name: str) -> Column:
    """What orders a column: a string as itself (whole, by its bytes), any other value as a number; null is below all."""
    if dict(df.dtypes)[name] == "string":
        return F.coalesce(F.concat(F.lit("\x01"), F.col(name)), F.lit(""))
    return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))


def _string_cuts(codes: DataFrame, cells: int) -> list[str]:
    """At most cells - 1 values between equal-depth ranges of the string column v.

    Rows are counted per distinct value first, so a hot value is one row; values are range-sorted, and running counts
    start from the sums of the partitions before.
    """
    values = codes.groupBy("v").agg(F.count("*").alias("n"))
    parts = staged(values.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")), "values")
    before, starts = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("part").agg(F.sum("n")).collect())):  # a row per partition
        starts.append((part, before))
        before += n
    offsets = F.broadcast(codes.sparkSession.createDataFrame(starts, "part int, base long"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    step = lambda c: F.floor(c * cells / max(before, 1))
    edges = parts.join(offsets, "part").withColumn("upto", upto).where((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (F.col("upto") < before))
    return sorted(r["v"] for r in edges.select("v").collect())  # at most cells - 1 rows


def boundaries(df: DataFrame, dims: list[str], bits: int = BITS) -> list[list]:
    """Cuts between 2**bits equal-depth ranges of every dimension; none for a dimension without rows."""
    cells = 1 << bits
    steps = [i / cells for i in range(1, cells)]
    kinds = dict(df.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    found = {}
    if numbers:  # one row of quantile sketches, however long the table
        row = df.agg(*[F.percentile_approx(code_of(df, d), steps, 10_000).alias(f"c{i}") for i, d in enumerate(numbers)]).head()
        found = {d: sorted(set(v or [])) for d, v in zip(numbers, row, strict=True)}
    for d in dims:
        if kinds[d] == "string":
            found[d] = _string_cuts(df.select(code_of(df, d).alias("v")), cells)
    return [found[d] for d in dims]


def hilbert_index(df: DataFrame, coords: list[str], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """df with column ``name``, the place on the curve of the cell with these coordinates (integers below 2**bits).

    Skilling's transform, a projection per step, so that no step's expression is written out again in the next one.
    """
    n, rest = len(coords), [c for c in df.columns if c not in coords]
    df = df.select(*rest, *[F.col(c).cast("int").alias(c) for c in coords])
    head = F.col(coords[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        df = df.withColumn(coords[0], F.when(head.bitwiseAND(q) != 0, head.bitwiseXOR(q - 1)).otherwise(head))
        for c in coords[1:]:
            own = F.col(c)
            bit, swap = own.bitwiseAND(q) != 0, head.bitwiseXOR(own).bitwiseAND(q - 1)
            df = df.withColumns({coords[0]: F.when(bit, head.bitwiseXOR(q - 1)).otherwise(head.bitwiseXOR(swap)), c: F.when(bit, own).otherwise(own.bitwiseXOR(swap))})
    for before, c in zip(coords, coords[1:], strict=False):
        df = df.withColumn(c, F.col(c).bitwiseXOR(F.col(before)))
    last, turn = F.col(coords[-1]), F.lit(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(last.bitwiseAND(q) != 0, q - 1).otherwise(0))
    df = df.withColumn("__turn", turn)
    place = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i, c in enumerate(coords):
            place = place + F.shiftleft(F.shiftright(F.col(c).bitwiseXOR(F.col("__turn")), b).bitwiseAND(1).cast("long"), b * n + n - 1 - i)
    return df.withColumn(name, place).drop("__turn", *coords)


def with_curve(df: DataFrame, dims: list[str], bits: int = BITS, cuts: list[list] | None = None, name: str = "hilbert") -> DataFrame:
    """df with its cell on the curve as column ``name``; dimensions of one cell only (an empty or constant one) take no part."""
    cuts = boundaries(df, dims, bits) if cuts is None else cuts
    used = [(f"__x{i}", d, v) for i, (d, v) in enumerate(zip(dims, cuts, strict=True)) if v]
    if not used:
        return df.withColumn(name, F.lit(0).cast("long"))
    codes = df.select("*", *[code_of(df, d).alias(x) for x, d, _ in used])
    cells = codes.withColumns({x: sum((F.when(F.col(x) > c, 1).otherwise(0) for c in v), F.lit(0)) for x, _, v in used})
    return hilbert_index(cells, [x for x, _, _ in used], bits, name)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with columns __rank, its gapless place in this order from 0, and __total, without a window over all rows.

    A range sort deals the order out; the place is the row's place in its partition plus the rows of the
    partitions before it. The sorted rows are staged, so both passes see the same partitions.
    """
    at = F.monotonically_increasing_id()
    parts = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "curve")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n")).collect()  # a row per partition, not per key
    before, starts = 0, []
    for part, n in sorted(map(tuple, counts)):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    return parts.join(F.broadcast(offsets), "__part").select("*", (F.col("__before") + F.col("__at")).alias("__rank"), F.lit(before).cast("long").alias("__total")).drop("__part", "__at", "__before")


def run_of(rank: Column, total: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot when total ranks are cut into runs whose lengths differ by one at most."""
    small, rest = F.floor(total / shards).cast("long"), total % shards
    edge = rest * (small + 1)
    big, late = F.call_function("div", rank, small + 1), F.call_function("div", rank - edge, F.greatest(small, F.lit(1)))
    shard = F.when(rank < edge, big).otherwise(rest + late)
    slot = F.when(rank < edge, rank % (small + 1)).otherwise((rank - edge) % F.greatest(small, F.lit(1)))
    return shard.cast("int"), slot.cast("long")


def _along_curve(rows: DataFrame, metadata: DataFrame, dims: list[str], bits: int, shards: int) -> DataFrame:
    """rows in curve order with __hilbert, __shard and __slot; metadata holds __id, __digest and the dims of the same rows.

    A group of equal texts takes the place of its row with the least id, so that it lies together although its rows'
    metadata differ; only groups whose rows differ there are joined (a text of many rows is split by the skew join).
    """
    own = F.struct(*dims)
    groups = metadata.groupBy("__digest").agg(F.min_by(own, F.struct(F.col("__id").isNull(), "__id", own)).alias("__lead"), F.min(own).alias("lo"), F.max(own).alias("hi")).where("not (lo <=> hi)")
    lead = staged(groups.select(F.col("__digest").alias("__group"), "__lead"), "groups")
    names = [f"__d{i}" for i in range(len(dims))]
    together = rows.join(lead.hint("merge"), rows["__digest"] == lead["__group"], "left").withColumns({n: F.when(F.col("__group").isNull(), F.col(d)).otherwise(F.col(f"__lead.{d}")) for n, d in zip(names, dims, strict=True)}).drop("__group", "__lead")
    curve = with_curve(together, names, bits, boundaries(metadata, dims, bits), "__hilbert").drop(*names)
    placed = ranked(curve, ["__hilbert", "__crc", "__digest", "__id"])
    shard, slot = run_of(F.col("__rank"), F.col("__total"), shards)
    return placed.withColumns({"__shard": shard, "__slot": slot}).drop("__rank", "__total")


def _described(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"__id": F.col("doc_id").cast("long"), "__size": (F.octet_length(text) + 1).cast("long"), "__crc": F.crc32(text.cast("binary")), "__digest": F.unhex(F.sha2(text.cast("binary"), 256))}


def assign_shards(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("source", "lang", "size"), bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert.

    The law is ``rows``: the curve's order is cut into runs whose row counts differ by one at most. ``size`` among the
    dims is the text's bytes plus 1 (a column of that name is not read); strings count whole. Null text
    has size 1 like empty text; null metadata sorts first. Equal texts lie together, at the place of the one with the least
    id, in the order of their ids; only a cut of the row law can part them. Rows that tie are ordered by text
    checksum, digest and id. Fully repeated rows get a slot each; an empty table gives no rows; fewer
    rows than shards leave the last shards empty. Very long texts count by their bytes, the text itself is not moved.
    Other columns, whatever their names, are not read.
    """
    own = _described(docs)
    rows = docs.select(*[c.alias(k) for k, c in own.items()], *[own["__size"].alias(d) if d == "size" else F.col(d) for d in dims])
    rows = staged(rows, "metadata")  # the texts are read once; what follows is narrow
    placed = _along_curve(rows, rows, list(dims), bits, shards)
    return placed.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__hilbert").alias("hilbert"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, dims: tuple[str, ...] = ("source", "lang", "size"), max_rows_per_file: int = 1_000_000, bits: int = BITS) -> DataFrame:
    """Write the documents, with all their columns, along the curve: a folder ``__shard=n`` per shard, several files each.

    Returns shard, file, rows and the least and greatest value of every dimension per file, for pruning. Every row is
    written once, repeated ones too; the columns __shard, __slot, __hilbert and __dim0 and so on are added.
    """
    own = _described(docs)
    names = [f"__dim{i}" for i in range(len(dims))]
    rows = docs.select(F.struct("*").alias("__row"), *[c.alias(k) for k, c in own.items()], *[(own["__size"] if d == "size" else F.col(d)).alias(n) for n, d in zip(names, dims, strict=True)])
    metadata = staged(rows.select("__id", "__digest", *names), "metadata")
    out = _along_curve(rows, metadata, names, bits, shards)
    out.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").select("__row.*", *names, "__hilbert", "__shard", "__slot").write.option("maxRecordsPerFile", max_rows_per_file).partitionBy("__shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    per_file = back.select("*", F.col("_metadata.file_path").alias("__file")).groupBy(F.col("__shard").alias("shard"), F.col("__file").alias("file"))
    return per_file.agg(F.count("*").alias("rows"), *[f(n).alias(f"{k}_{d}") for n, d in zip(names, dims, strict=True) for k, f in (("min", F.min), ("max", F.max))])
