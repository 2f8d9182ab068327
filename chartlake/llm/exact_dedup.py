"""Exact de-duplication by a distributed Grace hash join of the corpus with itself.

Every task folds its own rows first (a map-side combine), so a text held by a third of all rows crosses the
shuffle once per task. After the shuffle by digest each task folds what it was dealt. A fold keeps an
open-addressing table that compares complete contents; when the table outgrows its budget, it is written to
sixteen spill files by the next four bits of the digest, and each file is folded in turn.
"""

from __future__ import annotations

import os
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import documents_of

FANOUT_BITS, LEVELS = 4, 64
_HEAD = struct.Struct("<32sqqI")
#: Stands for "no id" inside a fold; below every id.
NO_ID = -(1 << 63)
PARTIAL = "digest binary, text string, top long, n long"
Row = tuple[bytes, bytes, int, int]


class ContentTable:
    """Open addressing with linear probing; an entry is (digest, content, largest id, rows)."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, top: int, n: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == digest:
                if entry[1] != content:
                    raise ValueError(f"two different texts share the digest {digest.hex()}")
                entry[2] = max(entry[2], top)
                entry[3] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, top, n])
        self.bytes += len(content) + 160
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, (digest, *_) in enumerate(self.entries):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _read(path: str) -> Iterator[Row]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            digest, top, n, size = _HEAD.unpack(head)
            yield digest, f.read(size), top, n


def fold(rows: Iterable[Row], budget: int, folder: str, level: int = 0) -> Iterator[Row]:
    """Merge equal contents; rows and results are (digest, content, largest id, number of rows)."""
    table, files = ContentTable(), None
    nibble = lambda digest: digest[level >> 1] >> (FANOUT_BITS * (level & 1)) & 15

    def put(digest: bytes, content: bytes, top: int, n: int) -> None:
        f = files[nibble(digest)]
        f.write(_HEAD.pack(digest, top, n, len(content)))
        f.write(content)

    for row in rows:
        if files:
            put(*row)
            continue
        table.add(*row)
        if table.bytes > budget and len(table.entries) > 1 and level < LEVELS:
            files = [tempfile.NamedTemporaryFile(dir=folder, delete=False) for _ in range(1 << FANOUT_BITS)]  # noqa: SIM115
            for entry in table.entries:
                put(*entry)
            table = None
    if not files:
        yield from map(tuple, table.entries)
        return
    for f in files:
        f.close()
    for f in files:
        yield from fold(_read(f.name), budget, folder, level + 1)
        os.unlink(f.name)


def _folder(budget: int, texts: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            for b in batches:
                for digest, text, top, n in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True):
                    yield digest, text.encode(), top, n

        def batch(out: list[Row]) -> pa.RecordBatch:
            held = [pa.array([r[1].decode() for r in out], pa.string())] if texts else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), *held, pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())], names=["digest", *["text"] * texts, "top", "n"])

        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            out, held = [], 0
            for row in fold(rows(), budget, folder):
                out.append(row)
                held += len(row[1])
                if held > 4 << 20 or len(out) >= 4000:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

    return run


def groups(docs: DataFrame, budget: int = 96 << 20, texts: bool = True) -> DataFrame:
    """One row per distinct text: digest binary, text (if asked for), keep_id (largest id, null if all are null), group_size.

    A fold's spill files lie in its task's own temporary folder and are gone with the task; a task that is run again makes them anew.
    """
    rows = documents_of(docs).select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("top"), F.lit(1).cast("long").alias("n"))
    local = rows.mapInArrow(_folder(budget), PARTIAL)
    merged = local.repartition("digest").mapInArrow(_folder(budget, texts), PARTIAL if texts else PARTIAL.replace("text string, ", ""))
    return merged.select("digest", *["text"] * texts, F.nullif("top", F.lit(NO_ID)).alias("keep_id"), F.col("n").alias("group_size"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 96 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, empty texts equal one another. Of equal texts the row with the largest id
    stays; a null id is below all others, and where a group has only null ids they all stay. Rows repeated
    with the same id and text count each, and are all marked kept (``deduplicate`` returns one of them). An id with
    several texts is in the group of each. Texts are compared whole, however long. An
    empty table gives no rows; other columns are not read. ``budget`` bounds the bytes of one task's table. A text of
    very many rows is one row of the groups; the join with them reads both sides from shuffles, so its skew can be split.
    """
    df = documents_of(docs, id_col, text_col)
    found = groups(df, budget, texts=False)
    rows = df.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    return rows.join(found, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, budget: int = 96 << 20) -> DataFrame:
    """The documents that stay, with all their columns; of rows repeated with one id and text one stays.

    Rows are kept by id and text, so an id with several texts loses none of them. Rows without an id stay. Null text counts
    as empty; an empty table gives no rows.
    """
    ids = groups(docs, budget, texts=False).where("keep_id is not null").select(F.col("keep_id").alias("__keep"), F.col("digest").alias("__kept"))
    rows = docs.withColumn("__digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    kept = rows.join(ids, (rows["doc_id"] == ids["__keep"]) & (rows["__digest"] == ids["__kept"]), "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))
