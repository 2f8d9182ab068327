"""Benchmark decontamination on templates.

Numbers, names and units become typed placeholders, so a question asked again with other parameters keeps its
template. Windows of canonical tokens are hash-joined between documents and benchmark items; along each run of
matching windows the slots must correspond: one benchmark value always meets one document value. An item has
leaked into a document if consistent runs cover enough of its windows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import mix, slices, staged

WINDOW, LITERALS, COVERAGE = 8, 0.5, 0.5
#: Up to so many rows of benchmark windows and bytes of their slots are handed to the tasks, which drop other windows before the join.
HANDED, HANDED_BYTES = 2_000_000, 64 << 20
#: Units of measure.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec min h hr hrs day days ms hz khz mhz ghz w kw mw v a k c f pa bar j kj cal kcal usd eur gbp dollars euros cents percent meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres hours minutes seconds".split())
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-zA-Z]{1,3})?")
_STRIP = string.punctuation + "“”‘’«»¿¡…"
_P = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.uint64(1 << 32)
_KEPT = 1_000_000


class Tokens(dict):
    """Word -> its number in the tables of canonical hashes and kinds, filled as words come."""

    def __init__(self) -> None:
        self.hash, self.kind, self.title, self.ends, self.core, self.plain = [], [], [], [], [], []

    def __missing__(self, w: str) -> int:
        core = w.strip(_STRIP) or w
        low = core.lower()
        kind = NUMBER if _NUMBER.fullmatch(core) else UNIT if low in UNITS and len(core) > 1 else LITERAL
        self.plain.append(xxhash.xxh64_intdigest(low))
        self.hash.append(self.plain[-1] if kind == LITERAL else kind)
        self.kind.append(kind)
        self.title.append(kind == LITERAL and core[0].isupper() and not (len(core) > 1 and core.isupper()))
        self.ends.append(w.rstrip("\"'”’»)")[-1:] in ".!?:")
        self.core.append(low)
        self[w] = n = len(self.hash) - 1
        return n

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.hash, np.uint64), np.array(self.kind, np.int8), np.array(self.title, bool), np.array(self.ends, bool), np.array(self.plain, np.uint64)

    def trim(self) -> None:
        if len(self) > _KEPT:
            self.clear()
            self.__init__()


def _rolled(values: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    last = len(values) - size + 1
    h = np.full(last, seed)
    for j in range(size):
        h = (h + values[j : last + j]) * _P
        h ^= h >> np.uint64(29)
    return h


def _among(at: np.ndarray, h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The positions whose hash is in the sorted array wanted."""
    if not len(wanted) or not len(at):
        return at[:0]
    place = np.searchsorted(wanted, h[at])
    return at[(place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == h[at])]


def windows_of(texts: list[str], sizes: list[int], tokens: Tokens, wanted: np.ndarray | None, copied: str | np.ndarray | None = None) -> Iterator[tuple[int, int, int, list[str] | None]]:
    """(text number, position, hash, slot values) of the windows of each size with enough literals, only wanted hashes if given.

    Windows of plain lower-cased words, for verbatim copies, follow with no slot values: with copied "own" those of
    texts that are one window and windows with too few literals, with "all" every one, with an array those hashes.
    """
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    code = np.fromiter((tokens[w] for ws in words for w in ws), np.int64, int(lengths.sum()))
    if not len(code):
        return
    table_hash, table_kind, table_title, table_ends, table_plain = tokens.tables()
    starts = np.cumsum(lengths) - lengths
    opens = np.concatenate(([True], table_ends[code[:-1]]))
    opens[starts[lengths > 0]] = True
    name = table_title[code] & ~opens  # a capital inside a sentence
    kind = np.where(name, NAME, table_kind[code])
    canon = mix(np.where(name, np.uint64(NAME), table_hash[code]) + _P)
    literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    plain = None if copied is None else mix(table_plain[code] + _P)
    doc = np.repeat(np.arange(len(texts)), lengths)
    room = (starts + lengths)[doc] - np.arange(len(code))  # tokens from here to the text's end
    for size in sizes:
        if len(code) < size:
            continue
        last = len(code) - size + 1
        h = _rolled(canon, size, np.uint64(size))
        inside, enough = room[:last] >= size, literal[size:] - literal[:last] >= max(1, LITERALS * size)
        at = np.flatnonzero(inside & enough)
        if wanted is not None:
            at = _among(at, h, wanted)
        for i in at.tolist():
            slots = [tokens.core[code[k]] for k in range(i, i + size) if kind[k] != LITERAL]
            yield int(doc[i]), int(i - starts[doc[i]]), int(h[i].astype(np.int64)), slots
        if plain is None:
            continue
        h = _rolled(plain, size, np.uint64(size) + _PLAIN)
        if isinstance(copied, str) and copied == "own":
            whole = lengths[doc[:last]] == size
            inside &= whole | (~enough & (size == max(sizes)))
        at = np.flatnonzero(inside)
        if not isinstance(copied, str):
            at = _among(at, h, copied)
        for i in at.tolist():
            yield int(doc[i]), int(i - starts[doc[i]]), int(h[i].astype(np.int64)), None


def _windows(df: DataFrame, id_col: str, sizes: list[int], wanted: np.ndarray | None = None, copied: str | np.ndarray | None = None) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast((wanted, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in slices(batches):
            tokens.trim()
            ids = b.column(0).to_pylist()
            out = []
            for n, at, h, slots in windows_of(b.column(1).to_pylist(), sizes, tokens, *held.value):
                out.append((ids[n], at, h, slots))
                if len(out) == 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["id", "at", "hash", "slots"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, at int, hash long, slots array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, handed: int = HANDED) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, windows, item_windows, coverage, changed_slots.

    An item shorter than a window is one window. Windows with fewer literals than half have no template; they and
    items that are one window are also compared by their plain words, so that verbatim copies always match. Coverage is
    the greater one of template windows among the item's templates and of all windows among all. Null texts count as empty and match nothing; an item with a null id is left out,
    documents with a null id count as one; repeated rows count once; an empty table gives no rows; other columns are
    not read. Very long texts are read whole. Runs of one item and document count together if one benchmark value meets
    one document value over all of them, else the longest run counts alone (ties: that of the least shift). With at most
    ``handed`` rows of benchmark windows the tasks drop other windows before the join;
    beyond, all windows are joined by a shuffle on the hash, with the same result.
    """
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    sizes = sorted(r["n"] for r in benchmark.select(F.least(n_words, F.lit(window)).alias("n")).where("n > 0").distinct().collect())  # at most `window` rows
    own = F.struct("at", "slots")
    items = _windows(benchmark, "item_id", sizes, copied="own")
    items = staged(items.where("id is not null").distinct(), "benchmark-windows")
    per_item = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct(F.when(F.col("slots").isNotNull(), F.col("at"))).alias("n_templates"), F.countDistinct("at").alias("n_all"))
    hashes = items.select("hash", F.col("slots").isNull().alias("copy")).distinct()
    held = items.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.array_join("slots", " ")).cast("long")), F.lit(0)).alias("bytes")).head()
    few = held["rows"] <= handed and held["bytes"] <= HANDED_BYTES
    if few:
        held = hashes.collect()
        wanted, copied = (np.sort(np.array([r["hash"] for r in held if r["copy"] == c], np.int64).astype(np.uint64)) for c in (False, True))
        found = F.broadcast(items.select("hash", F.col("id").alias("item_id"), own.alias("item")))
        hits = _windows(docs, "doc_id", sizes, wanted, copied if len(copied) else None).join(found, "hash")
    else:
        copied = "all" if hashes.where("copy").limit(1).count() else None
        hits = _windows(docs, "doc_id", sizes, copied=copied).join(items.select("hash", F.col("id").alias("item_id"), own.alias("item")), "hash")
    pairs = F.transform(F.arrays_zip(F.col("item.slots").alias("i"), F.col("slots").alias("d")), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
    runs = hits.select(F.col("id").alias("doc_id"), "item_id", (F.col("at") - F.col("item.at")).alias("shift"), F.col("item.at").alias("item_at"), pairs.alias("pairs"))
    template = F.col("pairs").isNotNull()
    runs = runs.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(F.when(template, F.col("item_at"))).alias("ats"), F.collect_set(F.when(~template, F.col("item_at"))).alias("copies"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    changed = consistent & F.exists("pairs", lambda p: p["i"] != p["d"])
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    # a run whose slots do not correspond in itself counts for nothing
    fit = F.when(consistent, F.struct(F.size("ats").alias("length"), (-F.col("shift")).alias("shift"), "ats", changed.alias("changed")))
    per_pair = runs.groupBy("doc_id", "item_id").agg(gathered(F.when(consistent, F.col("ats"))).alias("all_ats"), gathered(F.when(consistent, F.col("pairs"))).alias("pairs"), F.max(fit).alias("longest"), gathered("copies").alias("copies"), F.max(changed).alias("some_changed"))
    one = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    per_pair = per_pair.select("doc_id", "item_id", "copies", F.when(one, F.col("all_ats")).otherwise(F.col("longest.ats")).alias("ats"), F.when(one, F.col("some_changed")).otherwise(F.col("longest.changed")).alias("changed_slots"))
    out = per_pair.join(per_item, "item_id").withColumns({"n": F.size("ats"), "n_both": F.size(F.array_union("ats", "copies"))})
    by_template = (F.col("n_templates") > 0) & (F.col("n") * F.col("n_all") >= F.col("n_both") * F.col("n_templates"))
    out = out.withColumns({"windows": F.when(by_template, F.col("n")).otherwise(F.col("n_both")).cast("long"), "item_windows": F.when(by_template, F.col("n_templates")).otherwise(F.col("n_all"))})
    return out.select("doc_id", "item_id", "windows", "item_windows", (F.col("windows") / F.col("item_windows")).alias("coverage"), "changed_slots").where((F.col("windows") > 0) & (F.col("coverage") >= coverage))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item has leaked, with all their columns.

    Null and empty texts stay; repeated rows go or stay alike; documents with a null id go together if one of them holds an
    item; without items all stay; an empty table gives no rows.
    """
    leaked = find_leaks(docs, benchmark).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["__leaked"]), "left_anti")
