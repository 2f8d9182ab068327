"""Best-fit sequence packing by linear grouping.

Lengths are whole numbers up to the capacity, so the histogram of all pieces has at most that many rows,
however long the corpus: the plan is made on the histogram. Large lengths are sorted and cut into groups of
equal cardinality, each rounded up to its largest; a configuration program over these few sizes (column
generation, prices by a knapsack) says how often each pattern is used; actual pieces, which are no longer than
their rounded size, take the places; what is left and the small lengths go best-fit into the remaining room.
A plan is a list of runs (length, first rank, how many, first sequence, offset). Pieces find their run by
their rank among the pieces of their length, which per-task counters and a prefix sum over tasks give.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm.common import documents_of, slices, staged
from chartlake.llm.tokens import encoder

CAPACITY, END_ID, GROUPS, SMALL = 1024, 2, 96, 0.15
Run = tuple[int, int, int, int, int]


def _knapsack(prices: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """Best value of a pattern within the capacity, and the pattern."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.array(sizes)
    for room in range(min(sizes), capacity + 1):
        fit = order <= room
        values = np.where(fit, best[np.maximum(room - order, 0)] + prices, -1.0)
        g = int(values.argmax())
        if values[g] > best[room - 1] + 1e-12:
            best[room], last[room] = values[g], g
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        pattern[last[room]] += 1
        room -= order[last[room]]
    return best[capacity], pattern


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, rounded down, for the fewest bins that hold need[g] items of sizes[g]."""
    basis = np.diag([float(capacity // s) for s in sizes])
    demand = np.array(need, float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = _knapsack(prices, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        amount, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    amount = np.maximum(np.linalg.solve(basis, demand), 0)
    left = demand.copy()
    out = []
    for k in np.argsort(-amount):
        pattern = basis[:, k]
        times = int(min([amount[k] + 1e-6, *(left[pattern > 0] / pattern[pattern > 0])]))
        if times:
            left -= times * pattern
            out.append((tuple(int(x) for x in pattern), times))
    return out


class _Bins:
    """Classes of equally full sequences, by room left: (first sequence, how many, used)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count, self.open = capacity, 0, defaultdict(list)

    def new(self, n: int) -> int:
        first, self.count = self.count, self.count + n
        return first

    def keep(self, first: int, n: int, used: int) -> None:
        if n and used < self.capacity:
            self.open[self.capacity - used].append((first, n, used))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> tuple[list[Run], int]:
    """(runs, sequences): where the pieces of every length go. Ranks of a length count from 0."""
    bins, runs = _Bins(capacity), []
    full = histogram.get(capacity, 0)
    if full:
        runs.append((capacity, 0, full, bins.new(full), 0))
    large = sorted((n for n in histogram if small * capacity < n < capacity and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        # groups of equal cardinality over the sorted lengths: (rounded size, [[length, rank, count], ...])
        share, grouped, held = -(-total // groups), [], 0
        for n in large:
            rank, left = 0, histogram[n]
            while left:
                if held == 0:
                    grouped.append((n, []))
                take = min(left, share - held)
                grouped[-1][1].append([n, rank, take])
                rank, left, held = rank + take, left - take, (held + take) % share
        sizes, need = [], []
        members: list[list[list[int]]] = []
        for size, part in grouped:
            if sizes and sizes[-1] == size:
                need[-1] += sum(x[2] for x in part)
                members[-1] += part
            else:
                sizes.append(size)
                need.append(sum(x[2] for x in part))
                members.append(list(part))
        for pattern, times in configurations(sizes, need, capacity):
            slots = [_take(members[g], times) for g, a in enumerate(pattern) for _ in range(a)]
            first, done = bins.new(times), 0
            while done < times:  # as long as no slot changes its length, the sequences are alike
                n = min(s[0][2] for s in slots)
                used = 0
                for s in slots:
                    length, rank, count = s[0]
                    runs.append((length, rank, n, first + done, used))
                    used += length
                    s[0] = [length, rank + n, count - n]
                    if not s[0][2]:
                        s.pop(0)
                bins.keep(first + done, n, used)
                done += n
        rest = [x for part in members for x in part]
    else:
        rest = []
    rest += [[n, 0, histogram[n]] for n in histogram if 0 < n <= small * capacity and histogram[n]]
    for length, rank, count in sorted(rest, reverse=True):
        _best_fit(bins, runs, length, rank, count)
    return runs, bins.count


def _take(part: list[list[int]], n: int) -> list[list[int]]:
    """Remove n pieces from the front of a group."""
    out = []
    while n:
        length, rank, count = part[0]
        m = min(n, count)
        out.append([length, rank, m])
        n -= m
        if m == count:
            part.pop(0)
        else:
            part[0] = [length, rank + m, count - m]
    return out


def _best_fit(bins: _Bins, runs: list[Run], length: int, rank: int, count: int) -> None:
    """Place count pieces one by one where they leave the least room, whole classes at a time."""
    while count:
        rooms = [r for r in bins.open if r >= length and bins.open[r]]
        if rooms:
            room = min(rooms)
            first, n, used = bins.open[room].pop()
        else:
            room, used = bins.capacity, 0
            n = -(-count // (room // length))
            first = bins.new(n)
        each = room // length
        filled = min(n, count // each)
        for k in range(each):
            if filled:
                runs.append((length, rank + k * filled, filled, first, used + k * length))
        bins.keep(first, filled, used + each * length)
        rank, count = rank + each * filled, count - each * filled
        if filled < n:  # fewer pieces than room: one sequence takes what is left, the others stay as they were
            for k in range(count):
                runs.append((length, rank + k, 1, first + filled, used + k * length))
            part = 1 if count else 0
            bins.keep(first + filled, part, used + count * length)
            bins.keep(first + filled + part, n - filled - part, used)
            count = 0


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches, "text", 16 << 20):
            ids, ends = enc.encode(b.column(1).to_pylist())
            out: list[tuple] = []
            start = 0
            for doc, end in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                own = np.append(ids[start:end], end_id).astype("<u4")
                start, n = end, len(own)
                edge = 0
                for piece in range(-(-n // capacity)):
                    stop = n % capacity or capacity if piece == 0 else edge + capacity
                    size = stop - edge
                    out.append((doc, piece, edge, size, zlib.crc32(own[edge:stop].tobytes()), task, int(seen[size])))
                    seen[size] += 1
                    edge = stop
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return run


def _placer(runs: list[Run], capacity: int):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    wide = np.int64(1) << np.int64(48)
    keys = table[:, 0] * wide + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            hit = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = table[hit, 3] + rank - table[hit, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(table[hit, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and end_id. Only longer ones than the capacity are cut, into pieces of full
    length; the first piece is shorter where the length is no multiple. Null or empty text is end_id alone.
    Repeated rows are packed each; rows with a null id keep it; an empty table gives no rows; other columns
    are not read. Every piece is placed once, sequences are filled from offset 0 without gaps.
    """
    pieces = staged(documents_of(docs, id_col, text_col).mapInArrow(_cut(tokenizer_path, capacity, end_id), _PIECE), "pieces")
    counts = pieces.groupBy("length", "task").agg((F.max("place") + 1).alias("n"))
    # a row per length, at most as many as the capacity
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity, groups)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(_placer(runs, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
