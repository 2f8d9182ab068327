"""Near-duplicate classes by order MinHash.

A document is a sequence of k-mers (five words each), each labelled with how often it has occurred before. For
every band the few k-mers with the smallest hashes are sampled and kept in text order; documents whose samples
agree, order included, are candidates, which is far likelier after small edits than for texts that only share
k-mers. Candidates are verified by a banded alignment of their words: aligned words over the words of the longer text, at
least 0.8. A link is a pair of texts that share a bucket and align well enough; classes are components of links.

Exact copies are folded first. Small buckets are compared in all pairs. In larger ones every member is compared with the
most central member (the one with most candidates) of two of its buckets, then those still apart with the most central one of another
component. At last every member outside its bucket's largest component is joined with texts of other components on
its rarest words, of which any two texts with a link share one (a prefix filter); pairs without a common bucket are
dropped where they meet: no link is lost or added, and no bucket's members are paired with one another. As members of one component
need no comparison, work follows the bucket's size.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import documents_of, mix, reshuffled, scratch, slices, staged

K, BANDS, SIMILARITY = 5, 60, 0.8
#: Buckets up to this size are compared in all pairs, larger ones with their most central members.
SMALL = 8
#: Counters of how often words occur, for the order of rare words.
COUNTERS = 1 << 14
#: Words of texts that meet in one block; the blocks grow in number with the words.
BLOCK = 200_000
#: Bits of a text's set of words: bits that only one of two texts has bound how many words they can have in common.
BITS = 1024
#: A central text is sent once for so many texts that are compared with it.
PART = 256
#: Sampled k-mers per band, for texts of up to so many words.
#: They are as few as find pairs from the threshold on: of 0.8 similar texts a fifth of the five-word k-mers is common.
LEVELS = ((64, 1), (1 << 62, 2))
#: Ids that a task holds while it turns its edges into stars.
HELD = 250_000
_P = np.uint64(0x9E3779B97F4A7C15)
_KEPT = 1_000_000
_SKETCH = "doc_id long, copy binary, text_md5 binary, n int, words array<int>, buckets array<long>"


class WordHashes(dict):
    """Word -> 64-bit hash of its letters and digits in lower case; of the word itself if it has none."""

    def __missing__(self, w: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        low = w.lower()
        self[w] = h = xxhash.xxh64_intdigest(low if low.isalnum() else "".join(filter(str.isalnum, low)) or low)
        return h


def word_hashes(text: str, words: WordHashes) -> np.ndarray:
    w = text.split()
    return np.fromiter(map(words.__getitem__, w), np.uint64, len(w))


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of k words in text order; of all words, if they are fewer; none for a text without words."""
    if not len(h):
        return h
    size = min(k, len(h))
    last = len(h) - size + 1
    out = np.full(last, np.uint64(size))
    for j in range(size):
        out = (out + h[j : last + j]) * _P
        out ^= out >> np.uint64(29)
    return mix(out)


def labelled(h: np.ndarray) -> np.ndarray:
    """First occurrences as they are, later ones mixed with their occurrence number, so that all are distinct."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return h
    at = np.arange(len(h))
    starts = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), at, 0))
    again = (at - starts).astype(np.uint64)
    out = np.empty_like(h)
    out[order] = np.where(again > 0, mix(s + again * _P), s)
    return out


@functools.lru_cache(maxsize=4)
def _factors(bands: int) -> np.ndarray:
    return (mix(np.arange(1, bands + 1, dtype=np.uint64) * _P) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def level_of(n: float) -> int:
    return next(size for most, size in LEVELS if n <= most)


def bucket_keys(h: np.ndarray, bands: int = BANDS, similarity: float = SIMILARITY) -> np.ndarray:
    """Bucket keys of a text's word hashes, for the sample sizes of all texts that can be similar to it."""
    x = labelled(kmers(h))
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    values = (x >> np.uint64(32)).astype(np.uint32)[None, :] * _factors(bands)[:, None]  # x is mixed already, so a product is a hash
    order = _least(values, min(n, max(m for _, m in LEVELS)))
    out = []
    for size in sorted({level_of(math.floor(len(h) * similarity)), level_of(len(h)), level_of(len(h) / similarity)}):
        take = min(size, n)
        at = np.sort(order[:, :take], axis=1)
        keys = np.arange(bands, dtype=np.uint64) * np.uint64(1000) + np.uint64(size)
        for j in range(take):
            keys = (keys + x[at[:, j]]) * _P
            keys ^= keys >> np.uint64(31)
        out.append(mix(keys))
    return np.concatenate(out).astype(np.int64)


def _least(values: np.ndarray, take: int) -> np.ndarray:
    """Per row the places of the `take` smallest values, the least first; values are used up."""
    rows, found = np.arange(len(values)), []
    for _ in range(take):
        found.append(values.argmin(axis=1))
        values[rows, found[-1]] = np.iinfo(values.dtype).max
    return np.stack(found, axis=1)


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence among alignments that stay within `band` of the diagonal; bit-parallel along the band."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    common = lo + len(a) - ea
    a, b = a[lo:ea], b[lo:eb]
    if not a or not b:
        return common
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    full, top = (1 << (2 * band + 1)) - 1, 1 << (2 * band)
    row, found = full, 0  # bit t stands for place j - band + t of a; 0 where the length rises
    for j, x in enumerate(b):
        if j:
            found += not row & 1
            row = row >> 1 | top
        mask = 0
        for i in places.get(x, ()):
            t = i - j + band
            if 0 <= t <= 2 * band:
                mask |= 1 << t
        if mask:
            rise = row & mask
            row = ((row + rise) | (row - rise)) & full
    return common + found + (2 * band + 1) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, labels: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Aligned words over the words of the longer text; 0 where it must stay below `least`. labels: the labelled words, where known."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    need = math.ceil(least * longer - 1e-9)
    if min(len(a), len(b)) < need or len(np.intersect1d(*(labels or (labelled(a), labelled(b))), assume_unique=True)) < need:
        return 0.0
    return banded_lcs(a.tolist(), b.tolist(), longer - need) / longer


def short_hashes(h: np.ndarray) -> np.ndarray:
    """Words as they are kept for the alignment: four bytes of their hash."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _sketch(bands: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches):
            copies, sums, sizes, words, keys = [], [], [], [], []
            for t in b.column("text").to_pylist():
                h = word_hashes(t, known)
                copies.append(xxhash.xxh3_128_digest(h.tobytes()))
                sums.append(hashlib.md5(t.encode(), usedforsecurity=False).digest())
                sizes.append(len(h))
                words.append(short_hashes(h).view(np.int32))
                keys.append(bucket_keys(h, bands, least))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (words, keys)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(copies, pa.binary()), pa.array(sums, pa.binary()), pa.array(sizes, pa.int32()), *lists], names=["doc_id", "copy", "text_md5", "n", "words", "buckets"])

    return run


def _parts(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _wide(words: np.ndarray) -> np.ndarray:
    return words.view(np.uint32).astype(np.uint64)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for b in batches:
            out = []
            for kind, i, words in zip(b.column("kind").to_pylist(), b.column("id").to_pylist(), _parts(b.column("words")), strict=True):
                words = _wide(words)
                if kind == 0:
                    hub = i, words, labelled(words)
                elif similarity(hub[1], words, least, (hub[2], labelled(words))) >= least:
                    out.append((max(i, hub[0]), min(i, hub[0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [labelled(_wide(w)).astype(np.int64) for w in _parts(b.column("words"))]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        kept = ("id", "component", "outside", "buckets")
        yield pa.RecordBatch.from_arrays([*map(b.column, kept), lists], names=[*kept, "grams"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(counter, words) of all of a task's words."""
    n = np.zeros(COUNTERS, np.int64)
    for b in batches:
        n += np.bincount(b.column("grams").flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["slot", "n"])


def marks_of(grams: np.ndarray) -> bytes:
    """The bit set of a text's labelled words. These are four bytes but for repeated ones, so that they are mixed before their upper bits are used."""
    bits = np.zeros(BITS, bool)
    bits[(mix(grams.view(np.uint64)) >> np.uint64(40)) % np.uint64(BITS)] = True
    return np.packbits(bits).tobytes()


def _prefixes(often: np.ndarray, blocks: int, least: float):
    """Per text and block of words: the rare words of the text that lie in the block, with their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for b in batches:
            out: list[tuple] = []
            for i, component, outside, g, buckets in zip(*(b.column(c).to_pylist() for c in ("id", "component", "outside")), _parts(b.column("grams")), _parts(b.column("buckets")), strict=True):
                rare = g[np.lexsort((g, often[g & (COUNTERS - 1)]))[: len(g) - math.ceil(len(g) * least - 1e-9) + 1]]
                marks = marks_of(g)
                block = mix(rare.view(np.uint64)) % np.uint64(blocks)
                for k in np.unique(block):
                    at = np.flatnonzero(block == k)
                    out.append((int(k), i, component, outside, buckets, len(g), marks, rare[at], (at + 1).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "id", "component", "outside", "buckets", "n", "marks", "grams", "ranks"])

    return run


def _meet(least: float):
    """Of rows in the order of their block, outsiders first: (id, others), the outsiders that each text shares a bucket and can have a link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}
        for b in batches:
            ids, lists = [], []
            for block, i, component, outside, buckets, n, marks, grams, ranks in zip(*(b.column(c).to_pylist() for c in ("block", "id", "component", "outside", "buckets", "n", "marks", "grams", "ranks")), strict=True):
                own, mine = int.from_bytes(marks), frozenset(buckets)
                if block != current:
                    current, held = block, {}
                hits = set()
                for g, rank in zip(grams, ranks, strict=True):
                    for x, xc, xn, xr, theirs, others in held.get(g, ()):
                        if xc == component or x in hits or mine.isdisjoint(others):
                            continue
                        need = math.ceil(max(n, xn) * least - 1e-9)
                        if min(n, xn) >= need and 1 + min(n - rank, xn - xr) >= need and (own & ~theirs).bit_count() <= n - need and (theirs & ~own).bit_count() <= xn - need:
                            hits.add(x)
                    if outside:
                        held.setdefault(g, []).append((i, component, n, rank, own, mine))
                if hits:
                    ids.append(i)
                    lists.append(sorted(hits))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "others"])

    return run


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, other) of rows (id, others) in the order of ids: of one id each other once, as far as a bounded set holds."""
    current, held = None, set()
    for b in batches:
        out: list[tuple[int, int]] = []
        for i, others in zip(b.column("id").to_pylist(), _parts(b.column("others")), strict=True):
            if i != current or len(held) > _KEPT:
                current, held = i, set()
            new = set(others.tolist()) - held
            held |= new
            out += [(i, x) for x in new]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "other"])


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The links (a, b) among candidate pairs (a, b, hub); hub is one of a and b. texts: id, words.

    A hub's words are sent once for each of its parts, then follow the texts that it is compared with.
    """
    # a hub of many texts is sent to several tasks; ids of candidates and shared buckets grow with the corpus: merge joins at every size, never a broadcast
    many = reshuffled(pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    dealt = staged(pairs.join(many.hint("merge"), "hub").select("hub", other.alias("other"), F.pmod(F.xxhash64(other), F.col("parts")).cast("int").alias("part")), "dealt")
    # both sides join the texts on the same key, so that their words are shuffled once
    sent = texts.hint("merge")
    members = dealt.join(sent, F.col("other") == F.col("id")).select("hub", "part", F.lit(1).alias("kind"), *texts.columns)
    hubs = dealt.select("hub", "part").distinct().join(sent, F.col("hub") == F.col("id")).select("hub", "part", F.lit(0).alias("kind"), *texts.columns)
    return hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind").drop("hub", "part").mapInArrow(_verify(least), "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """verified, without the words that it staged."""
    with scratch() as keep:
        return keep(verified(pairs, texts, least))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (u, v) the stars that connect the same ids, each around its least id; the ids held are bounded."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    def stars() -> pa.RecordBatch:
        found = [(x, root(x)) for x in list(above)]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            if (x := root(u)) != (y := root(v)):
                above[max(x, y)] = min(x, y)
        if len(above) > HELD:
            yield stars()
            above.clear()
    if above:
        yield stars()


def _all_stars(links: DataFrame) -> bool:
    """Whether every id has one lower neighbour at most, and none if it is a lower neighbour itself."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("lower")), F.struct(F.col("v").alias("id"), F.lit(None).cast("long").alias("lower")))).alias("e")).select("e.*")
    seen = ends.groupBy("id").agg(F.min("lower").alias("least"), F.max("lower").alias("most"), F.max(F.col("lower").isNull()).alias("centre"))
    return not seen.where("least <> most OR centre AND least IS NOT NULL").agg(F.count("*")).head()[0]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b): the least id that it is linked to.

    Every task first replaces its own edges by stars. Then large-star and small-star steps alternate, each a minimum per key and a join,
    until there are only stars left, which one count tells; no neighbour list is collected. The minima are dealt anew before the
    join, so that the skew join can split an id of many edges.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    links = staged(links.mapInArrow(_contracted, "u long, v long"), "links")
    while not _all_stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(reshuffled(least).hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(reshuffled(lower).hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = staged(small.where("u <> v").distinct(), "links")
    every = links.union(links.select("v", "v"))  # the least ids themselves, too
    return every.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def _long_enough(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * least


def _all_pairs(shared: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a above b, within buckets of bounded size."""
    l, r = shared.alias("l"), shared.alias("r")
    return l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.id") > F.col("r.id")) & _long_enough("l.n", "r.n", least)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.id").alias("hub"), F.lit(1).alias("rank"))


def _to_leader(shared: DataFrame, least: float, apart: bool = False) -> DataFrame:
    """Pairs of every member with the most central ones of two of its buckets: of the one with the most central leader, and of the smallest.

    What the other buckets have is left to the later steps. With apart, all buckets count, the leader is the most central member outside the component of the bucket's first leader, and
    is paired with the members of other components than its own.
    """
    order = F.struct(F.col("degree").alias("d"), (-F.col("id")).alias("i"))
    cols = ["id", "n", "component" if apart else "degree"]
    pick = lambda df: reshuffled(df.groupBy("bucket").agg(F.max_by(F.struct(*cols), order).alias("lead"))).hint("merge")
    lead = pick(shared)
    if apart:
        others = shared.join(lead.select("bucket", F.col("lead.component").alias("first")), "bucket").where("component <> first")
        lead = pick(others)
    found = shared.join(lead, "bucket").where((F.col("id") != F.col("lead.id")) & _long_enough("n", "lead.n", least))
    if apart:
        found = found.where(F.col("component") != F.col("lead.component"))
    else:
        two = F.array_distinct(F.array(F.max_by("lead", F.struct("lead.degree", -F.col("lead.id"))), F.min_by("lead", F.struct("c", "bucket"))))
        found = found.groupBy("id").agg(two.alias("two"), F.max("c").alias("c")).select("id", "c", F.explode("two").alias("lead"))
    return found.select(F.greatest("id", "lead.id").alias("a"), F.least("id", "lead.id").alias("b"), F.col("lead.id").alias("hub"), F.col("c").cast("int").alias("rank"))


def _outsiders(placed: DataFrame, least: float, texts: DataFrame) -> DataFrame:
    """Pairs of every member outside its bucket's largest component with texts of other components that can have a link with it.

    They meet by rare words in place of buckets, so that no bucket's members are paired with one another. Of n labelled words in one
    order for all texts, two texts with a link share one of the first n - least * n + 1; the words left after it must suffice.
    Rare words come first, by counters that several words may share: any order that is one for all texts will do.
    Texts carry their buckets that hold several components, so that only pairs with a common one leave the tasks: the pairs that
    common words alone would give grow with the square of the corpus.
    """
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("members"))
    most = parts.groupBy("bucket").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.count("*").alias("k")).where("k > 1")
    split = placed.join(reshuffled(most.select("bucket", "largest")).hint("merge"), "bucket").groupBy("id").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("largest")).alias("outside"), F.collect_list("bucket").alias("buckets"))
    own = texts.select("id", "words").join(split.hint("merge"), "id")
    grams = staged(own.mapInArrow(_labels, "id long, component long, outside boolean, buckets array<long>, grams array<long>"), "grams")
    counts = grams.select("grams").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, np.int64)
    often[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    blocks = max(32, int(often.sum()) // BLOCK)
    first = grams.mapInArrow(_prefixes(often, blocks, least), "block long, id long, component long, outside boolean, buckets array<long>, n int, marks binary, grams array<long>, ranks array<int>")
    met = first.repartition("block").sortWithinPartitions("block", F.desc("outside")).mapInArrow(_meet(least), "id long, others array<long>")
    # a pair with many common words is one pair before it is a row
    pairs = met.repartition("id").sortWithinPartitions("id").mapInArrow(_distinct_pairs, "id long, other long")
    return pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"), F.col("other").alias("hub"), F.lit(1).alias("rank"))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) after more links (a, b), which join components, not texts."""
    ends = [label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    named = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    late = staged(components(named).select(F.col("id").alias("part"), F.col("component").alias("joined")), "late")
    old = label.join(late.hint("merge"), label["component"] == late["part"], "left").select("id", F.coalesce("joined", "component").alias("component"))
    alone = late.select(F.col("part").alias("id"), F.col("joined").alias("component"))
    return staged(old.unionByName(alone).distinct(), "components")


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair once, with the hub of the largest bucket."""
    return pairs.groupBy("a", "b").agg(F.max(F.struct("rank", "hub")).alias("m")).select("a", "b", "m.hub")


def _classified(docs: DataFrame, id_col: str, text_col: str, bands: int, least: float, small: int) -> DataFrame:
    """classify, with the text's md5."""
    df = documents_of(docs, id_col, text_col)
    # every row gets a number of its own here, so that an id with several texts is no trouble
    sketches = staged(df.mapInArrow(_sketch(bands, least), _SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = sketches.where("doc_id is not null")
    copies = staged(known.groupBy("copy").agg(F.min("row").alias("id"), F.min(F.struct("doc_id", "text_md5")).alias("lead")), "copies")
    texts = known.select(F.col("row").alias("id"), "n", "words", "buckets")
    with scratch() as keep:
        reps = staged(texts.drop("words").join(copies.select("id").hint("merge"), "id"), "copies")
        members = reps.select("id", "n", F.explode("buckets").alias("bucket"))
        sizes = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
        shared = staged(members.join(reshuffled(sizes).hint("merge"), "bucket"), "shared")
        # how many candidates a text has says how central it is among its copies
        central = shared.groupBy("id").agg(F.sum("c").alias("degree"))
        shared = keep(shared.join(central.hint("merge"), "id"))
    words = texts.select("id", "words")
    pairs = staged(_once(_all_pairs(shared.where(F.col("c") <= small), least).union(_to_leader(shared.where(F.col("c") > small), least))), "pairs")
    label = staged(components(_links(pairs, words, least)), "components")
    large = shared.where(F.col("c") > small)
    for choose in (functools.partial(_to_leader, apart=True), functools.partial(_outsiders, texts=words)):
        with scratch() as keep:
            placed = staged(large.join(label.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
            again = keep(_once(choose(placed, least)).join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.unionByName(again)
        # no new pairs, or no links among them, join nothing
        if not again.isEmpty() and not (found := _links(again, words, least)).isEmpty():
            label = _merged(label, found)
    placed = staged(copies.join(label.hint("merge"), "id", "left").select("copy", "lead", F.coalesce("component", "id").alias("component")), "placed")
    classes = placed.groupBy("component").agg(F.min("lead").alias("first"))
    named = placed.join(reshuffled(classes).hint("merge"), "component").select("copy", F.col("lead.doc_id").alias("copy_id"), "first")
    own = F.struct("doc_id", "text_md5")
    out = known.select("doc_id", "copy", "text_md5").join(named.hint("merge"), "copy").select("doc_id", "text_md5", "copy_id", F.col("first.doc_id").alias("class_id"), (own == F.col("first")).alias("kept"))
    none = F.lit(None).cast("long")
    return out.unionByName(sketches.where("doc_id is null").select("doc_id", "text_md5", none.alias("copy_id"), none.alias("class_id"), F.lit(True).alias("kept")))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, least: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, copy_id (least id with the same words), class_id (least id of its class), kept.

    Words are compared by their letters and digits in lower case. Null text counts as empty; texts without
    words are copies of one another. Repeated rows get the same class; of an id with several texts each text has its
    class, and one of them (that with the least md5) is kept where they share it. Rows with a null id are left out of
    comparisons and are a class of their own (all ids null, kept); an empty table gives no rows; other columns, whatever
    their names, are not read. Every text is read whole, however long. Tables made on the way are removed at the end.
    """
    with scratch() as keep:
        return keep(_classified(docs, id_col, text_col, bands, least, small).drop("text_md5"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns.

    Of rows repeated with one id and text one stays; an id with several texts loses none that are no copies of one another.
    Rows without an id stay. Null text counts as empty; an empty table gives no rows; other columns are kept as they are.
    """
    with scratch() as keep:
        ids = keep(_classified(docs, "doc_id", "text", BANDS, SIMILARITY, SMALL).where("kept and doc_id is not null").select(F.col("doc_id").alias("__keep"), F.col("text_md5").alias("__md5")).distinct())
    rows = docs.where("doc_id is not null").withColumn("__own", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    stay = rows.join(ids.hint("merge"), (rows["doc_id"] == ids["__keep"]) & (rows["__own"] == ids["__md5"]), "left_semi").dropDuplicates(["doc_id", "__own"]).drop("__own")
    return stay.unionByName(docs.where(docs["doc_id"].isNull()))
