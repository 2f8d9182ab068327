"""Many terms searched in many texts by Aho-Corasick automata: one pass over a text, whatever the number of terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.operators.scan import running
from chartlake.sources.staging import staged

#: Bytes of terms that one automaton holds (some 60 bytes of memory each); more are dealt in blocks, and the texts are read once a block.
BLOCK_BYTES = 1 << 20
#: Added to a term's bytes: what its node and row cost besides.
TERM_COST = 32


def _blocks(terms: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(folded, term) lists of at most block_bytes each (a longer term has a block for itself), one in the driver at a time."""
    sized = terms.withColumn("__size", (F.octet_length("__key") + F.octet_length("__term") + TERM_COST).cast("long"))
    total = sized.agg(F.sum("__size")).head()[0] or 0
    if total <= block_bytes:
        yield [tuple(r) for r in sized.select("__key", "__term").collect()]
        return
    # rows whose sum starts in one stretch of half a block: at most half a block and the last one's own bytes
    half = block_bytes // 2
    dealt = staged(running(sized, {"__before": "__size"}, ["__key", "__term"], inclusive=False).withColumn("__block", F.floor(F.col("__before") / half)), "terms")
    for (block,) in dealt.select("__block").distinct().orderBy("__block").toLocalIterator():
        yield [tuple(r) for r in dealt.where(F.col("__block") == block).select("__key", "__term").collect()]


def _search(df: DataFrame, block: list[tuple[str, str]], text: str, fold: bool) -> DataFrame:
    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        by_key: dict[str, list[str]] = {}
        for key, term in block:
            by_key.setdefault(key, []).append(term)
        automaton = ahocorasick.Automaton()
        for key, same in by_key.items():
            automaton.add_word(key, (key, same))
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([[term for same in {k: s for _, (k, s) in automaton.iter(t)}.values() for term in same] if t else [] for t in texts], dtype=object)

    seen = F.lower(text) if fold else F.col(text)
    return df.withColumn("__term", F.explode(found(seen)))


def find_terms(texts: DataFrame, terms: DataFrame, by: list[str], text: str = "text", term: str = "term", fold: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``by`` and the term, for each row of texts and each distinct term that it contains.

    With fold both sides are lower-cased first; the term comes back as it was given. Null and empty texts contain nothing,
    null and empty terms are in no text. Repeated terms count once, repeated rows of texts each for themselves; overlapping and nested
    terms are all found. Whole texts are searched, of any length. Terms are bounded per automaton: beyond block_bytes they are
    dealt in blocks, each searched in all texts and its hits staged, so neither a task nor the driver holds more than a block.
    """
    key = F.lower(term) if fold else F.col(term)
    wanted = terms.select(key.alias("__key"), F.col(term).alias("__term")).where("__key <> ''").distinct()
    df = texts.select(*by, F.col(text).alias("__text"))
    out, blocks = None, _blocks(wanted, block_bytes)
    block = next(blocks, [])
    while True:
        hits = _search(df, block, "__text", fold).select(*by, F.col("__term").alias(term)) if block else df.select(*by, F.lit("").alias(term)).where("false")
        following = next(blocks, None)
        if following is None and out is None:
            return hits
        hits = staged(hits, "hits")
        out = hits if out is None else out.unionAll(hits)
        if following is None:
            return out
        block = following
