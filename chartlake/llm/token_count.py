"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton finds every vocabulary piece that ends at a character; dynamic programming keeps,
for every end, only the best score and its number of pieces. Ties follow the tokenizer: a later candidate must
be strictly better, and candidates come from the earliest start on, so of equal scores the longest last piece
wins; a character that is no piece itself costs the lowest score less ten and is counted as its bytes. The
pre-tokenizer cuts at spaces, so each distinct word of a batch is counted once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chartlake.llm.common import documents_of, slices

#: Fixed values of unigram tokenizers: the mark of a word's start and the penalty of an unknown character.
MARK, UNKNOWN_PENALTY = "▁", 10.0
_KEPT, _NONE = 500_000, float("-inf")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.IdToPiece(i), model.GetScore(i)) for i in range(model.GetPieceSize())]


class _Kept(dict):
    """Counts of the words met so far, each with a mark before it."""

    def __init__(self, counter: PieceCounter) -> None:
        self.counter = counter

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = hit = self.counter.word(MARK + word)
        return hit


class PieceCounter:
    """Counts and best scores of words; byte_fallback counts an unknown character as its bytes, else a run of them is one piece."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.kept = _Kept(self)

    def word(self, w: str) -> tuple[int, float]:
        """(pieces, best score) of one pre-token."""
        n, unknown = len(w), self.unknown
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, best, pieces, single = 1, _NONE, 0, False
        # the automaton gives the ends in order and at each end the longest piece first
        for last, hit in chain(self.automaton.iter(w), ((n, None),)):
            while at <= last:  # every piece that ends at `at` has been seen
                if not single and score[at - 1] + unknown > best:
                    best, loose[at] = score[at - 1] + unknown, True
                    pieces = count[at - 1] + (len(w[at - 1].encode()) if self.byte_fallback else not loose[at - 1])
                score[at], count[at] = best, pieces
                at, best, single = at + 1, _NONE, False
            if hit:
                size, own = hit
                total = score[at - size] + own
                if total > best:
                    best, pieces = total, count[at - size] + 1
                if size == 1:
                    single = True
        return count[n], score[n]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, best scores) of whole texts."""
        counts, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not t:
                continue
            words = t.replace(MARK, " ").split(" ")
            n, total = 0, 0.0
            for pieces, score in map(self.kept.__getitem__, words if words[0] else words[1:]):
                n += pieces
                total += score
            counts[i], scores[i] = n, total
        return counts, scores


@functools.lru_cache(maxsize=2)
def counter(path: str, byte_fallback: bool) -> PieceCounter:
    return PieceCounter(vocabulary(path), byte_fallback)


def count_tokens(docs: DataFrame, vocabulary_path: str, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, score (of the best segmentation).

    Null or empty text has 0 tokens and score 0. Repeated rows are counted each, a null id is kept, an empty
    table gives no rows; other columns are not read. Whole texts are counted, in bounded slices of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary_path, byte_fallback)
        for b in slices(batches):
            n, s = c.batch(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(s)], names=["doc_id", "n_tokens", "score"])

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, score double")
