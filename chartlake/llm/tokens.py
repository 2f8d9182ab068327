"""Byte-level BPE ids of whole texts, a batch at a time.

Texts are cut at single spaces between non-spaces, where the tokenizer always cuts too; each distinct piece
of a batch is encoded once and the ids are gathered back. Texts in which a space meets other white space are
encoded as they are. Strings of added tokens get their own ids. The result equals that of the ``tokenizers`` library on the same vocabulary file.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def _byte_of() -> dict[str, int]:
    """Vocabulary files write printable bytes as themselves and the others as the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


class ByteBpe:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space with them are not supported")
        special = {t["content"]: t["id"] for t in added if t["content"]}
        self._special = special
        self._split = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._one = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self._size[i] = len(t)

    def _whole(self, t: str) -> list[int]:
        """Ids of one text; the strings of added tokens get their ids, as the library gives them."""
        if self._split is None or not self._split.search(t):
            return self._one(t)
        return [i for part in self._split.split(t) if part for i in ([self._special[part]] if part in self._special else self._one(part))]

    def _plain(self, t: str) -> bool:
        """Whether every space stands alone between two characters that are no white space, and no added token occurs."""
        if any(x in t for x in self._special) or not t or t[0].isspace() or t[-1].isspace() or "  " in t:
            return False
        return not any(c in t and (f"{c} " in t or f" {c}" in t) for c in _SPACES)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, int32; ends of the texts in it)."""
        plain = np.array([self._plain(t) for t in texts], bool)
        whole = pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string())
        code, vocab, first = self._words(whole)
        # the distinct words that begin with a space are encoded as one text, the others (first words) one by one
        spaced = pc.starts_with(vocab, " ").to_numpy(zero_copy_only=False)
        _, offsets, data = vocab.filter(pa.array(spaced)).buffers()
        joined = data.to_pybytes()[: np.frombuffer(offsets, np.int64)[spaced.sum()]].decode() if data else ""
        ids = np.array(self._one(joined), np.int64)
        ends_b = np.cumsum(pc.binary_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64)[spaced])
        stop = np.zeros(len(vocab), np.int64)
        stop[spaced] = np.searchsorted(np.cumsum(self._size[ids]), ends_b) + 1
        start = np.zeros(len(vocab), np.int64)
        start[spaced] = np.concatenate(([0], stop[spaced][:-1])) if spaced.any() else 0
        # what stands first in a text, or the whole of a text that is not plain
        firsts = [self._one(t[: t.index(" ")]) if p and " " in t else self._whole(t) for t, p in zip(texts, plain, strict=True)]
        sizes = np.array([len(x) for x in firsts], np.int64)
        pool = np.concatenate([ids, np.fromiter((i for x in firsts for i in x), np.int64, int(sizes.sum()))])
        begin, count = start[code], (stop - start)[code]
        begin[first] = len(ids) + np.cumsum(sizes) - sizes
        count[first] = sizes
        ends = np.cumsum(count)
        flat = np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        last = np.concatenate([first[1:], [len(code)]]) - 1 if len(first) else first
        return pool[flat].astype(np.int32), ends[last]

    @staticmethod
    def _words(whole: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(code of every word, distinct words, place of each text's first word); a word holds the space before it."""
        _, offsets, data = whole.buffers()
        edges = np.frombuffer(offsets, np.int64)[: len(whole) + 1]
        raw = np.frombuffer(data, np.uint8)[: edges[-1]] if data else np.zeros(0, np.uint8)
        # texts begin with no space, so no cut falls on an edge
        cuts = np.sort(np.concatenate([edges, np.flatnonzero(raw == 32)]), kind="stable")
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), data)
        coded = words.dictionary_encode()
        # an empty text's edge equals the next one's: the k-th edge stands after k edges and the spaces before it
        first = np.arange(len(whole)) + np.searchsorted(np.flatnonzero(raw == 32), edges[:-1])
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first
