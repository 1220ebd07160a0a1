"""Tokenising Arrow text columns with a public tokenizer, word by word.

The tokenizer cuts at white space before it merges, so a text's ids are its words' ids in a row; each distinct word is
encoded once by the tokenizers library and then looked up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliant.llm.common import cuts, offsets_of, utf8

END = 2
#: Bytes of words and ids that a worker remembers, and bytes of text that it looks at together: a task's memory is a few
#: times their sum, whatever the words.
KNOWN_BYTES, SLICE = 16 << 20, 1 << 21
#: Words that the tokenizer gets in one call: its time for a word grows with the length of a call.
CALL_WORDS = 500

_BLANKS = bytes(32 if 9 <= i <= 13 else i for i in range(256))
_BLANKS_LOWER = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_coders: dict[str, WordCoder] = {}


def coder(path: str | None = None) -> WordCoder:
    """The worker's coder for a tokenizer file (default: word_bpe_49k.json of the public files)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    total = offsets_of(n)
    return np.repeat((first - total[:-1]).astype(np.int32), n) + np.arange(total[-1], dtype=np.int32)


class WordCoder:
    """A tokenizer with a memory of words: an Arrow array of them, where each one's ids begin, and the ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = pa.array([], pa.string())
        self.begin, self.pool = np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.uint32)

    def remembered(self) -> int:
        """Bytes of the memory."""
        return self.known.nbytes + self.begin.nbytes + self.pool.nbytes

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in a row, and their number for each word."""
        ids, counts = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(words), CALL_WORDS):
            some = words[lo : lo + CALL_WORDS]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = offsets_of([len(w) + 1 for w in some])
            place = np.fromiter((o[0] for o in got.offsets), dtype=np.int64, count=len(got.ids))
            ids.append(np.array(got.ids, dtype=np.uint32))
            counts.append(np.diff(np.searchsorted(place, begin)))
        return np.concatenate(ids), np.concatenate(counts)

    def _remember(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """As many of the words, in their order, as there is room for."""
        ends = np.cumsum(counts)
        size = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False)) + 4 * ends + 8 * np.arange(1, len(words) + 1)
        n = int(np.searchsorted(size, KNOWN_BYTES - self.remembered(), side="right"))
        if n:
            self.known = pa.concat_arrays([self.known, words[:n]])
            self.begin = np.concatenate([self.begin, self.begin[-1] + ends[:n].astype(np.int32)])
            self.pool = np.concatenate([self.pool, ids[: ends[n - 1]]])

    def _of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct words, where each word's begin, and their number for each."""
        slots = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        old, new = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
        fresh = words.take(pa.array(new))
        ids, counts = self._encoded(fresh.to_pylist())
        first, n = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        n[new], n[old] = counts, self.begin[slots[old] + 1] - self.begin[slots[old]]
        there = self.pool[_runs(self.begin[slots[old]], n[old])]
        first[old], first[new] = offsets_of(n[old])[:-1], len(there) + offsets_of(counts)[:-1]
        if len(new):
            self._remember(fresh, ids, counts)
        return np.concatenate([there, ids]), first, n

    def _slice(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts that end at the given places of data, and their number for each text."""
        plain = b"<|" not in data  # the strings of special tokens count only as they are written
        data = data.translate(_BLANKS_LOWER if plain else _BLANKS)
        texts = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        if plain:  # the pattern of the tokenizer cuts here too
            texts = pc.replace_substring_regex(texts, r"([a-z])([.,])", r"\1 \2")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        ids, first, n = self._of(words.dictionary)
        place = words.indices.to_numpy(zero_copy_only=False)
        n = n[place]
        return ids[_runs(first[place], n)], np.diff(offsets_of(n)[split.offsets.to_numpy()])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a text column in a row, and their number for each text; null is empty."""
        texts, pieces, owner = utf8(column), [], []
        for i, t in enumerate(texts):
            for lo, hi in cuts(t, SLICE):
                pieces.append(t[lo:hi] if hi - lo < len(t) else t)
                owner.append(i)
        ids, counts, at = [], [], 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= SLICE):
                size += len(pieces[end])
                end += 1
            got, n = self._slice(b"".join(pieces[at:end]), offsets_of([len(p) for p in pieces[at:end]]))
            ids.append(got)
            counts.append(n)
            at = end
        if not texts:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        return np.concatenate(ids), np.bincount(owner, np.concatenate(counts), len(texts)).astype(np.int64)

    def encode_ended(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with END after each text."""
        ids, n = self.encode(column)
        out = np.full(len(ids) + len(n), END, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(n + 1) - 1] = False
        out[keep] = ids
        return out, n + 1
