"""Hashed subword features and a bounded memory of word rows, shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from mapwise.llm.words import mixed


def subwords(words: list[str], sizes: tuple[int, ...], affixes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of every character n-gram of the words, written as ``<word>``.

    ``sizes`` are the n-grams taken everywhere, ``affixes`` those taken at the word's beginning and end only; the whole
    word is a feature too. Features are hashed into ``buckets``; those of a word come together.
    """
    text = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owners, found = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for size in range(1, max(*sizes, *affixes, 1) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        rolling = mixed(rolling[:n] * np.uint64(31) + codes[size - 1 :] + np.uint64(size))
        if size in sizes:
            inside = owner[:n] == owner[size - 1 :]
            owners.append(owner[:n][inside])
            found.append(rolling[inside])
        elif size in affixes:
            fits = np.flatnonzero(lengths >= size)
            for at in (begins[fits], ends[fits] - size):
                owners.append(fits)
                found.append(rolling[at])
    place = np.arange(len(codes)) - begins[owner]
    whole = np.add.reduceat(mixed(codes * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), begins) if len(words) else codes
    owners.append(np.arange(len(words)))
    found.append(mixed(whole + np.uint64(77)))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return owners[order], (found[order] % np.uint64(buckets)).astype(np.int64)


class WordRows(dict):
    """A row of numbers for each word met, made by ``rows`` for many new words at once; emptied when full."""

    def __init__(self, rows: Callable[[list], np.ndarray], most: int = 400_000):
        super().__init__()
        self.rows, self.most, self.table, self.used = rows, most, None, 0

    def places(self, words: list) -> np.ndarray:
        """Rows of ``table`` for the words, which stay valid until the next call."""
        if len(self) > self.most:
            self.clear()
            self.used = 0
        new = [w for w in set(words) if w not in self]
        if new:
            made = self.rows(new)
            need = self.used + len(made)
            if self.table is None or need > len(self.table):
                grown = np.zeros((max(need, 2 * self.used), made.shape[1]), made.dtype)
                if self.used:
                    grown[: self.used] = self.table[: self.used]
                self.table = grown
            self.table[self.used : need] = made
            self.update(zip(new, range(self.used, need), strict=True))
            self.used = need
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
