"""Words of whole texts as arrays: what the operators' tasks share.

A word is a run of ``[^\\x20\\x09-\\x0D]``, which is exactly how ``bytes.split()`` cuts UTF-8.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

#: The same words for Spark SQL and DuckDB patterns.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task turns into Python words at a time.
SLICE_BYTES = 6_000_000


class WordHashes(dict):
    """64-bit hash of a word, kept for the words met before; emptied when full, so that memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts as UTF-8, each of about ``most`` bytes or of one text; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    begin, size = 0, 0
    lengths = pa.compute.binary_length(texts).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield begin, texts.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, texts.slice(begin).to_pylist()


def hashed_words(texts: Iterable[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and the number of words of each text."""
    parts, counts = [], []
    look = cache.__getitem__
    for text in texts:
        words = text.split()
        counts.append(len(words))
        parts.append(np.fromiter(map(look, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that start at each position; the last ``size`` - 1 positions are left out."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = mixed(total * np.uint64(3) + words[j : j + n] + np.uint64(1))
    return total


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each run begins in the arrays laid one after the other."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, laid one after the other, and the size of each set.

    A text of fewer than ``size`` words has its whole sequence as its one shingle; one without words has none.
    """
    found, sizes = [], []
    every = grams(words, size)
    for start, n in zip(starts_of(counts).tolist(), counts.tolist(), strict=True):
        if n >= size:
            own = np.unique(every[start : start + n - size + 1])
        elif n:
            own = mixed(grams(words[start : start + n], n) + np.uint64(n))
        else:
            own = np.zeros(0, np.uint64)
        found.append(own)
        sizes.append(len(own))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


#: What this Python worker keeps over its tasks: of one kind at a time, since workers outlive the stages.
_KEPT: dict[tuple, Any] = {}


def kept_by_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept by this Python worker for its next tasks with this key; what it kept for another one goes."""
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` in a Python worker that first drops what other work kept, and gives its own memory back at the end.

    A stage with two such steps has two workers for each task, and all of them take turns in later stages, so
    what each keeps adds up in an executor.
    """

    @wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        _KEPT.clear()
        release_memory()
        yield from run(batches)
        release_memory()

    return tidy


def release_memory() -> None:
    """Give back to the system what earlier work of this Python worker has freed; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
