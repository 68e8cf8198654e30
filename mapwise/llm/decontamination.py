"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mapwise.llm.words import WordHashes, mixed, slices, tidied

#: Word edits allowed per word of an item.
ERROR_SHARE = 0.15
#: Words of a piece that are looked up; shorter pieces are looked up whole.
SEED_WORDS = 5
#: Benchmark bytes that one pass over the documents holds in each task.
INDEX_BYTES = 16_000_000
_NOISE = re.compile(rb"[^\x09-\x0d a-z0-9\x80-\xff]+")


def plain_words(text: bytes) -> list[bytes]:
    """Words with A-Z lowered, without ASCII marks; words of marks alone are left out."""
    return _NOISE.sub(b"", text.lower()).split()


def myers(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where that part ends (the first such place).

    Bit-parallel: one machine-independent integer holds a whole column of the distance table.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict = defaultdict(int)
    for i, symbol in enumerate(pattern):
        masks[symbol] |= 1 << i
    every, high = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = every, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text, 1):
        same = masks.get(symbol, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        grow, shrink = down | (every & ~(diagonal | up)), up & diagonal
        if grow & high:
            distance += 1
        if shrink & high:
            distance -= 1
        grow, shrink = (grow << 1) & every, (shrink << 1) & every  # a part may begin anywhere
        up, down = shrink | (every & ~((same | down) | grow)), grow & (same | down)
        if distance < best:
            best, end = distance, j
    return best, end


@dataclass
class Index:
    """Items as words, and where each piece's seed is found in which item: (item, offset, budget)."""

    items: list[tuple[int | None, list[bytes]]]
    seeds: dict[int, dict[int, list[tuple[int, int, int]]]]  # seed length -> hash -> places
    sorted_hashes: dict[int, np.ndarray]


def budget(n_words: int, share: float) -> int:
    return int(n_words * share)


def build(items: list[tuple[int | None, str]], share: float) -> Index:
    """Split each item into budget + 1 pieces: with at most budget edits, one piece is left untouched."""
    cache = WordHashes()
    kept = [(i, w) for i, t in items if t and (w := plain_words(t.encode()))]
    seeds: dict = defaultdict(lambda: defaultdict(list))
    for number, (_, words) in enumerate(kept):
        k = budget(len(words), share)
        edges = [len(words) * p // (k + 1) for p in range(k + 2)]
        hashes = np.array([cache[w] for w in words], np.uint64)
        for begin, end in zip(edges, edges[1:], strict=False):
            n = min(SEED_WORDS, end - begin)
            seeds[n][int(_grams(hashes[begin : begin + n], n)[0])].append((number, begin, k))
    return Index(kept, {n: dict(v) for n, v in seeds.items()}, {n: np.array(sorted(v), np.uint64) for n, v in seeds.items()})


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total = mixed(total * np.uint64(3) + hashes[j : j + size] + np.uint64(1))
    return total


def matches(words: list[bytes], hashes: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """(item number, distance, end word) of the best match of each item in one document."""
    wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, known in index.sorted_hashes.items():
        found = _grams(hashes, n)
        if not len(found):
            continue
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        for place in np.flatnonzero(known[at] == found).tolist():
            for number, offset, k in index.seeds[n][int(found[place])]:
                m = len(index.items[number][1])
                wanted[number].append((max(0, place - offset - k), min(len(words), place - offset + m + k)))
    out = []
    for number, spans in wanted.items():
        pattern = index.items[number][1]
        best = (len(pattern) + 1, 0)
        spans.sort()
        begin, end = spans[0]
        for low, high in [*spans[1:], (len(words) + 1, 0)]:
            if low <= end:  # spans that overlap are searched together
                end = max(end, high)
                continue
            distance, stop = myers(pattern, words[begin:end])
            best = min(best, (distance, begin + stop))
            begin, end = low, high
        out.append((number, *best))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, n_words, end_word): each item that a document holds with few enough word edits.

    An item of n words matches a part of a text at an edit distance of at most floor(``share`` * n) words: A-Z lowered,
    ASCII marks dropped. Whole texts are searched. The item is cut into one more piece than it may have edits, so some
    piece is intact; exact hits of the pieces' first words give the places, and Myers' bit-parallel distance decides.
    Of an item's matches in a document, the nearest and then first is given. The benchmark is read in blocks of about
    ``index_bytes``, one pass over the documents for each, so the index in a task is bounded at any size.
    Null or empty texts and items match nothing; repeated rows each give their rows; a null ``doc_id`` or ``item_id``
    is carried along. Only (doc_id, text) and (item_id, text) are read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // index_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, item_id long, distance int, n_words int, end_word int"
    found = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = docs.sparkSession.sparkContext.broadcast(build([(r.item_id, r.text) for r in own], share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, cache = shared.value, WordHashes()
            for batch in batches:
                out = []
                for begin, texts in slices(batch.column(1)):
                    names = batch.column(0).slice(begin, len(texts)).to_pylist()
                    for name, text in zip(names, texts, strict=True):
                        words = plain_words(text)
                        hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                        for number, distance, end in matches(words, hashes, index):
                            item, pattern = index.items[number]
                            if distance <= budget(len(pattern), share):
                                out.append((name, item, distance, len(pattern), end))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "item_id", "distance", "n_words", "end_word"])

        part = rows.mapInArrow(tidied(run), kinds)
        found = part if found is None else found.unionByName(part)
    return found
