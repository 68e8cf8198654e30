"""Remove repeated passages: suffix subtrees over groups of suffixes that share a prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mapwise.llm.storage import stored
from mapwise.llm.words import WordHashes, grams, hashed_words, slices, starts_of

#: Words that end the variable-length prefix of a suffix, and occurrences of one prefix end that one task may hold.
ANCHOR, GROUP = 10, 60_000
#: Occurrences that a task sorts together; a group is never cut.
TASK_ROWS = 60_000


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: the place of the anchor, the window's least ``anchor``-gram (first of equals); and the grams' hashes."""
    found = grams(words, anchor)
    width = window - anchor + 1
    n = len(found) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), found
    view = np.lib.stride_tricks.sliding_window_view(found, width)
    places = np.concatenate([view[i : i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, n)) for i in range(0, n, 8192)])
    return places, found


def subtree(suffixes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which suffixes lie below an internal node as deep as the suffixes are long.

    ``suffixes`` has a row of word numbers each, cut at the window; ``groups`` the prefix group of each. Sorted rows and
    the common prefixes of neighbours are the groups' suffix trees: a run of neighbours with a full common prefix is
    a node of that depth, and its leaves are the passages that repeat.
    """
    keys = np.ascontiguousarray(np.concatenate([groups[:, None], suffixes], axis=1).astype(">u4"))
    order = np.argsort(keys.view(np.dtype((np.void, keys.shape[1] * 4))).ravel(), kind="stable")
    equal = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    deep = np.zeros(len(keys), bool)
    deep[order[1:]] |= equal
    deep[order[:-1]] |= equal
    return deep


def _summary(window: int, anchor: int):
    """Task: (doc_id, tid, n_words, sha, keys) of each text; ``keys`` are the anchors of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for begin, texts in slices(batch.column(1), 3_000_000):
                hashes, counts = hashed_words(texts, cache)
                tids, shas, keys = [], [], []
                for text, at, n in zip(texts, starts_of(counts).tolist(), counts.tolist(), strict=True):
                    tids.append(hashlib.md5(text).digest())
                    shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    places, found = anchors(hashes[at : at + n], window, anchor)
                    keys.append(found[np.unique(places)].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(tids, pa.binary()), pa.array(counts),
                     pa.array(shas), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "tid", "n_words", "sha", "keys"])

    return run


def _contexts(window: int, anchor: int):
    """Task: (key, hot, tid, first, offset, words) of each wanted anchor: the windows it leads and the words they span.

    ``first`` is the start of the first of these windows, ``offset`` its distance to the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                tid, wanted = batch.column(0)[row], batch.column(2)[row].as_py()
                hashes, _ = hashed_words([batch.column(1)[row].as_py().encode()], cache)
                hot = dict(zip((k["key"] for k in wanted), (k["hot"] for k in wanted), strict=True))
                places, found = anchors(hashes, window, anchor)
                cuts = np.flatnonzero(np.diff(places, prepend=-1))
                ends = np.append(cuts[1:], len(places))
                keys = found[places[cuts]].view(np.int64)
                small = hashes.astype("<u4")
                out = [
                    (key, hot[key], first, place - first, small[first : end - 1 + window].tobytes())
                    for key, first, end, place in zip(
                        keys.tolist(), cuts.tolist(), ends.tolist(), places[cuts].tolist(), strict=True) if key in hot
                ]
                if out:
                    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    columns.append(pa.array([tid.as_py()] * len(out), pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["key", "hot", "first", "offset", "words", "tid"])

    return run


def _trees(window: int):
    """Task: (tid, starts) of the repeated windows; rows come sorted by key, and no key is cut."""

    def repeated(keys: list, rows: list) -> tuple[list, list]:
        codes = np.cumsum(np.diff(np.array(keys), prepend=keys[0]) != 0).astype(np.uint32)
        firsts, offsets = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        words = [np.frombuffer(r[3], "<u4") for r in rows]
        n_windows = np.array([len(w) for w in words]) - window + 1
        starts = [[] for _ in rows]
        # Equal windows have their anchor at the same distance from the start: one subtree for each distance.
        for offset in range(int(offsets.max()) + 1):
            shift = offsets - offset  # which of the row's windows has it
            has = np.flatnonzero((shift >= 0) & (shift < n_windows))
            if len(has) < 2:
                continue
            suffixes = np.stack([words[i][shift[i] : shift[i] + window] for i in has.tolist()])
            for i in has[subtree(suffixes, codes[has])].tolist():
                starts[i].append(int(firsts[i] + shift[i]))
        found = [i for i, s in enumerate(starts) if s]
        return [rows[i][0] for i in found], [starts[i] for i in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []

        def made(upto: int) -> pa.RecordBatch:
            tids, starts = repeated(keys[:upto], rows[:upto])
            del keys[:upto], rows[:upto]
            return pa.RecordBatch.from_arrays(
                [pa.array(tids, pa.binary()), pa.array(starts, pa.list_(pa.int32()))], ["tid", "starts"])

        for batch in batches:
            keys += batch.column(0).to_pylist()
            rows += zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)
            if len(keys) >= TASK_ROWS and keys[0] != keys[-1]:
                yield made(int(np.searchsorted(np.array(keys), keys[-1])))
        if keys:
            yield made(len(keys))

    return run


def _windows(window: int):
    """Task: (low, high, tid, start) of every window of hot groups; the longest prefix, a window, as 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, first, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                digests = [xxhash.xxh3_128_digest(data[4 * i : 4 * (i + window)]) for i in range(len(data) // 4 - window + 1)]
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([tid] * len(both), pa.binary()),
                     pa.array(np.arange(first, first + len(both), dtype=np.int32))], ["low", "high", "tid", "start"])

    return run


def _kept(window: int):
    """Task: (tid, n_removed, kept_sha, spans, kept) of texts with repeated window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tid, text, starts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, begins = text.encode().split(), np.unique(starts)
                cuts = np.flatnonzero(np.diff(begins) > window) + 1
                spans = [(int(p[0]), int(p[-1]) + window) for p in np.split(begins, cuts)]
                kept, at = [], 0
                for first, last in spans:
                    kept += words[at:first]
                    at = last
                left = b" ".join(kept + words[at:])
                out.append((tid, sum(b - a for a, b in spans), hashlib.sha256(left).hexdigest(),
                            [{"first": a, "last": b} for a, b in spans], left.decode()))
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            types = [pa.binary(), pa.int64(), pa.string(), span, pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["tid", "n_removed", "kept_sha", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 [, spans, kept]): texts without their repeated passages.

    A window of ``window`` words of one document repeats if its words also start anywhere else, the same document
    included; every word that such a window covers goes. ``spans`` are the maximal covered runs, ``kept`` the words
    left, joined by one space (null where nothing is removed; a text with copies loses all of its windows, so it is empty).
    The variable-length prefix of a suffix runs from its start to the end of the anchor, the least hashed ``anchor``-gram
    of its first ``window`` words: equal windows have equal prefixes, and one word in about thirteen is an anchor.

    1. Equal texts are one, with a count. Anchors are counted over the corpus, partial counts first; a suffix whose
       anchor occurs once is a leaf and goes no further.
    2. The others meet in the group of their prefix's anchor, each occurrence with the words its windows span.
       Sorting a group's suffixes gives its subtree, whose internal nodes at depth ``window`` are the repeats.
    3. A group of more than ``GROUP`` occurrences gets longer prefixes instead: the whole window. Suffixes equal so far
       are one deep node and are only counted, partial counts first, so such a group is never gathered.

    Texts are told apart by md5, words of a window by 32 bits each. Null texts have no words. Repeated rows are copies
    of one text; ``doc_id`` is only carried along, null or not. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = stored(
        rows.mapInArrow(
            _summary(window, anchor), "doc_id long, tid binary, n_words long, sha string, keys array<long>"), "repeats-texts")
    texts = stored(
        every.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "repeats-distinct")
    occurrences = texts.select("tid", F.explode("keys").alias("key"))
    counts = occurrences.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = counts.select("key", (F.col("n") > GROUP).alias("hot"))
    wanted = occurrences.join(counts, "key").groupBy("tid").agg(F.collect_set(F.struct("key", "hot")).alias("wanted"))
    tid = F.unhex(F.md5(F.col("text").cast("binary")))
    held = rows.select(tid.alias("tid"), "text").join(wanted, "tid")
    held = stored(held.dropDuplicates(["tid"]), "repeats-candidates")
    contexts = stored(
        held.select("tid", "text", "wanted").mapInArrow(
            _contexts(window, anchor), "key long, hot boolean, first int, offset int, words binary, tid binary"),
        "repeats-contexts")
    groups = contexts.filter("not hot").select("key", "tid", "first", "offset", "words")
    dealt = groups.repartition("key").sortWithinPartitions("key")
    cold = dealt.mapInArrow(_trees(window), "tid binary, starts array<int>")
    long = contexts.filter("hot").select("tid", "first", "words").mapInArrow(
        _windows(window), "low long, high long, tid binary, start int")
    nodes = long.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("low", "high")
    warm = long.join(nodes, ["low", "high"]).groupBy("tid").agg(F.collect_list("start").alias("starts"))
    starts = cold.unionByName(warm).groupBy("tid").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = held.select("tid", "text").join(starts, "tid").select("tid", "text", "starts").mapInArrow(
        _kept(window),
        "tid binary, n_removed long, kept_sha string, spans array<struct<first: int, last: int>>, kept string")
    if not with_text:
        cut = cut.drop("spans", "kept")
    whole = texts.filter("copies > 1").select("tid", F.lit(True).alias("copied"))
    copied: Column = F.col("copied").isNotNull() & (F.col("n_words") >= window)
    found = every.drop("keys").join(cut, "tid", "left").join(whole, "tid", "left")
    columns = [
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        span = F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last"))
        columns += [F.when(copied, F.array(span)).otherwise(F.col("spans")).alias("spans"),
                    F.when(copied, F.lit("")).otherwise(F.col("kept")).alias("kept")]
    return found.select(*columns)
