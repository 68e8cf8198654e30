"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mapwise.llm.storage import stored
from mapwise.llm.words import mixed, slices, starts_of

#: Buckets of the word counts that order tokens by rarity (one array of 64-bit counts), in pieces of CHUNK.
BUCKETS, CHUNK = 1 << 20, 1 << 10
#: Bytes from which a word is hashed by itself.
LONG_WORD = 256
#: Rows of posting lists that a task holds at once, about, and pairs that it looks at side by side.
TASK_ROWS, TASK_PAIRS = 400_000, 4_000_000
#: Rows of the longest posting list that one task meets; a longer one is cut into blocks of half as many rows.
HOT = 2048
#: Pairs verified against one copy of a line's tokens.
BLOCK = 256
#: Bits of the filter of places whose tokens are to be read, in bytes of CHUNK: a fixed size. A full filter only lets
#: more lines through to the join that decides.
FILTER_BITS = 1 << 26
#: Bits of a set's size in the key of a posting row, below 40 bits of its token. A cut token or size only adds candidates.
SIZE_BITS = 24


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word of ``texts``, the number of words of each line, and of lines of each text.

    Words are hashed side by side, eight bytes at a time; the few long ones one by one.
    """
    n_lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join([*texts, b"\0" * 8]), np.uint8)
    seen = data[:-8]
    inner = np.zeros(len(seen) + 1, np.int8)
    inner[1:] = ~((seen == 32) | ((seen >= 9) & (seen <= 13)))
    steps = np.diff(inner)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    counts = np.diff(np.searchsorted(starts, np.flatnonzero(seen == 10)), prepend=0)
    length = ends - starts
    eights = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,), writeable=False)
    hashes = mixed(length.astype(np.uint64))
    rows = np.flatnonzero(length <= LONG_WORD)
    at, left = starts[rows], length[rows]
    while len(rows):
        part = eights[at] & (~np.uint64(0) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64))
        hashes[rows] = mixed((hashes[rows] ^ part) + np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes, counts, n_lines


def _lines(texts: list[bytes], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes of every line, rarest first, the number of them, and the number of lines of each text.

    Words are numbered by rarity once for all texts, so one sort of whole numbers orders all lines.
    """
    words, counts, n_lines = _word_hashes(texts)
    hashes, same = np.unique(words, return_inverse=True)
    order = np.argsort(often[(hashes % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = np.repeat(np.arange(len(counts)) << 32, counts)
    places += rank[same]
    places.sort()
    if len(places):
        places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    sizes = np.bincount(places >> 32, minlength=len(counts))
    return hashes[order][places & 0xFFFFFFFF], sizes, n_lines


def _parities(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parities of each line's tokens over at least twice as many bits as tokens: a power of two, 64 or more."""
    width = np.maximum(6, np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    begin = starts_of(1 << width)
    line = np.repeat(np.arange(len(sizes)), sizes)
    spots = begin[line] + (sets >> (64 - width[line]).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(spots, minlength=int((1 << width).sum())) & 1).astype(np.uint8)).tobytes()
    return [bits[b : b + n] for b, n in zip((begin // 8).tolist(), ((1 << width) // 8).tolist(), strict=True)]


def _differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the parities of each pair differ; the wider one is folded, which keeps parities."""
    found = np.zeros(len(a), np.int64)
    widths = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for pair in np.unique(widths, axis=0):
        rows = np.flatnonzero((widths == pair).all(axis=1))
        sides = [np.frombuffer(b"".join(side[i] for i in rows), np.uint8).reshape(len(rows), -1) for side in (a, b)]
        bits = sorted((np.unpackbits(x, axis=1) for x in sides), key=lambda x: x.shape[1])
        while bits[1].shape[1] > bits[0].shape[1]:
            bits[1] = bits[1][:, ::2] ^ bits[1][:, 1::2]
        found[rows] = (bits[0] ^ bits[1]).sum(axis=1)
    return found


def _keys(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128-bit key of each line's token set; null without tokens."""
    data = sets.tobytes()
    return [
        xxhash.xxh3_128_digest(data[8 * at : 8 * (at + n)]) if n else None
        for at, n in zip(starts_of(sizes).tolist(), sizes.tolist(), strict=True)
    ]


def _first64(keys: list[bytes | None]) -> list[int | None]:
    return [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys]


def rarity(docs: DataFrame) -> np.ndarray:
    """How often the words of each hash bucket occur over all lines of ``docs``: an array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0), 3_000_000):
                hashes, _, _ = _word_hashes(texts)
                total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BUCKETS // CHUNK, dtype=np.int32)),
                 pa.array([c.tobytes() for c in total.reshape(-1, CHUNK)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk")
    total = np.zeros(BUCKETS, np.int64)
    for row in parts.mapInArrow(add, "chunk int, counts binary").collect():
        total[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] += np.frombuffer(row.counts, np.int64)
    return total


def least_overlap(a, b, percent: int):
    """Common tokens from which sets of a and b tokens reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _may_match(first: tuple, second: tuple, percent: int) -> np.ndarray:
    """Which pairs of rows (ids, sizes, places, marks) of one token may reach the threshold.

    The sizes allow it (length filter) and enough tokens are left after the shared one (positional filter). ``marks``
    are 64 parities of each set's tokens: bits that differ are a lower bound of the tokens that only one of the sets
    has, and drop pairs beyond what the threshold allows.
    """
    (ids_a, sizes_a, places_a, marks_a), (ids_b, sizes_b, places_b, marks_b) = first, second
    both = sizes_a + sizes_b
    least = least_overlap(sizes_a, sizes_b, percent)
    apart = np.bitwise_count((marks_a ^ marks_b).view(np.uint64)).astype(np.int64)
    fits = 100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b)
    return fits & (np.minimum(sizes_a - places_a, sizes_b - places_b) >= least) & (apart <= both - 2 * least) & (ids_a != ids_b)


def posting_pairs(
    tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, marks: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of the posting lists: rows are sorted by (token, size). All pairs are held at once."""
    found_a, found_b = [], []
    left = np.arange(len(tokens))
    step = 1
    while True:
        left = left[left + step < len(tokens)]
        right = left + step
        fits = (tokens[left] == tokens[right]) & (100 * sizes[left] >= percent * sizes[right])
        left, right = left[fits], right[fits]  # larger ones only follow, so a row that fails is through
        if not len(left):
            break
        good = _may_match(*(tuple(c[side] for c in (ids, sizes, places, marks)) for side in (left, right)), percent)
        found_a.append(np.minimum(ids[left[good]], ids[right[good]]))
        found_b.append(np.maximum(ids[left[good]], ids[right[good]]))
        step += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _met(batches: Iterator[pa.RecordBatch], percent: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the posting lists of at most ``hot`` rows; of longer lists the rows themselves, for ``_hot_pairs``.

    ``batches`` are (key, cid, place, marks) in the order of (key, cid). Of equal rows, which come from several tasks,
    one is used. A long list is passed on as it is read, and pairs are handed on after about ``TASK_PAIRS``.
    """
    held: list[np.ndarray] = []
    passing = 1 << 62  # token of a long list that is not at its end; tokens have 40 bits
    names = ["a", "b", "key", "place", "marks"]

    def made(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, passing
        rows = np.concatenate(held)
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        tokens = rows[:, 0] >> SIZE_BITS
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        length = np.diff(np.append(first, len(rows)))
        long = (length > hot) | (tokens[first] == passing)
        upto = len(rows) if end else len(rows) - 1 if long[-1] else int(first[-1])
        held, passing = [rows[upto:]], int(tokens[-1]) if long[-1] else 1 << 62
        passed = np.repeat(long, length)[:upto]
        key, ids, places, marks = rows[:upto][passed].T.copy()
        if len(key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.nulls(len(key), pa.int64()), pa.array(key), pa.array(places.astype(np.int32)), pa.array(marks)], names)
        run = np.repeat(np.cumsum(length * (length - 1) // 2 * ~long) // TASK_PAIRS, length)[:upto][~passed]
        key, ids, places, marks = rows[:upto][~passed].T.copy()
        for cut in np.split(np.arange(len(key)), np.flatnonzero(np.diff(run)) + 1):
            a, b = posting_pairs(key[cut] >> SIZE_BITS, ids[cut], key[cut] & ((1 << SIZE_BITS) - 1), places[cut], marks[cut], percent)
            none = [pa.nulls(len(a), kind) for kind in (pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names)

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1))
        if sum(map(len, held)) >= TASK_ROWS:
            yield from made(False)
    if sum(map(len, held)):
        yield from made(True)


def _hot_pairs(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Candidate pairs (a, b) of long posting lists: ``rows`` has (token, size, cid, place, marks).

    A list is cut by ranges of size so wide that a set can only match sets of its own range and the two beside it, and a
    range by a hash into blocks of about ``block`` rows. Two blocks that can match meet in one group, so the work of a
    list is spread over its pairs of blocks, and memory is bounded by two blocks and their pairs.
    """
    width = math.log(max(100 / percent, 1.01)) * (1 + 1e-9)  # a little more, for rounded logarithms
    ranged = rows.withColumn("range", F.floor(F.log("size") / width).cast("int"))
    counts = stored(ranged.groupBy("token", "range").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "lines-hot")
    higher = counts.select("token", (F.col("range") - 1).alias("range"), F.col("blocks").alias("above"))
    lower = counts.select("token", (F.col("range") + 1).alias("range"), F.col("blocks").alias("below"))
    around = counts.join(higher, ["token", "range"], "left").join(lower, ["token", "range"], "left")
    cut = ranged.join(around, ["token", "range"]).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))

    def groups(n: str, made) -> Column:
        return F.coalesce(F.transform(F.sequence(F.lit(0), F.col(n) - 1), made), F.array())

    def group(low, up: int, i, j, left) -> Column:
        return F.struct(low.alias("low"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), left.alias("left"))

    own, here = F.col("own"), F.col("range")
    meets = F.concat(
        groups("blocks", lambda x: group(here, 0, F.least(own, x), F.greatest(own, x), own <= x)),
        groups("above", lambda x: group(here, 1, own, x, F.lit(True))),
        groups("below", lambda x: group(here - 1, 1, x, own, F.lit(False))))
    met = cut.select("token", "size", "cid", "place", "marks", F.explode(meets).alias("met")).select(
        "token", "met.*", "size", "cid", "place", "marks")

    def run(table: pa.Table) -> pa.Table:
        columns = [table[c].to_numpy().astype(np.int64) for c in ("cid", "size", "place", "marks")]
        left = table["left"].to_numpy().astype(bool)
        alone = left.all() and not table["up"][0].as_py() and table["i"][0].as_py() == table["j"][0].as_py()
        side = [c[left] for c in columns]
        other = tuple(c[None, :] for c in (side if alone else [c[~left] for c in columns]))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin in range(0, len(side[0]), 256):
            some = tuple(c[begin : begin + 256, None] for c in side)
            good = _may_match(some, other, percent)
            x, y = np.nonzero(good & (some[0] < other[0]) if alone else good)
            a, b = some[0][x, 0], other[0][0, y]
            found_a.append(np.minimum(a, b))
            found_b.append(np.maximum(a, b))
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return met.groupBy("token", "low", "up", "i", "j").applyInArrow(run, "a long, b long")


def _candidates(docs: DataFrame, counts, percent: int, hot: int = HOT) -> DataFrame:
    """Candidate pairs (a, b) of classes of lines that share a token of both prefixes and pass the filters."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, done = counts.value, set()
        for batch in batches:
            for _, texts in slices(batch.column(0), 3_000_000):
                sets, sizes, _ = _lines(texts, often)
                ids = _first64(_keys(sets, sizes))
                # Sets below this size can only equal another, which made them one class.
                use = np.array([n * (100 - percent) >= percent and i not in done for n, i in zip(sizes.tolist(), ids, strict=True)], bool)
                if len(done) > 1_000_000:
                    done.clear()
                done.update(i for i, u in zip(ids, use.tolist(), strict=True) if u)
                line = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(sets)) - np.repeat(starts_of(sizes), sizes)
                take = sizes - -(-percent * sizes // 100) + 1
                keep = use[line] & (place < take[line])
                rows = line[keep]
                bits = np.uint64(1) << (sets >> np.uint64(58))
                marks = np.zeros(len(sizes), np.uint64)
                has = np.flatnonzero(sizes)
                if len(has):
                    marks[has] = np.bitwise_xor.reduceat(bits, starts_of(sizes)[has])
                kept = np.minimum(sizes[rows], (1 << SIZE_BITS) - 1).astype(np.uint64)
                key = (sets[keep] >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS)) | kept
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.array([i or 0 for i in ids], np.int64)[rows]),
                     pa.array(place[keep].astype(np.int32)), pa.array(marks[rows].view(np.int64))],
                    ["key", "cid", "place", "marks"])

    rows = docs.select("text").mapInArrow(prefixes, "key long, cid long, place int, marks long")
    rows = rows.repartition(F.shiftright("key", SIZE_BITS)).sortWithinPartitions("key", "cid")
    met = stored(
        rows.mapInArrow(lambda batches: _met(batches, percent, hot), "a long, b long, key long, place int, marks long"), "lines-met")
    long = met.filter(F.col("key").isNotNull()).select(
        F.shiftright("key", SIZE_BITS).alias("token"), F.col("key").bitwiseAND((1 << SIZE_BITS) - 1).alias("size"),
        F.col("a").alias("cid"), "place", "marks")
    return met.filter(F.col("key").isNull()).select("a", "b").unionByName(_hot_pairs(long, percent, max(1, hot // 2))).distinct()


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and parities allow the threshold: most of those that reach it, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            apart = _differing(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            good = pa.array(apart <= n_a + n_b - 2 * least_overlap(n_a, n_b, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    first = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"))
    second = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    rows = pairs.join(second, "b").join(first, "a")
    return rows.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def _spots(tid: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each place."""
    one = mixed(tid.astype(np.int64).view(np.uint64) + mixed(line.astype(np.uint64) + np.uint64(1)))
    return (one % np.uint64(FILTER_BITS)).astype(np.int64), (one >> np.uint64(32)).astype(np.int64) % FILTER_BITS


def _place_filter(places: DataFrame) -> np.ndarray:
    """Bytes of a filter that lets the ``places`` (tid, line) through, and few others until it fills."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for spot in _spots(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                np.bitwise_or.at(bits, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
        parts = bits.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["chunk", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[chunk] = held.get(chunk, np.uint8(0)) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "bits"])

    parts = places.select("tid", "line").mapInArrow(mark, "chunk int, bits binary").repartition("chunk")
    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.mapInArrow(join, "chunk int, bits binary").collect():
        total[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.bits, np.uint8)
    return total


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, counts, percent: int) -> DataFrame:
    """Links (u, v) between class keys: the candidates that reach the threshold on their full token sets.

    The sets are read again from the texts, where a filter of fixed size passes the first lines of the classes that
    are left in a pair, so that texts are not shuffled.
    """
    pairs = stored(_alike(stored(pairs, "lines-pairs"), classes, percent), "lines-alike")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = stored(classes.join(wanted, "cid").select("cid", "first.tid", "first.line"), "lines-wanted")
    passes = docs.sparkSession.sparkContext.broadcast(_place_filter(wanted))  # FILTER_BITS at any size

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = passes.value, counts.value
        for batch in batches:
            for begin, texts in slices(batch.column(1), 3_000_000):
                cut = [t.split(b"\n") for t in texts]
                n_lines = np.array([len(x) for x in cut], np.int64)
                line = np.arange(n_lines.sum()) - np.repeat(starts_of(n_lines), n_lines)
                tid = np.repeat(batch.column(0).slice(begin, len(texts)).to_numpy(), n_lines)
                open_ = np.ones(len(line), bool)
                for spot in _spots(tid, line):
                    open_ &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
                text = np.repeat(np.arange(len(texts)), n_lines)
                sets, sizes, _ = _lines([cut[text[i]][line[i]] for i in np.flatnonzero(open_)], often)
                keys = _keys(sets, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(_first64(keys), pa.int64()),
                     pa.array([sets[b : b + n].tobytes() for b, n in zip(starts_of(sizes).tolist(), sizes.tolist(), strict=True)], pa.binary())],
                    ["cls", "cid", "tokens"])

    sets = docs.select("tid", "text").mapInArrow(tokens, "cls binary, cid long, tokens binary")
    sets = stored(sets.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid", "cls"]), "lines-tokens")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = stored(
        pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block")), "lines-dealt")
    left = dealt.select("a", "block").distinct().join(
        sets.select(F.col("cid").alias("a"), F.col("cls").alias("u"), F.col("tokens").alias("tokens_a")), "a")
    right = dealt.join(sets.select(F.col("cid").alias("b"), F.col("cls").alias("v"), F.col("tokens").alias("tokens_b")), "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])

    both = right.join(left, ["a", "block"]).select("u", "v", "tokens_a", "tokens_b")
    return stored(both.mapInArrow(decide, "u binary, v binary"), "lines-links")


def repeated_lines(docs: DataFrame, percent: int = 80, hot: int = HOT) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines, n_links): lines that resemble an earlier line.

    A line (cut at line feeds) is the set of its words. It is removed if a line at an earlier place, in the order of
    (doc_id, line number), has a set with 100 * common >= ``percent`` * union, whether or not that line stays itself.
    ``removed_lines`` are line numbers from 0, ``n_links`` counts the pairs of a line's set with different sets it resembles.
    Lines without words resemble nothing and stay.

    Lines with equal sets are one class. Tokens are ordered by rarity: by the counts of their hash bucket over all
    lines, then by hash. Two sets that reach the threshold share a token within their prefixes of
    n - ceil(t n) + 1 rarest tokens, so only prefixes are shuffled, by token; in each token's posting list the length and
    positional filters choose candidates. Parities over twice as many bits as tokens drop those that cannot reach the
    threshold, and every other is decided on the full sets. A list of
    at most ``hot`` rows is met in order of size by one task; a longer one is never held whole: it is cut by size and hash
    into blocks, and each two blocks whose sizes can match meet by themselves. Each candidate pair is one row until it is
    decided, so lines of which all resemble each other still cost the square of their number.

    Null texts have no lines (n_lines 0); an empty text has one empty line. Rows that share id and text are one document; a null ``doc_id`` sorts
    first. Tokens are compared by 64 bits, classes by 128. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "tid", F.coalesce(F.xxhash64("text"), F.lit(0)))
    counts = docs.sparkSession.sparkContext.broadcast(rarity(docs))  # BUCKETS numbers at any size

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for begin, texts in slices(batch.column(2), 3_000_000):
                sets, sizes, n_lines = _lines(texts, often)
                row = np.repeat(np.arange(len(texts)), n_lines)
                number = np.arange(len(row)) - np.repeat(starts_of(n_lines), n_lines)
                at = pa.array(row)
                keys = _keys(sets, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)).take(at), batch.column(1).slice(begin, len(texts)).take(at),
                     pa.array(number.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(_first64(keys), pa.int64()),
                     pa.array(sizes.astype(np.int32)), pa.array(_parities(sets, sizes), pa.binary())],
                    ["doc_id", "tid", "line", "cls", "cid", "n", "parity"])

    lines = stored(
        docs.filter(F.col("text").isNotNull()).select("doc_id", "tid", "text").mapInArrow(
            split, "doc_id long, tid long, line int, cls binary, cid long, n int, parity binary"), "lines")
    place: Column = F.struct("doc_id", "line", "tid")
    classes = stored(
        lines.filter(F.col("cls").isNotNull()).groupBy("cls", "cid", "n", "parity").agg(F.min(place).alias("first")), "lines-classes")
    links = _links(docs.filter(F.col("text").isNotNull()), classes, _candidates(docs, counts, percent, hot), counts, percent)
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = both.join(classes.select(F.col("cls").alias("v"), "first"), "v").groupBy("u").agg(
        F.min("first").alias("other"), F.count(F.lit(1)).alias("links"))
    earliest = classes.select("cls", "first").join(others.withColumnRenamed("u", "cls"), "cls", "left").select(
        "cls", F.least("first", "other").alias("earliest"), F.coalesce("links", F.lit(0)).alias("links"))
    # Only classes that remove something or have links need to meet their lines.
    copied = lines.groupBy("cls").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("cls", F.lit(True).alias("copied"))
    acting = earliest.join(copied, "cls", "left").filter("copied or links > 0").drop("copied")
    marked = lines.select("doc_id", "tid", "line", "cls").join(acting, "cls", "left").withColumn(
        "gone", F.coalesce(F.struct("doc_id", "line", "tid") > F.col("earliest"), F.lit(False)))
    # Repeated rows have equal places, so a line counts once.
    own = marked.groupBy("doc_id", "tid").agg(
        F.max("line").alias("last"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line")))).alias("removed_lines"),
        F.collect_set(F.when(F.col("links") > 0, F.struct("line", "links"))).alias("linked"))
    linked = F.aggregate("linked", F.lit(0).cast("long"), lambda total, x: total + x["links"])
    found = own.select(
        "doc_id", (F.col("last") + 1).cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"),
        "removed_lines", linked.alias("n_links"))
    empty = docs.filter(F.col("text").isNull()).select("doc_id").distinct().select(
        "doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<int>").alias("removed_lines"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(empty)


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the text's ``removed_lines`` taken out; ``found`` as from ``repeated_lines``, with unique ids."""
    gone = found.filter("n_removed > 0").select(F.col("doc_id").alias("of_doc"), "removed_lines").alias("found")
    rows = docs.alias("docs").join(gone, F.col("docs.doc_id").eqNullSafe(F.col("found.of_doc")), "left")
    lines = F.filter(
        F.split("docs.text", "\n"), lambda _, i: ~F.coalesce(F.array_contains("found.removed_lines", i), F.lit(False)))
    text = F.when(F.col("found.removed_lines").isNull(), F.col("docs.text")).otherwise(F.array_join(lines, "\n"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"docs.{c}") for c in docs.columns])
