"""Near-duplicate documents by SetSketch registers.

Each document's distinct word shingles are hashed and drawn into ``REGISTERS`` registers: every element has an
exponential arrival time at every register, a register keeps the smallest, and its value is the truncated exponent
of that minimum to the base ``BASE``. Registers of a union are the maxima of the parts' registers. Equal values
happen with a probability of about the Jaccard similarity, so bands of them find candidates; the numbers of
registers that are greater, smaller and equal give a joint likelihood estimate that drops clear misses; every
remaining link is decided on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mapwise.llm.graph import components
from mapwise.llm.storage import stored
from mapwise.llm.words import WordHashes, hashed_words, mixed, shingle_sets, slices, starts_of, tidied

#: Bands of ROWS registers. A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**30 = 1.4e-7.
BANDS, ROWS = 30, 4
#: Registers of a sketch; the bands are cut from the first ones, the estimates use all.
REGISTERS = 360
#: Register value k stands for a minimum in (RATE * BASE**-k, RATE * BASE**(1 - k)], truncated to 0 .. LIMIT.
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
#: Candidates whose estimate is this many standard errors below the threshold are dropped (3e-6 of links just at it).
SIGMAS = 4.5
#: Links verified against one copy of a shingle set; classes of a bucket that are compared in one piece, and their words.
BLOCK, BUCKET_BLOCK, BLOCK_WORDS = 256, 1024, 1 << 20


def arrivals(sets: np.ndarray, sizes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Smallest arrival time of each set at each register.

    An element's arrivals are one Poisson process of rate ``registers`` whose points fall on random registers, so
    its first points at the registers are independent exponentials. Points are drawn in ascending order and only up
    to the time by which all registers of the set are expected to be hit; sets with a register left empty are
    drawn again for twice as long.
    """
    n_sets = len(sizes)
    low = np.full(n_sets * registers, np.inf)
    todo, longer = np.arange(n_sets), 1.0
    begins = starts_of(sizes)
    while len(todo):
        own = sizes[todo]
        until = np.zeros(n_sets)
        until[todo] = longer * (np.log(registers) + 6) / np.maximum(own, 1)
        if len(todo) == n_sets:
            state = sets
        else:
            state = np.concatenate([sets[begins[i] : begins[i] + sizes[i]] for i in todo.tolist()])
        where = np.repeat(todo, own)
        time = np.zeros(len(state))
        while len(state):
            state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((state >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / registers
            alive = time <= until[where]
            state, time, where = state[alive], time[alive], where[alive]
            spot = (mixed(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(low, where * registers + spot, time)
        full = np.isfinite(low.reshape(n_sets, registers)).all(axis=1)
        todo, longer = todo[~full[todo]], longer * 2
        todo = todo[sizes[todo] > 0]
    return low.reshape(n_sets, registers)


def register_values(low: np.ndarray) -> np.ndarray:
    """Exponents of the minima, as 16-bit registers."""
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(low / RATE) / np.log(BASE))
    return np.clip(values, 0, LIMIT).astype("<u2")


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likelihood estimate of the Jaccard similarity of pairs from their registers and exact sizes.

    A register of the first set is greater with probability p(u - v J), smaller with p(v - u J), where u and v are
    the sizes' shares and p(x) = -log(1 - x (BASE - 1) / BASE) / log(BASE). The log-likelihood is concave in J; its
    maximum is found by halving on the derivative.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    c, log_base = (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-c * x) / log_base, -np.log1p(-c * y) / log_base
        dp, dq = -v * c / (1 - c * x) / log_base, -u * c / (1 - c * y) / log_base
        slope = more * dp / p + less * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def row_key() -> Column:
    """Hash of a row's id and text: equal for equal rows only, whether or not the id is null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, n, cls, cid, regs): ``row_key``, set size, key of the set, its first 64 bits, and registers
    (null if too small).

    ``cls`` is a 128-bit hash of the whole sorted set, the same for documents with equal sets; null without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                hashes, counts = hashed_words((t.lower() for t in texts), cache)
                sets, sizes = shingle_sets(hashes, counts, words)
                values = register_values(arrivals(sets, sizes)).tobytes()
                wide = 2 * REGISTERS
                keys, firsts, regs = [], [], []
                for i, (at, n) in enumerate(zip(starts_of(sizes).tolist(), sizes.tolist(), strict=True)):
                    key = xxhash.xxh3_128_digest(sets[at : at + n].tobytes()) if n else None
                    keys.append(key)
                    firsts.append(int.from_bytes(key[:8], "little", signed=True) if n else None)
                    regs.append(values[i * wide : (i + 1) * wide] if n else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), batch.column(2).slice(begin, len(texts)), pa.array(sizes),
                     pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(regs, pa.binary())],
                    ["doc_id", "row", "n", "cls", "cid", "regs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    return rows.mapInArrow(tidied(run), "doc_id long, row long, n long, cls binary, cid long, regs binary")


def _floor(percent: int) -> float:
    """Least joint estimate of a candidate."""
    least = percent / 100
    return least - SIGMAS * np.sqrt(least * (1 - least) / REGISTERS)


def _registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids that may reach the threshold, by sizes and by the joint estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _registers(batch.column(2)), _registers(batch.column(3))
            n_a, n_b = (batch.column(k).to_numpy().astype(np.float64) for k in (4, 5))
            good = pa.array(joint_estimate(a, b, n_a, n_b) >= _floor(percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    first = classes.select(F.col("cid").alias("a"), F.col("regs").alias("regs_a"), F.col("n").alias("n_a"))
    second = classes.select(F.col("cid").alias("b"), F.col("regs").alias("regs_b"), F.col("n").alias("n_b"))
    near = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    rows = pairs.join(second, "b").join(first, "a").filter(near)
    return rows.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, cid, partners): the classes of each pair of blocks that have a candidate of another part there.

    ``rows`` has (key, band, cid, part, tried, n, regs, held, words). Buckets are cut into blocks of about
    ``BUCKET_BLOCK`` classes and ``BLOCK_WORDS`` words; two blocks meet in one group, which compares registers as arrays.
    A candidate passes the filters by size and estimate, is met in the first band that the two share, and is not the
    leader with which a class was ``tried`` before. A group gives a row for each class with a candidate, with the other
    ends as a list at one of the two, so there is no row for a pair and a list is no longer than a block.
    """
    blocks = F.ceil(F.greatest(F.col("held") / BUCKET_BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    met = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(
        "key", "band", "cid", "part", "tried", "n", "regs", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        cids, tried, n = (group[c].to_numpy() for c in ("cid", "tried", "n"))
        n = n.astype(np.float64)
        part = np.array(group["part"].to_pylist(), dtype=object)
        _, part = np.unique(part, return_inverse=True)
        regs, band = _registers(group["regs"]), group["band"][0].as_py()
        bands = np.ascontiguousarray(regs[:, : BANDS * ROWS]).view("<u8")
        left = group["own"].to_numpy() == group["i"][0].as_py()
        alone = group["i"][0].as_py() == group["j"][0].as_py()
        partners: dict[int, np.ndarray] = {}
        needed = np.zeros(len(cids), bool)
        for x in np.flatnonzero(left).tolist():
            ys = np.arange(x + 1, len(cids)) if alone else np.flatnonzero(~left)
            ys = ys[(part[ys] != part[x]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
            ys = ys[(tried[ys] != cids[x]) & (cids[ys] != tried[x])]
            ys = ys[(bands[ys] == bands[x]).argmax(axis=1) == band] if len(ys) else ys
            if len(ys):
                many = np.broadcast_to(regs[x], (len(ys), REGISTERS))
                ys = ys[joint_estimate(many, regs[ys], np.full(len(ys), n[x]), n[ys]) >= _floor(percent)]
            if len(ys):
                partners[x] = cids[ys]
                needed[x] = needed[ys] = True
        given = np.flatnonzero(needed)
        lists = [partners.get(x, ()) for x in given.tolist()]
        return pa.table({
            **{c: group[c].take(pa.array(given)) for c in ("key", "i", "j", "cid")},
            "partners": pa.array(lists, pa.list_(pa.int64()))})

    return met.groupBy("key", "i", "j").applyInArrow(run, "key long, i int, j int, cid long, partners array<long>")


def _joined(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of class keys that join what ``near`` holds: full sets meet in its groups, see ``_near``.

    A pair that the group's links so far already connect is not decided, so a group gives a spanning forest: fewer links
    than classes. Memory is bounded by the sets of two blocks.
    """

    def run(group: pa.Table) -> pa.Table:
        keys, place = group["cls"].to_pylist(), {c: x for x, c in enumerate(group["cid"].to_pylist())}
        own = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["own"]]
        above = list(range(len(keys)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        found = []
        for x, whom in enumerate(group["partners"].to_pylist()):
            for y in [place[c] for c in whom if c in place]:
                if top(x) != top(y):
                    both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                    if 100 * both >= percent * (len(own[x]) + len(own[y]) - both):
                        above[top(x)] = top(y)
                        found.append((keys[x], keys[y]))
        return pa.table({
            "u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

    met = near.join(sets, "cid").select("key", "i", "j", "cid", "partners", "cls", "own")
    return stored(met.groupBy("key", "i", "j").applyInArrow(run, "u binary, v binary"), "dedup-links")


def _sets(cids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cid, cls, own): the full shingle sets of the classes in ``cids``; only their texts are shuffled."""
    chosen = classes.join(cids, "cid").select("row", F.col("cls").alias("expected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for begin, texts in slices(batch.column(0)):
                hashes, counts = hashed_words((t.lower() for t in texts), cache)
                sets, sizes = shingle_sets(hashes, counts, words)
                found = []
                expected = batch.column(1).slice(begin, len(texts)).to_pylist()
                for at, n, key in zip(starts_of(sizes).tolist(), sizes.tolist(), expected, strict=True):
                    own = sets[at : at + n].tobytes()
                    if xxhash.xxh3_128_digest(own) == key:  # another row may have the same key
                        found.append((int.from_bytes(key[:8], "little", signed=True), key, own))
                for row in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary())],
                        ["cid", "cls", "own"])

    rows = docs.select(row_key().alias("row"), "text").join(chosen, "row")
    sets = rows.select("text", "expected").mapInArrow(tidied(run), "cid long, cls binary, own binary")
    return stored(sets.dropDuplicates(["cls"]), "dedup-sets")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) of class keys, decided on the full shingle sets of the pairs (a, b).

    The set of a class with many pairs is copied once per ``BLOCK`` pairs, so that one document with thousands of near
    copies is spread over tasks.
    """
    pairs = stored(pairs, "dedup-pairs")
    sets = _sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), classes, docs, words)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    dealt = stored(dealt.select("a", "b", "block"), "dedup-dealt")
    leaders = dealt.select("a", "block").distinct().join(
        sets.select(F.col("cid").alias("a"), F.col("cls").alias("u"), F.col("own").alias("own_a")), "a")
    members = dealt.select("a", "b", "block").join(
        sets.select(F.col("cid").alias("b"), F.col("cls").alias("v"), F.col("own").alias("own_b")), "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])

    both = members.join(leaders, ["a", "block"]).select("u", "v", "own_a", "own_b")
    return stored(both.mapInArrow(decide, "u binary, v binary"), "dedup-links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where 100 * common >= ``percent`` * union.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lowered. A document of fewer than ``words`` words has its whole
    sequence as its one shingle; without words or text it has none and is linked with nothing. ``component_id`` is
    the smallest ``doc_id`` reachable, ``kept`` marks it. Documents with equal sets are one class from the start, so
    groups of exact copies cost one row each. Then, in three steps that lose no link that shares a band:

    1. Each class is paired with the least class of each band bucket it is in; of these leaders only the one it shares
       most bands with is verified, and links are joined into components.
    2. In buckets that still hold several components, the registers of classes of different components are compared in
       blocks. A group of near copies is one component by then, so it is not compared with itself.
    3. The full sets of classes with a pair whose estimate may reach the threshold meet in the same groups; each group
       gives links that join what belongs together, fewer than its classes, and all links are joined.

    Sizes and sets are those of 64-bit shingle hashes; classes are told apart by 128 bits. Rows with a null
    ``doc_id`` take part, but do not give their component a name: a component of such rows alone has a null
    ``component_id``, and none of its rows is kept. Repeated rows give repeated results. Columns other than
    ``doc_id`` and ``text`` are not read. An empty table gives no rows.
    """
    found = grouped(docs, words, percent)
    name = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", name.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def grouped(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row, n_shingles, component, component_id): as ``near_duplicates``, with ``row_key`` and the component's own key."""
    rows = stored(sketches(docs, words), "dedup-sketches")
    classes = stored(
        rows.filter("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("read"), F.first("n").alias("n"), F.first("cid").alias("cid"),
            F.first("regs").alias("regs")).select("*", "read.row").drop("read"),
        "dedup-classes")
    # A set of three or fewer can only equal another, which made them one class.
    smallest = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    large = classes.filter(F.col("n") >= smallest)
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    buckets = large.select("cid", F.posexplode(keys).alias("band", "key"))
    shared = buckets.groupBy("key").agg(
        F.min("cid").alias("a"), F.max("cid").alias("z"), F.count(F.lit(1)).alias("held")).filter("a < z")
    members = stored(buckets.join(shared.select("key", "held"), "key"), "dedup-buckets")
    # The original of a group of near copies is in the fullest buckets; its copies may all be further apart.
    weights = members.groupBy("cid").agg(F.sum("held").alias("weight"))
    members = stored(members.join(weights, "cid").select("key", "band", "cid", "held", "weight"), "dedup-members")
    tops = members.groupBy("key").agg(F.max(F.struct("weight", "cid"))["cid"].alias("a"))
    stars = members.join(tops, "key").filter("cid != a").groupBy("a", F.col("cid").alias("b")).agg(
        F.count(F.lit(1)).alias("bands"))
    best = stored(stars.groupBy("b").agg(F.max(F.struct("bands", "a")).alias("best")).select("best.a", "b"), "dedup-best")
    links = _verified(_estimated(best, large, percent), large, docs, words, percent)
    named = stored(components(links), "dedup-components")

    part = large.select("cid", "cls", "n").join(named, F.col("cls") == F.col("node"), "left")
    part = stored(part.select("cid", "n", F.coalesce("component", "cls").alias("part")), "dedup-parts")
    tagged = members.select("key", "band", "cid", "held").join(part, "cid")
    mixed_keys = tagged.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.sum("n").alias("words"))
    mixed_keys = mixed_keys.filter("p < q").select("key", "words")
    leaders = large.select("cid", "regs").join(best.select(F.col("b").alias("cid"), F.col("a").alias("tried")), "cid", "left")
    leaders = leaders.withColumn("tried", F.coalesce("tried", "cid"))
    open_rows = tagged.join(mixed_keys, "key").join(leaders, "cid")
    near = stored(_near(open_rows, percent), "dedup-near")
    more = _joined(near, _sets(near.select("cid").distinct(), large, docs, words), percent)
    final = stored(components(links.unionByName(more)), "dedup-components")

    owned = classes.select("cls", "rep").join(final, F.col("cls") == F.col("node"), "left")
    owned = owned.select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    least = owned.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = owned.join(least, "component").select("cls", "component", "component_id")
    found = rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "cls").join(labels, "cls", "left")
    return found.drop("cls")
