"""Resample documents by importance towards a target text: hashed word n-grams, CRCs by columns of equal lengths."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from mapwise.llm.storage import stored
from mapwise.llm.words import slices

#: Buckets of the hashed features, and words of the longest feature.
BUCKETS, LONGEST = 10_000, 3
#: Words whose features are hashed together, and the bytes from which a feature goes to zlib instead of a matrix.
CHUNK_WORDS, LONG_BYTES = 250_000, 400

#: What each byte of a text becomes: A-Z lower-cased; all but 0-9, a-z and bytes over 0x7F a separator.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    """The remainder of each byte for the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC_TABLE = _crc_table()


def matrix_crc32(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte string, the strings being the columns' transpose: ``rows[k]`` holds byte k of all strings."""
    crc = np.full(rows.shape[1], 0xFFFFFFFF, np.uint32)
    for column in rows:
        crc = CRC_TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32_of(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of ``buffer[start : start + length]`` for all strings.

    Strings of one length make a two-dimensional uint8 array, whose CRCs advance together, one byte column at a time;
    the results are scattered back to the strings' places. The few strings of ``LONG_BYTES`` or more, for which a
    column would hold next to nothing, are handed to zlib one by one, with the same result.
    """
    found = np.zeros(len(starts), np.uint32)
    order = np.argsort(np.minimum(lengths, LONG_BYTES).astype(np.int16), kind="stable")
    sorted_lengths = np.minimum(lengths[order], LONG_BYTES)
    cuts = np.flatnonzero(np.diff(sorted_lengths)) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        length = int(lengths[group[0]])
        if length >= LONG_BYTES:
            for i in group.tolist():
                found[i] = zlib.crc32(buffer[starts[i] : starts[i] + lengths[i]])
            continue
        for at in range(0, len(group), 32_768):
            some = group[at : at + 32_768]
            found[some] = matrix_crc32(buffer[starts[some] + np.arange(length)[:, None]])
    return found


class WordNumbers(dict):
    """A number for each word met, in turn; emptied when full, so that memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def feature_buckets(
    texts: list[bytes], numbers: WordNumbers, buckets: int = BUCKETS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every occurrence of every feature of the texts, in pieces; ``text`` is the place in the list.

    A piece takes ``CHUNK_WORDS`` words with the features that start at them; its distinct features, numbered exactly by
    the numbers of their words, are hashed once.
    """
    raw = np.frombuffer(b" ".join([t.translate(FOLDED) for t in texts] + [b""]), np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    letter = raw != 32
    # One separator after each word, so that a feature is one stretch of the buffer.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    buffer = raw[keep]
    letter = letter[keep]
    ends = np.flatnonzero(~letter)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    text_of = np.searchsorted(begins, np.flatnonzero(keep)[starts], "right") - 1
    for first in range(0, len(starts), CHUNK_WORDS):
        last = min(first + CHUNK_WORDS, len(starts))
        upto = min(last + LONGEST - 1, len(starts))
        words = buffer[starts[first] : ends[upto - 1]].tobytes().split(b" ")
        number = numbers.of(words)
        feature = np.zeros(last - first, np.int64)
        for n in range(1, LONGEST + 1):
            whole = np.arange(first, min(last, len(starts) - n + 1))
            whole = whole[text_of[whole] == text_of[whole + n - 1]]
            own = whole - first
            # The number of the feature one word shorter and that of the last word give each feature one key.
            key = feature[own] * len(numbers) + number[own + n - 1]
            _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            feature[own] = inverse
            begin = starts[whole[at]]
            crc = crc32_of(buffer, begin, ends[whole[at] + n - 1] - begin)
            yield text_of[whole], (crc % np.uint32(buckets)).astype("<u2")[inverse]


def hashed_features(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, buckets) of ``rows`` (doc_id, text): the buckets of each whole text as 16-bit numbers, six bytes a word."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            for begin, texts in slices(batch.column(1), 3_000_000):
                pieces = [(np.zeros(0, np.int64), np.zeros(0, "<u2")), *feature_buckets(texts, numbers, buckets)]
                text, found = (np.concatenate(x) for x in zip(*pieces, strict=True))
                ends = np.cumsum(np.bincount(text, minlength=len(texts)) * 2)
                data = found[np.argsort(text, kind="stable")].tobytes()
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
                lists = pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), lists], ["doc_id", "buckets"])

    return rows.mapInArrow(run, "doc_id long, buckets binary")


def _numbers_of(binary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of the rows, one row after the other, and how many each row has."""
    lengths = pc.binary_length(binary).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    return np.frombuffer(b"".join(binary.to_pylist()), "<u2"), lengths


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all rows of ``hashed``: one partial sum per task, ``buckets`` sums in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers_of(batch.column(0))[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = hashed.select("buckets").mapInArrow(count, "bucket long, n long")
    sums = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        sums[bucket] = n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(((t + 1) / (T + B)) / ((s + 1) / (S + B))))`` of each of the B buckets."""
    size = len(corpus)
    total_s, total_t = int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (total_s + size) / ((s + 1) * (total_t + size))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document in thousandths, from the first 32 bits of a hash of its id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every whole text of ``docs``, towards the texts of ``target``.

    The texts are hashed once and their buckets written; one pass over these sums the buckets of both sides, another adds
    up each document's gains. Between the two only ``buckets`` numbers reach the driver and go out with the tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = stored(hashed_features(rows, buckets), "importance-features")
    wanted = hashed_features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), buckets)
    gain = gains(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n_features = _numbers_of(batch.column(1))
            total = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(n_features)
            weight = total[ends] - total[ends - n_features]
            # n words give n + (n - 1) + (n - 2) features, one word gives one.
            n_words = np.where(n_features >= 3, n_features // 3 + 1, n_features)
            extra = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n_words, n_features, weight, weight + extra))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return hashed.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS,
) -> DataFrame:
    """Draw ``percent`` of the documents by importance: (doc_id, n_features, weight, score, rank), a row per document.

    Features are runs of one to three words ``[0-9a-z]`` or beyond ASCII, A-Z lower-cased. A document's weight is the sum
    of its buckets' log-likelihood gains of ``target`` over ``docs``, its score the weight with Gumbel noise, so the highest
    scores are a weighted sample without replacement. Of the documents with ``least_words`` words, the share drawn gets
    ranks from 1 by score, ties by smaller ``doc_id`` (null last); rows that tie in both keep the order in which they
    were stored. All others have a null rank.

    The ranks come from one range shuffle of five numbers a row: each task numbers its own range, offset by the sizes of
    the ranges before, which are one row per task. Ties, repeated rows and hot keys are split over ranges by the place
    of the stored row. Null and empty texts, and those without words, have no features and weight 0; a null id hashes as
    empty text. Very long texts are hashed in pieces of ``CHUNK_WORDS`` words. Empty tables give no rows, an empty target
    equal gains of smoothing. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    """
    scored = stored(weigh(docs, target, seed, buckets), "importance-scores")
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.filter(eligible).count() // 100
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    # Scores of rows that are not drawn from take no part in the order, only their places.
    placed = scored.select("*", eligible.alias("may"), F.monotonically_increasing_id().alias("place"))
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    in_range = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("part"), in_range.alias("seq")), "importance-order")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("seq") + 1
    return ranged.join(offsets, F.col("part") == F.col("of_part")).select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("may") & (rank <= drawn), rank).cast("long").alias("rank"))


#: The draw in SQL; ``crc`` runs the byte table over a feature's UTF-8 bytes.
RESAMPLE_SQL = r"""
with bits as (
  select b, list_reduce(list_prepend(cast(b as bigint), range(8)),
           lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v
  from range(256) r(b)),
crc_table as (select list(v order by b) as entries from bits),
words_of as (
  select 'd' as side, row_number() over () as row_no, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
  union all
  select 'b', row_number() over (), null, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  from benchmark),
features as (
  select side, row_no, unnest(list_concat(w,
           list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                       list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) as f
  from words_of),
hexed as (select f, hex(f) as h from (select distinct f from features)),
hashed as (
  select f, xor(4294967295::bigint, list_reduce(
           list_prepend(4294967295::bigint,
             list_transform(range(0, length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
           lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) % 10000 as bucket
  from hexed, crc_table),
placed as (select side, row_no, bucket from features join hashed using (f)),
sums as (
  select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from placed group by bucket),
totals as (select coalesce(sum(s), 0)::bigint as all_s, coalesce(sum(t), 0)::bigint as all_t from sums),
gain_of as (
  select bucket, cast(floor(1000 * ln(((t + 1) * (all_s + 10000))::double / ((s + 1) * (all_t + 10000))::double)) as bigint) as gain
  from sums, totals),
weights as (
  select row_no, count(*) as n, cast(sum(gain) as bigint) as gained
  from placed join gain_of using (bucket) where side = 'd' group by row_no),
scored as (
  select doc_id, coalesce(len(w), 0) as n_words, coalesce(n, 0) as n_features, coalesce(gained, 0) as weight,
         coalesce(gained, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8)
           as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from words_of left join weights using (row_no) where side = 'd'),
ordered as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place,
         5 * count(*) filter (n_words >= 20) over () // 100 as drawn
  from scored)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       case when n_words >= 20 and place <= drawn then place end as rank
from ordered
"""
