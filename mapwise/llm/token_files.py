"""Token-id files: blocks of ids as byte or bit planes, each plane compressed with zstandard, found by an index.

A token file is one binary value, kept as a row of a Parquet data set, so that it can be written and read on any
store Spark reaches and a lost task leaves nothing behind. All numbers are little-endian::

    magic "MWPL" | planes u8 (8: bit planes, 1: byte planes) | 3 spare bytes
    n_docs u64 | n_ids u64 | block u64 (ids in a block) | n_blocks u64
    document index: doc_id i64 x n_docs | null flag u8 x n_docs | n_tokens u64 x n_docs
    chunk index: for each block and plane the length u64 of its compressed bytes; 0 stands for a plane of zeros
    the compressed planes, block after block

An id takes four bytes, so a block has 4 byte planes or 32 bit planes; the last block of a file may be shorter.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mapwise.llm.words import kept_by_worker, release_memory, slices, tidied

#: Appended to each document.
END_ID = 1
#: Words that a Python worker keeps with their ids, about 170 bytes each; the memory is emptied when full.
KEPT_WORDS = 600_000
#: Ids in a block, and ids from which a file is closed; a document is never split over files.
BLOCK_IDS, FILE_IDS = 65_536, 1_000_000
LEVEL = 1
MAGIC = b"MWPL"
_HEAD = struct.Struct("<4sB3xQQQQ")

FILE_TYPE = "part int, seq int, before long, n_docs long, n_ids long, payload binary"


class WordIds(dict):
    """Ids of each word met, as places in one flat array.

    The vocabulary drops white space before it merges, so a text's ids are those of its words in turn. Words that
    are letters with a tail of marks skip the normaliser, which would only lower them; all others take the
    tokenizer's whole way.
    """

    TAIL = ".,!?;:%$&*#|"

    def __init__(self, path: str, most: int = KEPT_WORDS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.most = path, most
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.marks = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.flat, self.begins, self.tails = array("I"), array("Q", [0]), {}

    def _piece(self, text: str) -> list[int]:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.marks)
        return [t.id for t in self.model.tokenize(text)]

    def encode(self, word: str) -> list[int]:
        core = word.rstrip(self.TAIL)
        if core.isalpha() and (core.isascii() or (max(core) <= "ſ" and "İ" not in core)):
            tail = word[len(core):]
            if tail and tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._piece(tail)
            return self._piece(core.lower()) + (self.tails[tail] if tail else [])
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        self.flat.extend(self.encode(word.decode()))
        self.begins.append(len(self.flat))
        self[word] = place
        return place

    def texts(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and the number of ids of each."""
        if len(self) > self.most:
            self.clear()
            self.flat, self.begins = array("I"), array("Q", [0])
        places, n_words = [], []
        look = self.__getitem__
        for text in texts:
            words = text.split()
            n_words.append(len(words))
            places.append(np.fromiter(map(look, words), np.int64, len(words)))
        place = np.concatenate(places)
        begins = np.frombuffer(self.begins, np.uint64).astype(np.int64)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        sizes = np.diff(begins)[place]
        ends_of = np.cumsum(sizes)
        total = int(ends_of[-1]) if len(ends_of) else 0
        where = np.arange(total) + np.repeat(begins[place] - (ends_of - sizes), sizes)
        ids = flat[where]
        del flat
        word_ends = np.cumsum(n_words)
        doc_ends = np.concatenate([[0], ends_of])[word_ends]
        counts = np.diff(np.concatenate([[0], doc_ends])) + 1
        return np.insert(ids, doc_ends, np.uint32(end)), counts


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte or bit planes of a block, least significant first."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in np.ascontiguousarray(rows.T)]
    spread = np.unpackbits(rows, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    """The ids of a block; None is a plane of zeros."""
    rows = np.zeros((len(planes), -(-n // 8) if bits else n), np.uint8)
    for i, plane in enumerate(planes):
        if plane is not None:
            rows[i] = np.frombuffer(plane, np.uint8)
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int, bits: bool, level: int) -> bytes:
    """One token file."""
    press = zstandard.ZstdCompressor(level=level)
    lengths, body = [], []
    for begin in range(0, len(ids), block):
        for plane in to_planes(ids[begin : begin + block], bits):
            data = press.compress(plane) if plane.strip(b"\0") else b""
            lengths.append(len(data))
            body.append(data)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, 8 if bits else 1, len(doc_ids), len(ids), block, -(-len(ids) // block))
    index = own.tobytes() + nulls.tobytes() + counts.astype("<u8").tobytes() + np.array(lengths, "<u8").tobytes()
    return b"".join([head, index, *body])


def unpack(payload: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a token file, in order; one block is open at a time."""
    magic, kind, n_docs, n_ids, block, n_blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC or kind not in (1, 8):
        raise ValueError("not a token file")
    at = _HEAD.size

    def column(kind: str, n: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(payload, kind, n, at)
        at += values.nbytes
        return values

    planes = 32 if kind == 8 else 4
    own, nulls, counts = column("<i8", n_docs), column("u1", n_docs), column("<u8", n_docs)
    lengths = column("<u8", n_blocks * planes).reshape(n_blocks, planes)
    press = zstandard.ZstdDecompressor()

    def blocks() -> Iterator[np.ndarray]:
        place = at
        for b in range(n_blocks):
            n = min(block, n_ids - b * block)
            found = []
            for size in lengths[b].tolist():
                found.append(press.decompress(payload[place : place + size]) if size else None)
                place += size
            yield from_planes(found, n, kind == 8)

    source, rest = blocks(), np.zeros(0, np.uint32)
    for doc, null, n in zip(own.tolist(), nulls.tolist(), counts.tolist(), strict=True):
        parts, have = [rest], len(rest)
        while have < n:
            parts.append(next(source))
            have += len(parts[-1])
        rest = np.concatenate(parts) if len(parts) > 1 else rest
        yield (None if null else doc), rest[:n]
        rest = rest[n:]


def worker_words(path: str) -> WordIds:
    """The words met so far by this Python worker, over all its tasks of this stage."""
    return kept_by_worker(("token words", path), lambda: WordIds(path))


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
    block: int = BLOCK_IDS, file_ids: int = FILE_IDS, bits: bool = False, level: int = LEVEL,
) -> None:
    """Encode every whole text and write the ids to ``folder``, in ascending order of ``doc_id``.

    ``tokenizer`` is the path of a tokenizer file that every executor has. The texts are dealt out by ranges of
    ``doc_id`` (one shuffle of the texts, which are smaller than their ids); each task encodes its range and
    closes a file at ``file_ids`` ids. ``folder/files`` holds the files, ``folder/parts`` the ids before each range.
    Null text: the end id alone. A null ``doc_id`` sorts first; rows of one id sort by text, and each is a
    document. Other columns are not read. An empty table writes no file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        release_memory()
        words = worker_words(tokenizer)
        seq = before = held = 0
        names, sizes, arrays = [], [], []

        def close() -> pa.RecordBatch:
            payload = pack(names, np.concatenate(sizes), np.concatenate(arrays), block, bits, level)
            row = [part, seq, before, len(names), held, payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                ["part", "seq", "before", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, texts in slices(batch.column(1), 2_000_000):
                found, counts = words.texts(texts, end_id)
                names += ids[begin : begin + len(texts)]
                sizes.append(counts)
                arrays.append(found)
                held += len(found)
                if held >= file_ids:
                    yield close()
                    seq, before, held = seq + 1, before + held, 0
                    names, sizes, arrays = [], [], []
        if names:
            yield close()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    files = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(encode, FILE_TYPE)
    files.write.option("compression", "none").parquet(f"{folder}/files")
    parts = read_files(docs.sparkSession, folder).groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # One row per range, so the running sum in one task is over tasks, not documents.
    offset = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.select("part", F.coalesce(offset, F.lit(0)).cast("long").alias("offset")).write.parquet(f"{folder}/parts")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE_TYPE).parquet(f"{folder}/files")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of a token folder, decoded from its files: (doc_id, start, n_tokens, ids_crc32 [, ids]).

    ``start`` counts the ids of all documents before, ``ids_crc32`` is over the ids as little-endian 32-bit values.
    """
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, lists = batch.column(0)[i].as_py(), [], []
                for doc, ids in unpack(batch.column(1)[i].as_py()):
                    docs.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if with_ids:
                        lists.append(ids.astype(np.int64))
                columns = [pa.array(c, pa.int64()) for c in zip(*docs, strict=True)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    parts = spark.read.schema("part int, offset long").parquet(f"{folder}/parts")
    files = read_files(spark, folder).join(parts, "part")
    return files.select((F.col("offset") + F.col("before")).alias("start"), "payload").mapInArrow(tidied(decode), kinds)
