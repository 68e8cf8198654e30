"""Quality of documents by supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mapwise.llm.subwords import WordRows, subwords
from mapwise.llm.words import mixed, slices, starts_of, tidied

#: Hashed vectors and their length; character n-grams of each word; all taken with the word's own case and marks.
BUCKETS, DIM, SIZES, AFFIXES = 1 << 17, 12, (3,), (2, 4)
#: The feature of a word that stands next to itself; other word pairs are hashed.
AGAIN = 0
#: Labelled documents to learn from for each label, and the pieces taken evenly over the whole of each.
SAMPLE_DOCS, PIECES, PIECE_WORDS = 1500, 8, 20
#: Steps of the vectors against those of the output: a feature gets only its share of a document's mean.
VECTOR_RATE = 20
#: Documents scoring less are not predicted good.
THRESHOLD = 0.7


@dataclass
class Embeddings:
    """Learned vectors, the softmax weights over them, and its bias. Sizes are fixed by the parameters above."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """What each hashed vector adds to the log odds of label 1: the mean over a text commutes with the output."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)


def pairs(codes: np.ndarray) -> np.ndarray:
    """Feature of each word and the next; ``codes`` are the words' own features."""
    left, right = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    found = mixed(left * np.uint64(BUCKETS) + right + np.uint64(5)) % np.uint64(BUCKETS)
    return np.where(left == right, AGAIN, found.astype(np.int64))


def document_features(words: list[str]) -> np.ndarray:
    """Hashed character n-grams, words and word pairs of a text."""
    if not words:
        return np.zeros(0, np.int64)
    owner, found = subwords(words, SIZES, AFFIXES, BUCKETS)
    codes = found[np.searchsorted(owner, np.arange(1, len(words) + 1)) - 1]
    return np.concatenate([found, pairs(codes)])


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[int, list[str]]], epochs: int = 5, batch: int = 16, rate: float = 0.5, seed: int = 1) -> Embeddings | None:
    """Train on (label, words) rows by stochastic gradient descent; None without any.

    A document is the mean of the vectors of all features of its words; the
    sample has as many of either label where there are enough, so the rarer one is learned, too.
    """
    rows = sorted(rows)
    if not rows:
        return None
    draw = np.random.default_rng(seed)
    model = Embeddings(draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2)), np.zeros(2))
    docs = [document_features(words) for _, words in rows]
    truth = np.array([y for y, _ in rows])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = draw.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.array([len(docs[i]) for i in own])
            used = np.concatenate([docs[i] for i in own])
            doc = np.repeat(np.arange(len(own)), sizes)
            mean = np.zeros((len(own), DIM))
            has = np.flatnonzero(sizes)
            if len(has):
                mean[has] = np.add.reduceat(model.vectors[used], starts_of(sizes)[has], axis=0) / sizes[has, None]
            error = softmax(mean @ model.output + model.bias)
            error[np.arange(len(own)), truth[own]] -= 1
            back = (error @ model.output.T) / np.maximum(sizes, 1)[:, None]
            model.output -= step * mean.T @ error
            model.bias -= step * 0.1 * error.mean(axis=0)
            touched, at_of = np.unique(used, return_inverse=True)
            slope = np.stack([np.bincount(at_of, back[doc, j], len(touched)) for j in range(DIM)], 1)
            model.vectors[touched] -= (step * VECTOR_RATE * slope).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def sample_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> list[tuple[int, list[str]]]:
    """About ``most`` labelled documents of each label, chosen by a hash of the id before any text is read: (label, words).

    Labels other than 0 and 1 are ignored; a document with both is not learned from.
    """
    known = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for y in sorted(counts) for x in (y, min(1.0, most / counts[y]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(chance < share[F.col("label")])  # about 2 * most rows at any size of the table

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                words = text.encode().split()
                if len(words) > PIECES * PIECE_WORDS:
                    room = len(words) - PIECE_WORDS
                    begins = [room * i // (PIECES - 1) for i in range(PIECES)]
                    words = [w for at in begins for w in words[at : at + PIECE_WORDS]]
                found.append([w.decode() for w in words])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string()))], ["label", "words"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(tidied(cut), "label int, words array<string>")
    return [(r.label, r.words) for r in rows.collect()]


def _sent(docs: DataFrame, model: Embeddings | None):
    """The model as one number per hashed feature (512 KB): the mean of vectors and the output layer are both linear."""
    sent = None if model is None else (model.table(), float(model.bias[1] - model.bias[0]))
    return docs.sparkSession.sparkContext.broadcast(sent)


def _scorer(sent):
    """A function from UTF-8 texts to scores, with a bounded memory of words."""
    table, bias = sent or (np.zeros(BUCKETS, np.float32), 0.0)

    def rows(words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), 3))
        for begin in range(0, len(words), 20_000):
            part = [w.decode() for w in words[begin : begin + 20_000]]
            owner, found = subwords(part, SIZES, AFFIXES, BUCKETS)
            at = np.searchsorted(owner, np.arange(len(part) + 1))
            out[begin : begin + len(part), 0] = np.add.reduceat(table[found], at[:-1])
            out[begin : begin + len(part), 1] = np.diff(at)
            out[begin : begin + len(part), 2] = found[at[1:] - 1]
        return out

    cache = WordRows(rows)

    def scores(texts: list[bytes]) -> np.ndarray:
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = text.split()
            counts[i] = len(own)
            words += own
        odds = np.full(len(texts), bias)
        has = np.flatnonzero(counts)
        if len(has):
            place = cache.places(words)
            begins, row = starts_of(counts)[has], cache.table[place]
            follows = np.ones(len(row), bool)
            follows[begins] = False
            row[1:, 0] += np.where(follows[1:], table[pairs(row[:, 2].astype(np.int64))], 0)
            row[:, 1] += follows
            sums = np.add.reduceat(row[:, :2], begins, axis=0)
            odds[has] += sums[:, 0] / sums[:, 1]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    return scores


def score(docs: DataFrame, model: Embeddings | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; ``score`` is the probability of label 1.

    A text without words, or null, is scored by the bias alone; where nothing could be learned, all score 0.5. Each row
    is judged by itself, and only ``doc_id`` and ``text`` are read.
    """
    shared = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            for begin, texts in slices(batch.column(1), 3_000_000):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), batch.column(2).slice(begin, len(texts)), pa.array(scores(texts))],
                    ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all columns, in one pass; all rows where nothing can be learned."""
    model = fit(sample_rows(docs, labels))
    if model is None:
        return docs
    shared, place = _sent(docs, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            found = [scores(texts) for _, texts in slices(batch.column(place), 3_000_000)]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(tidied(run), docs.schema)


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn quality from the labelled rows that are not held out, then score every document (see ``score``)."""
    return score(docs, fit(sample_rows(docs, labels)))
