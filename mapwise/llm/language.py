"""Language of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mapwise.llm.subwords import WordRows, subwords
from mapwise.llm.words import slices, starts_of

#: Hashed weights per label; n-grams anywhere, and affixes at a word's ends, with its boundary marks.
BUCKETS, SIZES, AFFIXES = 1 << 17, (2, 3), (4,)
#: Distinct labelled texts to learn from (over all languages), and words of the pieces that these whole texts are cut into.
SAMPLE_TEXTS, PIECE_WORDS = 800, 8
#: Most frequent words of each language in the sample that make up its lexicon.
LEXICON = 2000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return [w for w in _LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class Field:
    """A trained field: its size is fixed by ``BUCKETS``, ``LEXICON`` and the number of labels."""

    labels: list[str]
    weights: np.ndarray  # (BUCKETS + one lexicon feature per label, labels)
    moves: np.ndarray  # (labels, labels) log weights of a step
    first: np.ndarray  # log weights of the first word
    lexicon: dict[str, int]  # word -> bit set of the languages whose lexicon has it

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owner, found = subwords(words, SIZES, AFFIXES, BUCKETS)
        extra_owner, extra = [], []
        for i, word in enumerate(words):
            bits = self.lexicon.get(word, 0)
            k = 0
            while bits:
                if bits & 1:
                    extra_owner.append(i)
                    extra.append(BUCKETS + k)
                bits, k = bits >> 1, k + 1
        owner = np.concatenate([owner, np.array(extra_owner, np.int64)])
        found = np.concatenate([found, np.array(extra, np.int64)])
        order = np.argsort(owner, kind="stable")
        return owner[order], found[order]

    def scores(self, words: list[str]) -> np.ndarray:
        """Sum of the weights of each word's features, for each label."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for begin in range(0, len(words), 20_000):
            part = words[begin : begin + 20_000]
            owner, found = self.features(part)
            out[begin : begin + len(part)] = np.add.reduceat(
                self.weights[found], np.searchsorted(owner, np.arange(len(part))), axis=0)
        return out


def forward_backward(
    scores: np.ndarray, firsts: np.ndarray, moves: np.ndarray, first: np.ndarray, step: int = 128
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward weights up to each word, backward weights after it, and its own weights, for many texts laid one after the other.

    Each row is right up to a factor. ``firsts`` marks the first word of each text; the chain starts anew there. The run
    of words is cut into equal pieces whose transfer matrices are multiplied side by side, then joined in turn, so the
    result is that of the whole sequences while the loops are over ``step`` words, not over texts.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k)), np.zeros((0, k))
    pieces = -(-n // step)
    e = np.ones((pieces * step, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    anew = np.ones(pieces * step, bool)
    anew[:n] = firsts
    e, anew = e.reshape(pieces, step, k), anew.reshape(pieces, step)
    go, start = np.exp(moves - moves.max()), np.exp(first - first.max())

    whole = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
    for t in range(step):
        on = (whole.reshape(-1, k) @ go).reshape(pieces, k, k)
        again = whole.sum(axis=2, keepdims=True) * start
        whole = np.where(anew[:, t, None, None], again, on) * e[:, t, None, :]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    into, back = np.ones((pieces, k)), np.ones((pieces, k))
    for s in range(1, pieces):
        into[s] = into[s - 1] @ whole[s - 1]
        into[s] /= into[s].sum()
    for s in range(pieces - 2, -1, -1):
        back[s] = whole[s + 1] @ back[s + 1]
        back[s] /= back[s].sum()
    ahead, behind = np.empty((pieces, step, k)), np.empty((pieces, step, k))
    now = into
    for t in range(step):
        now = np.where(anew[:, t, None], start * now.sum(axis=1, keepdims=True), now @ go) * e[:, t]
        now = now / now.sum(axis=1, keepdims=True)
        ahead[:, t] = now
    now = back
    for t in range(step - 1, -1, -1):
        behind[:, t] = now
        seen = e[:, t] * now
        now = np.where(anew[:, t, None], (seen * start).sum(axis=1, keepdims=True), seen @ go.T)
        now = now / now.sum(axis=1, keepdims=True)
    return tuple(weights.reshape(-1, k)[:n] for weights in (ahead, behind, e))


def marginals(scores: np.ndarray, firsts: np.ndarray, moves: np.ndarray, first: np.ndarray, step: int = 128) -> np.ndarray:
    """Probability of each label at each word; see ``forward_backward``."""
    ahead, behind, _ = forward_backward(scores, firsts, moves, first, step)
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True)


def slopes(
    scores: np.ndarray, firsts: np.ndarray, right: np.ndarray, moves: np.ndarray, first: np.ndarray, step: int = 128
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the negative log-likelihood of the labels ``right`` by ``scores``, ``moves`` and ``first``."""
    k = scores.shape[1]
    ahead, behind, e = forward_backward(scores, firsts, moves, first, step)
    error = ahead * behind
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(len(right)), right] -= 1
    steps = np.flatnonzero(~firsts)
    pair = ahead[steps - 1][:, :, None] * np.exp(moves - moves.max()) * (e * behind)[steps][:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    seen = np.bincount(right[steps - 1] * k + right[steps], minlength=k * k).reshape(k, k)
    return error, pair.sum(axis=0) - seen, error[firsts].sum(axis=0)


def fit(pieces: list[tuple[str, list[str]]], epochs: int = 6, length: int = 32, rate: float = 0.3, seed: int = 1) -> Field | None:
    """Train a field on (language, words) pieces; None without any.

    Pieces of all languages are shuffled into one stream and cut into sequences of ``length`` words, which switch
    language as mixed texts do, so the moves between labels are learned together with the features. Stochastic
    gradient steps (Adagrad) follow the log-likelihood by forward-backward.
    """
    pieces = sorted((p for p in pieces if p[1]), key=lambda p: (p[0], p[1]))
    if not pieces:
        return None
    labels = sorted({lang for lang, _ in pieces})
    k, number = len(labels), {lang: i for i, lang in enumerate(labels)}
    counts = [Counter() for _ in labels]
    for lang, words in pieces:
        counts[number[lang]].update(words)
    lexicon: dict[str, int] = {}
    for i, found in enumerate(counts):
        for word, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = lexicon.get(word, 0) | 1 << i
    field = Field(labels, np.zeros((BUCKETS + k, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    vocabulary = sorted({w for _, words in pieces for w in words})
    place = {w: i for i, w in enumerate(vocabulary)}
    owner, features = field.features(vocabulary)
    begins = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    draw = np.random.default_rng(seed)
    squares, move_squares, first_squares = np.full(field.weights.shape, 1e-2, np.float32), np.full((k, k), 1e-2), np.full(k, 1e-2)
    batch = 64 * length
    for _ in range(epochs):
        order = draw.permutation(len(pieces))
        stream = np.array([place[w] for i in order for w in pieces[i][1]])
        truth = np.array([number[pieces[i][0]] for i in order for _ in pieces[i][1]])
        for at in range(0, len(stream), batch):
            words, right = stream[at : at + batch], truth[at : at + batch]
            sizes = begins[words + 1] - begins[words]
            spread = np.repeat(begins[words] - starts_of(sizes), sizes) + np.arange(sizes.sum())
            used = features[spread]
            scores = np.add.reduceat(field.weights[used], starts_of(sizes), axis=0).astype(np.float64)
            firsts = np.arange(len(words)) % length == 0
            error, by_moves, by_first = slopes(scores, firsts, right, field.moves, field.first, step=length)
            slope = np.stack([np.bincount(used, np.repeat(error[:, j], sizes), len(field.weights)) for j in range(k)], 1)
            touched = np.unique(used)
            grad = (slope[touched] / length).astype(np.float32)
            squares[touched] += grad**2
            field.weights[touched] -= rate * grad / np.sqrt(squares[touched])
            grad = by_moves / max(1, len(firsts) - firsts.sum())
            move_squares += grad**2
            field.moves -= rate * grad / np.sqrt(move_squares)
            grad = by_first / firsts.sum()
            first_squares += grad**2
            field.first -= rate * grad / np.sqrt(first_squares)
    return field


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def sample_pieces(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> list[tuple[str, list[str]]]:
    """About ``texts`` / number of languages distinct whole texts of each language, cut into pieces of ``PIECE_WORDS`` words.

    Texts are counted and chosen once however often they are copied, so copies neither crowd out the other texts of a
    language nor reach the driver, and a language of few texts gives them all. The number of texts that reach the
    driver follows ``texts``, not the table.
    """
    mark = F.xxhash64("text", F.lit(17))
    marks = docs.select("lang", mark.alias("mark")).distinct()
    counts = {r["lang"]: r["n"] for r in marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = {lang: min(1.0, texts / len(counts) / n) for lang, n in counts.items()}
    parts = F.create_map(*[F.lit(x) for lang in sorted(share) for x in (lang, share[lang])])
    chance = F.pmod(mark, F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [letters(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["lang", "words"])

    rows = docs.filter(chance < parts[F.col("lang")]).select("lang", "text").distinct()
    rows = rows.mapInArrow(cut, "lang string, words array<string>").collect()
    return [(r.lang, r.words[at : at + PIECE_WORDS]) for r in rows for at in range(0, len(r.words), PIECE_WORDS)]


def label(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words): the language with the largest mean marginal over all words.

    ``score`` is that mean. A null text or one without a letter gives ``und`` and 0, as does every text where nothing
    could be learned; ties go to the label first in order. Each row is judged by itself, so repeated rows agree, and
    no column but ``doc_id`` and ``text`` is read. Texts of any length are scored whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)  # bounded: see Field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rows = WordRows(model.scores if model else None)
        for batch in batches:
            for begin, texts in slices(batch.column(1), 3_000_000):
                found = [letters(t.decode()) for t in texts]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model and counts.sum():
                    place = rows.places([w for words in found for w in words])
                    firsts = np.zeros(len(place), bool)
                    has = np.flatnonzero(counts)
                    firsts[starts_of(counts)[has]] = True
                    post = marginals(rows.table[place], firsts, model.moves, model.first)
                    mean = np.add.reduceat(post, starts_of(counts)[has], axis=0) / counts[has, None]
                    for i, best, top in zip(has.tolist(), mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                        langs[i], scores[i] = model.labels[best], min(1.0, top)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), batch.column(2).slice(begin, len(texts)),
                     pa.array(langs), pa.array(scores), pa.array(counts)],
                    ["doc_id", "held_out", "lang_pred", "score", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` that are not held out, then label every whole text (see ``label``)."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return label(docs, fit(sample_pieces(known)))


def label_words(text: str, field: Field) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text, for code-switched texts."""
    words = letters(text)
    firsts = np.zeros(len(words), bool)
    firsts[:1] = True
    post = marginals(field.scores(words), firsts, field.moves, field.first) if words else np.zeros((0, 1))
    return [(w, field.labels[p.argmax()], float(p.max())) for w, p in zip(words, post, strict=True)]
