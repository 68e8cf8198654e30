import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from mapwise.llm import importance

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    return words, [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least):
    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    all_s, all_t = corpus.total(), wanted.total()
    rows = []
    for doc, text in docs:
        words, found = features(text)
        weight = sum(
            math.floor(1000 * math.log((wanted[b] + 1) * (all_s + 10_000) / ((corpus[b] + 1) * (all_t + 10_000))))
            for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, len(words) >= least))
    drawn = percent * sum(r[4] for r in rows) // 100
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for n, r in enumerate(order[:drawn], 1):
        ranks.setdefault(r[:4], []).append(n)
    return [(*r[:4], ranks[r[:4]].pop(0) if r[4] and ranks.get(r[:4]) else None) for r in rows], drawn


def found(spark, docs, target, **more):
    rows = spark.createDataFrame([(d, t, 7, 8) for d, t in docs], "doc_id long, text string, part int, score int")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    return [tuple(r) for r in importance.resample(rows, items, **more).collect()]


def key(row):
    return tuple((v is None, v or 0) for v in row)


def test_equals_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "ÉTÉ", "naïve", "文字", "A1", "x-y", "don't"]
    docs = [(d, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for d in range(200)]
    docs += [(300, None), (301, ""), (302, "!!! ---"), (303, "one"), (304, "one two"), (None, docs[3][1]), (None, docs[4][1])]
    docs += [(305, "word " * 3000 + "z" * 2000 + " " + "q" * 900), (306, "\x00\x7f\x80 � end"), docs[7], docs[7]]
    target = [" ".join(draw.choices(vocabulary[:20], k=30)) for _ in range(12)] + [None, ""]
    want, drawn = brute(docs, target, 20, 20)
    got = found(spark, docs, target, percent=20)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert drawn > 20 and sorted(r[4] for r in got if r[4]) == list(range(1, drawn + 1))


def test_repeated_rows_take_one_rank_each(spark):
    docs = [(9, "same words of every text " * 6)] * 30 + [(None, "same words of every text " * 6)] * 10
    got = found(spark, docs, ["same words"], percent=50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21)) and len(got) == 40
    assert sorted(got, key=key) == sorted(brute(docs, ["same words"], 50, 20)[0], key=key)


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    rows = found(spark, [(1, "a b c " * 10)], [], percent=100)
    assert len(rows) == 1 and rows[0][4] == 1


def test_pieces_do_not_change_the_features(monkeypatch):
    texts = [b"a b c d e f g", b"", b"x", b"y z", b"b c d " * 20]
    def counted():
        out = Counter()
        for text, bucket in importance.feature_buckets(texts, importance.WordNumbers()):
            out.update(zip(text.tolist(), bucket.tolist(), strict=True))
        return out
    whole = counted()
    monkeypatch.setattr(importance, "CHUNK_WORDS", 3)
    assert counted() == whole
    want = Counter((i, b) for i, t in enumerate(texts) for b in features(t.decode())[1])
    assert whole == want


def test_matrix_crc_equals_zlib():
    draw = random.Random(1)
    strings = [draw.randbytes(draw.choice([1, 2, 2, 3, 7, 399, 400, 1000])) for _ in range(300)]
    buffer = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    got = importance.crc32_of(buffer, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [zlib.crc32(s) for s in strings]
