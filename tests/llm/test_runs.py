import hashlib
import random
import zlib

import numpy as np
import pytest

from mapwise.llm import runs


def brute(words, least=6, periods=4):
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def drawn_texts(draw):
    texts = []
    for _ in range(draw.randint(1, 5)):
        kinds, n = draw.choice([1, 2, 3]), draw.randint(0, 60)
        words = [draw.randrange(kinds) for _ in range(n)]
        if draw.random() < 0.5 and n:
            a, p = draw.randrange(n), draw.randint(1, 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(words * draw.choice([1, 1, 1, 2, 5]))
    return texts


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (10, 3)])
def test_runs_equal_brute_force(least, periods):
    draw = random.Random(least)
    for _ in range(400):
        texts = drawn_texts(draw)
        numbers = np.array([w for t in texts for w in t], np.int64)
        got = runs.find_runs(numbers, np.array([len(t) for t in texts]), least, periods)
        assert [got.get(i, []) for i in range(len(texts))] == [brute(t, least, periods) for t in texts]


def test_suffixes_are_sorted_and_their_common_prefixes_exact():
    draw = random.Random(9)
    for _ in range(200):
        words = [draw.randrange(2) for _ in range(draw.randint(1, 50))]
        n = len(words)
        got = runs.Sorted(np.array(words), np.zeros(n, np.int64), np.full(n, n), 5)
        places = got.places.tolist()
        assert places == sorted(places, key=lambda i: words[i:])
        for a, b, common in zip(places, places[1:], got.common.tolist()[1:], strict=False):
            want = next((k for k in range(n) if max(a, b) + k >= n or words[a + k] != words[b + k]), n)
            assert common == want


def test_places_skip_equal_left_words():
    draw = random.Random(6)
    left = np.array([draw.randrange(3) for _ in range(80)])
    order = draw.sample(range(80), 60)
    held = runs.Places(order[0])
    for x in order[1:]:
        held.add(x, left)
    assert held.places == sorted(order)
    for x in set(range(80)) - set(order):
        want = [y for y in held.places if abs(x - y) <= 9 and left[y] != left[x]]
        assert sorted(held.others(x, 9, left)) == want


def test_long_periodic_texts_take_a_bounded_number_of_steps():
    n = 100_000
    for words in (np.zeros(n, np.int64), np.arange(n) % 2, np.arange(n) % 900):
        (found,) = runs.find_runs(words, np.array([n])).values()
        assert found == [(0, n, len(np.unique(words)))]


def expected(rows, tail=False):
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc).encode())
        if tail and doc is not None and n and h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        milli = 1000 * best[1] // best[2] if found else None
        out.append((doc, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_nulls_repeated_rows_clashing_columns_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (None, "x " * 9), (3, "a b " * 5 + "c"), (3, "a b " * 5 + "c"), (4, "one two three"),
            (5, "k " * 6 + "z " + "a b c " * 4), (6, "w " * 30_000), (7, " ".join(f"v{i % 7000}" for i in range(29_000)))]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_runs int")
    got = runs.collapse_runs(docs).drop("n_words")
    short = got.filter("doc_id is null or doc_id < 6")
    assert sorted((tuple(r) for r in short.collect()), key=str) == expected([r for r in rows if r[0] not in (6, 7)])
    long = {r.doc_id: r for r in got.filter("doc_id in (6, 7)").collect()}
    assert (long[6].start, long[6].length, long[6].period) == (0, 30_000, 1)
    assert (long[7].start, long[7].length, long[7].period, long[7].exponent_milli) == (0, 29_000, 7000, 4142)
    assert runs.collapse_runs(docs.limit(0)).collect() == []


def test_runs_and_texts_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "Go go go go go go go on\tand on")], "doc_id long, text string")
    (row,) = runs.collapse_runs(docs, with_text=True).collect()
    assert row.collapsed == "Go go on and on" and [tuple(r) for r in row.runs] == [(1, 6, 1)]


def test_query_equals_brute_force_on_the_whole_table(spark):
    from mapwise.llm.queries import op13_periodic_runs

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, folder).collect()), key=str)
    assert got == expected(rows, tail=True) and any(r[1] for r in got)
