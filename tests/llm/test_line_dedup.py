import random
from collections import defaultdict

from mapwise.llm import line_dedup as ld


def brute(rows, percent=80):
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [(d, n, frozenset(x.encode().split())) for d, t in docs for n, x in enumerate(t.split("\n"))]
    by_word = defaultdict(set)
    classes = {s for *_, s in lines if s}
    for s in classes:
        for w in s:
            by_word[w].add(s)
    near = {s: {o for w in s for o in by_word[w] if o != s and 100 * len(s & o) >= percent * len(s | o)} for s in classes}
    first = {}
    for i, (*_, s) in enumerate(lines):
        first.setdefault(s, i)
    out = {d: [0, [], 0] for d, _ in docs}
    for i, (d, n, s) in enumerate(lines):
        out[d][0] += 1
        if s:
            out[d][2] += len(near[s])
            if min(first[o] for o in near[s] | {s}) < i:
                out[d][1].append(n)
    found = {d: (n, len(gone), gone, links) for d, (n, gone, links) in out.items()}
    return found | {d: (0, 0, [], 0) for d, t in rows if t is None}


def collected(frame):
    return {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines, r.n_links) for r in frame.collect()}


def test_equals_brute_force(spark):
    draw = random.Random(4)
    words = [f"w{int(draw.paretovariate(0.6)) % 400}" for _ in range(3000)]
    base = [[draw.choice(words) for _ in range(draw.randint(1, 30))] for _ in range(60)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(draw.randint(1, 8)):
            own = list(draw.choice(base))
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(words)
            lines.append("  ".join(own))
        rows.append((d, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n \t"), (93, rows[0][1]), (93, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, cid int")
    got, want = collected(ld.repeated_lines(docs)), brute(rows)
    assert got == want and sum(x[1] for x in want.values()) > 50
    kept = {r.doc_id: r.text for r in ld.without_lines(docs, ld.repeated_lines(docs)).collect()}
    for d, text in rows:
        if text is not None:
            assert kept[d] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[d][2])


def test_hot_posting_lists_equal_brute_force(spark):
    draw = random.Random(6)
    rows = [(d, f"one line template of eight words with v{d} inside\nthe same head {' '.join(f'x{i}' for i in range(d % 40))} u{d % 7}")
            for d in range(150)]
    rows += [(d, " ".join(draw.sample([f"y{i}" for i in range(14)], draw.randint(5, 13)))) for d in range(200, 320)]
    docs = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert collected(ld.repeated_lines(docs, hot=10)) == want and sum(x[3] for x in want.values()) > 150 * 149
    assert collected(ld.repeated_lines(docs, percent=50, hot=6)) == brute(rows, 50)


def test_a_long_posting_list_is_passed_on_and_not_held():
    import numpy as np
    import pyarrow as pa

    n, step = 1_000_000, 10_000
    every = [(7, i // 2) for i in range(n)] + [(8, 1), (8, 1), (8, 2)]  # (token, cid); each row of the long list twice
    key, cid = (np.array(c, np.int64) for c in zip(*every, strict=True))
    key, zero = (key << ld.SIZE_BITS) | 9, np.zeros(len(key), np.int64)
    batches, read = [], 0
    for b in range(0, len(key), step):
        cut = [pa.array(c[b : b + step]) for c in (key, cid, zero, zero)]
        batches.append(pa.RecordBatch.from_arrays(cut, ["key", "cid", "place", "marks"]))

    def reading():
        nonlocal read
        for batch in batches:
            read += batch.num_rows
            yield batch

    passed, pairs = [], []
    for out in ld._met(reading(), 80, 2048):
        passed += [a for a, k in zip(out["a"].to_pylist(), out["key"].to_pylist(), strict=True) if k is not None]
        pairs += [(a, b) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True) if b is not None]
        assert read // 2 - len(passed) <= 2 * ld.TASK_ROWS
    assert passed == list(range(n // 2)) and pairs == [(1, 2)]


def test_whole_table_equals_brute_force(spark):
    from mapwise.llm.queries import op10_line_dedup

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(op10_line_dedup(spark, folder)) == brute(rows)


def test_empty_table(spark):
    assert ld.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_are_cut_as_bytes_split_cuts_them():
    draw = random.Random(9)
    texts = ["".join(draw.choice("ab \n\t\r\x0b\x0c\x00é  ") for _ in range(draw.randint(0, 60))).encode() for _ in range(300)]
    texts += [b"", b"\n", b"x" * 255, b"x" * 256 + b" " + b"x" * 257, b"y" * 1000 + b"\n" + b"y" * 1001, b"abcdefgh abcdefghi abcdefgh"]
    hashes, counts, n_lines = ld._word_hashes(texts)
    lines = [x.split() for t in texts for x in t.split(b"\n")]
    words = [w for x in lines for w in x]
    assert counts.tolist() == [len(x) for x in lines] and n_lines.tolist() == [t.count(b"\n") + 1 for t in texts]
    named = dict(zip(words, hashes.tolist(), strict=True))
    assert [named[w] for w in words] == hashes.tolist() and len(set(named.values())) == len(named)


def test_parities_fold_to_the_narrower_width():
    import numpy as np

    draw = np.random.default_rng(3)
    for n, m in ((40, 30), (70, 60), (300, 250), (5, 4)):
        own = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        other = own[: m]
        a, b = (ld._parities(x, np.array([len(x)])) for x in (own, other))
        apart = ld._differing(a, b)[0]
        assert 0 < apart <= len(own) - len(other) and (apart - len(own) + len(other)) % 2 == 0
        assert ld._differing(a, a)[0] == 0
