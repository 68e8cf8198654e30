import random
from collections import Counter, defaultdict

from mapwise.llm import near_duplicates as nd


def brute(rows, k=4, percent=80):
    """(n_shingles, component) of each document, by an inverted index and union-find."""
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        common = Counter(e for g in s for e in holders[g])
        for g in s:
            holders[g].append(d)
        for e, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_equals_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [draw.choices(vocabulary, k=draw.randint(1, 120)) for _ in range(12)]
    rows = []
    for d in range(150):
        own = list(base[d % 12])
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        rows.append((d, " ".join(own).upper() if d % 5 == 0 else "\t".join(own)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a"), (204, "A"), (205, rows[7][1])]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, cid int, n int")
    docs = docs.union(docs.filter("doc_id = 205")).union(spark.createDataFrame([(None, "null id", 1, 2)], docs.schema))
    got = nd.near_duplicates(docs, words=4).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_blocks_of_few_classes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "BUCKET_BLOCK", 4)
    draw = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(60):  # changes at a few places, so that copies of different leaders are linked late
        own = list(base)
        for _ in range(draw.randint(3, 7)):
            own[draw.randrange(len(own))] = f"v{draw.randrange(40)}"
        rows.append((d, " ".join(own)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 1
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got) and len(got) == 60


def test_a_row_without_id_links_two_documents(spark):
    words = [f"w{i}" for i in range(100)]
    far = [f"x{i}" for i in range(100)]
    bridge, one, two = words[:], ["p"] * 8 + words[8:], words[:92] + ["q"] * 8
    rows = [(1, " ".join(one)), (2, " ".join(two)), (None, " ".join(bridge)), (3, " ".join(far)), (None, " ".join(far[:96]))]
    assert [nd_top for _, nd_top in brute([(9 if d is None else d, t) for d, t in rows[:3]]).values()] == [1, 1, 1]
    assert [nd_top for _, nd_top in brute(rows[:2]).values()] == [1, 2]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r.component_id, r.doc_id or 0, r.kept) for r in got) == [
        (1, 0, False), (1, 1, True), (1, 2, False), (3, 0, False), (3, 3, True)]


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
