import random

from mapwise.llm import decontamination as dc


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t)))
    return min(row), row.index(min(row))


def test_myers_equals_plain_distance():
    draw = random.Random(1)
    for _ in range(400):
        a = [draw.choice("abc") for _ in range(draw.randint(1, 90))]
        b = [draw.choice("abc") for _ in range(draw.randint(0, 60))]
        assert dc.myers(a, b) == plain_distance(a, b)


def brute(docs, items):
    found = set()
    for doc, text in docs:
        words = dc.plain_words((text or "").encode())
        for item, own in items:
            pattern = dc.plain_words((own or "").encode())
            if pattern and (d := plain_distance(pattern, words)[0]) <= int(0.15 * len(pattern)):
                found.add((doc, item, d))
    return found


def test_equals_brute_force(spark):
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(8, 40)))) for i in range(8)] + [(8, None), (9, ""), (10, "!!"), (0, "w1 w2 w3")]
    docs = []
    for d in range(60):
        words = draw.choices(vocabulary, k=draw.randint(0, 80))
        own = items[d % 8][1].split()
        for _ in range(d % 7):
            at = draw.randrange(len(own))
            own[at : at + 1] = draw.choice([[], ["x"], [own[at], "y"]])
            own = own or ["z"]
        at = draw.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + own + words[at:]).upper() + " !!."))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, distance int")
    for size in (1 << 20, 300):
        got = {(r.doc_id, r.item_id, r.distance) for r in dc.contaminated(frame, bench, index_bytes=size).collect()}
        want = brute(docs, items)
        assert got == want and len(want) > 30


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, bench).count() == 0
