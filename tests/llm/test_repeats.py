import hashlib
import random
from collections import Counter

import pytest

from mapwise.llm import repeats


def brute(rows, window):
    seen = Counter()
    for _, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            seen[tuple(words[i : i + window])] += 1
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, tid int")
    return sorted((tuple(r) for r in repeats.remove_repeats(docs, **more).collect()), key=str)


@pytest.mark.parametrize("group", [60_000, 1])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    draw = random.Random(3)
    common = " ".join(draw.choices("abcdefgh", k=60))
    rows = []
    for d in range(50):
        words = draw.choices([f"v{i}" for i in range(300)], k=draw.randint(0, 120))
        if d % 3 == 0:
            at = draw.randint(0, len(words))
            words[at:at] = common.split()[draw.randint(0, 20):]
        rows.append((d, " ".join(words)))
    rows += [(60, "x " * 200), (61, "a b " * 30), (62, rows[1][1]), (62, rows[1][1]), (63, None), (64, ""), (None, rows[2][1] + " end")]
    assert found(spark, rows) == brute(rows, 35)
    assert found(spark, rows, window=12, anchor=4) == brute(rows, 12)


def test_whole_table_equals_brute_force(spark):
    from mapwise.llm.queries import op7_repeated_passages

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op7_repeated_passages(spark, folder).collect()), key=str) == brute(rows, 35)


def test_empty_table(spark):
    assert found(spark, []) == []
