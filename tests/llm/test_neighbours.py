import math

import numpy as np

from mapwise.llm import neighbours


def exact(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q, a in good.items():
        if q % every == 0:
            hits = sorted((-float(a @ b), i) for i, b in good.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in hits[:k]]
    return out


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int")
    out = {}
    for r in sorted(neighbours.nearest(frame, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_ties_copies_and_bad_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, rows[40][1]) for i in range(60, 130)]  # many copies, queries among them
    rows += [(200, None), (201, []), (220, [0.0] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6),
             (280, [float("inf")] * 6), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (None, rows[0][1]), rows[3], rows[3]]
    got, want = found(spark, rows, shard=30, block=4), exact(rows)
    assert got.keys() == {q for q, hits in want.items() if hits}
    for q, hits in got.items():
        assert [i for i, _ in hits] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in hits], [s for _, s in want[q]], rtol=1e-12)


def test_recall_on_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect()]
    got, want = found(spark, rows, shard=500), exact(rows)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in hits}) for q, hits in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_recall_on_uneven_norms(spark):
    draw = np.random.default_rng(7)
    vectors = draw.normal(size=(4000, 64)) * np.exp(draw.normal(size=(4000, 1)))
    rows = list(enumerate(vectors.tolist()))
    got, want = found(spark, rows), exact(rows)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in hits}) for q, hits in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_recall_on_one_long_vector_and_on_far_groups():
    draw = np.random.default_rng(8)
    long = draw.normal(size=(3000, 32))
    long[5] *= 1e5
    far = draw.normal(size=(3000, 32)) * 0.01 + draw.normal(size=(30, 32))[np.arange(3000) % 30]
    for vectors in (long.astype(np.float32), far.astype(np.float32)):
        queries = vectors[::10]
        got = neighbours.answers(vectors, neighbours.build(vectors), queries, 21)
        want = np.argsort(-(queries.astype(np.float64) @ vectors.T.astype(np.float64)), axis=1)[:, :21]
        assert sum(len(np.intersect1d(a, b)) for a, b in zip(got, want, strict=True)) >= 0.9 * want.size


def test_empty_table(spark):
    assert found(spark, []) == {}
