from pyspark.sql import functions as F

from mapwise.llm import language, quality

FOLDER = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "12 ²³ !!", None), (None, "the and of", None), (9004, "x" * 50000, None)]
    every = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.identify(every.withColumn("score", F.lit("clash"))).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (9001, 9002, 9003))
    assert got[9004].lang_pred != "und" and None in got
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 100


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    draw = np.random.default_rng(1)
    scores, moves, first = draw.normal(size=(5, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    got = language.marginals(scores, np.array([1, 0, 0, 1, 0], bool), moves, first, step=2)
    for begin, end in ((0, 3), (3, 5)):
        total, want = 0.0, np.zeros((end - begin, 3))
        for path in itertools.product(range(3), repeat=end - begin):
            weight = np.exp(first[path[0]] + sum(scores[begin + i, y] for i, y in enumerate(path))
                            + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for i, y in enumerate(path):
                want[i, y] += weight
        assert np.allclose(got[begin:end], want / total)


def test_slopes_equal_finite_differences():
    import itertools

    import numpy as np

    draw = np.random.default_rng(2)
    values = [draw.normal(size=(7, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)]
    firsts, right = np.array([1, 0, 0, 0, 1, 0, 0], bool), draw.integers(0, 3, 7)

    def loss(scores, moves, first):
        total = 0.0
        for begin, end in ((0, 4), (4, 7)):
            weigh = lambda path: (first[path[0]] + sum(scores[begin + i, y] for i, y in enumerate(path))
                                  + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            every = [weigh(path) for path in itertools.product(range(3), repeat=end - begin)]
            total += np.log(np.exp(every).sum()) - weigh(right[begin:end].tolist())
        return total

    got = language.slopes(values[0], firsts, right, values[1], values[2], step=2)
    for which, slope in enumerate(got):
        for at in np.ndindex(slope.shape):
            ends = []
            for shift in (1e-5, -1e-5):
                moved = [v.copy() for v in values]
                moved[which][at] += shift
                ends.append(loss(*moved))
            assert abs((ends[0] - ends[1]) / 2e-5 - slope[at]) < 1e-6


def test_copies_neither_hide_a_language_nor_come_more_than_once(spark):
    rows = [("de", "der hund und die katze")] * 3000 + [("en", f"the dog number {'x' * (i % 50)}{i} and the cat") for i in range(3000)]
    rows += [("fr", "le chien et le chat " * 2000)]
    pieces = language.sample_pieces(spark.createDataFrame(rows, "lang string, text string"), texts=200)
    words = {lang: [w for own, piece in pieces if own == lang for w in piece] for lang in ("de", "en", "fr")}
    assert words["de"] == ["der", "hund", "und", "die", "katze"] and words["fr"] == ["le", "chien", "et", "le", "chat"] * 2000
    assert 30 < words["en"].count("dog") < 120
    assert language.fit(pieces).labels == ["de", "en", "fr"]


def test_words_of_mixed_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang is not null")
    field = language.fit(language.sample_pieces(docs.select("lang", "text")))
    one = {r.lang: " ".join(language.letters(r.text)[:12]) for r in docs.filter("lang in ('en', 'de')").collect()}
    found = language.label_words(f"{one['en']} {one['de']}", field)
    assert sum(y == "en" for _, y, _ in found[:12]) >= 10 and sum(y == "de" for _, y, _ in found[12:]) >= 10


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "x"), (9003, "word " * 30000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.rate_documents(docs.select("doc_id", "text").union(odd), labels).collect()}
    assert got[9001].score == got[9002].score and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held) > 50


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    assert {r.score for r in quality.rate_documents(docs, labels).collect()} == {0.5}
    assert quality.keep_good(docs, labels).count() == 2
    assert language.identify(docs.filter("false")).count() == quality.rate_documents(docs.filter("false"), labels).count() == 0
