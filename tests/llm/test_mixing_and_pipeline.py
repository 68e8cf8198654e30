from collections import Counter

import duckdb

import corpus_pipeline
from mapwise.llm import mixing
from mapwise.llm.queries import SQL

from .test_decontamination import plain_distance
from .test_near_duplicates import brute


def test_mix_equals_sql(spark):
    rows = [(i, "w " * (i % 23), f"s{i % 4}") for i in range(200)]
    rows += [(i, "w " * 40, None) for i in range(200, 260)] + [(300, None, "z"), (301, "", "z"), (None, "a b c", "s1"), (5, "w " * 5, "s1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, hash int")
    found = mixing.mix_sources(docs)
    got = sorted((tuple(r) for r in found.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert got == sorted((tuple(r) for r in con.execute(SQL["op6_mix_sources"]).fetchall()), key=str)
    copies = Counter({(r.doc_id, r.size, r.source): r.copies for r in found.collect()})
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found.collect())
    assert all(copies[(r.doc_id, len((r.text or "").split()), r.source)] > 0 for r in mixed.collect())
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_rows_without_ids_are_mixed_one_by_one(spark):
    rows = [(None, f"{i} " + "w " * (i % 9 + 1), "a") for i in range(300)] + [(7, f"{i} x y", "b") for i in range(300)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    from mapwise.llm.decontamination import plain_words

    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, folder)
        if i < 4:
            assert after.columns == docs.columns
            after.write.parquet(str(tmp_path / name))
            after = spark.read.parquet(str(tmp_path / name))
        had, has = {r.doc_id: r.text for r in docs.collect()}, Counter(r.doc_id for r in after.collect())
        if name == "quality":
            good = [d for d in had if labels.get(d) == 1]
            assert sum(d in has for d in good) >= 0.97 * len(good)
        if name == "near_duplicates":
            assert set(has) == {d for d, (_, top) in brute(list(had.items()), k=5).items() if d == top}
        if name == "decontamination":
            words = {d: plain_words((t or "").encode()) for d, t in had.items()}
            wanted = [plain_words(t.encode()) for t in items]
            assert set(has) == {d for d, w in words.items() if not any(plain_distance(p, w)[0] <= int(0.15 * len(p)) for p in wanted)}
        if name == "tokens":
            assert after.count() == docs.count() and after.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        docs = after


def test_stages_act_by_row_not_by_id(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    rows = [(None, texts[0]), (1, texts[0] + " end"), (2, texts[1]), (2, texts[1]), (2, texts[1] + " end"), (None, texts[2]),
            (None, texts[2] + " end"), (None, None), (5, "")]
    kind = "doc_id long, text string"
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, kind), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 2, None, None, 5])
    assert len({r.text for r in got}) == 5
    rows = [(None, item), (3, item), (3, "clean"), (None, "clean too"), (4, None)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, kind), str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter([(3, "clean"), (None, "clean too"), (4, None)])


def test_workers_drop_what_an_earlier_stage_kept():
    from mapwise.llm import token_files, words
    from mapwise.llm.queries import TOKENIZER

    held = token_files.worker_words(TOKENIZER)
    assert token_files.worker_words(TOKENIZER) is held  # kept over the tasks of a stage
    before = len(words._KEPT)

    def run(batches):
        assert not words._KEPT  # dropped before the next stage takes memory of its own
        yield from batches

    assert before == 1 and list(words.tidied(run)(iter([1, 2]))) == [1, 2]
    assert token_files.worker_words(TOKENIZER) is not held
