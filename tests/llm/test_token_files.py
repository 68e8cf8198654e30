import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mapwise.llm import token_files as tf
from mapwise.llm.queries import TOKENIZER

TEXTS = {
    1: "Hello, World!! it's Café Été. naïve", 2: None, 3: "", 4: "  \t\n ", 5: "İstanbul ΣΣ ẞ ǅ éclair",
    6: "a b c <|endoftext|>x it'll 'S ''s 12² Ⅷ x_y __ 你好。 \U0001f600!! ­​", 7: "WORD.*** $$$ ### über.%%% größe, ſo ªº",
    8: "x" * 5000 + " " + "y!" * 300, 9: "\x1c\x85 a\x1fb ﬁ Å", 10: "don't we've I'm you'd they're O'S|a|b ",
}


PLAIN = Tokenizer.from_file(TOKENIZER)


def expected(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip_equals_plain_encoding(spark, tmp_path, bits):
    rows = [(i, t, "x", 1) for i, t in TEXTS.items()] + [(None, "no id", "x", 1), (4, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    tf.write_tokens(docs, str(tmp_path / "t"), TOKENIZER, block=64, file_ids=100, bits=bits)
    got = tf.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got.sort(key=lambda r: r.start)
    start = 0
    assert len(got) == len(order)
    for row, (doc, text, *_) in zip(got, order, strict=True):
        ids = expected(text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc, start, len(ids), ids), text
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write_tokens(docs, str(tmp_path / "t"), TOKENIZER)
    assert tf.read_tokens(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    ids = np.array([0, 1, 2**32 - 1, 49407, 7, 256, 65536], np.uint32)
    assert (tf.from_planes(tf.to_planes(ids, bits), len(ids), bits) == ids).all()


def test_whole_table_equals_plain_encoding(spark):
    from mapwise.llm.queries import op3_token_files

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op3_token_files(spark, folder).collect()}
    start = 0
    for row in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = expected(row.text)
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens) == (start, len(ids))
        assert got[row.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
