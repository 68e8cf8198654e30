import random

import numpy as np
import pytest

from mapwise.llm import token_counts
from mapwise.llm.queries import BYTE_TOKENIZER, op12_token_counts

EDGES = [
    "", "a", " ", "  ", "\n", "a  b", "a \n b", "don't", "DON'T", "'s", "''s", " 's", "x'll've're'd'm't's", "'l", "'r e", "a'",
    "  \n\n  ", " a", "　　x", "1a2", "½x", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext", "é", "日本語テキスト",
    "á", "🙂🙂x", "\x00\x01", "\x00", "'ll's", "!'s's", "' s", "\x85\xa0", "a" * 3000, "ab" * 900, "the" * 700, "\n" * 3000 + "a", "=" * 999,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_TOKENIZER)


@pytest.fixture(scope="module")
def counted():
    return token_counts.CountedTexts(
        BYTE_TOKENIZER, token_counts.kind_runs(BYTE_TOKENIZER), token_counts.special_strings(BYTE_TOKENIZER))


def lengths(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def drawn():
    draw = random.Random(4)
    letters = ["".join(draw.choices("abcdehilnorst", k=draw.randint(0, 50))) for _ in range(800)]
    marks = ["".join(draw.choices(" '\n\tstmdrevlab1!é 日", k=draw.randint(0, 40))) for _ in range(1500)]
    every = ["".join(chr(draw.choice([draw.randint(0, 0x2FF), draw.randint(0, 0xD7FF), draw.randint(0xE000, 0x10FFFF)]))
                     for _ in range(30)) for _ in range(800)]
    return EDGES + letters + marks + every


@pytest.mark.parametrize("chunk", [512, 3])
def test_counts_equal_the_tokenizer(tokenizer, counted, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    texts = drawn()
    assert counted.of([t.encode() for t in texts]).tolist() == lengths(tokenizer, texts)


def test_a_table_that_fills_up_is_made_anew(tokenizer):
    runs, special = token_counts.kind_runs(BYTE_TOKENIZER), token_counts.special_strings(BYTE_TOKENIZER)
    small = token_counts.CountedTexts(BYTE_TOKENIZER, runs, special)
    small.counter = token_counts.Counter(BYTE_TOKENIZER, slots=1 << 9)
    draw = random.Random(2)
    texts = drawn()[:400] + ["".join(draw.choices("abcdehilnorst", k=3000))]
    assert small.of([t.encode() for t in texts]).tolist() == lengths(tokenizer, texts)
    assert small.counter.used <= 1 << 8


def test_pieces_equal_the_splitter(tokenizer, counted):
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for text in [t for t in drawn() if t and "<|" not in t][::7]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbol = token_counts.symbols(counted.kinds[points], points, np.zeros(len(points), bool))
        for chunk in (1, 2, 5, 1000):
            found = np.flatnonzero(token_counts.piece_starts(symbol, chunk)).tolist()
            assert found == [first for _, (first, _) in split(text)]


def test_scan_composes_the_maps():
    draw = np.random.default_rng(3)
    maps = draw.integers(0, 8, (37, 8)).astype(np.uint8)
    states, state = [], token_counts.DONE
    for own in maps:
        states.append(state)
        state = int(own[state])
    assert token_counts.scanned(maps).tolist() == states


def test_query_equals_the_tokenizer_on_the_whole_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()), n, n > 512)
            for r, n in zip(rows, lengths(tokenizer, [r.text or "" for r in rows]), strict=True)]
    assert sorted(tuple(r) for r in op12_token_counts(spark, folder).collect()) == sorted(want)


def test_nulls_repeated_rows_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x y", 5), (3, "x y", 5), (4, "word " * 600, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, BYTE_TOKENIZER).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (3, 3, 2, False), (3, 3, 2, False),
                          (4, 3000, 601, True)], key=str)
    assert token_counts.count_tokens(docs.limit(0), BYTE_TOKENIZER).collect() == []
