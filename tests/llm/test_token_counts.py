import random
import re

import public_tokenizers
import pytest

from conceptile.llm.token_counts import PLAIN, VOCABULARY, Encoder, op4_token_counts, resync_count


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_tokenizers.path(VOCABULARY))


def library(encoder, text):
    return len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_whole_table_against_the_library(spark, sf_dir, encoder):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len(r.text.encode()), library(encoder, r.text)) for r in rows}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in op4_token_counts(spark, sf_dir).collect()}
    assert got == want


def test_spliced_chunks_equal_the_whole(encoder):
    rng = random.Random(5)
    parts = [*"abz A.!\n\t '019é", "  ", "<|endoftext|>", "<|", "'re", " the", "日本", " ", " ", "🙂", "²"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))
        assert encoder.total(text) == library(encoder, text)
        assert resync_count(text, encoder.pieces, rng.randint(21, 90), rng.randint(1, 20), 16) == library(encoder, text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "é" * 3000 + "!" * 3000, "ab\n" * 4000, "<|endoftext|>" * 300, "日" * 2000])
def test_overlaps_widen_until_chunks_align(encoder, text):
    assert resync_count(text, encoder.pieces, 200, 16) == library(encoder, text)


def test_every_plain_character_is_cut_as_the_library_does(encoder):
    for c in filter(PLAIN.fullmatch, map(chr, range(0x2100))):
        for text in (c, f"a{c}b", f" {c} ", f"1{c}{c}", f"!{c}"):
            assert encoder.total(text) == library(encoder, text), repr(text)


def test_null_empty_long_and_repeated(spark, docs, table_dir, encoder):
    long = "word and other words, " * 9000
    rows = [(1, None), (2, ""), (3, "x <|endoftext|> y"), (3, "x <|endoftext|> y"), (None, long)]
    got = op4_token_counts(spark, table_dir(documents=docs(rows, ["n_tokens", "n_bytes"]))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or 0, len((t or "").encode()), n := library(encoder, t or ""), n > 1024) for i, t in rows)
    assert op4_token_counts(spark, table_dir(documents=docs([]))).collect() == []


def test_one_huge_piece_is_not_encoded_again_and_again():
    """A piece longer than many chunks: what is encoded in all is a few times its size."""
    read = 0

    def pieces(text):
        nonlocal read
        read += len(text)
        ends = [m.end() for m in re.finditer(r"a+|.", text)]
        return ends, [1] * len(ends)

    text = "b" * 500 + "a" * 200_000 + "b" * 500
    assert resync_count(text, pieces, chunk=100, overlap=16, margin=8) == 1001 and read < 8 * len(text)
