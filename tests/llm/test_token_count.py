from __future__ import annotations

import random

import public_tokenizers as tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortcast.llm.queries import QUERIES
from cohortcast.llm.token_count import Counter, count_tokens

PATH = tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SMALL = Counter(PATH, chunk=64, overlap=8)
PARTS = ["the ", "  ", "\n", "é", "日本語", "🙂", "aaaa", "x" * 50, "▁", "<s>", "á", " \t ", "hello world "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=12)), max_size=80))
def test_spliced_counts_equal_the_whole(parts):
    text = "".join(parts)
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert SMALL.long_count(text) == len(LIBRARY.encode(text)) if text else True


def test_widening_and_growing():
    counter = Counter(PATH, chunk=64, overlap=4)
    for text in ("a" * 5000, "ab" * 3000 + " end", " " * 3000, "thing " * 900, "\n" * 999):
        assert counter.long_count(text) == len(LIBRARY.encode(text))
    assert counter.widened > 0


def test_frame(spark):
    words = ["the", "tion", "é", "日本", "x1", "\n"]
    long = " ".join(random.Random(3).choices(words, k=200_000))
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 0), (2, "", 0), (3, long, 1), (4, "z" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, count_tokens(df, PATH).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 4096) for i, t, _ in rows), key=repr)
    assert got == want
    assert count_tokens(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].n_tokens == len(LIBRARY.encode(d.text or ""))
