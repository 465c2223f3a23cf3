from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortcast.llm import alignment
from cohortcast.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PATHS = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")
LETTERS = {c: b for c, b in alignment.Tokens._byte_letters().items()}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_groups(text, libraries):
    """Groups of (ids of A, ids of B), token by token."""
    a, b = libraries
    if not text:
        return []
    data = (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False)
    y = b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in t) for t in x.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
    if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return []
    ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        out.append((x.ids[i:k], y[j:m]))
        i, j = k, m
    return out


def brute(rows, libraries):
    all_groups, counts = [], Counter()
    for _, text in rows:
        groups = plain_groups(text, libraries)
        all_groups.append(groups)
        counts.update({(p, q) for a, b in groups for p in a for q in b})
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for (i, _), groups in zip(rows, all_groups, strict=True):
        links = [(p, q) for a, b in groups for p in a for q in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def odd_texts():
    return [
        None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\ta b　c", "<|endoftext|> x", "<s> </s> <unk> <0x41>", "a▁b c",
        "한국어 문장 하나", "日本語の文章です。空白がない", "é é ﬁ ​ x", "😀 😀😀 \U0001F9D1‍\U0001F680", "\x00\x01 a\x7f", "don't  we'll I'm",
        "word " * 3000, "x" * 9000, " " * 5000, "日" * 4000, "1234567890" * 700, "the same words again and again", "the same words again and again",
    ]


@pytest.mark.parametrize("piece, block", [(1 << 13, 1 << 23), (7, 900), (64, 20_000)])
def test_equals_brute_force(spark, libraries, piece, block):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(odd_texts())]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, block int, n_a int, place string").repartition(3)
    got = alignment.align_tokens(df, *PATHS, piece=piece, block_bytes=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, libraries)


def test_batches_and_wide_groups(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE_GROUP", 2)
    texts = odd_texts()
    code = alignment.Tokens(*PATHS)
    columns, digests, text, pair, times = alignment.Aligner(code, 11).align(texts)
    want = brute(list(enumerate(texts)), libraries)
    assert sorted(((i, *(int(c[i]) for c in columns), digests[i]) for i in range(len(texts))), key=repr) == [(r[0], *r[1:5], r[7]) for r in want]
    links = Counter()
    for t, p, n in zip(text.tolist(), pair.tolist(), times.tolist(), strict=True):
        links[t, *divmod(p, code.b.get_piece_size())] += n
    assert links == Counter((i, p, q) for i, t in enumerate(texts) for a, b in plain_groups(t, libraries) for p in a for q in b)


def test_full_cache_starts_anew(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_UNITS", 3)
    aligner = alignment.Aligner(alignment.Tokens(*PATHS))
    for _ in range(3):
        columns, digests, *_ = aligner.align(["one two three four five", "two six"])
        assert [len(plain_groups(t, libraries)) for t in ("one two three four five", "two six")] == columns[2].tolist()
        assert len(set(digests)) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tab.é日▁0'<|s>"), max_size=30), min_size=1, max_size=5))
def test_any_text(libraries, texts):
    if not hasattr(test_any_text, "aligner"):
        test_any_text.aligner = alignment.Aligner(alignment.Tokens(*PATHS), 5)
    columns, digests, *_ = test_any_text.aligner.align(texts)
    want = {r[0]: r for r in brute(list(enumerate(texts)), libraries)}
    for i in range(len(texts)):
        assert (*(int(c[i]) for c in columns), digests[i]) == (*want[i][1:5], want[i][7])


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(1, 9))
def test_merge_path(a, b, piece):
    x, y = np.array(sorted(a), dtype=np.int64), np.array(sorted(b), dtype=np.int64)
    i, j = alignment.diagonals(x, y, piece)
    assert i[-1] == len(x) and j[-1] == len(y)
    if len(x) + len(y):
        work = np.diff(i) + np.diff(j)
        assert work.max() <= piece + 1 and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
    cut_a, cut_b = alignment.common_cuts(x, y, piece)
    assert x[cut_a].tolist() == y[cut_b].tolist() == sorted(a & b)


@given(st.lists(st.dictionaries(st.integers(0, 40_000), st.integers(1, 300), max_size=20), max_size=8))
def test_links_round_trip(rows):
    block = alignment.Block()
    triples = [(t, p, n) for t, links in enumerate(rows) for p, n in sorted(links.items())]
    arrays = [np.array([x[k] for x in triples], dtype=np.int64) for k in range(3)]
    block.add(1, len(rows), *arrays)
    pairs, counts, data = block.close()
    text, place, times = alignment.text_links(data)
    assert sorted(zip(text.tolist(), pairs[place].tolist(), times.tolist(), strict=True)) == triples
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == Counter(p for links in rows for p in links)


def test_empty_table(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_token_alignment"](spark, SF_DIR).collect()), key=repr) == brute(rows, libraries)
