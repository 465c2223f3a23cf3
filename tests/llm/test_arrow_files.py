from __future__ import annotations

import glob
import zlib

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortcast.llm import arrow_files
from cohortcast.llm.queries import QUERIES

PATH = tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = arrow_files.Encoder(PATH)
PARTS = ["the ", " ", "  ", "\n", "\t", "'s ", " a", "é", " ", "　", "<|endoftext|>", "12 ", "!?", "\x1c", "\x85"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=20))
def test_stretches_equal_the_whole(parts):
    text = "".join(parts)
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert np.frombuffer(ENCODER.encode([text])[0], "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def expected(rows):
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tmp_path):
    rows = [(i, f"text {i}! " * (i % 50)) for i in range(300, 0, -1)] + [(None, None), (1000, ""), (1001, "wide open " * 40_000)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start int, part string")
    manifest = arrow_files.write_tokens(df, PATH, f"file://{tmp_path}/out", length=64)
    got = sorted((tuple(r) for r in arrow_files.read_tokens(manifest, f"file://{tmp_path}/out").collect()), key=lambda r: r[1])
    assert got == expected(rows)
    path = next(p for p in glob.glob(f"{tmp_path}/out/*.arrow") if not p.endswith(".docs.arrow"))
    with pa.memory_map(path) as source:
        file = pa.ipc.open_file(source)
        before = pa.total_allocated_bytes()
        batch = file.get_batch(file.num_record_batches - 1)
        assert batch.column(0).type == pa.list_(pa.field("item", pa.uint16(), nullable=False), 64)
        assert pa.total_allocated_bytes() == before  # mapped, not copied


def test_repeats_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(7, "same text")] * 50, "doc_id long, text string")
    assert sorted(r.start for r in arrow_files.token_digest(df, PATH).collect()) == [3 * k for k in range(50)]
    assert arrow_files.token_digest(df.limit(0), PATH).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op6_arrow_tokens"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
