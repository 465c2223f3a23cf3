"""Each stage against brute force on its own input."""

from __future__ import annotations

import corpus_pipeline
from cohortcast.llm import langid, packing
from tests.llm import test_decontam, test_jaccard, test_line_dedup, test_packing

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 120)
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "benchmark_passages", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    inputs, outputs = {}, {}
    for name, function in corpus_pipeline.STAGES:
        inputs[name] = docs
        function(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = outputs[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS

    before, after = texts(inputs["language_id"]), texts(outputs["language_id"])
    assert set(after) <= set(before)
    clean = {i for i, t in before if t and sum(c.isalpha() for c in t) > 50}
    assert clean <= {i for i, _ in after}
    assert all(t and any(c.isalpha() for c in t) for _, t in after)

    want = test_line_dedup.brute(texts(inputs["line_dedup"]), corpus_pipeline.LINE_DOCS, "first")
    assert texts(outputs["line_dedup"]) == sorted((i, t) for i, t, *_ in want)
    assert all(r.n_chars == len(r.text) for r in outputs["line_dedup"].collect())

    rows = texts(inputs["ngram_jaccard"])
    monkeypatch.setattr(test_jaccard.plain_set, "__defaults__", (corpus_pipeline.NEAR_WORDS,))
    names = {i: c for i, _, c in test_jaccard.brute(rows, corpus_pipeline.NEAR_PERCENT)}
    left = [(i, t) for i, t in rows if names[i] == i]
    want = test_line_dedup.brute(left, corpus_pipeline.PASSAGE_DOCS, "first", corpus_pipeline.PASSAGE_WORDS)
    assert texts(outputs["ngram_jaccard"]) == sorted((i, t) for i, t, *_ in want)

    rows = texts(inputs["benchmark_passages"])
    tests = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {i for i, _, n, _ in test_decontam.brute(rows, tests, 10) if n}
    assert texts(outputs["benchmark_passages"]) == [(i, t) for i, t in rows if i not in hit]
    test_packing.check(outputs["best_fit_packing"].collect(), texts(inputs["best_fit_packing"]), packing.SIZES)
    assert steps


def test_odd_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 3)
    rows = [(1, "some words of text", "en", "s", 18), (1, "some words of text", "en", "s", 18), (None, "more words", None, None, None), (3, None, "en", "s", None), (4, "", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, docs in enumerate((df, df.limit(0))):
        docs = docs.withColumn("score", docs["n_chars"])
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, docs, SF_DIR)
            assert name == "best_fit_packing" or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert docs.count() == (2 if k == 0 else 0)  # the repeated row goes, as do texts without letters


def test_rows_are_judged_one_by_one(spark, tmp_path):
    """Copies without id or with one id go but for one; a clean namesake of a hit row stays."""
    near, items = dict(corpus_pipeline.STAGES)["ngram_jaccard"], dict(corpus_pipeline.STAGES)["benchmark_passages"]
    text = " ".join(f"w{k}" for k in range(40))
    passage = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("length(text) > 200").first().text
    rows = [(1, text)] * 4 + [(None, text)] * 3 + [(None, "another text of its own")] + [(7, passage), (7, "a clean text"), (None, passage)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 5) for i, t in rows], schema)
    kept = near(spark, docs, SF_DIR)
    assert kept.columns == docs.columns and all(r["_row"] == 5 for r in kept.collect())
    assert sorted(map(str, texts_of(kept))) == sorted(map(str, [(1, text), (None, "another text of its own"), (7, passage), (7, "a clean text")]))
    clean = items(spark, docs, SF_DIR)
    assert sorted(map(str, texts_of(clean))) == sorted(map(str, [r for r in rows if r[1] != passage]))


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]
