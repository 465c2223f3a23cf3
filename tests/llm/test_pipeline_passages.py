"""Long lines in two documents that are not near duplicates of each other."""

from __future__ import annotations

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_passages_stay_once(spark, tmp_path):
    long, short = words("p", 51), words("s", 50)
    texts = {
        1: f"{words('a', 60)}\n{short}\n{long}",
        2: f"{long}\n{words('b', 300)}\n{short}",
        3: f"{words('c', 200)}\n{words('d', 60)}\nshort of c",
        4: f"{words('c', 200)}\n{words('d', 60)}\nother end",  # a near copy of 3 goes as a whole
    }
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in corpus_pipeline.STAGES[1:3]:
        function(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = {1: texts[1], 2: f"{words('b', 300)}\n{short}", 3: texts[3]}
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
