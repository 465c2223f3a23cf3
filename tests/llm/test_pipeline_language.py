"""What the language stage rejects and keeps."""

from __future__ import annotations

import random

import corpus_pipeline
from cohortcast.llm import langid

SF_DIR = "/root/testdata/sf0.001"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def test_other_scripts_and_letter_noise_go(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 120)
    rng = random.Random(3)
    noise = "".join(rng.choice(ALPHABET + "   ") for _ in range(2000))
    bad = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 8,
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια. " * 8,
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心" * 8,
        "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق " * 8,
        noise,
        noise.upper(),
        noise.replace(" ", ""),
    ]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    more = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(bad)], docs.schema)
    kept = {r[0] for r in corpus_pipeline.language(spark, docs.unionByName(more), SF_DIR).select("doc_id").collect()}
    assert not kept & {10**6 + k for k in range(len(bad))}
    clean = {r.doc_id for r in docs.collect() if r.text and sum(c.isalpha() for c in r.text) > 50}
    assert clean <= kept
