"""The bars of the language stage come from all labelled texts, however small the training sample."""

from __future__ import annotations

import numpy as np

from cohortcast.llm import langid


def test_bars_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 20)
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 1)
    monkeypatch.setattr(langid, "SAMPLE_WINDOWS", 1)
    rows = [(k, f"the words of text {k} and no more than these " * (k % 9 + 1), "en") for k in range(40)]
    rows += [(k, f"die {k} wörter dieses textes sind andere als jene " * (k % 7 + 1), "de") for k in range(40, 80)]
    df = spark.createDataFrame([*rows, (80, "qqq", None), (81, "123", "en"), (82, None, "de")], "doc_id long, text string, lang string")
    network = langid.learn(df, "doc_id", "text", "lang", bars=True)

    halves = dict(df.select("doc_id", langid.F.xxhash64("doc_id").bitwiseAND(1)).collect())
    windows = []
    for k, text, lang in rows:
        data = text.encode()
        windows += [(data[at : at + langid.WINDOW], halves[k], lang) for at in range(0, len(data), langid.WINDOW)]
    counts = np.zeros((2, 256, 256))
    for data, half, _ in windows:
        for a, b in zip(data, data[1:], strict=False):
            counts[half, a, b] += 1

    def bits(c):
        return np.log2((c.sum(axis=1, keepdims=True) + 25.6) / (c + 0.1))

    assert np.allclose(network.pair_bits, bits(counts.sum(axis=0)))
    need = [np.mean([bits(counts[1 - half])[a, b] for a, b in zip(data, data[1:], strict=False)] or [0]) for data, half, _ in windows]
    need = float(np.quantile(need, 1 - langid.HIGH_BITS, method="inverted_cdf"))
    assert max(8, need) <= network.most_bits <= max(8, need + 0.01)
    pooled = network.pooled([data for data, *_ in windows])
    right = [network.languages[k] == lang for k, (*_, lang) in zip(pooled.argmax(axis=1), windows, strict=True)]
    low = float(np.quantile(pooled.max(axis=1)[right], langid.LOW_SCORES, method="inverted_cdf"))
    assert abs(network.least_score - (low + 0.5) / 2) < 1e-4
