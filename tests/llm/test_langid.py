from __future__ import annotations

import zlib

import numpy as np

from cohortcast.llm import langid
from cohortcast.llm.queries import QUERIES


def test_gradients_equal_differences():
    network = langid.Network(["a", "b", "c"], hidden=3, seed=2)
    network.weights = [w.astype(np.float64) for w in network.weights]
    rng = np.random.default_rng(0)
    symbols = rng.integers(97, 101, (7, 5)).astype(np.uint8)
    lengths, labels = np.array([7, 7, 3, 1, 5]), np.array([0, 1, 2, 0, 1])
    _, grads = network.gradients(symbols, lengths, labels)
    for w, g in zip(network.weights, grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            at = (at[0], int(rng.integers(97, 101))) if w.shape[1] == 256 else at
            keep = w[at]
            w[at] = keep + 1e-5
            high = network.gradients(symbols, lengths, labels)[0]
            w[at] = keep - 1e-5
            low = network.gradients(symbols, lengths, labels)[0]
            w[at] = keep
            assert abs((high - low) / 2e-5 - g[at]) < 1e-6


def test_windows_hold_every_byte():
    texts = [b"", b"x", b"y" * 128, b"z" * 300]
    windows, lengths, owner = langid.cut(texts)
    for k, text in enumerate(texts):
        assert b"".join(w[:n].tobytes() for w, n, o in zip(windows, lengths, owner, strict=True) if o == k) == text


def test_held_out_accuracy_and_contract(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op7_byte_language"](spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in tested]) > 0.95


def test_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 3)
    df = spark.createDataFrame([(1, "the text", "en", 7, 8, 9)], "doc_id long, text string, lang string, _guess int, _letters int, c1 int")
    out = langid.identify(df, sure=True)
    assert out.columns == [*df.columns, "held_out", "lang_pred", "score", "lang_sure"]
    assert tuple(out.first())[:6] == (1, "the text", "en", 7, 8, 9)


def plain_pooled(network, text):
    def run(table, turn, data):
        n, state, out = turn.shape[1], np.zeros(turn.shape[1]), []
        for byte in data:
            x, r = table[:, byte].astype(float), turn @ state
            update, reset = (1 / (1 + np.exp(-(x[:n] + r[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + r[n : 2 * n]))))
            new = np.tanh(x[2 * n :] + reset * r[2 * n :])
            state = state + update * (new - state)
            out.append(state)
        return out

    w, total = network.weights, np.zeros(len(network.languages))
    for at in range(0, len(text), langid.WINDOW):
        part = text[at : at + langid.WINDOW]
        padded = part + bytes(langid.WINDOW - len(part))
        there, back = run(w[0], w[1], padded), run(w[2], w[3], padded[::-1])[::-1]
        for a, b in list(zip(there, back, strict=True))[: len(part)]:
            scores = np.exp(w[4] @ np.concatenate([a, b]) + w[5][:, 0])
            total += scores / scores.sum()
    return total / len(text)


def test_plain_forward_pass():
    """One document, one byte at a time, against the batched network."""
    rng = np.random.default_rng(5)
    network = langid.Network(["a", "b", "c"])
    for text in (b"some bytes", bytes(rng.integers(0, 256, 300, dtype=np.uint8).tolist())):
        assert np.allclose(network.pooled([text])[0], plain_pooled(network, text), atol=1e-5)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    rows = [(1, "the text", "en", 1), (None, "a b", "en", 1), (3, None, "en", 1), (4, "", None, 1), (5, "12 !?", "de", 1), (6, "das ist " * 50_000, "de", 1), (6, "x", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.text): r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    for key in ((3, None), (4, ""), (5, "12 !?")):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert got[(None, "a b")].held_out is False and got[(None, "a b")].lang_pred in ("en", "de")
    assert langid.identify(df.limit(0)).collect() == []
    unlabelled = langid.identify(df.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
