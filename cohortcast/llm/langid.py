"""Language of texts: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import batches_of, covered, release_memory, tidy

WINDOW = 128
HIDDEN = 8
BLOCK_WINDOWS = 2048
BATCH_BYTES = 1 << 21
#: Bound of the labelled sample: texts per language, and windows of ``WINDOW`` bytes from each.
SAMPLE_TEXTS = 400
SAMPLE_WINDOWS = 6
STEPS = 300
BATCH_WINDOWS = 256
RATE = 0.02
UNKNOWN = "und"
#: Share of the rightly labelled training windows that may score below the bar, and of all that may need more bits.
LOW_SCORES, HIGH_BITS = 0.001, 0.01
#: Bits a byte takes if nothing is known of it.
BYTE_BITS = 8.0
#: Bins of window scores (0 to 1) and of bits a byte (0 to ``MOST_BITS``).
BINS, MOST_BITS = 1 << 16, 64.0


class Direction:
    """A gated recurrent layer. Rows of ``table`` (by byte) and ``turn``: update, reset, candidate gate.

    All arrays have the batch last. Times run over the first axis of ``bytes_`` in the given order.
    """

    def __init__(self, table: np.ndarray, turn: np.ndarray):
        self.table, self.turn = table, turn

    def step(self, symbols: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(state)
        gates = np.take(self.table, symbols, axis=1)
        recurrent = self.turn @ state
        gates[: 2 * n] += recurrent[: 2 * n]
        gates[: 2 * n] *= 0.5
        np.tanh(gates[: 2 * n], out=gates[: 2 * n])
        gates[: 2 * n] += 1
        gates[: 2 * n] *= 0.5
        update, reset, new = gates[:n], gates[n : 2 * n], gates[2 * n :]
        new += reset * recurrent[2 * n :]
        np.tanh(new, out=new)
        return state + update * (new - state), update, reset, new, recurrent[2 * n :]

    def forward(self, symbols: np.ndarray, order: range, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each time (time, hidden, batch), and what the backward pass needs."""
        n = self.turn.shape[1]
        states = np.empty((symbols.shape[0], n, symbols.shape[1]), dtype=self.table.dtype)
        state, tape = np.zeros((n, symbols.shape[1]), dtype=self.table.dtype), []
        for t in order:
            before = state
            state, *rest = self.step(symbols[t], state)
            states[t] = state
            if keep:
                tape.append((t, before, *rest))
        return states, tape

    def backward(self, symbols: np.ndarray, tape: list, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and turn by backpropagation through time; ``upper``: that of the states."""
        n = self.turn.shape[1]
        d_turn = np.zeros_like(self.turn)
        d_in = np.empty((symbols.shape[0], 3 * n, symbols.shape[1]), dtype=self.table.dtype)
        d_state = np.zeros_like(upper[0])
        for t, before, update, reset, new, inner in reversed(tape):
            d_state = d_state + upper[t]
            d_new = d_state * update * (1 - new * new)
            d_gate = np.concatenate([
                d_state * (new - before) * update * (1 - update),
                d_new * inner * reset * (1 - reset),
                d_new * reset,
            ])
            d_turn += d_gate @ before.T
            d_in[t] = d_gate
            d_in[t, 2 * n :] = d_new
            d_state = d_state * (1 - update) + self.turn.T @ d_gate
        flat = np.zeros((symbols.size, 256), dtype=self.table.dtype)
        flat[np.arange(symbols.size), symbols.ravel()] = 1
        return d_in.transpose(1, 0, 2).reshape(3 * n, -1) @ flat, d_turn


class Network:
    """Weights: (table, turn) forwards, (table, turn) backwards, output matrix and bias."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        self.languages = languages
        self.least_score, self.most_bits, self.pair_bits = 0.0, np.inf, np.full((256, 256), BYTE_BITS)
        rng = np.random.default_rng(seed)

        def some(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.weights = []
        for _ in range(2):
            self.weights += [some(3 * hidden, 256, scale=0.5), some(3 * hidden, hidden, scale=hidden**-0.5)]
        self.weights += [some(len(languages), 2 * hidden, scale=hidden**-0.5), np.zeros((len(languages), 1), dtype=np.float32)]

    def layers(self) -> tuple[Direction, Direction]:
        w = self.weights
        return Direction(w[0], w[1]), Direction(w[2], w[3])

    def positions(self, symbols: np.ndarray, keep: bool = False):
        """Language probabilities at every position: (time, language, batch)."""
        there, back = self.layers()
        times = symbols.shape[0]
        a, tape_a = there.forward(symbols, range(times), keep)
        b, tape_b = back.forward(symbols, range(times - 1, -1, -1), keep)
        out, bias = self.weights[4:]
        n = a.shape[1]
        scores = out[:, :n] @ a + out[:, n:] @ b + bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return (scores, (a, tape_a, b, tape_b)) if keep else scores

    def gradients(self, symbols: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions inside the windows, and its gradients."""
        probabilities, (a, tape_a, b, tape_b) = self.positions(symbols, keep=True)
        inside = (np.arange(symbols.shape[0])[:, None] < lengths).astype(self.weights[0].dtype)
        total = inside.sum()
        right = probabilities[:, labels, np.arange(len(labels))]
        loss = float(-(np.log(right + 1e-12) * inside).sum() / total)
        d = probabilities.copy()
        d[:, labels, np.arange(len(labels))] -= 1
        d *= (inside / total)[:, None, :]
        out, n = self.weights[4], a.shape[1]
        d_out = np.concatenate([np.einsum("tlb,thb->lh", d, x, optimize=True) for x in (a, b)], axis=1)
        there, back = self.layers()
        up = [np.matmul(part.T, d) for part in (out[:, :n], out[:, n:])]
        first = there.backward(symbols, tape_a, up[0])
        second = back.backward(symbols, tape_b, up[1])
        return loss, [*first, *second, d_out, d.sum(axis=(0, 2))[:, None]]

    def train(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam over batches with as many windows of each language."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            of = rng.integers(0, len(groups), BATCH_WINDOWS)
            rows = np.array([groups[k][rng.integers(len(groups[k]))] for k in of])
            _, grads = self.gradients(windows[rows].T.copy(), lengths[rows], labels[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(self.weights, grads, first, second, strict=True):
                g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(w.dtype)

    def window_sums(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities of each window, summed over its positions: (windows, languages)."""
        sums = np.zeros((len(windows), len(self.languages)))
        for k in range(0, len(windows), BLOCK_WINDOWS):
            part, sizes = windows[k : k + BLOCK_WINDOWS].T.copy(), lengths[k : k + BLOCK_WINDOWS]
            probabilities = self.positions(part)
            probabilities *= (np.arange(WINDOW)[:, None] < sizes)[:, None, :]
            sums[k : k + BLOCK_WINDOWS] = probabilities.sum(axis=0).T
        return sums

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for empty texts."""
        windows, lengths, owner = cut(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        np.add.at(sums, owner, self.window_sums(windows, lengths))
        return sums / np.maximum(1, [[len(t)] for t in texts]) if texts else sums

    def set_bars(self, rows: DataFrame) -> None:
        """What a text of a learned language has: a least ``score`` and most bits a byte.

        The network is sure of bytes it never saw as well, so its score alone rejects no other script. The
        bits of a byte after the one before it, counted in all windows of all labelled texts, tell those: bytes of
        unlearned scripts and random letters take more than the ``BYTE_BITS`` of any byte. The bars: the
        middle between the ``LOW_SCORES`` quantile of scores of the rightly labelled windows and the score of
        no opinion, as texts in two languages score lower than windows; and ``BYTE_BITS``, or for few
        texts what all but ``HIGH_BITS`` of the windows need by the counts of the other half of the texts.

        ``rows`` (hash of the id, text, language) are read twice. Byte pairs are summed by half; then scores
        and bits are counted in ``BINS`` bins, whose edges on the generous side are the quantiles.
        """
        counts = np.zeros((2, 1 << 16))
        np.add.at(counts, *_summed(rows, lambda texts, half, _: [(k, byte_pairs([t for t, h in zip(texts, half, strict=True) if h == k])) for k in (0, 1)]))
        halves = [pair_bits(part) for part in counts.reshape(2, 256, 256)]
        numbers = {lang: k for k, lang in enumerate(self.languages)}

        def judge(texts: list[bytes], half: np.ndarray, langs: list[str]) -> list[tuple[int, np.ndarray]]:
            windows, lengths, owner = cut(texts)
            means = self.window_sums(windows, lengths) / lengths[:, None]
            right = means.argmax(axis=1) == np.array([numbers[x] for x in langs])[owner]
            need = np.where(half[owner] == 0, *(window_bits(windows, lengths, bits) for bits in halves[::-1]))
            return [(0, means.max(axis=1)[right] * BINS), (1, need * (BINS / MOST_BITS))]

        bins = np.zeros((2, BINS))
        np.add.at(bins, *_summed(rows, lambda *batch: [(k, np.clip(x, 0, BINS - 1).astype(np.int64)) for k, x in judge(*batch)]))
        scores, needs = np.cumsum(bins, axis=1)
        if scores[-1]:
            low = float(np.searchsorted(scores, LOW_SCORES * scores[-1])) / BINS
            self.least_score = (low + 1 / len(self.languages)) / 2 - 1e-6
        need = float(np.searchsorted(needs, (1 - HIGH_BITS) * needs[-1]) + 1) * MOST_BITS / BINS
        self.most_bits = max(BYTE_BITS, need)
        self.pair_bits = pair_bits(counts.sum(axis=0).reshape(256, 256))


def _summed(rows: DataFrame, numbers_of: Callable) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """How often each number occurs in each of a few kinds: ((kinds, numbers), counts).

    ``numbers_of(texts, halves, languages)`` gives (kind, numbers under 2**16); tasks count, Spark adds up.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << 16), dtype=np.int64)
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            for kind, numbers in numbers_of(batch.column(1).to_pylist(), batch.column(0).to_numpy() & 1, batch.column(2).to_pylist()):
                total[kind] += np.bincount(numbers, minlength=1 << 16)
        kinds, numbers = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(numbers), pa.array(total[kinds, numbers])], names=["kind", "number", "n"])

    found = rows.select("_hash", "_text", "_lang").mapInArrow(run, "kind long, number long, n long")
    table = found.groupBy("kind", "number").agg(F.sum("n").alias("n")).toArrow()
    kinds, numbers, counts = (table.column(c).to_numpy() for c in ("kind", "number", "n"))
    return (kinds, numbers), counts


def byte_pairs(texts: list[bytes]) -> np.ndarray:
    """The pairs of bytes side by side in the texts' windows, as numbers: first times 256 plus second."""
    windows, lengths, _ = cut(texts)
    pairs = windows[:, :-1].astype(np.int64) << 8 | windows[:, 1:]
    return pairs[np.arange(1, WINDOW) < lengths[:, None]]


def pair_bits(counts: np.ndarray) -> np.ndarray:
    """Bits of each byte (column) after each byte (row) by the counts of pairs, a tenth added to each."""
    counts = counts + 0.1
    return np.log2(counts.sum(axis=1, keepdims=True) / counts)


def window_bits(windows: np.ndarray, lengths: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Mean bits of the bytes of each window but the first; 0 for windows of one byte."""
    inside = np.arange(1, WINDOW) < lengths[:, None]
    return (bits[windows[:, :-1], windows[:, 1:]] * inside).sum(axis=1) / np.maximum(1, lengths - 1)


def surprise(texts: list[bytes], bits: np.ndarray) -> np.ndarray:
    """Mean bits of the bytes of each text but the first; 0 for texts of under two bytes."""
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        some = np.frombuffer(text, dtype=np.uint8)
        if len(some) > 1:
            out[k] = bits[some[:-1], some[1:]].mean()
    return out


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts in windows: (windows, WINDOW) filled with 0, lengths, text numbers."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    each = -(-sizes // WINDOW)
    ends = np.cumsum(each)
    windows = np.zeros((int(each.sum()), WINDOW), dtype=np.uint8)
    flat = windows.reshape(-1)
    for text, start in zip(texts, (ends - each) * WINDOW, strict=True):
        flat[start : start + len(text)] = np.frombuffer(text, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), each)
    lengths = np.full(len(windows), WINDOW, dtype=np.int64)
    some = sizes > 0
    lengths[ends[some] - 1] = sizes[some] - (each[some] - 1) * WINDOW
    return windows, lengths, owner


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, bars: bool = False) -> Network | None:
    """Network learned from a sample of the labelled rows; None if no row has a language.

    The sample: of each language the ``SAMPLE_TEXTS`` texts with letters whose ids have the smallest
    hashes, and up to ``SAMPLE_WINDOWS`` windows spread evenly over each. A cut on the hash, from
    the exact count of the language's texts, leaves few more than that before they are ordered. ``bars``
    are set from all these rows.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64(id_col).alias("_hash"), F.encode(text_col, "UTF-8").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not counts:
        return None
    share = df.sparkSession.createDataFrame([(k, min(1.0, 4 * SAMPLE_TEXTS / n)) for k, n in counts.items()], "_lang string, _share double")
    some = rows.join(F.broadcast(share), "_lang").filter(F.pmod("_hash", F.lit(1 << 40)) < F.col("_share") * (1 << 40))

    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                windows, lengths, _ = cut([text])
                at = np.unique(np.linspace(0, len(windows) - 1, SAMPLE_WINDOWS).astype(int))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([key]), pa.array([[windows[k, : lengths[k]].tobytes() for k in at]], pa.list_(pa.binary()))],
                    names=["_lang", "_hash", "_windows"],
                )

    found = some.select("_lang", "_hash", "_text").mapInArrow(spread, "_lang string, _hash long, _windows array<binary>").collect()
    languages = sorted(counts)
    picked = []
    for k, lang in enumerate(languages):
        mine = sorted((r for r in found if r[0] == lang), key=lambda r: (r[1], [bytes(w) for w in r[2]]))[:SAMPLE_TEXTS]
        picked += [(bytes(w), k) for r in mine for w in r[2]]
    windows, lengths, _ = cut([w for w, _ in picked])
    labels = np.array([k for _, k in picked])
    network = Network(languages)
    network.train(windows, lengths, labels)
    if bars:
        network.set_bars(rows)
    return network


def held_out(id_col: str, folds: int = 4, fold: int = 2):
    """True for ids whose crc32 (of the id as text) has the remainder ``fold``; false for NULL ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sure: bool = False) -> DataFrame:
    """All columns and held_out, lang_pred, score, and with ``sure`` also lang_sure.

    Learns from rows that are not held out and have a language (and an id), then labels every byte of
    every text and pools: ``score`` is the mean probability of ``lang_pred``. Only the text's bytes
    enter a prediction. NULL texts and texts without a letter are ``und`` with score 0, as is
    everything if no row has a language. Input columns named like the results are replaced; repeated
    rows pass; an empty table gives an empty result. No shuffle but counts and the bounded sample.

    ``lang_sure``: not ``und``, and past both bars of ``Network.set_bars``, which hold for the whole text.
    """
    results = ["held_out", "lang_pred", "score", *["lang_sure"][: int(sure)]]
    names_in = df.drop(*results).columns
    df, numbers = covered(df, *(r for r in results if r not in (id_col, text_col, lang_col)))
    id_col, text_col, lang_col = numbers[id_col], numbers[text_col], numbers[lang_col]
    base = df.withColumn("held_out", held_out(id_col))

    def named(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(numbers[n]).alias(n) for n in names_in], *results)

    network = learn(base.filter(~F.col("held_out") & F.col(id_col).isNotNull()), id_col, text_col, lang_col, sure)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if network is None:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}
        return named(base.withColumns(none | ({"lang_sure": F.lit(False)} if sure else {})))
    names = pa.array(network.languages)

    @F.arrow_udf("lang string, score double, sure boolean")
    def predict(texts: pa.Array) -> pa.Array:
        found, scores, passed = [], [], []
        batch = pa.RecordBatch.from_arrays([texts.cast(pa.binary())], names=["t"])
        for part in batches_of(iter([batch]), "t", BATCH_BYTES):
            some = part.column(0).to_pylist()
            pooled = network.pooled(some)
            found.append(pooled.argmax(axis=1))
            scores.append(pooled.max(axis=1))
            passed.append((scores[-1] >= network.least_score) & (surprise(some, network.pair_bits) <= network.most_bits) if sure else np.zeros(len(some), dtype=bool))
        picks = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        points = np.concatenate(scores) if scores else np.zeros(0)
        good = np.concatenate(passed) if passed else np.zeros(0, dtype=bool)
        release_memory()
        return pa.StructArray.from_arrays([names.take(pa.array(picks)), pa.array(np.clip(points, 0, 1)), pa.array(good)], names=["lang", "score", "sure"])

    guess = predict(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    return named(
        base.withColumns({"_letters": letters, "_guess": guess})
        .withColumns({
            "lang_pred": F.when(F.col("_letters"), F.col("_guess.lang")).otherwise(UNKNOWN),
            "score": F.when(F.col("_letters"), F.col("_guess.score")).otherwise(0.0),
            **({"lang_sure": F.col("_letters") & F.col("_guess.sure")} if sure else {}),
        })
    )
