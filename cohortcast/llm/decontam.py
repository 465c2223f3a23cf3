"""Passages of test items in training texts, found through positional inverted indexes.

The index is split by documents: each task indexes the words of its documents by term and
position. Test items come in blocks of bounded size that every index answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import batches_of, tidy

WINDOW = 10
NEAR_WORDS = 3
NEAR_TERMS = 3
BLOCK_BYTES = 1 << 24
BATCH_BYTES = 1 << 20
CANDIDATES = 1 << 18
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case; runs of 0-9, a-z and whatever is not ASCII."""
    return text.translate(_TABLE).split()


@dataclass
class Block:
    """Windows of some test items. Rows of ``terms`` and ``offsets`` go from the rarest term on."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def windows_of(items: list[tuple[str | None, bytes]], window: int) -> tuple[dict[bytes, int], dict[tuple[int, ...], set[str | None]]]:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[at : at + window]), set()).add(item)
    return vocabulary, found


def _named(items: set[str | None]) -> list[str | None]:
    """Sorted, what has no id last."""
    return sorted(items, key=lambda x: (x is None, x))


def ranked(vocabulary: dict[bytes, int], windows: dict[tuple[int, ...], set[str]], counts: np.ndarray, window: int) -> Block:
    """Order each window's terms by how rare they are in the training texts; -1 fills short ones."""
    terms = np.full((len(windows), window), -1, dtype=np.int64)
    for row, content in enumerate(windows):
        terms[row, : len(content)] = content
    lengths = (terms >= 0).sum(axis=1)
    rarity = np.where(terms >= 0, counts[terms], np.iinfo(np.int64).max)
    offsets = np.argsort(rarity, axis=1, kind="stable")
    return Block(vocabulary, np.take_along_axis(terms, offsets, axis=1), offsets, lengths, [_named(x) for x in windows.values()])


class Index:
    """Word positions of a batch of documents, by term."""

    def __init__(self, texts: list[list[bytes]], vocabulary: dict[bytes, int]):
        get = vocabulary.get
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.fromiter((get(w, -1) for t in texts for w in t), dtype=np.int64, count=int(self.sizes.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.places = np.argsort(self.ids, kind="stable")
        self.first = np.searchsorted(self.ids[self.places], np.arange(len(vocabulary) + 1))

    def at(self, places: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Terms at the places; -2 outside the document."""
        inside = np.clip(places, 0, max(0, len(self.ids) - 1))
        return np.where((inside == places) & (self.doc[inside] == doc), self.ids[inside], -2)

    def search(self, block: Block, near: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Exact matches (window, first place) and near ones (window, document), part by part.

        The list of a window's rarest term, moved back by the term's place in the window, gives the
        candidates; the lists of its other terms, moved likewise, are intersected with it from rare to
        common. A near match has the rarest terms within ``near`` words of their places.
        """
        anchor = block.terms[:, 0]
        lists = self.first[anchor + 1] - self.first[anchor]
        active = np.flatnonzero(lists)
        if not len(active):
            return
        # the postings of all active windows are one long list; it is walked in parts of CANDIDATES
        ends = np.cumsum(lists[active])
        for low in range(0, int(ends[-1]), CANDIDATES):
            number = np.arange(low, min(low + CANDIDATES, int(ends[-1])))
            which = np.searchsorted(ends, number, side="right")
            window = active[which]
            place = self.places[self.first[anchor[window]] + number - (ends[which] - lists[window])]
            doc, start = self.doc[place], place - block.offsets[window, 0]
            close = block.lengths[window] >= NEAR_TERMS if near else np.zeros(len(window), dtype=bool)
            for k in range(1, NEAR_TERMS):
                rows = np.flatnonzero(close)
                there = start[rows] + block.offsets[window[rows], k]
                hit = np.zeros(len(rows), dtype=bool)
                for step in range(-near, near + 1):
                    hit |= self.at(there + step, doc[rows]) == block.terms[window[rows], k]
                close[rows] = hit
            yield_near = (window[close], doc[close])
            for k in range(1, block.terms.shape[1]):
                expected = block.terms[window, k]
                same = (expected < 0) | (self.at(start + block.offsets[window, k], doc) == expected)
                window, doc, start = window[same], doc[same], start[same]
            yield window, start, doc, *yield_near


def _runs(marked: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edge.tolist()


def _covered(size: int, runs: list[int]) -> np.ndarray:
    out = np.zeros(size, dtype=bool)
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out[a:b] = True
    return out


def find_passages(
    df: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    near: int = NEAR_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per row: id, n_words, n_hit, hits, items and near_items.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item that has
    words. ``hits`` are the runs of words inside any occurrence, as word numbers (start, stop, start,
    stop, ...); ``items`` the ids, as text, of items with an occurring window, sorted; ``near_items``
    those of items with a window whose three rarest terms stand within ``near`` words of their places.
    Items without id hit like others and are one NULL at the end of a list.

    Terms of the items are counted over all texts, so that intersection starts from the rarest.
    Items are taken in blocks of about ``BLOCK_BYTES`` of text, each broadcast and held against all
    texts; more items mean more passes and never a larger broadcast. Nothing is shuffled but the
    term counts. NULL texts have no words, items without text are left out, NULL document ids and
    repeated rows pass, other columns are ignored, empty tables give empty results or no hits.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"),
        *[F.array().cast(t).alias(n) for n, t in (("_hits", "array<long>"), ("_items", "array<string>"), ("_near", "array<string>"))],
    )
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.encode(item_text_col, "UTF-8").alias("text")).filter("text IS NOT NULL").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for number in range(blocks):
        mine = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()
        vocabulary, windows = windows_of([(r.item, bytes(r.text)) for r in mine], window)
        if windows or number == blocks - 1:
            rows = _answer(spark, rows, vocabulary, windows, window, near, kind)
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_hits") - 2), F.lit(2)), F.lit(0).cast("long"),
        lambda n, k: n + F.coalesce(F.get("_hits", k + 1) - F.get("_hits", k), F.lit(0)),
    )
    return rows.select(
        F.col("_id").alias(id_col), F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_hits").alias("hits"),
        F.col("_items").alias("items"), F.col("_near").alias("near_items"),
    )


def _answer(spark, rows: DataFrame, vocabulary, windows, window: int, near: int, kind: str) -> DataFrame:
    """One block against all texts; earlier blocks' findings are in the rows and are added to."""
    terms = spark.sparkContext.broadcast(vocabulary)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms.value) + 1, dtype=np.int64)
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            get = terms.value.get
            for text in batch.column(0).to_pylist():
                ids = np.fromiter((get(w, -1) for w in words_of(text)), dtype=np.int64)
                total += np.bincount(ids + 1, minlength=len(total))
        some = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1:][some])], names=["term", "n"])

    counts = np.zeros(len(vocabulary), dtype=np.int64)
    if windows:
        found = rows.select("_text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in found.collect():
            counts[r.term] = r.n
    block = spark.sparkContext.broadcast(ranked(vocabulary, windows, counts, window))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            index = Index(texts, block.value.vocabulary)
            marks = np.zeros(int(index.sizes.sum()) + 1, dtype=np.int64)
            exact, close = set(), set()
            for found, start, doc, near_found, near_doc in index.search(block.value, near):
                np.add.at(marks, start, 1)
                np.add.at(marks, start + block.value.lengths[found], -1)
                exact.update(zip(doc.tolist(), found.tolist(), strict=True))
                close.update(zip(near_doc.tolist(), near_found.tolist(), strict=True))
            hit = np.cumsum(marks)[:-1] > 0
            hits, items, nears = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for doc in {d for d, _ in exact}:
                mine = hit[index.starts[doc] : index.starts[doc] + index.sizes[doc]]
                hits[doc] = _runs(mine | _covered(len(mine), hits[doc]))
            for pairs, lists in ((exact, items), (close, nears)):
                more: dict[int, set[str]] = {}
                for doc, found in pairs:
                    more.setdefault(doc, set()).update(block.value.items[found])
                for doc, names in more.items():
                    lists[doc] = _named(names.union(lists[doc]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
                 pa.array(nears, pa.list_(pa.string())), pa.array(index.sizes)],
                names=["_id", "_text", "_hits", "_items", "_near", "_words"],
            )

    schema = f"_id {kind}, _text binary, _hits array<long>, _items array<string>, _near array<string>, _words long"
    return rows.select("_id", "_text", "_hits", "_items", "_near").mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
