"""Token counts of whole texts; huge texts in overlapping chunks that are spliced where it is safe."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import batches_of, tidy

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 10
BATCH_BYTES = 1 << 21


class Counter:
    """Counts as the library's own for a whole text.

    A place between two characters is *safe* if no entry of the vocabulary holds the two side by
    side: no merge can reach over it, so what stands left and right of it is encoded alike in any
    chunk that shows both characters. Chunks are cut apart only at safe places where both
    encodings begin a token. If an overlap has none, it is doubled; if it then covers the whole
    chunk, the chunk grows instead, in the end to the whole text.
    """

    def __init__(self, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        plain = [p.replace("▁", " ") for p in pieces]
        self.sizes = np.array(
            [1 if self.library.is_byte(i) else len(p.encode()) for i, p in enumerate(plain)], dtype=np.int64
        )
        self.together = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk // 4 else "" for t in texts]
        found = [len(ids) for ids in self.library.encode(short, num_threads=1)]
        return [n if s or not t else self.long_count(t) for n, s, t in zip(found, short, texts, strict=True)]

    def begins(self, data: bytes, start: int, stop: int) -> np.ndarray | None:
        """Byte offsets at which tokens of a chunk begin; None if sizes don't add up to the chunk."""
        ids = np.array(self.library.encode(data[start:stop].decode()), dtype=np.int64)
        ends = np.cumsum(self.sizes[ids])
        if not len(ends) or ends[-1] != stop - start + 1:  # the library puts one space in front
            return None
        return np.concatenate([[0], ends[:-1]]) - 1 + start

    def splice(self, data: bytes, left: np.ndarray, right: np.ndarray, start: int, stop: int) -> int | None:
        """The safe common boundary nearest to the middle of [start, stop)."""
        both = np.intersect1d(left[left > start], right[right < stop])
        for place in both[np.argsort(np.abs(both - (start + stop) // 2))]:
            before, after = int(place) - 1, int(place) + 1
            while before and data[before] & 0xC0 == 0x80:
                before -= 1
            while after < len(data) and data[after] & 0xC0 == 0x80:
                after += 1
            # a pair that the chunks' ends cut in two proves nothing
            if before >= start and after <= stop and data[before:after].decode() not in self.together:
                return int(place)
        return None

    def long_count(self, text: str) -> int:
        data = text.encode()

        def at(place: int) -> int:
            place = max(0, min(place, len(data)))
            while 0 < place < len(data) and data[place] & 0xC0 == 0x80:
                place -= 1
            return place

        total, cut, start, stop = 0, -1, 0, at(self.chunk)
        left = self.begins(data, start, stop)
        while left is not None and stop < len(data):
            overlap, place = self.overlap, None
            after = at(stop + self.chunk)
            while place is None and overlap < stop - start:
                again = at(stop - overlap)
                right = self.begins(data, again, after)
                if right is None:
                    return len(self.library.encode(text))
                place = self.splice(data, left, right, again, stop)
                if place is None:
                    overlap *= 2
                    self.widened += 1
            if place is None:  # nothing safe in the whole chunk: it grows
                stop = after
                left = self.begins(data, start, stop)
                continue
            total += int(((left >= cut) & (left < place)).sum())
            cut, start, stop, left = place, again, after, right
        if left is None:  # the model rewrites the text, so offsets can't be told
            return len(self.library.encode(text))
        return total + int((left >= cut).sum())


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(
    df: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``model_path`` is a sentencepiece model that every executor has. Counts equal those of the
    library for the whole text, without begin and end marks. NULL and empty texts have 0 tokens,
    NULL ids and repeated rows pass, other columns are ignored, an empty table gives an empty
    result. There is no shuffle; a task holds one batch of about 2 MB, or one text if it is longer.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path, chunk, overlap)
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            texts = batch.column(1)
            tokens = pa.array(count.counts(texts.to_pylist()), pa.int64())
            sizes = texts.cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sizes], pa.int64()), tokens],
                names=["_id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
