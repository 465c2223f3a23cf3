"""Sorted rows as whole groups, and pairs inside groups, for use in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        stop = int(np.argmax(keys == keys[-1]))
        if stop:
            yield table.slice(0, stop)
            held = table.slice(stop).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if len(table):
            yield table


def starts_of(keys: np.ndarray) -> np.ndarray:
    """First row of each run of equal keys, and the number of rows at the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def pairs_inside(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal keys, by distance; ``keys`` has equal ones together."""
    rows = np.arange(len(keys))
    for gap in range(1, len(keys)):
        rows = rows[: len(keys) - gap] if len(rows) == len(keys) - gap + 1 else rows[rows + gap < len(keys)]
        rows = rows[keys[rows] == keys[rows + gap]]
        if not len(rows):
            return
        yield rows, rows + gap
