"""Best-fit packing into sequences of several permitted lengths.

Texts of one length are interchangeable, so the plan is made over the histogram of lengths, which
has at most as many rows as the longest sequence has tokens, and the texts then look up their
places by their rank within their length.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import numbered

SIZES = (1024, 2048, 4096, 8192)
BROADCAST_ROWS = 200_000


def sequence_cost(size: int) -> float:
    """Relative cost of training on a sequence: linear layers and attention."""
    return size * (1 + size / 16_384)


@dataclass
class Plan:
    """``runs``: (length, first rank, items, items per bin, first bin, offset); item i of a run is
    in bin first_bin + i // per_bin at offset + (i % per_bin) * length. ``bins``: (first bin,
    bins, tokens used), in the order of bins. ``capacity`` of used tokens is the downsized one."""

    sizes: tuple[int, ...]
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)

    def capacity(self, used: int) -> int:
        return self.sizes[bisect.bisect_left(self.sizes, used)]

    def cost(self, price: Callable[[int], float]) -> float:
        return sum(n * price(self.capacity(used)) for _, n, used in self.bins)


class _Open:
    """Open bins by room left; bins alike are kept as runs of neighbouring numbers."""

    def __init__(self):
        self.rooms: list[int] = []
        self.by_room: dict[int, list[tuple[int, int, int]]] = {}

    def put(self, room: int, first: int, count: int, used: int) -> None:
        if count:
            if room not in self.by_room:
                bisect.insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append((first, count, used))

    def tightest(self, length: int) -> tuple[int, int, int, int] | None:
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count, used = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[at]
        return room, first, count, used


def best_fit(counts: dict[int, int], sizes: Sequence[int], openable: Sequence[int], price: Callable[[int], float]) -> Plan:
    """Best fit over lengths from long to short, all texts of a length at once.

    A text goes to the open bin with the least room that holds it. If none does, a bin is opened
    of the size that costs least per token when filled with texts of this length. At the end each
    bin is downsized to the smallest of ``sizes`` that holds its contents.
    """
    plan, opened, bins = Plan(tuple(sorted(sizes))), _Open(), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = opened.tightest(length)
            if found is None:
                size = min((s for s in openable if s >= length), key=lambda s: (price(s) / (s // length), s))
                found = (size, bins, -(-left // (size // length)), 0)
                bins += found[2]
            room, first, count, used = found
            each = room // length
            full = min(count, left // each)
            rest = min(left - full * each, each) if full < count else 0
            plan.runs.append((length, rank, full * each + rest, each, first, used))
            opened.put(room - each * length, first, full, used + each * length)
            at = first + full
            if rest:
                opened.put(room - rest * length, at, 1, used + rest * length)
                at += 1
            opened.put(room, at, first + count - at, used)
            rank, left = rank + full * each + rest, left - full * each - rest
    plan.bins = sorted(b for some in opened.by_room.values() for b in some)
    return plan


def best_plan(counts: dict[int, int], sizes: Sequence[int], price: Callable[[int], float] = sequence_cost) -> Plan:
    """The cheapest plan over all sets of sizes that bins may be opened with."""
    largest = max(sizes)
    others = [s for s in sorted(sizes) if s != largest]
    plans = [
        best_fit(counts, sizes, [*some, largest], price)
        for n in range(len(others) + 1) for some in itertools.combinations(others, n)
    ]
    return min(plans, key=lambda p: p.cost(price))


def _pieces(plan: Plan) -> list[tuple[int, int, int, int, int, int, int]]:
    """Runs cut where the capacity of their bins changes; the capacity comes last."""
    firsts = [b[0] for b in plan.bins]
    out = []
    for length, rank, items, each, first, offset in plan.runs:
        done = 0
        while done < items:
            start, count, used = plan.bins[bisect.bisect_right(firsts, first + done // each) - 1]
            some = min(items, (start + count - first) * each) - done
            out.append((length, rank + done, some, each, first + done // each, offset, plan.capacity(used)))
            done += some
    return out


def pack(
    df: DataFrame,
    sizes: Sequence[int] = SIZES,
    price: Callable[[int], float] = sequence_cost,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every whole text in a bin: id, piece, start, length, bin_id, capacity, offset.

    Tokens are the UTF-8 bytes of the text and one end mark. A text longer than the largest size is
    cut into pieces of that size and a rest; ``start`` is the piece's first token in the text.
    ``capacity`` is one of ``sizes``, the smallest that holds the bin's contents; ``offset`` is the
    piece's place in it. Bins are numbered from 0 without gaps.

    NULL and empty texts are one end mark. NULL ids pass; rows with equal id are placed each on its
    own, and which of two rows of one id and length gets which place is open. Other columns are
    ignored; an empty table gives an empty result. The driver sees counts of lengths only, at most
    ``max(sizes)``; ranks come from one global sort, so a length that most texts share is
    spread over many tasks.
    """
    spark, largest = df.sparkSession, max(sizes)
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    rows = df.select(F.col(id_col).alias("_id"), size.alias("_size"))
    rows = rows.select("_id", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / largest))).alias("piece"))
    rows = rows.withColumn("_length", F.least(F.lit(largest), F.col("_size") - F.col("piece") * largest).cast("int"))
    rows, total = numbered(rows.select("_length", "_id", "piece"), ["_length", "_id", "piece"], "pack_rows")
    counts = {r[0]: r[1] for r in rows.groupBy("_length").count().collect()}
    plan = best_plan(counts, sizes, price)
    before, start = {}, 0
    for length in sorted(counts):
        before[length], start = start, start + counts[length]
    runs = [(n, before[n] + rank, before[n] + rank + items, each, first, offset, capacity)
            for n, rank, items, each, first, offset, capacity in _pieces(plan)]
    places = spark.createDataFrame(runs, "_n int, _from long, _to long, _each long, _bin long, _offset long, capacity int")
    if len(runs) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    joined = rows.join(places, (F.col("_length") == F.col("_n")) & (F.col("row_no") >= F.col("_from")) & (F.col("row_no") < F.col("_to")))
    at = F.col("row_no") - F.col("_from")
    nth = F.pmod(at, F.col("_each"))
    return joined.select(
        F.col("_id").alias(id_col), "piece", (F.col("piece") * largest).alias("start"),
        F.col("_length").alias("length"),
        (F.col("_bin") + ((at - nth) / F.col("_each")).cast("long")).alias("bin_id"), "capacity",
        (F.col("_offset") + nth * F.col("_length")).alias("offset"),
    )
