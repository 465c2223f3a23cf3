"""Alignment of two tokenizers' tokens: token ends are merged in pieces of equal work, groups stitched.

Tokenizer A is a byte-level BPE of the tokenizers library, B a BPE of sentencepiece. Both see the
text with one space in front (B adds it itself).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortcast.llm.common import batches_of, release_memory, stage, tidy

PIECE = 1 << 13
BATCH_BYTES = 1 << 20
BLOCK_BYTES = 1 << 23
CACHED_UNITS = 300_000
#: Groups with more links than this are counted by distinct ids.
WIDE_GROUP = 1 << 12


# --- merge path ------------------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of ``piece`` merged ends start in a and in b; the last entries are the lengths.

    A diagonal d holds all (i, j) with i + j = d; a binary search finds the one at which the merge
    of the sorted ``a`` and ``b`` (a first among equals) has taken i of a and j of b. All diagonals
    are searched at once. An end of b that equals the last end taken of a goes with it, so that equal
    ends are never in two pieces.
    """
    at = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        take = np.zeros(len(at), dtype=bool)
        take[open_] = a[mid[open_]] <= b[at[open_] - mid[open_] - 1]
        low, high = np.where(open_ & take, mid + 1, low), np.where(open_ & ~take, mid, high)
    i, j = low, at - low
    tied = (i > 0) & (j < len(b))
    tied[tied] = a[i[tied] - 1] == b[j[tied]]
    return np.append(i, len(a)), np.append(j + tied, len(b))


def piece_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends that a piece's ``a`` and ``b`` have in common."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    return np.flatnonzero(same), at[same]


def common_cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all common ends, found piece by piece.

    Tokens before a piece's first cut and after its last one belong to groups that go over its
    boundary; stitching is to number the cuts through, a group being all from one cut to the next.
    """
    i, j = diagonals(a, b, piece)
    found = [piece_cuts(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]) for k in range(len(i) - 1)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return (
        np.concatenate([x + s for (x, _), s in zip(found, i, strict=False)]),
        np.concatenate([y + s for (_, y), s in zip(found, j, strict=False)]),
    )


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[k] .. starts[k] + counts[k] - 1 of all k, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


# --- tokens ----------------------------------------------------------------------------------


class Tokens:
    """Ids of whole texts under A and B; the libraries are called once for each distinct stretch.

    A text is cut before single spaces between two characters that are no white space. A always
    begins a token there. B does if none of its pieces holds a space after another character (a
    merge can't reach over the place then); if one does, texts are not cut. Tokens of the stretches,
    put together, are those of the text. A stretch whose tokens' bytes are not its own is ``bad``.
    """

    cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = self._byte_letters()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i)) if self._plain(self.a.id_to_token(i), letters) else self.a.id_to_token(i).encode()
                        for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.clear()

    @staticmethod
    def _plain(token: str, letters: dict[str, int]) -> bool:
        return all(c in letters for c in token)

    @staticmethod
    def _byte_letters() -> dict[str, int]:
        """The letter that stands for each byte: itself if it prints, else the next free one from 256."""
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(prints)]
        return {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(rest)}

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids_a, self.ids_b = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        self.counts_a, self.counts_b, self.bad = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
        self.n = 0

    def _put(self, units: list[str]) -> None:
        """Encode new stretches and number them."""
        if not units:
            return
        codes_a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        codes_b = self.b.encode(units, num_threads=1)
        bad = []
        for unit, x, y in zip(units, codes_a, codes_b, strict=True):
            data = b" " + unit.encode()
            bad.append(b"".join(map(self.bytes_a.__getitem__, x)) != data or b"".join(map(self.bytes_b.__getitem__, y)) != data)
        for codes, ids, counts in ((codes_a, self.ids_a, self.counts_a), (codes_b, self.ids_b, self.counts_b)):
            ids.append(np.fromiter((i for c in codes for i in c), dtype=np.int32))
            counts.append(np.array([len(c) for c in codes], dtype=np.int64))
        self.bad.append(np.array(bad))
        self.known.update(zip(units, range(self.n, self.n + len(units)), strict=True))
        self.n += len(units)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(ids, tokens per text) under A and under B, and whether each text is bad."""
        if self.n > CACHED_UNITS:
            self.clear()
        units = [[t] if self.whole else t.split(" ") for t in texts]
        odd: set[str] = set()
        if not self.whole:
            odd = {u for u in set().union(*units) if not u or u[0].isspace() or u[-1].isspace()}
            if odd:  # a space at an end or beside white space: those texts are cut with more care
                units = [self.cut.split(t) if not odd.isdisjoint(u) else u for t, u in zip(texts, units, strict=True)]
        self._put([u for u in dict.fromkeys(u for some in units for u in some) if u not in self.known])
        for name in ("ids_a", "ids_b", "counts_a", "counts_b", "bad"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        per_text = np.array([len(u) for u in units], dtype=np.int64)
        at = np.fromiter((self.known[u] for some in units for u in some), dtype=np.int64, count=int(per_text.sum()))
        first = np.cumsum(per_text) - per_text
        out = []
        for ids, counts in ((self.ids_a[0], self.counts_a[0]), (self.ids_b[0], self.counts_b[0])):
            starts = np.cumsum(counts) - counts
            out += [ids[spread(starts[at], counts[at])], np.add.reduceat(counts[at], first) if len(first) else first]
        bad = np.maximum.reduceat(self.bad[0][at], first) if len(first) else first.astype(bool)
        return (*out, bad)


@lru_cache(maxsize=1)
def tokens(path_a: str, path_b: str) -> Tokens:
    return Tokens(path_a, path_b)


# --- alignment of a batch ----------------------------------------------------------------------


class Aligner:
    """Groups, their digest and links of a batch of texts."""

    def __init__(self, code: Tokens, piece: int = PIECE):
        self.code, self.piece, self.span = code, piece, len(code.bytes_b)
        marks = [(f"{i}{s}").encode() for i in range(len(code.bytes_a)) for s in ",|"]
        self.marks = marks + [(f"{i}{s}").encode() for i in range(len(code.bytes_b)) for s in ",;"]
        self.marks_b = len(marks)

    def align(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text n_a, n_b, n_groups, n_links; digests; and the links as (text, pair, times), sorted.

        A pair is id of A times the size of B's vocabulary plus id of B.
        """
        good = np.array([k for k, t in enumerate(texts) if t], dtype=np.int64)
        a, n_a, b, n_b, bad = self.code.encode([texts[k] for k in good])
        keep = ~bad
        a, b = a[np.repeat(keep, n_a)], b[np.repeat(keep, n_b)]
        good, n_a, n_b = good[keep], n_a[keep], n_b[keep]
        ends_a, ends_b = np.cumsum(self.code.size_a[a]), np.cumsum(self.code.size_b[b])
        cut_a, cut_b = common_cuts(ends_a, ends_b, self.piece)
        first_a, first_b = np.append(0, cut_a[:-1] + 1)[: len(cut_a)], np.append(0, cut_b[:-1] + 1)[: len(cut_b)]
        many_a, many_b = cut_a - first_a + 1, cut_b - first_b + 1
        stops = np.cumsum(n_a)
        owner = np.searchsorted(stops, cut_a, side="right")  # every text ends with a cut
        digests = [""] * len(texts)
        self._digests(digests, good, a, b, first_a, first_b, many_a, many_b, n_a + n_b)
        text, pair, times = self._links(a, b, first_a, first_b, many_a, many_b, owner)
        columns = [np.zeros(len(texts), dtype=np.int64) for _ in range(4)]
        sums = (n_a, n_b, np.bincount(owner, minlength=len(good)), np.bincount(owner, many_a * many_b, minlength=len(good)))
        for column, values in zip(columns, sums, strict=True):
            column[good] = np.asarray(values).astype(np.int64)
        return columns, digests, good[text], pair, times

    def _digests(self, out, good, a, b, first_a, first_b, many_a, many_b, sizes) -> None:
        """SHA-256 of ids in order, A's and B's of each group in turn."""
        which = np.empty(len(a) + len(b), dtype=np.int64)
        ids, last = 2 * a.astype(np.int64), np.zeros(len(a), dtype=np.int64)
        last[first_a + many_a - 1] = 1
        which[spread(first_a + first_b, many_a)] = ids + last
        ids, last = 2 * b.astype(np.int64) + self.marks_b, np.zeros(len(b), dtype=np.int64)
        last[first_b + many_b - 1] = 1
        which[spread(first_a + first_b + many_a, many_b)] = ids + last
        listed, at = which.tolist(), 0
        for k, size in zip(good.tolist(), sizes.tolist(), strict=True):
            text = b"".join(map(self.marks.__getitem__, listed[at : at + size]))
            out[k] = hashlib.sha256(text[:-1]).hexdigest()
            at += size

    def _links(self, a, b, first_a, first_b, many_a, many_b, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        narrow = many_a * many_b <= WIDE_GROUP
        fa, fb, na, nb, own = (x[narrow] for x in (first_a, first_b, many_a, many_b, owner))
        tokens_a = spread(fa, na)
        wide_b = np.repeat(nb, na)
        pair = np.repeat(a[tokens_a].astype(np.int64) * self.span, wide_b) + b[spread(np.repeat(fb, na), wide_b)]
        text = np.repeat(own, na * nb)
        times = np.ones(len(pair), dtype=np.int64)
        for g in np.flatnonzero(~narrow).tolist():  # very many tokens without a common end
            x, cx = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            y, cy = np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            pair = np.append(pair, (x.astype(np.int64)[:, None] * self.span + y[None, :]).ravel())
            text = np.append(text, np.full(len(x) * len(y), owner[g]))
            times = np.append(times, np.outer(cx, cy).ravel())
        pairs = len(self.code.bytes_a) * self.span
        if (times == 1).all():
            both, times = np.unique(text * pairs + pair, return_counts=True)
        else:
            both, back = np.unique(text * pairs + pair, return_inverse=True)
            times = np.bincount(back, times, minlength=len(both)).astype(np.int64)
        return both // pairs, both % pairs, times


# --- links of a text as bytes ------------------------------------------------------------------


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, the high bit where more follow; and the bytes of each."""
    sizes = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        more = values >> bits > 0
        if not more.any():
            break
        sizes += more
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[starts[some] + k] = (values[some] >> (7 * k) & 127) | np.where(sizes[some] > k + 1, 128, 0)
    return out, sizes


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    which = np.repeat(np.arange(len(ends)), ends - starts + 1)
    shift = 7 * (np.arange(len(data)) - starts[which])
    return np.bincount(which, (data & 127).astype(np.float64) * 2.0**shift, minlength=len(ends)).astype(np.int64)


class Block:
    """Texts whose links share one table of distinct pairs, most frequent first."""

    def __init__(self):
        self.bytes, self.parts, self.texts = 0, [], 0

    def add(self, size: int, texts: int, text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((text + self.texts, pair, times))
        self.texts += texts
        self.bytes += size

    def close(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The distinct pairs, in how many texts each is, and for each text its links in bytes.

        A text's links are the steps between its places in the table, twice the step plus whether
        the link occurs more than once; then, for those, how often.
        """
        text, pair, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        pairs, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(pairs), dtype=np.int64)
        place[order] = np.arange(len(pairs))
        at = place[back]
        sort = np.argsort(text * max(1, len(pairs)) + at)
        text, at, times = text[sort], at[sort], times[sort]
        step = np.diff(at, prepend=0)
        new = np.diff(text, prepend=-1) > 0
        step[new] = at[new]
        again = times > 1
        steps, step_sizes = pack_numbers(2 * step + again)
        more, more_sizes = pack_numbers(times[again])
        a = np.bincount(text, step_sizes, minlength=self.texts).astype(np.int64).tolist()
        b = np.bincount(text[again], more_sizes, minlength=self.texts).astype(np.int64).tolist()
        steps, more, out, i, j = steps.tobytes(), more.tobytes(), [], 0, 0
        for x, y in zip(a, b, strict=True):
            out.append(steps[i : i + x] + more[j : j + y])
            i, j = i + x, j + y
        return pairs[order], counts[order], out


def text_links(links: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the table, times) of the links of several texts."""
    sizes = np.array([len(x) for x in links], dtype=np.int64)
    data = np.frombuffer(b"".join(links), dtype=np.uint8)
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    values = unpack_numbers(data)
    text = np.repeat(np.arange(len(links)), sizes)[data < 128]
    # of n numbers of a text, the first s are steps and the others the counts of the odd steps among them
    count = np.bincount(text, minlength=len(links))
    start = np.cumsum(count) - count
    rank = np.arange(len(values)) - start[text]
    odd = values & 1
    seen = np.cumsum(odd) - np.where(start[text] > 0, np.cumsum(odd)[start[text] - 1], 0)  # odd numbers of the text so far
    # the steps end where numbers so far plus odd ones so far make up all numbers
    whole = rank + 1 + seen == count[text]
    first = np.full(len(links), len(values), dtype=np.int64)
    np.minimum.at(first, text[whole], rank[whole] + 1)
    is_step = rank < first[text]
    times = np.ones(len(values), dtype=np.int64)
    times[np.flatnonzero(is_step & (odd == 1))] = values[~is_step]
    text, step, times = text[is_step], values[is_step] >> 1, times[is_step]
    place = np.cumsum(step)
    new = np.diff(text, prepend=-1) > 0
    base = np.where(new, place - step, 0)
    return text, place - np.maximum.accumulate(base), times


# --- the operator -----------------------------------------------------------------------------


def align_tokens(
    df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, piece: int = PIECE
) -> DataFrame:
    """Per row: id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    Byte offsets at which tokens of A and of B both end cut both into groups; every A token of a
    group is linked with every B token of it. A pair of ids counts in how many rows it is linked;
    ``n_best`` counts the links whose pair has the highest count of all pairs of its A id, ties
    included, ``count_sum`` adds the counts of all links. ``groups_sha256`` is the SHA-256 of
    ``a1,a2|b1;a3|b2``: ids of A and of B by group.

    A row is a document, also where ids repeat. NULL and empty texts, and texts that A's or B's tokens
    don't give back byte by byte, have no tokens: zeros and an empty digest. Other columns are
    ignored, an empty table gives an empty result. ``path_a`` and ``path_b`` are files that every
    executor has.

    Ends are merged by ``common_cuts``. Rows go in blocks of about ``block_bytes`` of text (one row if
    its text is longer). Of a block only its distinct pairs are shuffled, to be counted; the counts
    come back to the block, whose rows keep their links as places in the block's list of pairs. A
    pair that every text has is one row per block.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens(path_a, path_b)
        aligner = Aligner(code, piece)
        block, held, part, number = Block(), [], TaskContext.get().partitionId(), 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, number
            pairs, counts, links = block.close()
            name, at = (part << 32) + number, 0
            for ids, columns, digests in held:
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, name)), ids, *map(pa.array, columns), pa.array(digests, pa.string()),
                     pa.array(links[at : at + n], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                    names=names,
                )
                at += n
            for i in range(0, len(pairs), 1 << 16):
                some, n = pairs[i : i + (1 << 16)], counts[i : i + (1 << 16)]
                blank = [pa.nulls(len(some), t) for t in (id_type, *[pa.int64()] * 4, pa.string(), pa.binary())]
                places = pa.array(np.arange(i, i + len(some), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name)), *blank, places, pa.array(some), pa.array(n.astype(np.int64))], names=names)
            block, held, number = Block(), [], number + 1
            release_memory()

        for batch in batches_of(batches, "_text", BATCH_BYTES):
            id_type = batch.column(0).type
            columns, digests, text, pair, times = aligner.align(batch.column(1).to_pylist())
            block.add(batch.column(1).nbytes, len(batch), text, pair, times)
            held.append((batch.column(0), columns, digests))
            if block.bytes >= block_bytes:
                yield from close()
        if held:
            yield from close()

    names = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "place", "pair", "n"]
    schema = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, place int, pair long, n long"
    done = stage(rows.mapInArrow(run, schema), "aligned")
    docs, pairs = done.filter("place IS NULL").select(names[:8]), done.filter("place IS NOT NULL").select("block", "place", "pair", "n")
    span = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    a_id = F.floor(F.col("pair") / span).cast("int")
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    met = stage(pairs.select("block", "place", "pair").join(counted, "pair"), "aligned_pairs")
    best = met.groupBy(a_id.alias("a")).agg(F.max("total").alias("most"))  # at most one row per id of A
    met = met.withColumn("a", a_id).join(F.broadcast(best), "a")
    met = met.select("block", "place", "total", (F.col("total") == F.col("most")).alias("best"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        places = right.column("place").to_numpy()
        total, best = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        total[places], best[places] = right.column("total").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        sums, hits = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
        links, at = left.column("links").to_pylist(), 0
        while at < len(links):
            some = links[at : at + 256]
            text, place, times = text_links(some)
            np.add.at(sums, text + at, total[place] * times)
            np.add.at(hits, text + at, best[place] * times)
            at += len(some)
        release_memory()
        return left.drop_columns(["block", "links"]).append_column("n_best", pa.array(hits)).append_column("count_sum", pa.array(sums))

    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    result = docs.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(finish, out)
    return result.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
