"""Near-duplicate vectors: learned binary codes, multi-index tables, exact cosines of what they find."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import stage, tidy
from cohortcast.llm.graph import components, forest
from cohortcast.llm.groups import pairs_inside, whole_groups
from cohortcast.llm.ranges import spread_join

#: Bound of the sample that the rotations are learned from.
SAMPLE = 20_000
BITS = 64
ROUNDS = 30
#: Share of the probe pairs at the threshold that the tables must catch, and how many probes measure it.
RECALL, PROBES = 0.998, 4_000
#: Rotations from which a narrower chunk serves better than one more.
MOST_ROTATIONS = 24
BLOCK = 512


def learn_rotation(vectors: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Iterative quantisation: a projection (size, bits) whose signs lose least of the vectors.

    Centred vectors are projected on their main directions; a random rotation of these is then
    moved, in turn, to fit the signs of what it yields, which balances the variance over the bits.
    """
    _, _, axes = np.linalg.svd(vectors, full_matrices=False)
    main = axes[:bits].T
    projected = vectors @ main
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((main.shape[1], main.shape[1])))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
        rotation = (left @ right).T
    return main @ rotation


def probe_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sets of pairs of unit vectors whose cosine is the threshold: the hardest links there are.

    Vectors of the sample are turned by that angle, in one set towards anywhere, in the other
    towards another vector of the sample, as pairs inside few dimensions would be.
    """
    rng = np.random.default_rng(11)
    x = sample[rng.integers(len(sample), size=PROBES)]
    pairs = []
    for towards in (rng.standard_normal(x.shape), sample[rng.integers(len(sample), size=PROBES)] - x):
        aside = towards - np.einsum("ij,ij->i", towards, x)[:, None] * x
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
        y = threshold * x + math.sqrt(1 - threshold**2) * aside
        pairs.append((x, y / np.linalg.norm(y, axis=1, keepdims=True)))
    return pairs


class Codes:
    """Binary codes of all rotations, their tables and the Hamming radius of a link.

    A table is a chunk of ``width`` bits of one rotation. Rotations are added until both sets of
    ``probe_pairs`` agree in some chunk often enough; where many do not suffice, chunks get
    narrower. No probe pair lies outside ``radius``, counted over the bits of all rotations.
    """

    def __init__(self, sample: np.ndarray, threshold: float, width: int):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.bits = min(BITS, *centred.shape)
        probes = probe_pairs(sample, threshold)
        learned: list[np.ndarray] = []
        self.width = max(1, min(width, self.bits))
        while True:
            self.chunks = self.bits // self.width
            caught, apart = [np.zeros(len(a), dtype=bool) for a, _ in probes], [np.zeros(len(a), dtype=int) for a, _ in probes]
            self.recall, used = 0.0, 0
            while self.recall < RECALL and used < MOST_ROTATIONS:
                if used == len(learned):
                    learned.append(learn_rotation(centred, self.bits, used))
                for k, (a, b) in enumerate(probes):
                    differ = self._signs(a, learned[used]) != self._signs(b, learned[used])
                    chunks = differ[:, : self.chunks * self.width].reshape(len(a), self.chunks, self.width)
                    caught[k] |= ~chunks.any(axis=2).all(axis=1)
                    apart[k] += differ.sum(axis=1)
                used += 1
                self.recall = min(c.mean() for c in caught)
            if self.recall >= RECALL or self.width == 1:
                break
            self.width -= 1
        self.rotations = learned[:used]
        self.radius = int(max(a.max() for a in apart))
        self.tables = used * self.chunks

    def _signs(self, vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ rotation >= 0

    def words(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, words) codes of vectors of length one, a word of 64 bits for each rotation."""
        out = np.zeros((len(vectors), len(self.rotations), 8), dtype=np.uint8)
        for k, rotation in enumerate(self.rotations):
            packed = np.packbits(self._signs(vectors, rotation), axis=1, bitorder="little")
            out[:, k, : packed.shape[1]] = packed
        return out.reshape(len(vectors), -1).view("<u8")

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(rows, tables) chunk values of codes."""
        mask = np.uint64((1 << self.width) - 1)
        shifts = (np.arange(self.chunks) * self.width).astype(np.uint64)
        return ((words[:, :, None] >> shifts) & mask).astype(np.int64).reshape(len(words), -1)


def _unit(values: pa.Array, size: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True, initial=0.0)  # squares of large components overflow
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def near_vectors(
    df: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per vector: id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not NULL, they have the same length and their
    cosine in double precision is at least ``threshold``. NULL vectors, zero vectors and vectors
    with a NULL or non-finite component link with nothing. ``component_id`` is the smallest id
    reachable by links, ``kept`` says whether it is the vector's own.

    Rows with one id are one vector, that of the smallest (label, vector). Rows without id come
    back with 0 links and no component, not kept. Other columns are ignored; an empty table gives an
    empty result.

    Equal vectors with one label are a class (by 128 bits of hash) and are compared once; they link
    with each other. Classes meet in multi-index tables over learned binary codes: candidates share
    a chunk of bits and lie within a Hamming radius, see ``Codes``. The width of a chunk grows with
    the table. Large buckets are cut into blocks of about ``BLOCK`` classes, and pairs of blocks are
    compared by themselves. Only codes travel to the buckets; the vectors follow for those that have
    a candidate, for the exact cosine. A pair counts in the first table in which it agrees, so
    nothing is counted twice, and only degrees and spanning forests leave a task.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    ids = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    same = ["class_a", "class_b"]
    hashes = [F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), "label", "vector")]
    ids = stage(ids.select("*", *(F.when(usable, h).alias(n) for n, h in zip(same, hashes, strict=True))), "vectors")
    alike = ids.filter(F.col("class_a").isNotNull()).groupBy(*same)
    classes = alike.agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = stage(classes.withColumn("size", F.size("vector")), "vector_classes")
    sizes = [(r[0], r[1]) for r in classes.groupBy("size").count().collect()]
    links = [_links(classes.filter(F.col("size") == size), size, count, threshold) for size, count in sizes]
    lone = ids.filter(F.col("class_a").isNull()).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root"))
    out = lone
    if links:
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        degrees = found.groupBy("id").agg(F.sum("degree").alias("n"))
        roots = components(found.select("id", "root"), "id", "root").withColumnsRenamed({"node": "id", "root": "reached"})
        known = classes.select(*same, "id", "copies").join(degrees, "id", "left").join(roots, "id", "left")
        known = known.select(*same, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("reached", "id").alias("root"))
        members = ids.filter(F.col("class_a").isNotNull()).select("id", *same)
        out = spread_join(members, stage(known, "vector_roots"), same, "copies").select("id", "n", "root").unionByName(lone)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("root").cast("long").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))
    none = rows.filter(F.col("id").isNull())
    none = none.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    return out.unionByName(none)


def learn_codes(rows: DataFrame, size: int, count: int, threshold: float) -> Codes:
    """Codes for ``count`` rows with a ``vector`` of one length, learned from at most ``2 * SAMPLE`` of them."""
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, SAMPLE / count) * (1 << 30)
    sample = rows.filter(share).limit(2 * SAMPLE).select("vector").toArrow().column(0)
    if not len(sample):
        sample = rows.limit(1).select("vector").toArrow().column(0)
    width = max(6, min(24, int(math.log2(max(2, count))) - 3))
    return Codes(_unit(sample.combine_chunks(), size), threshold, width)


def _links(rows: DataFrame, size: int, count: int, threshold: float) -> DataFrame:
    """Rows (id, degree, root): partial degrees and links of spanning forests, for classes of one length."""
    codes = rows.sparkSession.sparkContext.broadcast(learn_codes(rows, size, count, threshold))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                words = codes.value.words(_unit(batch.column(2), size))
                keys = codes.value.keys(words)
                ends = np.arange(len(batch) + 1, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends * m.shape[1]), pa.array(m.ravel())) for m in (words.view(np.int64), keys)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "label", "code", "keys"])

    placed = rows.select("id", "label", "vector").mapInArrow(place, f"id {kinds['id']}, label {kinds['label']}, code array<bigint>, keys array<bigint>")
    placed = stage(placed, "vector_codes")
    bucket = ["label", "tab", "key"]
    spots = placed.select("id", "label", "code", F.posexplode("keys").alias("tab", "key"))
    held = spots.groupBy(*bucket).agg(F.count("*").alias("held")).filter("held > 1")
    met = spread_join(spots, stage(held, "vector_buckets"), bucket, "held")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    met = met.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    met = met.select(F.xxhash64(*bucket, low, high).alias("grp"), "id", *bucket, "mine", (low != high).alias("split"), "code")
    met = met.repartition("grp").sortWithinPartitions("grp")

    def candidates(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one bucket within the radius that agree in no earlier table."""
        groups, tab, mine, split, key = (table.column(n).to_numpy(zero_copy_only=False) for n in ("grp", "tab", "mine", "split", "key"))
        words = table.column("code").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
        keys = codes.value.keys(words)
        labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        for i, j in pairs_inside(groups):
            ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= codes.value.radius
            i, j = i[ok], j[ok]
            # groups go by a hash, so what they stand for is compared as well
            ok = (~split[i] | (mine[i] != mine[j])) & (labels[i] == labels[j]) & (tab[i] == tab[j]) & (key[i] == key[j])
            i, j = i[ok], j[ok]
            first = (keys[i] == keys[j]).argmax(axis=1) == tab[i]
            yield i[first], j[first]

    @tidy
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp"):
            table = table.combine_chunks()
            wanted = np.zeros(len(table), dtype=bool)
            for i, j in candidates(table):
                wanted[i] = wanted[j] = True
            yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp"):
            table = table.combine_chunks()
            unit = _unit(table.column("vector").combine_chunks(), size)
            copies = table.column("copies").to_numpy()
            degree, a, b = np.zeros(len(table), dtype=np.int64), [], []
            for i, j in candidates(table):
                close = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                a.append(i[close])
                b.append(j[close])
            if not a:
                continue
            a, b = np.concatenate(a), np.concatenate(b)
            np.add.at(degree, a, copies[b])
            np.add.at(degree, b, copies[a])
            root = forest(len(table), a, b)
            linked = np.flatnonzero(degree)
            names = table.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(linked)), pa.array(degree[linked]), names.take(pa.array(root[linked]))], names=["id", "degree", "root"]
            )

    sifted = met.mapInArrow(sift, met.schema.simpleString()[len("struct<"):-1]).join(rows.select("id", "copies", "vector"), "id")
    sifted = sifted.repartition("grp").sortWithinPartitions("grp")
    return stage(sifted.mapInArrow(compare, f"id {kinds['id']}, degree long, root {kinds['id']}"), "vector_links")
