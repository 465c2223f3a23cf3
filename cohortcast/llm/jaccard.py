"""Near-duplicate texts: Jaccard join over word n-grams, their order cut into fragments.

N-grams are 64-bit hashes and their global order is that of the hashes, cut into fragments of equal
width. What two texts share is the sum of what they share in each fragment. The sizes of a text's
fragments alone bound that sum, which rules nearly all candidates out; for the rest the fragments
are intersected one by one and the partial counts added per pair. Candidates share one of their
rarest n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.llm.blooms import FAN_IN, filter_bits, holds, seen
from cohortcast.llm.common import batches_of, stage, tidy
from cohortcast.llm.graph import components, forest
from cohortcast.llm.groups import pairs_inside, starts_of, whole_groups

WORDS = 3
FRAGMENTS = 128
BATCH_BYTES = 1 << 20
#: Bytes whose words are hashed at a time; the arrays for them take some 64 times as much.
PART_BYTES = 1 << 17
LEAST_COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 24
SEGMENT = 1 << 16
HOT = 1 << 16
#: Finer cut for the texts that are still candidates; it tells long texts apart.
FINE_FRAGMENTS = 2048
BUCKET_BLOCK = 512
FINE_BLOCK = 2048
SET_BLOCK = 1 << 19
COLUMNS = 1 << 12
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base**0, base**1, ... modulo 2**64, kept for the next call unless a very long word asks for more."""
    have = kept.get(base)
    if have is None or len(have) < count:
        have = np.full(max(count, PART_BYTES + (1 << 16)), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if count <= 2 * PART_BYTES:
            kept[base] = have
    return have[:count]


def _part_words(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a stretch of bytes: polynomials over the word's bytes."""
    space = np.concatenate([[True], _SPACES[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edges[::2], edges[1::2]
    values = (_LOWER[data] + np.uint64(1)) * _powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    raw = (sums[stops] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    return starts, mix(raw + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + (stops - starts).astype(np.uint64))


def word_hashes(data: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words, in stretches that end at white space."""
    array, at, out = np.frombuffer(data, dtype=np.uint8), 0, []
    while at < len(array):
        stop = min(len(array), at + PART_BYTES)
        while stop < len(array) and not _SPACES[array[stop]]:
            stop += 1
        starts, hashes = _part_words(array[at:stop], seed)
        out.append((starts + at, hashes))
        at = stop
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def shingle_sets(texts: list[bytes], words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, or none."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts, hashes = word_hashes(b"\n".join(texts), seed)
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    grams = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        grams = mix(grams * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + len(grams)])
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = mix(np.array([short]) * np.uint64(0x2545F4914F6CDD1D) + h)[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def node_of(grams: np.ndarray) -> tuple[int, int]:
    """Two independent fingerprints of a set."""
    a = mix(grams.sum(dtype=np.uint64)[None] + np.uint64(len(grams)))
    b = mix(mix(grams + np.uint64(77)).sum(dtype=np.uint64)[None])
    return int(a.astype(np.int64)[0]), int(b.astype(np.int64)[0])


def fragment_sizes(grams: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """N-grams of a set in each fragment; 255 stands for any larger number."""
    of = (grams >> np.uint64(64 - fragments.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(of, minlength=fragments), 255).astype(np.uint8)


def may_link(n_a, n_b, sizes_a, sizes_b, percent: int) -> np.ndarray:
    """Whether the sizes of the sets and of their fragments leave room for a link."""
    shared = np.minimum(sizes_a, sizes_b).sum(axis=1, dtype=np.int64)
    full = ((sizes_a == 255) & (sizes_b == 255)).any(axis=1)
    most = np.where(full, np.minimum(n_a, n_b), np.minimum(shared, np.minimum(n_a, n_b)))
    return 100 * most >= percent * (n_a + n_b - most)


def prefix_length(n: int, percent: int) -> int:
    """Rarest n-grams among which a set of n shares one with every set it links with."""
    return n - -(-n * percent // 100) + 1


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared n-grams of each left with each right set: partial counts by fragment, added up.

    Only n-grams on both sides are columns of the 0/1 matrices whose product a fragment adds; a
    fragment of the order is ``COLUMNS`` such n-grams wide.
    """
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    owner_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    owner_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    for k in range(0, len(both), COLUMNS):
        fragment = both[k : k + COLUMNS]
        matrices = []
        for grams, owner, count in ((a, owner_a, len(left)), (b, owner_b, len(right))):
            inside = np.flatnonzero((grams >= fragment[0]) & (grams <= fragment[-1]))
            column = np.searchsorted(fragment, grams[inside])
            known = fragment[column] == grams[inside]
            matrix = np.zeros((count, len(fragment)), dtype=np.float32)
            matrix[owner[inside[known]], column[known]] = 1
            matrices.append(matrix)
        total += (matrices[0] @ matrices[1].T).astype(np.int64)
    return total


def _counters(rows: DataFrame, counters: int, words: int, seed: int) -> np.ndarray:
    """How often n-grams occur over all texts, by hash modulo ``counters``.

    Tasks count into arrays of fixed size, which are added up by segment, ``FAN_IN`` at a time.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.uint32)
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            for grams in _joined(shingle_sets(batch.column(1).to_pylist(), words, seed)):
                np.add.at(total, (grams & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
        for k in range(0, counters, SEGMENT):
            part = total[k : k + SEGMENT]
            if part.any():
                kind = np.uint16 if part.max() < 1 << 16 else np.int64
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.max() >= 1 << 16]), pa.array([part.astype(kind).tobytes()])], names=["at", "wide", "counts"])

    parts = rows.mapInArrow(run, "at long, wide boolean, counts binary").withColumn("part", F.spark_partition_id().cast("long"))

    def combine(key: tuple, some: pa.Table) -> pa.Table:
        total = np.zeros(min(SEGMENT, counters), dtype=np.int64)
        for wide, part in zip(some.column("wide"), some.column("counts"), strict=True):
            total += np.frombuffer(part.as_py(), dtype=np.int64 if wide.as_py() else np.uint16).astype(np.int64)
        return pa.table({"at": [key[0].as_py()], "wide": [True], "counts": [total.tobytes()], "part": [key[1].as_py()]})

    left = max(1, rows.rdd.getNumPartitions())
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("at", "part").applyInArrow(combine, "at long, wide boolean, counts binary, part long")
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    out = np.zeros(counters, dtype=np.int64)
    for r in parts.select("at", "counts").toLocalIterator():
        out[r[0] : r[0] + SEGMENT] = np.frombuffer(r[1], dtype=np.int64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def _joined(sets: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate(sets)] if sets else []


def near_texts(
    df: DataFrame, percent: int = 90, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_shingles, component_id.

    A text's set holds its distinct n-grams of ``words`` words (A-Z in lower case, split at ASCII
    white space); fewer words are one n-gram. Two texts link if ``100 * shared >= percent * union``;
    texts without words link with nothing. ``component_id`` is the smallest id reachable by links.

    Texts with equal sets are one class, and only classes are compared. All candidates of a class
    are found, whatever the size of its group: large buckets and groups are cut into blocks that
    are compared pair by pair, and only spanning forests leave a task. NULL ids pass: they join
    their class but name no component, so one with no other id has none. Rows with one id are told
    apart by their texts. Repeated rows give repeated results, other columns are ignored, an empty table gives
    an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"))
    seed = 0
    while True:
        marks = _marks(rows, kind, words, seed)
        classes = marks.filter("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.min("check").alias("low"), F.max("check").alias("high"), F.first("n").alias("n"))
        classes = stage(classes, "classes")
        if classes.filter("low <> high").isEmpty():
            break
        seed += 1  # two sets met in 64 bits: take other hashes
    total = marks.count()
    links = _links(spark, rows, classes, total, percent, words, seed, kind)
    roots = components(links, "a", "b")
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    by_class = rooted.join(names, "root").select("node", "component")
    out = marks.join(by_class, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _marks(rows: DataFrame, kind: str, words: int, seed: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            sets = shingle_sets(batch.column(1).to_pylist(), words, seed)
            nodes = [node_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [a for a, _ in nodes], [b for _, b in nodes]))],
                names=["id", "n", "node", "check"],
            )

    return stage(rows.mapInArrow(run, f"id {kind}, n long, node long, check long"), "text_sets")


def _links(spark, rows, classes, total, percent, words, seed, kind) -> DataFrame:
    """Links (a, b) of spanning forests over the classes."""
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (4 * total).bit_length()))
    counts = spark.sparkContext.broadcast(_counters(rows, counters, words, seed))
    # below this size any difference is too much, and equal sets are one class already
    least = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1))

    @tidy
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            out = []
            for grams in shingle_sets(batch.column(1).to_pylist(), words, seed):
                if len(grams) >= least:
                    often = counts.value[(grams & np.uint64(counters - 1)).astype(np.int64)]
                    at = np.lexsort((grams, often))[: prefix_length(len(grams), percent)]
                    some, hot = grams[at].astype(np.int64), often[at] > HOT
                    out.append((node_of(grams)[0], len(grams), some[~hot], some[hot], fragment_sizes(grams).tobytes()))
            if out:
                node, n, some, hot, sizes = zip(*out, strict=True)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(n), pa.array(some, lists), pa.array(hot, lists), pa.array(sizes, pa.binary())], names=["node", "n", "rare", "hot", "sizes"]
                )

    heads = rows.mapInArrow(rare, "node long, n long, rare array<long>, hot array<long>, sizes binary").dropDuplicates(["node"])
    heads = stage(heads, "rare_grams")
    # most n-grams are held once; one exchange drops them, and the counters bound each window by HOT
    rare_rows = heads.select("node", "n", F.explode("rare").alias("gram"))
    rare_rows = rare_rows.withColumn("held", F.count("*").over(Window.partitionBy("gram"))).filter("held > 1")
    # sets that may link have sizes of at least this ratio, also to the next size of their window
    by_size = Window.partitionBy("gram").orderBy("n")
    rare_rows = rare_rows.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    rare_rows = rare_rows.filter((100 * F.col("less") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("more"))).drop("less", "more")
    hot_rows = heads.select("node", "n", F.explode("hot").alias("gram"))
    hot_rows = hot_rows.join(hot_rows.groupBy("gram").agg(F.count("*").alias("held")), "gram").select(rare_rows.columns)
    buckets = stage(rare_rows.unionByName(hot_rows).filter("held > 1"), "buckets").join(heads.select("node", "sizes"), "node")
    maybe = stage(_possible(buckets, percent, BUCKET_BLOCK), "possible_links")
    wanted = _blobs(maybe, classes)
    fine = _of_classes(spark, rows, wanted, words, seed, kind, lambda grams: fragment_sizes(grams, FINE_FRAGMENTS))
    fine = fine.select(F.col("blob").alias("gram"), "node", "n", F.col("held"), F.col("value").alias("sizes"))
    wanted = _blobs(stage(_possible(fine, percent, FINE_BLOCK), "possible_links"), classes)
    return stage(_exact(spark, rows, wanted, percent, words, seed, kind), "text_links")


def _blobs(maybe: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that possible links connect, with their blob's number of classes and blocks of sets."""
    blobs = components(maybe, "a", "b").select("node", F.col("root").alias("blob"))
    wanted = blobs.join(classes.select("node", "rep", "n"), "node")
    weight = F.greatest(F.ceil(F.sum("n") / SET_BLOCK), F.ceil(F.count("*") / BUCKET_BLOCK)).alias("weight")
    return stage(wanted.join(wanted.groupBy("blob").agg(weight, F.count("*").alias("held")), "blob"), "candidate_sets")


def _split(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Rows of each pair of blocks of a group; ``grp`` names the pair, ``mine`` the row's own block."""
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return rows.withColumns({"grp": F.xxhash64(group, low, high), "split": low != high})


def _possible(buckets: DataFrame, percent: int, block: int) -> DataFrame:
    """Spanning forests, per bucket, of the pairs that the sizes of their fragments allow to link."""
    rows = _split(buckets, "gram", F.ceil(F.col("held") / block))
    rows = rows.select("grp", "gram", "node", "n", "sizes", "mine", "split").repartition("grp").sortWithinPartitions("grp")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp", rows=4000):
            table = table.combine_chunks()
            groups, gram, node, n, mine, split = (table.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "gram", "node", "n", "mine", "split"))
            sizes = np.frombuffer(b"".join(table.column("sizes").to_pylist()), dtype=np.uint8).reshape(len(table), -1)
            found = []
            for i, j in pairs_inside(groups):
                ok = (gram[i] == gram[j]) & (~split[i] | (mine[i] != mine[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                ok = may_link(n[i], n[j], sizes[i], sizes[j], percent)
                found.append((i[ok], j[ok]))
            if found:
                root = forest(len(table), np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]))
                some = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _text_keys(nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Filter keys of one text of a class: the class and the hash of the text's id."""
    return mix(nodes.astype(np.int64).view(np.uint64) + mix(ids.astype(np.int64).view(np.uint64)))


def _of_classes(spark, rows: DataFrame, wanted: DataFrame, words: int, seed: int, kind: str, value) -> DataFrame:
    """``wanted`` with ``value`` of each class's set, an array made from one text per class.

    A Bloom filter of fixed bounds picks these texts in the tasks that read them, and a join makes
    the choice exact. Repeated rows of a text bring its set repeatedly.
    """
    hashed = wanted.select("node", F.xxhash64("rep").alias("k"))
    packed = seen(hashed, lambda batch: _text_keys(*(batch.column(k).to_numpy() for k in (0, 1))), filter_bits(wanted.count()))
    chosen = spark.sparkContext.broadcast(packed)

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_text", BATCH_BYTES):
            found = shingle_sets(batch.column(1).to_pylist(), words, seed)
            nodes = np.array([node_of(s)[0] for s in found], dtype=np.int64)
            likely = np.flatnonzero(holds(chosen.value, _text_keys(nodes, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(likely)), pa.array(nodes[likely]), pa.array([value(found[k]).tobytes() for k in likely], pa.binary())], names=["id", "node", "value"]
            )

    found = rows.withColumn("_key", F.xxhash64("_id")).mapInArrow(sets, f"id {kind}, node long, value binary")
    return found.join(wanted.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("rep")))


def _exact(spark, rows: DataFrame, wanted: DataFrame, percent: int, words: int, seed: int, kind: str) -> DataFrame:
    """Links among the classes of each blob, from their whole sets."""
    found = _of_classes(spark, rows, wanted, words, seed, kind, lambda grams: grams)
    split = _split(found.select("blob", "node", F.col("value").alias("grams"), "weight"), "blob", F.col("weight"))
    split = split.select("grp", "blob", "node", "grams", "mine", "split").repartition("grp").sortWithinPartitions("grp", "mine", "node")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp", rows=256):
            groups, node = (table.column(c).to_numpy() for c in ("grp", "node"))
            # repeated rows bring a set twice; one is enough
            table = table.filter(pa.array(np.concatenate([[True], (groups[1:] != groups[:-1]) | (node[1:] != node[:-1])])))
            groups, blob, mine, node, split_ = (table.column(c).to_numpy() for c in ("grp", "blob", "mine", "node", "split"))
            grams = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
            edges = starts_of(groups)
            links_a, links_b = [], []
            for first, stop in zip(edges, edges[1:], strict=False):
                middle = first + int((mine[first:stop] == mine[first]).sum()) if split_[first] else first
                left = range(first, middle if split_[first] else stop)
                right = range(middle, stop) if split_[first] else left
                if not len(left) or not len(right) or (len(left) == 1 and not split_[first]):
                    continue
                shared = overlaps([grams[k] for k in left], [grams[k] for k in right])
                union = np.array([len(grams[k]) for k in left])[:, None] + np.array([len(grams[k]) for k in right]) - shared
                i, j = np.nonzero(100 * shared >= percent * union)
                i, j = i + first, j + right[0]
                ok = (i != j) & (blob[i] == blob[j])
                links_a.append(i[ok])
                links_b.append(j[ok])
            if links_a:
                root = forest(len(table), np.concatenate(links_a), np.concatenate(links_b))
                some = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"])

    return split.mapInArrow(run, "a long, b long")
