"""Prefix trie of conversations: grouped by digests of blocks of turns, refined only where siblings diverge.

A conversation's prefix is known by two 64-bit digests: the exclusive or, over its turns, of a hash
of (role, text, place). Digests of prefixes so add up like sums, over ranges of any conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import stage, tidy
from cohortcast.llm.ranges import range_carries, run_values, running, spread_join

BLOCK = 4
CHUNK_IDS = 8192
NODE = ["depth", "d1", "d2"]
UP = ["depth", "u1", "u2"]


def _long(value: int):
    return F.lit(value).cast("long")


def rebuilt_turns(df: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, g1, g2, n_bytes, length) of the rebuilt conversations, and all (conv, length).

    Conversation c takes the first h turns of conversation c - c % ``group`` and then its own turns
    after its first h; h is crc32 of c in decimal digits, modulo ``heads``.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = df.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("h1"),
        F.xxhash64(_long(1), text, role).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"), _long(1).alias("one"),
    )
    turns = running(turns, ["conv"], ["turn", "h1", "h2"], {"one": "sum"}, "conv_turns")
    turns = turns.withColumn("pos", F.col("before_one") + 1)
    h = F.pmod(F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")), _long(heads))
    base = F.col("conv") - F.col("conv") % group
    head = F.when((F.col("pos") < heads) & (F.col("conv") == base), F.struct("pos", "h1", "h2", "n_bytes"))
    convs = stage(turns.groupBy("conv").agg(F.count("*").alias("own"), F.collect_list(head).alias("head")), "convs")
    lent = convs.filter(F.col("conv") == base).select(F.col("conv").alias("base"), F.col("head").alias("lent"))
    convs = convs.drop("head").withColumns({"base": base, "h": h}).join(lent, "base", "left")
    convs = convs.withColumn("lent", F.filter(F.coalesce("lent", F.array().cast(lent.schema["lent"].dataType)), lambda t: t["pos"] <= F.col("h")))
    taken = F.size("lent").cast("long")
    convs = convs.withColumns({"shift": taken - F.col("h"), "length": taken + F.greatest(_long(0), F.col("own") - F.col("h"))})
    convs = stage(convs.select("conv", "lent", "shift", "length"), "convs_rebuilt")
    first = convs.select("conv", "length", F.explode("lent").alias("t")).select("conv", "length", "t.pos", "t.h1", "t.h2", "t.n_bytes")
    # a conversation of very many turns meets its row range by range
    pieces = turns.select("_range", "conv").distinct().join(convs.drop("lent"), "conv")
    own = turns.filter(F.col("pos") > h).join(pieces, ["_range", "conv"]).withColumn("pos", F.col("pos") + F.col("shift"))
    both = first.unionByName(own.select(first.columns))
    both = both.select("conv", "pos", F.xxhash64("h1", "pos").alias("g1"), F.xxhash64("h2", "pos").alias("g2"), "n_bytes", "length")
    return both, convs.select("conv", "length")


def turn_blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block of ``block`` turns, with prefix digests.

    Columns: conv, block, length, p1, p2 (digest of all turns before the block), q1, q2 (to its end),
    end (depth there), and lists d1, d2 (digest to each turn), n_bytes. Rows are dealt to ranges of
    (conv, block), so that no block is cut and a conversation of any size is spread.
    """
    spark = turns.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor((F.col("pos") - 1) / block).cast("long")
    dealt = turns.withColumn("block", at).repartitionByRange(ranges, "conv", "block").sortWithinPartitions("conv", "pos")
    dealt = dealt.select("conv", "pos", "block", "length", "g1", "g2", "n_bytes")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, first, carry, held = TaskContext.get().partitionId(), 0, None, True, [0, 0], None

        def blocks(table: pa.Table) -> pa.RecordBatch:
            nonlocal place, last, first, carry
            conv, pos, number, length, g1, g2, size = (c.to_numpy() for c in table.columns)
            new = np.ones(len(conv), dtype=bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = last is not None and conv[0] != last
            firsts = first & (np.cumsum(new) == 0)
            digests = [run_values(g, new, c, "xor") for g, c in zip((g1, g2), carry, strict=True)]
            starts = np.flatnonzero((pos - 1) % block == 0)
            stops = np.append(starts[1:], len(pos))
            offsets = pa.array(np.append(starts, len(pos)).astype(np.int32))
            last, first, carry = conv[-1], bool(firsts[-1]), [int(d[-1]) for d in digests]
            before = [(d ^ g)[starts] for d, g in zip(digests, (g1, g2), strict=True)]
            columns = [
                conv[starts], number[starts], length[starts], *before, *(d[stops - 1] for d in digests), pos[stops - 1],
                np.full(len(starts), part), np.arange(place, place + len(starts)), firsts[starts],
            ]
            place += len(starts)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (*digests, size)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], names=names)

        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            starts = np.flatnonzero((table.column("pos").to_numpy() - 1) % block == 0)
            stop = int(starts[-1]) if len(starts) else 0
            if stop:
                yield blocks(table.slice(0, stop).combine_chunks())
            held = table.slice(stop)
        if held is not None and len(held):
            yield blocks(held.combine_chunks())

    scalar = ["conv", "block", "length", "p1", "p2", "q1", "q2", "end", "_range", "_place"]
    names = [*scalar, "_first", "d1", "d2", "n_bytes"]
    schema = ", ".join(f"{n} long" for n in scalar) + ", _first boolean, d1 array<long>, d2 array<long>, n_bytes array<long>"
    done = stage(dealt.mapInArrow(run, schema), "conv_blocks")
    ends = done.groupBy("_range").agg(
        F.min("conv").alias("head"), F.max_by(F.struct("conv", "_first", "q1", "q2"), "_place").alias("tail")
    ).orderBy("_range").collect()
    carries = range_carries([((r.head,), (r.tail["conv"],), r.tail["_first"], (r.tail["q1"], r.tail["q2"])) for r in ends], ["xor", "xor"])
    table = spark.createDataFrame([(r["_range"], *c) for r, c in zip(ends, carries, strict=True)], "_range long, c1 long, c2 long")
    out = done.join(F.broadcast(table), "_range")
    for k in ("1", "2"):
        add = F.when(F.col("_first"), F.col(f"c{k}")).otherwise(_long(0))
        out = out.withColumn("_add", add).withColumns({
            f"p{k}": F.col(f"p{k}").bitwiseXOR(F.col("_add")), f"q{k}": F.col(f"q{k}").bitwiseXOR(F.col("_add")),
            f"d{k}": F.transform(f"d{k}", lambda d: d.bitwiseXOR(F.col("_add"))),
        })
    return out.select("conv", "block", "length", "p1", "p2", "q1", "q2", "end", "d1", "d2", "n_bytes")


def block_nodes(blocks: DataFrame) -> DataFrame:
    """Nodes (depth, d1, d2, u1, u2, conv, n_convs, n_bytes): u1, u2 are the parent's digest.

    Blocks are grouped by (digest before, digest to the end). Where all conversations that come to
    a block go through the same one, its inner nodes have the same members, and those of the smallest
    conversation stand for all. Only where siblings diverge are all conversations' turns looked at.
    """
    ways = blocks.groupBy("block", "p1", "p2", "q1", "q2", "end").agg(F.count("*").alias("n"), F.min("conv").alias("rep"))
    ways = ways.groupBy("block", "p1", "p2").agg(F.count("*").alias("ways"), F.sum("n").alias("n"), F.min("rep").alias("rep"))
    ways = stage(ways, "conv_ways")
    shown = spread_join(blocks, ways, ["block", "p1", "p2"], "n").filter("ways > 1 OR conv = rep")
    turn = F.arrays_zip("d1", "d2", "n_bytes")
    turns = shown.select(
        "conv", "p1", "p2", "d1", "d2", "ways", F.when(F.col("ways") == 1, F.col("n")).otherwise(_long(1)).alias("n"),
        (F.col("end") - F.size("d1") + 1).alias("start"), F.posexplode(turn).alias("i", "t"),
    )

    def before(k: str):
        return F.when(F.col("i") == 0, F.col(f"p{k}")).otherwise(F.get(f"d{k}", F.col("i") - 1)).alias(f"u{k}")

    turns = turns.select(
        (F.col("start") + F.col("i")).alias("depth"), F.col("t.d1").alias("d1"), F.col("t.d2").alias("d2"),
        before("1"), before("2"), "conv", "n", F.col("t.n_bytes").alias("n_bytes"), "ways",
    )
    grouped = turns.groupBy(*NODE).agg(
        F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), F.min("n_bytes").alias("n_bytes")
    )
    return grouped


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 (hex) of each node's ``conv`` ids, ascending and joined by commas.

    Ranges of (node, id) are sorted and joined in chunks of ``CHUNK_IDS`` ids; a second step reads a
    node's chunks in order and feeds them to the hash. Memory is one chunk, whatever a node holds.
    """
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select(*NODE, "conv").repartitionByRange(ranges, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    kind = "depth long, d1 long, d2 long"

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            ids = batch.column(3).to_numpy()
            new = np.ones(len(ids), dtype=bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            cuts = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, len(ids), CHUNK_IDS), [len(ids)]]))
            chunks = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:], strict=False)]
            at = cuts[:-1]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array(ids[at]), pa.array(chunks, pa.string())], names=[*NODE, "conv", "ids"])

    chunks = dealt.mapInArrow(join, f"{kind}, conv long, ids string").repartition(ranges, *NODE).sortWithinPartitions(*NODE, "conv")

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            if len(out) >= 4096:
                yield flush()
        if state is not None:
            out.append((*node, state.hexdigest()))
            yield flush()

    return chunks.mapInArrow(digest, f"{kind}, ends_sha256 string")


def path_totals(paths: DataFrame, sums: list[str]) -> DataFrame:
    """Rows (path, sums): each path's sums and those of all paths that hang below it.

    ``paths`` has path, up (the path it hangs on, NULL at the top) and the sums. Pointers double in every
    round, so rounds are the logarithm of how deep paths hang on paths.
    """
    now = stage(paths.select("path", "up", *sums), "conv_paths")
    while not now.filter("up IS NOT NULL").isEmpty():
        adds = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("_rows"), *[F.sum(s).alias(f"_{s}") for s in sums])
        grown = now.join(adds, "path", "left")
        grown = stage(grown.select("path", "up", "_rows", *[(F.col(s) + F.coalesce(f"_{s}", _long(0))).alias(s) for s in sums]), "conv_grown")
        over = grown.filter("_rows IS NOT NULL").select(F.col("path").alias("up"), F.col("up").alias("_up"), F.col("_rows").alias("_n"))
        moved = spread_join(grown.filter("up IS NOT NULL").drop("_rows"), over, ["up"], "_n")
        moved = moved.select("path", F.col("_up").alias("up"), *sums)
        now = stage(moved.unionByName(grown.filter("up IS NULL").select(moved.columns)), "conv_paths")
    return now.select("path", *sums)


def prefix_trie(df: DataFrame, group: int = 5, heads: int = 9, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt_turns``).

    A node is a distinct sequence of first turns (role, text), the root the empty one. Columns:
    conv_id (smallest member), depth, parent_conv_id (NULL at the root), n_convs (members), n_children,
    n_leaves (childless nodes of the subtree, the node included), saved_tokens (over the subtree,
    bytes of the node's last text times members but one), ends_sha256 (of the ids that end here).

    Turns go by ``turn``, NULL first; turns of one number go by a hash of role and text. NULL role and
    text are empty. Rows without conv_id belong to no conversation and are left out; equal rows are
    turns each; a conversation may be rebuilt without turns and then ends at the root. Other columns are
    ignored, an empty table has no node. A conversation, prefix or group of copies of any size is
    spread: conversations over ranges, hot prefixes by ``spread_join``, sums by map-side combining.

    Nodes with the same smallest member lie on one path down. Sums over subtrees are sums along
    paths, once every path has the total of the paths that hang on it.
    """
    turns, convs = rebuilt_turns(df, group, heads)
    blocks = turn_blocks(turns, block)
    below = block_nodes(blocks)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).filter("n_convs > 0")
    none = _long(0)
    root = root.select(none.alias("depth"), none.alias("d1"), none.alias("d2"), none.alias("u1"), none.alias("u2"), "conv", "n_convs", none.alias("n_bytes"))
    nodes = stage(below.unionByName(root), "conv_nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("d1"), F.col("u2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", none)), "conv_kids")
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("d1").alias("u1"), F.col("d2").alias("u2"), F.col("conv").alias("parent"), F.col("n_children").alias("_kids")
    )
    hung = spread_join(nodes.filter("depth > 0"), parents, UP, "_kids").drop("_kids")
    top = nodes.filter("depth = 0").withColumn("parent", F.lit(None).cast("long"))
    nodes = hung.unionByName(top).select(
        *NODE, "conv", "parent", "n_convs", "n_children",
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"),
    )
    nodes = stage(nodes, "conv_hung")
    paths = nodes.groupBy(F.col("conv").alias("path")).agg(
        F.min("depth").alias("top"), F.min_by(F.struct("parent"), "depth")["parent"].alias("up"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    paths = stage(paths, "conv_tops")
    totals = path_totals(paths, ["saved", "leaves"])
    hangs = paths.filter("up IS NOT NULL").select("path", "up", "top").join(totals, "path")
    hangs = hangs.groupBy(F.col("up").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
    nodes = nodes.join(hangs, ["conv", "depth"], "left").select(
        *nodes.drop("saved", "leaves").columns, (F.col("saved") + F.coalesce("_s", none)).alias("saved"), (F.col("leaves") + F.coalesce("_l", none)).alias("leaves")
    )
    nodes = running(nodes, ["conv"], [-F.col("depth")], {"saved": "sum", "leaves": "sum"}, "conv_sums")
    ends = blocks.filter("end = length").select("conv", F.col("end").alias("depth"), F.col("q1").alias("d1"), F.col("q2").alias("d2"))
    ends = ends.unionByName(convs.filter("length = 0").select("conv", none.alias("depth"), none.alias("d1"), none.alias("d2")))
    return nodes.join(id_digests(ends), NODE, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("before_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("before_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.encode(F.lit(""), "UTF-8"), 256)).alias("ends_sha256"),
    )
