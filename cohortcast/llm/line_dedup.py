"""Repeated lines: two Bloom filters find suspects, an exact count over the suspects decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.blooms import filter_bits, holds, seen_twice
from cohortcast.llm.common import covered, release_memory, stage
from cohortcast.llm.ranges import spread_join

SPACE = b" \t\n\x0b\x0c\r"
LINES_PER_DOC = 16


def line_keys(text: bytes) -> list[bytes]:
    """Keys of a text's lines: A-Z in lower case, ASCII white space stripped at both ends."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def hash_of(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def doc_hashes(text: bytes, least: int, words: int = 0) -> list[bytes]:
    """Distinct 128-bit hashes of the keys of at least ``least`` code points and ``words`` words."""
    keys = [k for k in set(line_keys(text)) if len(k) >= least and len(k.decode(errors="replace")) >= least]
    return [hash_of(k) for k in keys if not words or len(k.split()) >= words]


def _words(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype="<u8")[::2]


def _cut(text: bytes, gone: set[bytes], single: set[bytes]) -> tuple[bytes, int, int]:
    """The text without the lines of ``gone``, and of ``single`` but the first; lines before, dropped."""
    lines = text.split(b"\n")
    if not gone and not single:
        return text, len(lines), 0
    kept = []
    for line, key in zip(lines, map(hash_of, line_keys(text)), strict=True):
        if key in single:
            single.discard(key)
            gone.add(key)
            kept.append(line)
        elif key not in gone:
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(
    df: DataFrame,
    min_docs: int = 10,
    keep: str = "none",
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 0,
) -> DataFrame:
    """All columns with the text's repeated lines dropped, and n_lines (before) and n_dropped.

    A key (see ``line_keys``) of at least ``min_chars`` code points and ``min_words`` words (cut at ASCII
    white space) that ``min_docs`` documents hold is repeated; rows of one id are one document, rows
    without id one for each text. ``keep='none'`` drops all its lines. ``keep='first'`` leaves one: the first such line
    of the row that comes first by id (NULL last), then by text hash.

    Method: all tasks fill two fixed-size Bloom filters, for hashes seen in one row and in two. Only
    keys that the second holds are shuffled, as 128-bit hashes, and counted exactly, by document first
    and then by key; only texts with such keys move to meet the result. A key that very many rows hold
    is one row in the count after map-side sums and meets its lines by ``spread_join``.

    NULL text counts as one empty line and comes back as an empty text; texts without repeated
    lines come back as they are. NULL ids pass; rows equal in id and text are first together. Input columns named n_lines or n_dropped are replaced. An empty table
    gives an empty result.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    df, numbers = covered(df, *({"n_lines", "n_dropped"} - {id_col, text_col}))
    id_col, text_col = numbers[id_col], numbers[text_col]
    df = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))

    def all_hashes(texts: pa.Array) -> np.ndarray:
        found = [_words(doc_hashes(t.as_py(), min_chars, min_words)) for t in texts]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    bits = filter_bits(df.count() * LINES_PER_DOC)
    twice = spark.sparkContext.broadcast(seen_twice(df, all_hashes, F.encode(text_col, "UTF-8"), bits))

    @F.arrow_udf("array<binary>")
    def suspects(texts: pa.Array) -> pa.Array:
        packed, out = np.frombuffer(twice.value, dtype=np.uint8), []
        for text in texts:
            found = doc_hashes(text.as_py(), min_chars, min_words)
            out.append([h for h, bad in zip(found, holds(packed, _words(found)), strict=True) if bad])
        release_memory()
        return pa.array(out, pa.list_(pa.binary()))

    me = {"_id": F.col(id_col), "_k1": F.xxhash64(text_col), "_k2": F.xxhash64(F.lit(1), text_col)}
    marked = df.withColumns(me | {"_suspects": suspects(F.encode(text_col, "UTF-8"))})
    lines = stage(marked.select("_id", "_k1", "_k2", F.explode("_suspects").alias("_key")), "line_suspects")
    place = F.struct(F.col("_id").isNull().alias("no"), "_id", "_k1", "_k2")
    nameless = F.when(F.col("_id").isNull(), F.struct("_k1", "_k2")).alias("_text")
    per_doc = lines.groupBy("_key", "_id", nameless).agg(F.count("*").alias("_rows"), F.min(place).alias("_first"))
    repeated = per_doc.groupBy("_key").agg(F.count("*").alias("_n"), F.sum("_rows").alias("_rows"), F.min("_first").alias("_first"))
    repeated = stage(repeated.filter(F.col("_n") >= min_docs), "line_repeated")
    is_first = (F.col("_first") == place) if keep == "first" else F.lit(False)
    drops = (
        spread_join(lines, repeated, ["_key"], "_rows")
        .groupBy("_id", "_k1", "_k2")
        .agg(
            F.collect_set(F.when(~is_first, F.col("_key"))).alias("_drop"),
            F.collect_set(F.when(is_first, F.col("_key"))).alias("_once"),
        )
    )

    @F.arrow_udf("kept string, n_lines long, n_dropped long")
    def cut(texts: pa.Array, drop: pa.Array, once: pa.Array) -> pa.Array:
        kept = [_cut(t.as_py(), set(d.as_py() or ()), set(o.as_py() or ())) for t, d, o in zip(texts, drop, once, strict=True)]
        columns = zip(*kept, strict=True) if kept else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64())
        release_memory()
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kept", "n_lines", "n_dropped"])

    some = F.size("_suspects") > 0
    same = [F.col("a._id").eqNullSafe(F.col("b._id")), F.col("a._k1") == F.col("b._k1"), F.col("a._k2") == F.col("b._k2")]
    moved = marked.filter(some).drop("_suspects").alias("a").join(drops.alias("b"), same, "left")
    moved = moved.select("a.*", "b._drop", "b._once")
    done = cut(F.encode(text_col, "UTF-8"), F.col("_drop"), F.col("_once"))
    moved = moved.withColumn("_done", done).withColumns(
        {text_col: F.col("_done.kept"), "n_lines": F.col("_done.n_lines"), "n_dropped": F.col("_done.n_dropped")}
    )
    still = marked.filter(~some).withColumns(
        {
            "n_lines": (F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.lit(0).cast("long"),
        }
    )
    columns = [*[F.col(numbers[n]).alias(n) for n in names], "n_lines", "n_dropped"]
    return moved.select(columns).unionByName(still.select(columns))
