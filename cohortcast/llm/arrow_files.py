"""Token ids in Arrow files: batches of fixed-size lists that a reader maps and slices without copies."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortcast.llm.common import batches_of, stage, tidy
from cohortcast.session import staging_path

SEQUENCE = 2048
BATCH_SEQUENCES = 128
FILE_TOKENS = 1 << 26
BATCH_BYTES = 1 << 21
CACHED_UNITS = 1_000_000


#: White space other than the space, as the pre-tokenizer or Python sees it.
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]


class Encoder:
    """Whole texts to ids, the library called once for each distinct stretch of a text.

    A text is cut before single spaces between two other characters that are no white space. The
    byte-level pre-tokenizer always starts a unit there and never merges over units, so the ids of
    the stretches, put together, are the ids of the text. A tokenizer whose tokens reach over such a
    space is given whole texts. ``dtype`` is the narrowest unsigned type for the vocabulary.
    """

    cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.sizes = np.array([len(self.library.id_to_token(i)) for i in range(self.library.get_vocab_size())], dtype=np.int64)
        self.whole = False
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    @staticmethod
    def irregular(text: str) -> bool:
        """Whether a space stands at an end or beside other white space."""
        if text[:1] == " " or text[-1:] == " " or "  " in text:
            return True
        return any(c in text and (" " + c in text or c + " " in text) for c in OTHER_SPACE)

    def _learn(self, known: dict[str, bytes], fresh: list[str], prefix: str) -> None:
        """Add the ids of new units.

        Units with no white space at their ends are encoded as one text, with the spaces they were
        cut at; as every token has a fixed number of bytes, the ids fall apart at the units' ends.
        """
        plain = [u for u in fresh if u and not u[0].isspace() and not u[-1].isspace()] if prefix == " " else []
        if plain:
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.cumsum(np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in plain), dtype=np.int64, count=len(plain)) + 1)
            offsets = np.cumsum(self.sizes[ids])
            stops = np.searchsorted(offsets, ends) + 1
            if len(offsets) < stops[-1] or (offsets[stops - 1] != ends).any():
                self.whole = True  # a token reaches over a space
                return
            code, cuts = ids.tobytes(), [0, *(stops * self.dtype.itemsize).tolist()]
            known.update(zip(plain, map(code.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        odd = [u for u in fresh if u not in known]
        found = self.library.encode_batch_fast([prefix + u for u in odd], add_special_tokens=False)
        known.update((u, np.array(x.ids, dtype=self.dtype).tobytes()) for u, x in zip(odd, found, strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return self._whole(texts)
        units = [self.cut.split(t) if self.irregular(t) else t.split(" ") for t in texts]
        later, first = self.later, self.first
        codes = [list(map(later.get, u)) for u in units]
        for u, c in zip(units, codes, strict=True):
            c[0] = first.get(u[0])  # a text's first unit has no space before it
        new_first = list({u[0] for u, c in zip(units, codes, strict=True) if c[0] is None})
        open_ = [k for k, c in enumerate(codes) if None in c]
        new_later = list({u for k in open_ for u, c in zip(units[k][1:], codes[k][1:], strict=True) if c is None})
        self._learn(first, new_first, "")
        self._learn(later, new_later, " ")
        if self.whole:
            return self._whole(texts)
        for k in open_:
            u, c = units[k], codes[k]
            start = first[u[0]]
            codes[k] = [later[x] if y is None else y for x, y in zip(u, [start, *c[1:]], strict=True)]
        out = list(map(b"".join, codes))
        for known, new in ((first, new_first), (later, new_later)):
            if len(known) > CACHED_UNITS:  # full: what came with this batch goes again
                for unit in new:
                    del known[unit]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """One file of sequences and, beside it, one of documents (id, first token, tokens).

    A sequence is a fixed-size list of ids and two of bits: ``mask`` (a token, no padding) and
    ``last`` (the last token of a document).
    """

    def __init__(self, folder: str, name: str, id_type: pa.DataType, length: int, dtype: np.dtype):
        self.store, root = pa.fs.FileSystem.from_uri(folder)
        self.path, self.length, self.dtype, self.tokens = f"{root}/{name}", length, dtype, 0
        self.store.create_dir(root, recursive=True)
        self.schema = pa.schema([
            pa.field(n, pa.list_(pa.field("item", t, nullable=False), length), nullable=False)
            for n, t in (("ids", pa.from_numpy_dtype(dtype)), ("mask", pa.bool_()), ("last", pa.bool_()))
        ])
        self.sink = self.store.open_output_stream(f"{self.path}.arrow")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.docs_schema = pa.schema([("id", id_type), ("first", pa.int64()), ("tokens", pa.int64())])
        self.docs_sink = self.store.open_output_stream(f"{self.path}.docs.arrow")
        self.docs = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.ids, self.last, self.n_docs = bytearray(), bytearray(), 0

    def add(self, ids: pa.Array, codes: list[bytes]) -> None:
        sizes = np.array([len(c) // self.dtype.itemsize for c in codes], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.docs.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(self.tokens + ends - sizes), pa.array(sizes)], schema=self.docs_schema))
        last = np.zeros(int(ends[-1]), dtype=np.uint8)
        last[ends - 1] = 1
        self.ids += b"".join(codes)
        self.last += last.tobytes()
        full = len(self.last) // (self.length * BATCH_SEQUENCES)
        self._flush(full * BATCH_SEQUENCES)  # all batches but the last hold the same number
        self.tokens += int(ends[-1])
        self.n_docs += len(codes)

    def _flush(self, sequences: int, padding: int = 0) -> None:
        width, done = self.dtype.itemsize, 0
        while sequences:
            some = min(sequences, BATCH_SEQUENCES)
            n = some * self.length
            values = np.frombuffer(bytes(self.ids[width * done : width * (done + n)]), dtype=self.dtype)
            last = np.frombuffer(bytes(self.last[done : done + n]), dtype=np.uint8).astype(bool)
            mask = np.ones(n, dtype=bool)
            if padding and some == sequences:
                mask[n - padding :] = False
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((values, mask, last), self.schema, strict=True)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            done += n
            sequences -= some
        del self.ids[: width * done], self.last[:done]

    def close(self) -> None:
        short = -len(self.last) % self.length
        self.ids += bytes(self.dtype.itemsize * short)
        self.last += bytes(short)
        self._flush(len(self.last) // self.length, short)
        for x in (self.file, self.sink, self.docs, self.docs_sink):
            x.close()


def write_tokens(
    df: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, length: int = SEQUENCE,
    id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the id.

    Rows are dealt to ranges of (id, text hash) and sorted there; a random last key cuts runs of
    equal rows. Each range writes files of about ``file_tokens`` tokens (more only for a single longer
    text), cut between documents; the last sequence of a file is padded, which its mask says. Ids are
    16 bits wide where the vocabulary allows it. A file name holds the task's attempt, and the
    returned manifest lists the files of the attempts that were committed, so tasks that are lost
    or run twice leave no wrong rows. ``folder`` is a place that every executor and Arrow's file
    systems reach.

    Returns the manifest: part, number, path, n_docs, n_tokens; part and number order the files.
    NULL texts are empty (just the end mark), NULL ids come first, repeated rows are written
    repeatedly, other columns are ignored, an empty table gives an empty manifest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        df.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .withColumns({"_hash": F.xxhash64("_text"), "_tie": F.rand(5)})
        .repartitionByRange(ranges, "_id", "_hash", "_tie")
        .sortWithinPartitions("_id", "_hash", "_text")
        .select("_id", "_text")
    )
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, code, out, done = TaskContext.get(), encoder(tokenizer_path), None, []
        part, end = context.partitionId(), np.array([end_id], dtype=code.dtype).tobytes()

        def close() -> None:
            out.close()
            done.append({"part": part, "number": len(done), "path": out.path, "n_docs": out.n_docs, "n_tokens": out.tokens})

        for batch in batches_of(batches, "_text", BATCH_BYTES):
            if out is None:
                name = f"part-{part:06d}-{len(done):04d}-{context.taskAttemptId()}"
                out = Writer(folder, name, batch.column(0).type, length, code.dtype)
            out.add(batch.column(0), [c + end for c in code.encode(batch.column(1).to_pylist())])
            if out.tokens >= file_tokens:
                close()
                out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return stage(rows.mapInArrow(run, "part long, number long, path string, n_docs long, n_tokens long"), "token_files")


def read_tokens(manifest: DataFrame, folder: str, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (tokens of all documents before), n_tokens, ids_crc32.

    Files are mapped where the store allows it; a document's ids are a slice of the flat values of
    the batches it lies in.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")))
    files = files.select("path", "before").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pa.fs.FileSystem.from_uri(folder)
        local = isinstance(store, pa.fs.LocalFileSystem)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = [pa.memory_map(p) if local else store.open_input_file(p) for p in (f"{path}.arrow", f"{path}.docs.arrow")]
                tokens, docs = map(pa.ipc.open_file, source)
                per_batch = BATCH_SEQUENCES * tokens.schema.field("ids").type.list_size
                flat = FlatTokens(tokens, per_batch)
                for i in range(docs.num_record_batches):
                    some = docs.get_batch(i)
                    firsts, sizes = some.column(1).to_numpy(), some.column(2).to_numpy()
                    checks = [flat.crc32(int(a), int(n)) for a, n in zip(firsts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), pa.array(firsts + before), pa.array(sizes), pa.array(checks, pa.int64())],
                        names=[id_col, "start", "n_tokens", "ids_crc32"],
                    )
                for s in source:
                    s.close()

    return files.mapInArrow(run, f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long")


class FlatTokens:
    """Random access to the ids of a file; every batch but the last holds the same number."""

    def __init__(self, file: pa.ipc.RecordBatchFileReader, per_batch: int):
        self.file, self.per_batch = file, per_batch
        self.number, self.ids, self.marks = -1, None, None

    def pieces(self, first: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of the mapped ids, and of the bits that mark last tokens."""
        while count:
            number, at = divmod(first, self.per_batch)
            if number != self.number:
                batch = self.file.get_batch(number)
                self.number, self.ids = number, batch.column(0).flatten().to_numpy()
                self.marks = (batch.column(2).flatten().to_numpy(zero_copy_only=False) & batch.column(1).flatten().to_numpy(zero_copy_only=False))
            some = min(count, len(self.ids) - at)
            if some <= 0:
                raise ValueError("the file ends inside a document")
            yield self.ids[at : at + some], self.marks[at : at + some]
            first, count = first + some, count - some

    def crc32(self, first: int, count: int) -> int:
        """Checksum of the ids as 32-bit numbers; the marks must agree with the list of documents."""
        check, marks, last = 0, 0, False
        for ids, mark in self.pieces(first, count):
            check, marks, last = zlib.crc32(ids.astype("<u4").view(np.uint8), check), marks + int(mark.sum()), bool(mark[-1])
        if marks != 1 or not last:
            raise ValueError("the marks do not agree with the list of documents")
        return check


def token_digest(df: DataFrame, tokenizer_path: str, **names: str) -> DataFrame:
    """Write the files below the session's shared folder and read them back."""
    folder = staging_path(df.sparkSession, "token_arrow")
    id_col = names.get("id_col", "doc_id")
    manifest = write_tokens(df, tokenizer_path, folder, **names)
    return read_tokens(manifest, folder, df.schema[id_col].dataType.simpleString(), id_col)
