"""Token ids as Arrow files of equal-length sequences.

The ids of all documents, in ascending order of id, form one stream. Range partitions of documents are encoded and
written as Arrow IPC files in the shared folder: one file of sequences for each partition (record batches with the
fixed-size-list columns ``ids`` and ``mask``, bits packed into bytes; the last sequence is padded, its mask 0 there), and one file
with a row for each document (id, start in this partition, tokens). Memory-mapped, any sequence is reached without
copying. Ids are stored as 16-bit numbers if the vocabulary allows, else as 32-bit ones.

The manifest has one row for each partition: its place in the order and its number of ids; running sums over it
give every document's place in the whole stream. File names carry the task attempt, and the written manifest names
the files of the attempts that won, so a retried task or a lost executor leaves no doubt which files count.

Texts are shuffled once, by range of (id, text hash), so equal ids of a third of all rows still spread; only the
manifest passes through one task.

Defined results: a null text is empty and has only the end id; null ids come first; rows with equal ids are ordered
by the hash of their texts; an empty input gives an empty manifest.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melisma.llm.memo import Memo
from melisma.session import new_path, ship_package, written

LENGTH = 2048
CACHE = 400_000
#: Sequences in a record batch, and documents encoded at once.
BATCH_SEQUENCES, BATCH_DOCS = 64, 256
#: Pre-tokens never span from a character that isn't white space to a following space or line end.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: The same for texts without other white space. Latin letters and digits are cut from marks behind them, so that words
#: are known whatever follows.
ODD_SPACE = re.compile(r"[^\S \n]")
PLAIN_SEGMENT = re.compile(r"[ \n]*[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?![^ \n.,;:!?*#$%&|])|[ \n]*[^ \n]+|[ \n]+")
MANIFEST = "part long, sequences string, documents string, n_ids long, n_docs long"


class Encoder:
    """Whole texts to ids, by the tokenizers library on cached segments."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if sys.byteorder != "little":
            raise OSError("the files hold little-endian numbers")
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.code, self.model = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # How a byte-level pre-tokenizer shows bytes; other pre-tokenizers split every segment themselves.
        shows = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.bytewise = [p for p, _ in shows(" a\u00e9.")] == ["\u0120a\u00c3\u00a9", "."]
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.shown = {b: chr(256 + i) for i, b in enumerate(odd)}
        # Cuts behind letters are sound for it alone, and where no added token begins with a letter: only then a cut could stand in one.
        self.plain = PLAIN_SEGMENT if self.bytewise and not any(t[:1].isalnum() for t in self.added) else SEGMENT
        self.known = Memo(self._encode, CACHE)

    def _encode(self, segment: str) -> bytes:
        """A segment's ids, by the library's pre-tokenizer and model; added tokens by its whole pipeline."""
        for t in self.added:
            if t in segment:
                return self._packed(self.tokenizer.encode(segment, add_special_tokens=False).ids)
        tokenize = self.model.tokenize
        if self.bytewise and segment[:1] == " " and segment[1:].isalpha():  # one pre-token
            word = "\u0120" + segment[1:] if segment.isascii() else segment.encode().decode("latin-1").translate(self.shown)
            return self._packed([t.id for t in tokenize(word)])
        return self._packed([t.id for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment) for t in tokenize(p)])

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, (SEGMENT if ODD_SPACE.search(text) else self.plain).findall(text)))


_READY: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _READY:
        _READY[tokenizer_file] = Encoder(tokenizer_file)
    return _READY[tokenizer_file]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class _Sequences:
    """Writes a stream of ids as batches of equal-length sequences."""

    def __init__(self, store: fs.FileSystem, path: str, dtype: np.dtype, length: int):
        if length % 8:
            raise ValueError("a sequence's length must be a multiple of 8, since masks are packed bits")
        self.length, self.dtype, self.rest, self.n = length, dtype, bytearray(), 0
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.out = store.open_output_stream(path)
        self.file = ipc.new_file(self.out, self.schema)

    def add(self, ids: bytes) -> None:
        self.rest += ids
        self.n += len(ids) // self.dtype.itemsize
        block = BATCH_SEQUENCES * self.length * self.dtype.itemsize
        while len(self.rest) >= block:
            self._batch(np.frombuffer(bytes(self.rest[:block]), self.dtype), block // self.dtype.itemsize)
            del self.rest[:block]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        bits = np.packbits(np.arange(len(ids)) < real, bitorder="little")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(bits), self.length // 8)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(bytes(self.rest), self.dtype)
        if len(ids):
            self._batch(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.dtype)]), len(ids))
        self.file.close()
        self.out.close()


def write_sequences(docs: DataFrame, tokenizer_file: str, end_id: int = 0, length: int = LENGTH, parts: int | None = None, path: str | None = None) -> DataFrame:
    """Encode (doc_id, text) rows and write the files; returns the written manifest with ``start`` (long).

    parts: range partitions, by default as many as a shuffle has.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = path or new_path(spark, "sequences")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, name = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, root = _store(base)
        store.create_dir(root, recursive=True)
        code = encoder(tokenizer_file)
        end = np.array([end_id], code.dtype).tobytes()
        sequences = _Sequences(store, f"{root}/{name}.sequences.arrow", code.dtype, length)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with store.open_output_stream(f"{root}/{name}.documents.arrow") as out, ipc.new_file(out, schema) as index:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_DOCS):
                    part_rows = batch.slice(at, BATCH_DOCS)
                    starts, sizes = [], []
                    for value in part_rows.column(1):
                        starts.append(sequences.n)
                        sequences.add(code.ids(value.as_py()) + end)
                        sizes.append(sequences.n - starts[-1])
                    index.write_batch(pa.RecordBatch.from_arrays([part_rows.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
                    n_docs += part_rows.num_rows
        sequences.close()
        if n_docs:
            row: dict[str, list[Any]] = {"part": [part], "sequences": [f"{base}/{name}.sequences.arrow"], "documents": [f"{base}/{name}.documents.arrow"], "n_ids": [sequences.n], "n_docs": [n_docs]}
            yield pa.RecordBatch.from_pydict(row)

    manifest = written(dealt.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class SequenceReader:
    """Random access to the sequences of one file. Local files are memory-mapped and nothing is copied; of others the
    last batch is kept, so that documents in order read each batch once. Close it, or use it as a context."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.at, self.last = -1, None
        self.length = self.file.schema.field("ids").type.list_size

    def __enter__(self) -> SequenceReader:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        self.last = None
        self.source.close()

    def batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.last = i, self.file.get_batch(i)
        return self.last

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of the i-th sequence, both views of the file: a number for each id, a bit (lowest first) for each place."""
        batch, row = self.batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        ids, bits = (batch.column(k)[row].values for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), bits.to_numpy(zero_copy_only=True)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` (exclusive) of this file's stream."""
        block, found = BATCH_SEQUENCES * self.length, []
        for i in range(start // block, (stop - 1) // block + 1 if stop > start else 0):
            flat = self.batch(i).column(0).flatten().to_numpy()
            found.append(flat[max(0, start - i * block) : stop - i * block])
        return np.concatenate(found) if found else np.zeros(0, np.uint16)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: doc_id, start, n_tokens, ids_crc32; one task reads whole files."""
    ship_package(manifest.sparkSession)
    rows = manifest.select("sequences", "documents", "start")
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["documents"])
                with SequenceReader(row["sequences"]) as reader, store.open_input_file(path) as source:
                    index = ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                        sums = [zlib.crc32(reader.ids(a, a + n).astype("<u4").tobytes()) for a, n in zip(starts, sizes)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + row["start"], pa.int64()), part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
