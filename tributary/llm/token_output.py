"""Token ids as Arrow files of equal-length sequences and masks.

Each range of ascending document ids becomes one Arrow IPC file whose batches
hold ``ids`` and ``mask`` as fixed-size lists, and one small index file with
each document's id, start and length. Sequence k of a file lies in batch
k // BATCH at row k % BATCH: a memory-mapped reader gets any of them
without copying or parsing what comes before.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import arrow, partitions, pieces, prepare, rows_of, scratch, stored, text_key, text_of
from tributary.llm.tokens import default_tokenizer, library_ids

#: Tokens in a sequence, and sequences in a record batch.
LENGTH = 1024
BATCH = 256

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def sequence_schema(length: int, wide: bool = True) -> pa.Schema:
    """ids take 32 bits, or 16 where the vocabulary allows it."""
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.uint8(), length))])


class SequenceWriter:
    """Appends ids; writes a record batch whenever one is full, and pads the last sequence (id 0, mask 0)."""

    def __init__(self, sink, length: int, batch: int, wide: bool = True):
        self.length, self.room = length, length * batch
        self.schema, self.kind = sequence_schema(length, wide), np.uint32 if wide else np.uint16
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for i in range(0, whole, self.room):
                self._write(flat[i : i + self.room], self.room)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = (np.arange(len(flat)) < real).astype(np.uint8)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat.astype(self.kind), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.file.close()


class SequenceReader:
    """Random access to a file of sequences: rows and id ranges are views of the mapped file."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = pa.ipc.open_file(pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name))
        self.length = self.file.schema.field("ids").type.list_size
        self._at = (-1, None)
        self.rows = self._batch(0).num_rows if self.file.num_record_batches else 0

    def _batch(self, i: int) -> pa.RecordBatch:
        if self._at[0] != i:
            self._at = (i, self.file.get_batch(i))
        return self._at[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b, r = self._batch(k // self.rows), k % self.rows
        return tuple(c.values.to_numpy()[r * self.length : (r + 1) * self.length] for c in b.columns)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from start, in views that each lie in one batch."""
        room = self.rows * self.length
        while n:
            i, o = divmod(start, room)
            view = self._batch(i).column(0).values.to_numpy()[o : o + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_sequences(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH, batch: int = BATCH
) -> DataFrame:
    """Writes docs to folder in ascending id order; returns the manifest: part, path, docs, tokens.

    A null text is empty and still gets its end id. A null id comes last, equal
    ids stand in order of their texts' hashes, repeated rows are written again.
    An empty table writes no sequences. Columns other than the two named are not
    looked at. A task that runs again writes a new pair of files and the
    manifest names the pair of the attempt that counted.
    """
    spark = prepare(docs.sparkSession)
    path, n = tokenizer or default_tokenizer(), partitions(spark)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("h"))
    key = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    rows = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).select("doc_id", "text")

    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) > 0xFFFF

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        library = library_ids(path)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], "<u4").tobytes()
        at = docs_n = 0
        with store.open_output_stream(f"{base}/{name}.arrow") as sink, store.open_output_stream(f"{base}/{name}.index.arrow") as beside:
            out, index = SequenceWriter(sink, length, batch, wide), pa.ipc.new_file(beside, INDEX)
            for whole in batches:
                for b in pieces(whole):
                    ids = [x + end for x in library.of(b.column("text").to_pylist())]
                    sizes = np.array([len(x) // 4 for x in ids], np.int64)
                    out.append(np.frombuffer(b"".join(ids), "<u4"))
                    starts = at + np.cumsum(sizes) - sizes
                    index.write_batch(rows_of({"doc_id": b.column("doc_id"), "start": starts, "n_tokens": sizes}, INDEX))
                    at, docs_n = at + int(sizes.sum()), docs_n + len(ids)
            out.close()
            index.close()
        yield rows_of({"part": [part], "path": [f"{folder}/{name}"], "docs": [docs_n], "tokens": [at]}, MANIFEST)

    return stored(arrow(rows, "library ids", write, "part int, path string, docs long, tokens long"), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the written files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    files = files.repartitionByRange(partitions(manifest.sparkSession), "part").select("path", "base")

    def read(batches):
        for f in batches:
            for path, base in zip(f.column("path").to_pylist(), f.column("base").to_pylist(), strict=True):
                reader = SequenceReader(f"{path}.arrow")
                store, name = fs.FileSystem.from_uri(f"{path}.index.arrow")
                with store.open_input_file(name) as beside:
                    index = pa.ipc.open_file(beside)
                    for i in range(index.num_record_batches):
                        b = index.get_batch(i)
                        starts, sizes = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                        crcs = []
                        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                            crc = 0
                            for view in reader.span(s, n):
                                crc = zlib.crc32(np.ascontiguousarray(view, "<u4"), crc)
                            crcs.append(crc)
                        yield rows_of({"doc_id": b.column("doc_id"), "start": starts + base, "n_tokens": sizes, "ids_crc32": crcs}, READ)

    return arrow(files, "library ids", read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_sequences(docs, scratch(spark, "sequences")))
