"""What the operators share: settings, the shared folder, cut lineage, text buffers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, in every operator that counts or compares them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one Arrow batch may hold, so that a batch of very long documents stays small.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, where the session has no bound of its own."""
    for key, value, default in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, None),
    ):
        if spark.conf.get(key, default) in (default, str((1 << 63) - 1)):
            spark.conf.set(key, str(value))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where it is unset and all run in one process, a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/") if "://" in path else "file://" + path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112  the session may have ended before
            continue


def scratch_paths() -> list[str]:
    """What scratch() has given out and drop_scratch() has not deleted, oldest first."""
    return [path for _, path in _scratch]


def drop_scratch(paths: list[str]) -> None:
    """Deletes tables of which no frame is read any more."""
    gone = set(paths)
    for spark, path in [x for x in _scratch if x[1] in gone]:
        _delete(spark, path)
    _scratch[:] = [x for x in _scratch if x[1] not in gone]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a table in the shared folder. A lost executor costs no more than the tasks it ran."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    try:
        if before is not None:  # the shuffle files of this write serve nothing else
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_forget: dict[str, Callable[[], object]] = {}
_owner: str | None = None


def on_leaving(owner: str, forget: Callable[[], object]) -> None:
    """Says how a Python worker lets go of what an operator's tasks keep in it from one to the next."""
    _forget[owner] = forget


def _settle() -> None:
    """Freed memory goes back to the system: an executor's workers share its limit with the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def claim(owner: str) -> None:
    """A task of owner begins in this worker: what tasks of other operators kept goes."""
    global _owner
    if owner != _owner:
        for name, forget in _forget.items():
            if name != owner:
                forget()
        _owner = owner
    _settle()


def arrow(df: DataFrame, owner: str, f: Callable, ddl) -> DataFrame:
    """mapInArrow, in workers that keep nothing of other operators."""

    def run(batches):
        claim(owner)
        try:
            yield from f(batches)
        finally:
            _settle()

    return df.mapInArrow(run, ddl)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """The whole text; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: Column) -> Column:
    """128 bits that stand for a text: equal texts form one class, however their ids repeat.

    Never null, and known to be: else joins on it would filter below the shuffle
    of the text, which could then not be shared.
    """
    return F.coalesce(F.unhex(F.md5(column)), F.lit(b""))


def unique_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text: h, text, first_id (the smallest id, null last) and copies.

    Copies are combined before the shuffle, so a text that a third of the rows
    share costs one row per task. The result is partitioned by h: later
    joins on h reuse this one shuffle of the text.
    """
    text = text_of(text_col)
    rows = docs.select(text_key(text).alias("h"), text.alias("text"), F.col(id_col).cast("long").alias("i"))
    first = F.coalesce(F.min("i"), F.lit((1 << 63) - 1)).alias("first_id")
    return rows.groupBy("h").agg(F.first("text").alias("text"), first, F.count(F.lit(1)).alias("copies"))


def pieces(batch: pa.RecordBatch, limit: int = 4 << 20):
    """Parts of a batch with about limit bytes of text each, at least one row."""
    at, sizes = 0, np.diff(_offsets(batch.column("text")))
    while at < batch.num_rows:
        total = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(at, n)
        at += n


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a non-null string column, one after another, and each row's start (with the end last)."""
    off = _offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def rows_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
