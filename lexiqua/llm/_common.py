"""What the operators of this subpackage share: shared folders, partition counts, word arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker holds as one array; longer Arrow batches are cut into slices of whole documents.
SLICE_BYTES = 4 << 20


#: The C library's call that returns freed memory, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Arrays of a megabyte or more have pages of their own (``M_MMAP_THRESHOLD``), which go back as soon as an array is freed: a
#: worker that lives on through tasks of other kinds keeps none of what the last one took.
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/lexiqua-shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder, which goes when the driver's JVM ends."""
    path = new_path(spark, name)
    at, store = _store(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


#: For each block of code that asks, where ``cut`` has written in it. Each thread has its own.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Paths that ``cut`` writes to in the block."""
    made: list[str] = []
    before = _written.set((*_written.get(), made))
    try:
        yield made
    finally:
        _written.reset(before)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch; no frame that was made from it may be used after this."""
    for p in paths:
        at, store = _store(spark, p)
        store.delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that a lost executor costs no more than the stage it ran.

    What is written goes with ``delete``, or when the driver's JVM ends.
    """
    path = new_path(df.sparkSession, name)
    for paths in _written.get():
        paths.append(path)
    df.write.parquet(path)
    at, store = _store(df.sparkSession, path)
    store.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    """``df`` written and read again, with the scratch that it was made from deleted."""
    before = list(made)
    out = cut(df, name)
    delete(df.sparkSession, before)
    return out


def parts_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for a shuffle of ``df``: by its estimated size, never fewer than the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size // bytes_each + 1, 1_000_000))


#: What a worker keeps between tasks of one kind: one thing at most.
_kept: dict[tuple, object] = {}


def kept(key: tuple, build: Callable[[], object]) -> object:
    """What ``build`` makes, made once in a worker as long as it runs tasks that ask for the same."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches again, cut so that the column ``text`` holds about ``most`` bytes in each; one document is never cut.

    A task that doesn't ``keep`` anything lets go of what the worker kept for tasks of other kinds.
    """
    if not keeps:
        _kept.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = size[low - 1] if low else 0
            high = max(int(np.searchsorted(size, before + most, side="right")), low + 1)
            yield batch.slice(low, high - low)
            low = high
            _give_back()


def _give_back() -> None:
    """Return freed memory to the machine; a worker lives on through tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def filled(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts, in one array whose buffers hold nothing else."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1] or b"\0\0\0\0", np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    if len(column) and (column.offset or offsets[0] or held is not None and held.size > offsets[-1]):
        data = held.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if held else pa.py_buffer(b"")
        column = pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets - offsets[0]), data)
    return column


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """A filled string column with each UTF-8 byte replaced through ``table`` (which must map non-ASCII bytes to themselves)."""
    column = filled(column)
    _, offsets, data = column.buffers()
    data = data.to_pybytes() if data is not None else b""
    return pa.StringArray.from_buffers(len(column), offsets, pa.py_buffer(data.translate(table)))


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a filled string column.

    Returns each word's code, the words that the codes stand for, and the first word of each document
    (with the count of all words at the end).
    """
    lists = pc.ascii_split_whitespace(column)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, offsets.astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start..start+length-1 of each pair, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts.astype(np.int64) - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def mixed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers scattered (the finalizer of splitmix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values from each place in ``first`` up to the next."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[first[1:]] - total[first[:-1]]
