"""Lines of files by number: only the asked ranges are read into rows, and no file is ever held whole.

Files are listed with their lengths (contents aren't read for that) and cut into slices. One pass counts the line breaks of each slice,
prefix sums give the number of its first line, and a second pass opens only slices with asked lines, reading on past a slice's end to
finish its last line. A line belongs to the slice that holds the break before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a slice, and bytes that a task reads at a time.
SLICE, BLOCK = 16 << 20, 1 << 20
LAST = 2**62


def _store(root: str):
    """The store and top folder of a URI as Spark writes it (``file:/a`` or ``scheme://host/a``)."""
    from pyarrow import fs

    scheme, _, rest = root.partition(":")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}" if not rest.startswith("//") else f"{scheme}:{quote(rest)}")


def _blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    f.seek(at)
    while data := f.read(BLOCK):
        yield at, data
        at += len(data)


def asked_lines(f, at: int, length: int, size: int, before: int, asked: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """Numbers and bytes of the asked lines that belong to one slice; ``before`` line breaks stand in the slices before it."""
    asked = sorted(asked)
    wanted = lambda low, high: any(a <= high and b >= low for a, b in asked)
    no, keep, held = before + 1, at == 0 and wanted(1, 1), []
    for o, data in _blocks(f, at):
        n = data.count(b"\n")
        if not keep and o + len(data) <= at + length and not wanted(no + 1, no + n):
            no += n
            continue
        low = 0
        while True:
            cut = data.find(b"\n", low)
            if keep:
                held.append(data[low : cut if cut >= 0 else len(data)])
            if cut < 0:
                break
            if keep:
                yield no, b"".join(held)
                held = []
            if o + cut >= at + length:
                return
            low, no = cut + 1, no + 1
            keep = o + cut + 1 < size and wanted(no, no)
        if not keep and o + len(data) >= at + length:
            return
    if keep:
        yield no, b"".join(held)


def lines(spark: SparkSession, folder: str, ranges: DataFrame | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """``path, no, line`` of the files below ``folder``: of all lines, or of those in ``ranges`` (``path, start, end``, from 1, both included).

    ``path`` is relative to the folder, so files of one name in several folders are several files. Lines end at line feeds; a carriage
    return before one stays. Ranges of files that aren't there, and beyond a file's end, have no rows; ranges with a null are not asked.
    Overlapping ranges give each line once. Bytes that are no UTF-8 become the replacement character.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("path"), F.col("length").alias("size")).filter("size > 0")
    if ranges is not None:
        ranges = ranges.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("path IS NOT NULL AND start <= end").distinct()
        files = files.join(ranges.select("path").distinct(), "path", "left_semi")
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(slice_bytes).cast("long"))).alias("at"))
    cut = cut.withColumn("length", F.least(F.lit(slice_bytes), F.col("size") - F.col("at"))).repartition("path", "at")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                with store.open_input_file(f"{top}/{r['path']}") as f:
                    n = 0
                    for o, data in _blocks(f, r["at"]):
                        n += data.count(b"\n", 0, max(0, r["at"] + r["length"] - o))
                        if o + len(data) >= r["at"] + r["length"]:
                            break
                    found.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)

        def rows() -> Iterator[tuple[str, int, str]]:
            for batch in batches:
                for r in batch.to_pylist():
                    with store.open_input_file(f"{top}/{r['path']}") as f:
                        for no, data in asked_lines(f, r["at"], r["length"], r["size"], r["before"], [(x["start"], x["end"]) for x in r["asked"]]):
                            yield r["path"], no, data.decode("utf-8", "replace")

        some, held = [], 0
        for row in rows():
            some.append(row)
            held += len(row[2])
            if held > BLOCK or len(some) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some)], names=["path", "no", "line"])
                some, held = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some)], names=["path", "no", "line"])

    counted = cut.mapInArrow(count, "path string, size long, at long, length long, n long")
    ahead = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice of a file
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    if ranges is None:
        asked = counted.withColumn("asked", F.array(F.struct(F.lit(1).cast("long").alias("start"), F.lit(LAST).cast("long").alias("end"))))
    else:
        first = F.when(F.col("at") == 0, 1).otherwise(F.col("before") + 2)
        met = counted.join(ranges, "path").filter((F.col("start") <= F.col("before") + F.col("n") + 1) & (F.col("end") >= first))
        asked = met.groupBy("path", "size", "at", "length", "before").agg(F.collect_list(F.struct("start", "end")).alias("asked"))
    return asked.select("path", "size", "at", "length", "before", "asked").mapInArrow(read, "path string, no long, line string")
