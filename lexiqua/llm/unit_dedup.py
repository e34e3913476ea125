"""Substring dedup by line or paragraph hashing.

A worker cuts each whole text into units, normalises them (ASCII lower case, white space as one space) and hashes them to
128 bits. Units are lines cut once more at the ends of sentences, whole lines, or paragraphs. Digests are grouped over all
documents; the occurrence first in rank (document id, then place) stays and the rest are repeats. Neighbouring repeats make a
run (units without a word do not part it), and a run goes if it has ``least_words`` words or more, whatever the length of its
units: a repeated passage goes however its lines are broken, a stock line that stands alone stays. What goes is named by its
offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, filled, slices, split_words

#: Words of the shortest run of repeated units that goes. A passage of over 50 words that begins and ends within sentences
#: keeps this many in whole ones if the cut sentences have 15 words each.
LEAST_WORDS = 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What parts units.
BREAKS = {"sentence": "\n", "line": "\n", "paragraph": "\n\n"}
#: The end of a sentence: its mark, what closes it (quotes, brackets), and the one space that is taken as a line break.
SENTENCE_END = r"([.!?…。！？][^0-9A-Za-z\x{80}-\x{10FFFF}\x00-\x20]*)[\x20\x09\x0B-\x0D]"
SPANS = "array<struct<start:long,end:long>>"
#: Digests of more occurrences than this, and than this part of all units, are sent to all executors: at most one for each such part.
HOT_UNITS, HOT_PART = 10_000, 1e-5


def parted(texts: pa.Array, unit: str) -> pa.Array:
    """Filled texts as lists of units; each is followed by its break, which has the break's length in the text."""
    if unit == "sentence":
        texts = pc.replace_substring_regex(texts, SENTENCE_END, r"\1" + "\n")
    return pc.split_pattern(texts, BREAKS[unit])


def units(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """``doc_id, th, uid, no, at, start, end, n_words, d1, d2`` of each unit with a word, written to the shared folder.

    ``no`` counts all units of the text, ``at`` those with a word; offsets are code points of the text.
    """
    gap = len(BREAKS[unit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = parted(filled(batch.column("text")), unit)
            part, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            length = pc.utf8_length(part).to_numpy().astype(np.int64)
            stop = np.cumsum(length + gap)
            end = stop - gap - np.concatenate(([0], stop))[ends[:-1]][of]
            n_words = np.diff(split_words(part)[2])
            full = np.flatnonzero(n_words)
            keys = (b" ".join(x.translate(_LOWER).split()) for x in part.take(pa.array(full)).cast(pa.binary()).to_pylist())
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in keys], np.uint64).reshape(-1, 2)
            before = np.searchsorted(full, ends[:-1])
            rows = pa.array(of[full])
            numbers = (full - ends[of[full]], np.arange(len(full)) - before[of[full]], (end - length)[full], end[full], n_words[full])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("th").take(rows), batch.column("uid").take(rows), *(pa.array(x, pa.int64()) for x in numbers), *(pa.array(np.ascontiguousarray(digests[:, i]).view(np.int64)) for i in (0, 1))],
                names=["doc_id", "th", "uid", "no", "at", "start", "end", "n_words", "d1", "d2"],
            )

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"))
    return cut(known.mapInArrow(run, "doc_id long, th long, uid long, no long, at long, start long, end long, n_words long, d1 long, d2 long"), "units")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, unit: str = "sentence") -> DataFrame:
    """One row for each unit to remove: ``doc_id, th, uid, unit_no, start, end, n_words, run_words, first_doc_id, first_start``.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their names, are not read. Null ids rank last; of repeated
    rows the first keeps its units (``uid`` tells them apart). Units repeated inside one text are repeats, too. Null, empty and
    wordless texts have no units. A very long text is cut as a whole by one worker, and the runs of one text are found in one
    task, from its repeated units alone. No rows: no rows.

    Digests are counted with partial sums. Those of many occurrences, 100 000 at most by the part of all units that each has,
    are broadcast to their units; only others are joined by a shuffle, so no digest makes a task large.
    """
    every = units(docs, unit)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("start"), F.col("uid"))
    first = every.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(rank).alias("first")).filter("c > 1")
    first = cut(first.withColumn("hot", F.col("c") > max(HOT_UNITS, every.count() * HOT_PART)), "digests")
    hot = F.broadcast(first.filter("hot").select("d1", "d2", "first"))
    cold = every.join(hot.drop("first"), ["d1", "d2"], "left_anti").join(first.filter("NOT hot").select("d1", "d2", "first"), ["d1", "d2"])
    found = every.join(hot, ["d1", "d2"]).unionByName(cold).filter(~((F.col("uid") == F.col("first.uid")) & (F.col("start") == F.col("first.start"))))
    # Of neighbours, each is one place further in the text and one further among the repeats.
    found = found.withColumn("_run", F.col("at") - F.row_number().over(Window.partitionBy("uid").orderBy("at")))
    found = found.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("uid", "_run"))).filter(F.col("run_words") >= least_words)
    return found.select("doc_id", "th", "uid", F.col("no").alias("unit_no"), "start", "end", "n_words", "run_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, unit: str = "sentence") -> DataFrame:
    """``docs`` without its repeated units, and ``removed``: the spans that are gone, as offsets in the original text.

    The break after a removed unit goes with it. Rows find their spans by id and text hash; repeated rows are told apart
    by their number. Nulls, empty texts and ties are as in ``repeats``. A column ``removed`` of ``docs`` is replaced, others
    stay as they are, whatever their names. No rows: no rows.
    """
    docs = docs.drop("removed")
    gone = repeats(docs, least_words, unit).groupBy("doc_id", "th", "uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    # Of rows with one id and text, the one in front keeps most; the others are numbered from the end.
    gone = gone.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.desc(F.size("removed")), "uid")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("_n").alias("_m"), "removed")
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h")).withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_h").orderBy(F.lit(0))))
    joined = row.join(gone, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")) & (F.col("_n") == F.col("_m")), "left")
    gap = len(BREAKS[unit])
    cuts = f"aggregate(removed, named_struct('at', 0L, 's', ''), (a, r) -> named_struct('at', r.end + {gap}, 's', concat(a.s, substring(_row.text, cast(a.at + 1 AS int), cast(r.start - a.at AS int)))), a -> concat(a.s, substring(_row.text, cast(a.at + 1 AS int))))"
    text = F.when(F.size("removed") > 0, F.expr(cuts)).otherwise(F.col("_row.text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns), F.coalesce("removed", F.array().cast(SPANS)).alias("removed"))


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeats(docs).select("doc_id", "unit_no", "start", "end", "n_words", "run_words", "first_doc_id", "first_start")


QUERIES = {"op10_unit_dedup": op10_unit_dedup}
ORACLES = {
    "op10_unit_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '{SENTENCE_END}', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS unit_no FROM d),
p AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u),
n AS (SELECT doc_id, unit_no, start, start + length(line) AS "end", regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM p),
r AS (SELECT doc_id, unit_no, start, "end", CAST(len(w) AS BIGINT) AS n_words, first_value(doc_id) OVER o AS first_doc_id, first_value(start) OVER o AS first_start, row_number() OVER o AS rn, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS place FROM n WHERE len(w) > 0
 WINDOW o AS (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id NULLS LAST, start)),
g AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM r WHERE rn > 1),
s AS (SELECT *, CAST(sum(n_words) OVER (PARTITION BY doc_id, run) AS BIGINT) AS run_words FROM g)
SELECT doc_id, unit_no, start, "end", n_words, run_words, first_doc_id, first_start FROM s WHERE run_words >= {LEAST_WORDS}
"""
}
