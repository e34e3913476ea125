"""Quality rules with cross-document line frequency.

A worker counts each whole text's base figures and hashes its normalised lines (ASCII lower case, digits as 0, ASCII
punctuation dropped, white space as one space). Each line then counts the distinct documents of its host that hold it.
Documents whose normalised lines are all equal are one document, so exact copies don't make their own lines look like
boilerplate; near copies are documents each, and what they share counts for each of them. Lines above the host's limit
are removed, and a document is rejected as depleted if too few of its words stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, filled, mixed, slices, split_words, sums

#: A line goes if more than this many documents of its host hold it, and more than this share of them.
LIMIT_DOCS, LIMIT_SHARE = 20, 0.01
#: A document is depleted if fewer words stay, or less than this share of its words.
LEAST_WORDS, LEAST_SHARE = 10, 0.1
SYMBOLS = b"#*$%&|<>"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_DROPPED = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_IS_SYMBOL = bytes(int(b in SYMBOLS) for b in range(256))
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD))
LINES = "array<struct<no:int,hash:long,words:int>>"
FIGURES = f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines {LINES}"
#: What tells documents apart where a line's documents are counted: the set of all their lines.
DOCUMENT = "xxhash64(array_sort(array_distinct(lines.hash)))"
#: The largest table of verdicts, in rows, that is sent to all executors (about 64 bytes a row).
BROADCAST_ROWS = 1_000_000


def figures(column: pa.Array) -> list[pa.Array]:
    """The columns of ``FIGURES`` for a column of texts."""
    text = filled(column)
    n = len(text)
    lists = pc.split_pattern(text, "\n")
    line, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    codes, words, first = split_words(line)
    start = first[ends]
    doc_of_line = np.repeat(np.arange(n), np.diff(ends))
    n_words = np.diff(start)
    chars = pc.utf8_length(words).to_numpy().astype(np.int64)
    data = text.buffers()[2]
    symbols = np.frombuffer((data.to_pybytes() if data else b"").translate(_IS_SYMBOL), np.uint8)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[: n + 1]
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(symbols, dtype=np.int64)))
    # repeated lines
    full = np.flatnonzero(np.diff(first) > 0)
    coded = line.dictionary_encode()
    distinct = np.unique(doc_of_line[full] * np.int64(len(coded.dictionary) or 1) + coded.indices.to_numpy()[full]) // (len(coded.dictionary) or 1)
    dup = np.bincount(doc_of_line[full], minlength=n) - np.bincount(distinct, minlength=n)
    # words in repeated windows of five
    repeated = np.zeros(len(codes) + 4, bool)
    if len(codes) > 4:
        doc_of_word = np.repeat(np.arange(n), n_words)
        value = mixed(np.arange(1, len(words) + 1))[codes]
        h = mixed(doc_of_word[:-4] + 1)
        for j, f in enumerate(_FACTORS):
            h = h + mixed(value[j : len(value) - 4 + j] * f + np.uint64(j))
        inside = np.flatnonzero(doc_of_word[:-4] == doc_of_word[4:])
        inside = inside[np.argsort(h[inside])]
        same = h[inside][1:] == h[inside][:-1]
        twice = inside[np.append(same, False) | np.append(False, same)] if len(inside) else inside
        for j in range(5):
            repeated[twice + j] = True
    # lines
    value = np.fromiter((xxhash.xxh3_64_intdigest(b) if (b := w.translate(_FOLD, _DROPPED)) else 0 for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))[codes] if len(words) else np.zeros(0, np.uint64)
    counted = np.concatenate(([0], np.cumsum(value != 0)))
    place = counted[:-1] - np.repeat(counted[first[:-1]], np.diff(first))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _FACTORS[0]), dtype=np.uint64)
    hashed = mixed(sums(value * power[place], first)).view(np.int64)
    size = np.diff(counted[first])
    kept = np.flatnonzero(size > 0)
    number = (np.arange(len(size)) - np.repeat(ends[:-1], np.diff(ends)))[kept]
    listed = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(hashed[kept], pa.int64()), pa.array(np.diff(first)[kept], pa.int32())], ["no", "hash", "words"])
    of_doc = np.concatenate(([0], np.cumsum(np.bincount(doc_of_line[kept], minlength=n)))).astype(np.int32)
    long = lambda x: pa.array(x, pa.int64())
    return [long(n_words), long(sums(chars[codes] if len(codes) else np.zeros(0, np.int64), start)), long(at[offsets[1:]] - at[offsets[:-1]]), long(dup), long(sums(repeated[: len(codes)].astype(np.int64), start)), pa.ListArray.from_arrays(pa.array(of_doc), listed)]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "_hash")), *figures(batch.column("_text"))], names=["doc_id", "host", "_hash", *(x.split()[0] for x in FIGURES.split(", ", 5))])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, host, _hash`` and ``FIGURES`` of each document, written to the shared folder."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.xxhash64("text").alias("_hash"), F.col("text").cast("string").alias("_text"))
    return cut(known.mapInArrow(_measured, f"doc_id long, host string, _hash long, {FIGURES}"), "figures")


def frequent_lines(figures_: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """``host, hash, n_docs`` of the lines above their host's limit; ``n_docs`` are distinct documents."""
    known = figures_.select("host", F.expr(DOCUMENT).alias("_doc"), "lines")
    lines = known.select("host", "_doc", F.explode("lines.hash").alias("hash"))
    hosts = known.select("host", "_doc").distinct().groupBy("host").agg(F.count("*").alias("_all")).withColumnRenamed("host", "_host")
    counts = lines.distinct().groupBy("host", "hash").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limit_docs)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n_docs") > F.col("_all") * limit_share).select("host", "hash", "n_docs")


def judge(docs: DataFrame, **limits) -> DataFrame:
    """One row for each document: ``doc_id, host, _hash``, the base figures, ``base_failed``, ``removed_lines`` (numbers
    from 0), ``kept_words`` and ``kept``.

    ``docs`` needs ``doc_id``, ``text`` and ``source`` (its host; null is a host of its own). A null text has no words and
    fails the base rules. Repeated rows are judged alike and count as one document. Texts are read whole, a very long one
    in one worker; other columns of ``docs`` are not read, whatever their names. No rows: no rows.
    """
    base = measure(docs)
    frequent = cut(frequent_lines(base, **limits), "frequent").select(F.col("host").alias("_h"), F.col("hash").alias("_l"))
    key = ["doc_id", "host", "_hash"]
    lines = base.select(*key, F.explode("lines").alias("line")).distinct()
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line.hash") == F.col("_l")), "left_semi")
    hit = hit.groupBy(*(F.col(c).alias(f"r_{c}") for c in key)).agg(F.sum("line.words").alias("_gone"), F.array_sort(F.collect_list("line.no")).alias("removed_lines"))
    joined = base.join(hit, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & F.col("host").eqNullSafe(F.col("r_host")) & (F.col("_hash") == F.col("r__hash")), "left")
    joined = joined.withColumn("kept_words", F.col("n_words") - F.coalesce("_gone", F.lit(0))).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("kept_words") >= LEAST_WORDS) & (F.col("kept_words") >= LEAST_SHARE * F.col("n_words"))
    return joined.select(*key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), "kept_words", kept.alias("kept"))


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, without the lines above the limits; ``n_chars``, where there is one, is counted anew.

    All other columns stay as they are, whatever their names. Null, empty and wordless texts fail the base rules and go;
    repeated rows stay or go together; a null ``doc_id`` or ``source`` is a value like others. No rows: no rows.
    """
    verdicts = cut(judge(docs, **limits).filter("NOT kept OR size(removed_lines) > 0").select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("_hash").alias("_h"), F.col("removed_lines").alias("_lines"), F.col("kept").alias("_kept")).distinct(), "verdicts")
    if verdicts.count() <= BROADCAST_ROWS:
        verdicts = F.broadcast(verdicts)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.col("source").cast("string").alias("_s"), F.xxhash64("text").alias("_x"))
    joined = rows.join(verdicts, F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_host")) & (F.col("_x") == F.col("_h")), "left").filter(F.coalesce("_kept", F.lit(True)))
    cut_ = F.size("_lines") > 0
    text = F.when(cut_, F.array_join(F.filter(F.split("_row.text", "\n", -1), lambda x, i: ~F.array_contains("_lines", i)), "\n")).otherwise(F.col("_row.text"))
    new = {"text": text} | ({"n_chars": F.when(cut_, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {})
    return joined.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words", F.size("removed_lines").cast("long").alias("n_removed_lines"))


QUERIES = {"op1_quality": op1_quality}
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_NORMAL = r"array_to_string(list_filter(string_split(translate(regexp_replace(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'), '[\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), ' '), lambda x: x <> ''), ' ')"
ORACLES = {
    "op1_quality": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
l AS (SELECT doc_id, source, no, line, CAST(len({_WORDS.format("line")}) AS BIGINT) AS n, {_NORMAL.format("line")} AS norm FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY 1),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5))),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS i FROM win WHERE c > 1) GROUP BY 1),
nl AS (SELECT * FROM l WHERE norm <> ''),
known AS (SELECT doc_id, md5(array_to_string(list_sort(list(DISTINCT norm)), chr(10))) AS k FROM nl GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT coalesce(k, '')) AS n FROM d LEFT JOIN known USING (doc_id) GROUP BY 1),
freq AS (SELECT nl.source, norm, count(DISTINCT k) AS n FROM nl JOIN known USING (doc_id) GROUP BY 1, 2),
gone AS (SELECT doc_id, sum(nl.n) AS n, count(*) AS c FROM nl JOIN freq ON nl.source IS NOT DISTINCT FROM freq.source AND nl.norm = freq.norm JOIN hosts ON nl.source IS NOT DISTINCT FROM hosts.source WHERE freq.n > {LIMIT_DOCS} AND freq.n > hosts.n * {LIMIT_SHARE} GROUP BY 1),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS kept_words, CAST(coalesce(gone.c, 0) AS BIGINT) AS n_removed_lines
 FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND kept_words >= {LEAST_WORDS} AND kept_words >= {LEAST_SHARE} * n_words AS kept FROM b
"""
}
