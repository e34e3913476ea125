"""Target-distribution importance resampling: documents are drawn by how much they look like a target corpus.

Identical texts are collapsed by grouping whole texts; each distinct text is hashed once, into buckets of its runs of 1 to
3 words, and its bucket counts are multiplied by its copies. A bucket's gain is the logarithm of its smoothed frequency in
the target over that in all documents; a text's weight is the sum of its gains. Weights are joined back to the documents,
where each document gets noise of its own (Gumbel, from a digest of its id), so the highest scores are a sample without
replacement by weight.

CRC-32 is linear: that of a run of words is that of the run without its last word, moved by the last word's length, xor that of the
last word. A worker therefore hashes each distinct word once and finds all runs by table look-ups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, filled, parts_for, slices, split_words, sums, translated

#: The register behind the space that joins words.
SPACE = zlib.crc32(b" ")
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Texts of more copies than this, and than this part of all documents, are joined by a broadcast: 100 000 of them at most.
HOT_COPIES, HOT_PART = 100, 1e-5
#: A-Z in lower case, ASCII that belongs to no word as spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _moved(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC registers after zero bytes; ``table`` has 256 outcomes for each byte of the register."""
    at = [(values >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    return table[0][at[0]] ^ table[1][at[1]] ^ table[2][at[2]] ^ table[3][at[3]]


def _single_byte() -> np.ndarray:
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step = step ^ step[0]  # without what conditions the register before and after: linear in the byte
    base = np.arange(256, dtype=np.uint32)
    return np.stack([step[base], *(base << np.uint32(8 * (k - 1)) for k in (1, 2, 3))]).astype(np.uint32)


#: Outcomes of 1, 2, 4, ... zero bytes, as far as they were asked for.
_POWERS: list[np.ndarray] = [_single_byte()]


def _table(length: int) -> np.ndarray:
    """Outcomes of ``length`` zero bytes."""
    out, bit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]), 0
    while length >> bit:
        if bit == len(_POWERS):
            _POWERS.append(_moved(_POWERS[-1], _POWERS[-1]))
        if length >> bit & 1:
            out = _moved(out, _POWERS[bit])
        bit += 1
    return out


def run_hashes(column: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of all runs of 1 to ``run`` words, joined by a space, document by document: the hashes, the first of each
    document (with the count of all at the end), and each document's words."""
    codes, words, first = split_words(translated(column, _WORDS))
    held = words.cast(pa.binary()).to_pylist()
    alone = np.fromiter(map(zlib.crc32, held), np.uint32, len(held))[codes] if held else np.zeros(0, np.uint32)
    after = np.fromiter((zlib.crc32(w, SPACE) for w in held), np.uint32, len(held)) if held else np.zeros(0, np.uint32)  # the word behind a space
    n_words = np.diff(first)
    length = np.fromiter((len(w) + 1 for w in held), np.int64, len(held)) if held else np.zeros(0, np.int64)
    kinds, kind = np.unique(length, return_inverse=True)
    tables = np.stack([_table(int(x)) for x in kinds]).reshape(-1) if len(kinds) else np.zeros(0, np.uint32)
    place, base = kind[codes] * 1024, after[codes]
    of = np.repeat(np.arange(len(n_words)), n_words)
    number = np.arange(len(codes)) - np.repeat(first[:-1], n_words)
    each = sum((np.maximum(n_words - k, 0) for k in range(run)), np.zeros(len(n_words), np.int64))
    start = np.concatenate(([0], np.cumsum(each)))
    out, now, behind = np.zeros(start[-1], np.uint32), alone, np.zeros(len(n_words), np.int64)
    keep = np.arange(len(codes))
    for k in range(run):
        if k:
            keep = keep[number[keep] + k < n_words[of[keep]]]  # where the run still ends in its document
            last, value = keep + k, now[keep]
            at = place[last]
            moved = base[last]
            for j in range(4):
                moved = moved ^ tables[at + 256 * j + ((value >> np.uint32(8 * j)) & np.uint32(255))]
            now = np.zeros(len(codes), np.uint32)
            now[keep] = moved
        out[start[of[keep]] + behind[of[keep]] + number[keep]] = now[keep]
        behind = behind + np.maximum(n_words - k, 0)
    return out, start, n_words


def collapsed(texts: DataFrame, n_buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """``digest, copies, n_words, n_features, buckets`` of each distinct text of a column ``text``, written to the shared folder.

    ``buckets`` holds the text's buckets one after another, as little-endian integers of 2 bytes (4 where there are more than 65 536).
    """
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"
    alike = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, first, n_words = run_hashes(filled(batch.column("text")), run)
            width = np.dtype(kind).itemsize
            data = (values % np.uint32(n_buckets)).astype(kind).tobytes()
            held = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first * width), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("copies"), pa.array(n_words, pa.int64()), pa.array(np.diff(first), pa.int64()), held], names=["digest", "copies", "n_words", "n_features", "buckets"]
            )

    named = alike.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")
    return cut(named.mapInArrow(hashed, "digest binary, copies long, n_words long, n_features long, buckets binary"), "features")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a batch, and the first of each text (with the count of all at the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return data, (offsets - offsets[0]) // np.dtype(kind).itemsize


def bucket_counts(features: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features in each bucket over all texts, each as often as it has copies. A task sends a row for each bucket at most."""
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in slices(batches, "buckets"):
            data, first = _flat(batch.column("buckets"), kind)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            once = copies == 1
            each = np.repeat(once, np.diff(first))
            total += np.bincount(data[each], minlength=n_buckets)
            for i in np.flatnonzero(~once):
                total += copies[i] * np.bincount(data[first[i] : first[i + 1]], minlength=n_buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    return features.select("copies", "buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` from two tables of ``bucket_counts``: floor(1000 ln) of the smoothed frequency in the target over that in the source."""
    spark = source.sparkSession
    s, t = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    of_s, of_t = (df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("all")) for df in (source, target))
    rows = spark.range(n_buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    rows = rows.crossJoin(F.broadcast(of_s.withColumnRenamed("all", "all_s"))).crossJoin(F.broadcast(of_t.withColumnRenamed("all", "all_t")))  # one row each
    ratio = (F.col("t").cast("double") + 1) * (F.col("all_s") + n_buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + n_buckets))
    return rows.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def weights(features: DataFrame, gain: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """``digest, copies, n_words, n_features, weight`` of each distinct text. All gains, a number for each bucket, are sent to all workers."""
    table = np.zeros(n_buckets, np.int64)
    for b, g in gain.select("bucket", "gain").collect():  # as many rows as there are buckets
        table[b] = g
    shared, kind = features.sparkSession.sparkContext.broadcast(table), "<u2" if n_buckets <= 1 << 16 else "<u4"
    names = ["digest", "copies", "n_words", "n_features"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "buckets"):
            data, first = _flat(batch.column("buckets"), kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums(shared.value[data], first), pa.int64())], names=[*names, "weight"])

    return features.mapInArrow(weigh, "digest binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's noise in thousandths: Gumbel, from the first 32 bits of a digest of its id (a null id counts as an empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row of ``docs``; ``docs`` needs ``doc_id`` and ``text``, ``target`` needs ``text``.

    Null, empty and wordless texts have no features and weight 0. Repeated rows are documents each, with one score. Texts are
    grouped whole, so a very long one is hashed as a whole by one worker; copies meet in partial counts before they are shuffled. Digests
    of texts with many copies are joined by a broadcast, so no group of copies makes a task large. An empty target gives gains from
    its smoothing alone; no documents give no rows. Other columns are not read, whatever their names.
    """
    features = collapsed(docs, n_buckets, run)
    gain = gains(bucket_counts(features, n_buckets), bucket_counts(collapsed(target, n_buckets, run), n_buckets), n_buckets)
    known = cut(weights(features, gain, n_buckets), "weights")
    total = known.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") > max(HOT_COPIES, total * HOT_PART)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest"))
    rows = cut(rows, "digests")
    many = F.broadcast(known.filter(hot).drop("copies"))
    few = rows.join(many.select("digest"), "digest", "left_anti").join(known.filter(~hot).drop("copies"), "digest")
    joined = rows.join(many, "digest").unionByName(few)
    return joined.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **more) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the drawn documents, null for the others.

    Of the documents with ``least_words`` words or more, ``percent`` in 100 (rounded down) are drawn by score; ties go to the smaller id
    (null last), and rows equal in both are interchangeable. Ranks come from a range sort: a row's number in its partition, after the
    rows of the partitions before it (prefix sums of a row for each partition).
    """
    every = cut(scored(docs, target, **more).withColumn("_uid", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    n_drawn = every.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_uid")]
    sorted_ = every.filter(able).repartitionByRange(parts_for(every), *order).sortWithinPartitions(*order)
    numbered = cut(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    ahead = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ahead = ahead.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = numbered.join(F.broadcast(ahead), "_part").withColumn("rank", F.when(rank <= n_drawn, rank).cast("long"))
    rest = every.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance": op13_importance}
_WORD_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "SELECT {0} unnest(w) AS f FROM {1} UNION ALL SELECT {0} unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {1} UNION ALL SELECT {0} unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM {1}"
ORACLES = {
    # CRC-32 a byte at a time, from its table of 256 outcomes.
    "op13_importance": f"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
b AS (SELECT {_WORD_LIST} AS w FROM benchmark),
g AS (SELECT doc_id, f, count(*) AS n FROM ({_RUNS.format("doc_id,", "d")}) GROUP BY ALL),
h AS (SELECT f, count(*) AS n FROM ({_RUNS.format("", "b")}) GROUP BY ALL),
x AS (SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda y: CAST('0x' || y AS BIGINT)) AS y FROM (SELECT f FROM g UNION SELECT f FROM h)),
c AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), y), lambda r, v: xor(r // 256, t[xor(r % 256, v) + 1])), 4294967295) % {BUCKETS} AS bucket FROM x, k),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM g JOIN c USING (f) GROUP BY 1),
t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM h JOIN c USING (f) GROUP BY 1),
v AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS}) / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM g JOIN c USING (f) JOIN v USING (bucket) GROUP BY 1),
e AS (SELECT doc_id, len(d.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, (CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296 AS h FROM d LEFT JOIN w USING (doc_id)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(h))) AS BIGINT) AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * {PERCENT} // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""
}
