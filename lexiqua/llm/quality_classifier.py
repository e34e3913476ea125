"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, or of ASCII punctuation, in ASCII lower case. Features are the hashes of single words and of
neighbouring pairs; a pair of equal words is a feature of its own, too, so repetition in any language is one. A text is the
sparse vector of the square roots of its features' counts, of length 1; its score is the logistic function of that vector's product
with the weights.

Training reads ``SAMPLE_ROWS`` labelled documents at most, those whose ids have the lowest hashes. They are dealt to shards
of ``SHARD_ROWS``; in each round a shard takes its documents in an order of its own through FTRL-proximal updates, from the state (sums
of gradients, and of their squares) of the round before, and the new state of a bucket is the mean over the shards that met it. A worker
holds the state, whose size is that of the buckets, and one batch of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, filled, mixed, slices, split_words, sums, translated

BUCKETS = 1 << 18
#: The bound on labelled documents that are learnt from; scores are of all documents.
SAMPLE_ROWS = 6_000
#: There is a shard for each so many documents of the sample.
SHARD_ROWS, ROUNDS = 2_000, 5
ALPHA, BETA, L1, L2 = 8.0, 1.0, 0.0, 0.0
THRESHOLD = 0.3
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The feature of two equal words next to each other.
_AGAIN = np.uint64(0xFF51AFD7ED558CCD)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from: crc32 of its id as text divides by 5 (that of no id is 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(column: pa.Array, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of a column of texts: buckets in rising order and values, text by text, and the first of each (with the count of
    all at the end)."""
    text = pc.replace_substring_regex(translated(column, _LOWER), r"([!-/:-@\[-`{-~]+)", r" \1 ")
    codes, words, first = split_words(text)
    n = len(first) - 1
    value = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))[codes] if len(words) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(n), np.diff(first))
    inside = np.flatnonzero(of[:-1] == of[1:])
    pair = mixed(value[inside] * _FACTORS[0] + mixed(value[inside + 1] * _FACTORS[1]))
    again = inside[value[inside] == value[inside + 1]]
    hashes = np.concatenate((mixed(value), pair, np.full(len(again), _AGAIN)))
    key = np.concatenate((of, of[inside], of[again])) * np.int64(n_buckets) + (hashes % np.uint64(n_buckets)).astype(np.int64)
    key, counts = np.unique(key, return_counts=True)
    start = np.searchsorted(key, np.arange(n + 1) * np.int64(n_buckets))
    length = np.sqrt(sums(counts, start).astype(float))  # the squares of the values are the counts
    return key % n_buckets, np.sqrt(counts) / np.repeat(length, np.diff(start)), start


def _packed(data: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(start.astype(np.int64) * data.itemsize), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def examples(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_buckets: int = BUCKETS) -> DataFrame:
    """``place, label, buckets, amounts`` of the documents to learn from, written to the shared folder.

    ``labels`` has ``doc_id`` and ``label`` (0 to 1); several labels of one id count as their mean, null ones not at all. Of several
    documents with one id one is learnt from, that whose text has the lowest hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("label").cast("double").alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("_id").agg(F.avg("label").alias("label")).withColumn("place", F.xxhash64("_id"))
    known = F.broadcast(known.orderBy("place", "_id").limit(sample_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(known, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buckets, values, start = features(filled(batch.column("text")), n_buckets)
            vectors = [_packed(buckets.astype("<i4"), start), _packed(values.astype("<f2"), start)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "place", "th", "label")), *vectors], names=["_id", "place", "th", "label", "buckets", "amounts"])

    rows = rows.select("_id", "place", F.xxhash64("text").alias("th"), "label", "text").mapInArrow(run, "_id long, place long, th long, label double, buckets binary, amounts binary")
    one = rows.groupBy("_id").agg(F.min_by(F.struct("place", "label", "buckets", "amounts"), "th").alias("x"))
    return cut(one.select("x.*"), "examples")


class Leader:
    """FTRL-proximal state: for each bucket, and for the constant behind them, ``z`` and ``n``."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (logistic(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


def trained(rows: DataFrame, n_buckets: int = BUCKETS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of all buckets, the constant last, from ``examples``. No examples give zeros, so all scores are 0.5.

    Each round sends a row for each bucket at most, from each shard, and a mean for each to the driver, which sends the state to all.
    """
    spark, shards = rows.sparkSession, max(1, math.ceil(rows.count() / SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    z, n = np.zeros(n_buckets + 1), np.zeros(n_buckets + 1)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shard, leader, met = None, None, None

            def state() -> pa.RecordBatch:
                at = np.flatnonzero(met)
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard), pa.int32()), pa.array(at, pa.int64()), pa.array(leader.z[at]), pa.array(leader.n[at])], names=["shard", "bucket", "z", "n"])

            for batch in slices(batches, "buckets"):
                for of, label, buckets, amounts in zip(*(batch.column(c).to_pylist() for c in ("shard", "label", "buckets", "amounts"))):
                    if of != shard:
                        if shard is not None:
                            yield state()
                        shard, leader, met = of, Leader(*(x.copy() for x in shared.value)), np.zeros(n_buckets + 1, bool)
                    at = np.append(np.frombuffer(buckets, "<i4"), n_buckets)
                    leader.learn(at, np.append(np.frombuffer(amounts, "<f2").astype(float), 1.0), label)
                    met[at] = True
            if shard is not None:
                yield state()

        dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("place", F.lit(r)), "place")
        states = dealt.mapInArrow(run, "shard int, bucket long, z double, n double")
        # In the order of shards, so that sums of doubles are the same in each run.
        mean = lambda c: F.expr(f"aggregate(states, 0D, (s, x) -> s + x.{c}) / size(states)").alias(c)
        new = states.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("shard", "z", "n"))).alias("states")).select("bucket", mean("z"), mean("n")).toArrow()
        at = new["bucket"].to_numpy()
        z, n = z.copy(), n.copy()
        z[at], n[at] = new["z"].to_numpy(), new["n"].to_numpy()
        shared.unpersist()
    return Leader(z, n).weights()


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of each row of ``docs`` (``doc_id``, ``text``): 0 to 1, higher where label 1 is likelier.

    Null, empty and wordless texts have the score of the constant alone. Repeated rows are scored each; a very long text is hashed
    as a whole by one worker. Other columns are not read, whatever their names. No rows: no rows.
    """
    shared, n_buckets = docs.sparkSession.sparkContext.broadcast(weights), len(weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buckets, values, start = features(filled(batch.column("text")), n_buckets)
            of = np.repeat(np.arange(batch.num_rows), np.diff(start))
            x = np.bincount(of, shared.value[buckets] * values, batch.num_rows) + shared.value[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -700, 700))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_buckets: int = BUCKETS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``; ``labels`` (``doc_id, label``) of held-out ids are not learnt from."""
    weights = trained(examples(docs, labels.filter(~held_out(F.col("doc_id"))), sample_rows, n_buckets), n_buckets, rounds)
    return scores(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return classified(docs, labels)


QUERIES = {"op11_quality_classifier": op11_quality_classifier}
ORACLES: dict[str, str] = {}
