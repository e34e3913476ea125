import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lexiqua.llm import quality_classifier as m

M = (1 << 64) - 1
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scattered(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def vector(text, n=m.BUCKETS):
    """A text's sparse vector, by plain counting."""
    w = [xxhash.xxh3_64_intdigest(x) for x in re.findall(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[!-/:-@\[-`{-~]+", text.translate(LOWER))]
    hashes = [scattered(x) for x in w]
    for a, b in zip(w, w[1:]):
        hashes.append(scattered(a * int(m._FACTORS[0]) + scattered(b * int(m._FACTORS[1]) & M) & M))
        if a == b:
            hashes.append(int(m._AGAIN))
    counts = Counter(h % n for h in hashes)
    norm = math.sqrt(sum(counts.values())) or 1
    return {k: math.sqrt(c) / norm for k, c in counts.items()}


ODD = ["", "Hello, World!!! hello", "a a a a", "|x| | y", "Ünï çode 漢字 ÄÖ", "line\nline\n", "### $$$ 1 2 3", "word " * 60_000, "\x01\x7f ctrl"]


def test_features():
    buckets, values, start = m.features(pa.array(ODD))
    for i, text in enumerate(ODD):
        want = sorted(vector(text).items())
        assert buckets[start[i] : start[i + 1]].tolist() == [k for k, _ in want] and np.allclose(values[start[i] : start[i + 1]], [v for _, v in want])


def test_training_and_scores_by_plain_updates(spark):
    """One shard: the same documents in the same order through the update rule, written out for each coordinate."""
    docs = [(i, "good plain words " + str(i % 7)) if i % 3 else (i, "bad bad bad ### " + str(i % 5)) for i in range(60)] + [(100, None), (101, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(60)] + [(100, 1), (7, 0), (None, 1), (8, None), (999, 1)]
    d = spark.createDataFrame([(i, x, "z", 1.5) for i, x in docs], "doc_id long, text string, label string, score double")
    y = spark.createDataFrame(labels, "doc_id long, label int")
    got = {r.doc_id: r for r in m.classified(d, y, n_buckets=512, rounds=2).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    mean = {i: np.mean([v for k, v in labels if k == i and v is not None]) for i, x in docs if any(k == i and v is not None for k, v in labels)}
    place = {r.i: r.h for r in spark.createDataFrame([(i,) for i in mean], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    z, n = Counter(), Counter()

    def weight(k):
        return -z[k] / ((m.BETA + math.sqrt(n[k])) / m.ALPHA)

    def product(text):
        return sum(weight(k) * v for k, v in [*vector(text or "", 512).items(), ("constant", 1.0)])

    for r in range(2):
        order = {i: h for i, h in ((x.i, x.h) for x in spark.createDataFrame(list(place.items()), "i long, p long").select("i", F.xxhash64("p", F.lit(r)).alias("h")).collect())}
        for i in sorted((i for i in mean if not held(i)), key=lambda i: (order[i], place[i])):
            x = {**vector(dict(docs)[i] or "", 512), "constant": 1.0}
            g = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items()))) - mean[i]
            for k, v, w in [(k, v, weight(k)) for k, v in x.items()]:
                z[k] += g * v - (math.sqrt(n[k] + (g * v) ** 2) - math.sqrt(n[k])) / m.ALPHA * w
                n[k] += (g * v) ** 2
    assert len(got) == len(docs)
    for i, x in docs:
        want = 1 / (1 + math.exp(-product(x)))
        assert abs(got[i].score - want) < 2e-3 and got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = m.op11_quality_classifier(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [p for p, y, _ in held if y == 0], [p for p, y, _ in held if y == 1]
    assert sum(p == y for p, y, _ in held) >= 0.95 * len(held) and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)
    assert {r.doc_id: r.score for r in m.op11_quality_classifier(spark, sf).collect()} == {r.doc_id: r.score for r in rows}  # reruns agree


def test_several_shards_agree_between_runs(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_ROWS", 20)
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad ### words") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, label int")
    one, two = ({r.doc_id: (r.score, r.predicted) for r in m.classified(docs, labels, n_buckets=1 << 12).collect()} for _ in range(2))
    assert one == two and all(p == i % 2 for i, (_, p) in one.items())


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")] * 5 + [(1, "c d"), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert m.examples(docs, labels).count() == 1
    assert m.classified(docs, labels).count() == 7
    assert {r.score for r in m.classified(docs, labels.limit(0)).collect()} == {0.5}
    assert m.classified(docs.limit(0), labels).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, label int")
    assert m.examples(docs, labels, sample_rows=7).count() == 7
