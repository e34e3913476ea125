import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexiqua.streaming import conversation

SCHEMA = "conv_id long, turn long, role string, text string, ts timestamp"
START = datetime(2024, 1, 1)


def told(spark, folder, batches, name, **more):
    """What the stream tells when each batch is a file of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        # files are taken by their time of change
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = conversation.stream_in_order(stream, "ts", **more).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(key, before)
    return sorted(((r.conv_id, r.turn, r.previous, r.recent_same) for r in spark.table(name).collect() if r.conv_id >= 0), key=str)


def test_shuffled_batches_give_the_rows_of_the_batch_query(spark, tmp_path):
    rng = random.Random(2)
    turns = [(c, t, rng.choice(["user", "assistant"]), f"text {c} {t}" if t % 5 else None, START + timedelta(minutes=3 * t + c)) for c in range(4) for t in range(25)]
    # arrival: by time, but up to 20 minutes late
    arrived = sorted(turns, key=lambda r: r[4] + timedelta(minutes=rng.uniform(0, 20)))
    batches = [arrived[i : i + 25] for i in range(0, len(arrived), 25)] + [[(-1, 0, "x", "x", START + timedelta(days=1))], [(-1, 1, "x", "x", START + timedelta(days=2))]]
    assert [r[1] for r in batches[0] if r[0] == 0] != sorted(r[1] for r in batches[0] if r[0] == 0)
    want = conversation.with_previous(spark.createDataFrame(turns, SCHEMA))
    want = sorted(((r.conv_id, r.turn, r.previous, r.recent_same) for r in want.collect()), key=str)
    assert told(spark, str(tmp_path), batches, "ordered", late="30 minutes") == want


def test_memory_ends(spark, tmp_path):
    """A turn long after the last one has nothing before it."""
    far = START + timedelta(days=5)
    batches = [[(1, 0, "user", "a", START)], [(-1, 0, "x", "x", START + timedelta(days=3))], [(-1, 1, "x", "x", START + timedelta(days=4))], [(1, 1, "user", "b", far), (1, 2, "user", "c", far + timedelta(minutes=1))], [(-1, 2, "x", "x", START + timedelta(days=9))], [(-1, 3, "x", "x", START + timedelta(days=10))]]
    assert told(spark, str(tmp_path), batches, "forgotten", keep=timedelta(hours=1)) == [(1, 0, None, 0), (1, 1, None, 0), (1, 2, "b", 1)]
