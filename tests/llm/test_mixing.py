import random

from pyspark.sql import functions as F

from lexiqua.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, target int, taken string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", "", "é", None])) for i in range(300)]
    rows += [(i, "w " * 30, "hot") for i in range(1000, 1200)] + [(2000, None, "a"), (None, "x y", "b"), (5, rows[5][1], rows[5][2]), (3000, "only here", "z"), (3001, "", "empty")]
    return rows


def filled(sizes):
    """Targets by sharing again and again."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 3 * sizes[s]]
        for s in over or free:
            target[s] = 3 * sizes[s] if over else level * weight[s]
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def test_targets_and_taken(spark):
    rows = corpus()
    got = m.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = filled(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, m.mix(frame(spark, rows)).collect()))


def test_early_weights_come_early(spark):
    mean = {r[0]: r[1] for r in m.mix(frame(spark, corpus())).select("source", F.explode("positions").alias("p")).groupBy("source").agg(F.avg("p")).collect()}
    assert mean[""] < 0.45 and abs(mean["a"] - 0.5) < 0.05 and mean["b"] > 0.55


def test_schedule_of_many_knots_is_inverted(spark):
    docs = frame(spark, [(i, "w w", "a") for i in range(400)])
    knots = [(0.0, 0.0), (0.5, 2.0), (0.5, 0.0), (1.0, 0.0)]
    plan = spark.createDataFrame([("a", knots)], f"source string, knots {m.KNOTS}")
    p = sorted(x for r in m.mix(docs, plan).collect() for x in r.positions)
    assert len(p) == 400 and all(abs(x - 0.5 * (i / 400) ** 0.5) < 1e-9 for i, x in enumerate(p))


def test_mixed_documents_are_whole_and_repeat(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = m.mixed_documents(docs)
    assert out.columns == docs.columns
    plan = {}
    for r in m.mix(docs, cut_last=False).collect():
        plan[(r.doc_id, r.source)] = plan.get((r.doc_id, r.source), 0) + len(r.positions)
    got = {}
    for r in out.collect():
        got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


def test_no_rows(spark):
    assert m.mix(frame(spark, [])).count() == 0
    assert m.mixed_documents(frame(spark, [])).count() == 0


def test_rows_come_in_training_order(spark):
    rows = m.mix(frame(spark, corpus()).repartition(4)).collect()
    first = [(not r.positions, r.positions[0] if r.positions else 0.0) for r in rows]
    assert len(rows) == len(corpus()) and first == sorted(first)
    assert len({r.source for r in rows[:40]}) > 3
