import random

import pytest
from pyspark.sql import functions as F

from lexiqua.operators import lookup, relations


def texts(n, seed, common=""):
    rng = random.Random(seed)
    return [(i, common + " ".join(rng.choice(["river", "stone", "running", "walks", "and", "because", "house", "tree", "jumped", "under", "cloud", "light"]) + rng.choice(["", "s", "x"]) for _ in range(rng.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("most", [5, 60, 100_000])
def test_most_similar_pairs_are_those_of_all_pairs(spark, most):
    df = spark.createDataFrame([*texts(60, 1), (100, None), (101, "river stone house"), (102, "river stone house")], "id int, text string")
    every = relations.best_pairs(relations.similar_pairs(df, "id", "text"), most).collect()
    assert every and relations.top_pairs(df, "id", "text", most).orderBy("rank").collect() == sorted(every, key=lambda r: r.rank)


@pytest.mark.parametrize("most", [3, 20, 100_000])
def test_exemplified_pairs_are_those_of_all_pairs(spark, most):
    from lexiqua.functions import text

    df = spark.createDataFrame([*texts(50, 2), (100, None)], "id int, text string")
    rows = {r.id: (sorted(set(r.n)), r.t or "") for r in df.select("id", text.nouns(F.col("text")).alias("n"), F.lower("text").alias("t")).collect()}
    want = []
    for a in rows:
        for b in rows:
            shared = sorted(set(rows[a][0]) & set(rows[b][0]))
            examples = sum(n in rows[a][1] or n in rows[b][1] for n in shared[:6])
            if a < b and examples:
                want.append((a, b, examples, len(shared)))
    want.sort(key=lambda r: (-r[2], -r[3], r[0], r[1]))
    got = relations.exemplified_pairs(df, "id", "text", most).orderBy("rank").collect()
    assert [(r.a, r.b, r.examples, r.shared) for r in got] == want[:most] and [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_a_word_of_all_texts_brings_few_together(spark):
    """One word in all texts: prefixes put it aside, so candidates stay far from all pairs."""
    rng = random.Random(3)
    rows = [(i, "everywhere " + " ".join("".join(rng.choice("bcdfgh") for _ in range(7)) for _ in range(8))) for i in range(600)]
    known = relations.profiles(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    assert relations.met_pairs(relations._prefixes(known, 75.0)).select("a", "b").distinct().count() < 600 * 599 / 2 / 10


def test_relations_with_a_word_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(relations, "SPREAD_ROWS", 20)
    rng = random.Random(4)
    rows = [(i, "shared " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) for _ in range(rng.randint(0, 6)))) for i in range(70)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    from lexiqua.functions import text

    t = df.select("id", text.tokenize(F.col("text")).alias("t"))
    every = t.select(F.col("id").alias("a"), F.col("t").alias("ta")).crossJoin(t.select(F.col("id").alias("b"), F.col("t").alias("tb"))).filter("a < b")
    want = {(r.a, r.b): r.r for r in every.select("a", "b", relations.relation(F.col("ta"), F.col("tb")).alias("r")).collect() if r.r != "distinct"}
    got = relations.relations(df, "id", "text").collect()
    assert {(r.a, r.b): r.relation for r in got} == want and len(got) == len(want) > 100
    # no task of the join on words holds more than a few times what others hold
    words = t.select("id", F.explode("t").alias("k")).distinct()
    joined = relations.met(words, words)
    sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == words.alias("x").join(words.alias("y"), "k").count()


def test_first_keys_of_a_group_are_kept_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 3)
    rows = [("a", "x"), ("a", "y"), ("a", "y"), ("a", None), ("b", "z"), (None, "q")] + [("c", f"k{i:02}") for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k string")
    found = lookup.siblings(df, "g", "k", 3)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    names = {g: sorted({k for x, k in rows if x == g and k}) for g in "abc"}
    assert got == sorted(((g, k, [s for s in names[g] if s != k][:3]) for g, k in rows if g), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    big = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    assert lookup.siblings(big, "g", "k").agg(F.count("*"), F.max(F.size("siblings"))).first()[:] == (1_000_000, 10)
