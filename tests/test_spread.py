import random
import re

from pyspark.sql import functions as F

from lexiqua.operators import spread
from lexiqua.plans import responses, sessions

ENTRIES = "file string, key string, senses array<struct<gloss:string,synonyms:array<string>>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def entries(spark):
    return spark.createDataFrame([(f"f{i % 3}.json", f"part {i}", [(f"a red part of size {i % 7}", ["brand"])]) for i in range(90)], ENTRIES)


def test_numbers_are_those_of_one_window(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y", "zz"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s int, t string, i int")
    for bounds in (1, 4, 256):
        monkeypatch.setattr(spread, "BOUNDS", bounds)
        got = {r.i: r.n for r in spread.numbered(df, ["g"], [(-F.col("s")).alias("less"), F.col("t"), F.col("i")], "n").collect()}
        order = lambda r: (r[1] is not None, -(r[1] or 0), r[2] is not None, r[2] or "", r[3])
        assert got == {r[3]: n for g in (None, "a", "b") for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=order), 1)}
    assert spread.numbered(df.limit(0), [], [F.col("i")], "n").count() == 0


def test_rows_of_one_task_are_spread_by_count(spark):
    df = spark.range(100, numPartitions=1)
    assert spread.spread(df, 30, "id").rdd.getNumPartitions() == 4 and spread.spread(df, 100, "id").rdd.getNumPartitions() == 1


def test_no_window_holds_a_whole_session(spark):
    items = sessions.create("s", sessions.analyze(spark, spark.createDataFrame([(1, "red brand")], "prompt_id int, prompt string"), entries(spark)))
    assert "windowspecdefinition(session_id" not in plan(items)
    assert sorted(r["rank"] for r in items.collect()) == list(range(1, 181))
    told = plan(sessions.conjecture(items, 4))
    assert "windowspecdefinition(session_id" not in told and "GlobalLimit 8" in told  # the only window without groups is over what is left


def test_no_window_holds_a_whole_prompt(spark):
    taxa = responses.analysis(spark, spark.createDataFrame([(1, "red brand")], "prompt_id int, prompt string"), entries(spark))
    whole = re.compile(r"windowspecdefinition\(prompt_id#\d+, (?!variable|frag)")
    for kind in ("conditional", "plain", "poetic"):
        found = responses.variations(taxa, kind=kind)
        assert not whole.search(plan(found)) and found.count() == 6
    answer = responses.respond(taxa).select("n_clarifiers", F.size("clarifiers").alias("n"), "response").first()
    assert answer.n_clarifiers == answer.n == 30 and answer.response.count("(synonyms: brand)") == 4
