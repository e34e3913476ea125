import random

import pytest
from pyspark.sql import functions as F

from lexiqua.operators import match

ENTRIES = "file string, key string, senses array<struct<gloss:string,synonyms:array<string>>>"


def rows(found):
    return sorted(tuple(r) for r in found.select("keyword", "file", "key", "field", "sense").collect())


def plain(s):
    return "".join(c for c in (s or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def brute(entries, words):
    out = []
    for w in {w for w in words if plain(w)}:
        for file, key, senses in entries:
            if plain(w) in plain(key):
                out.append((w, file, key, "key", 0))
                continue
            for i, (gloss, synonyms) in enumerate(senses or []):
                if any(plain(w) in plain(s) for s in synonyms or []):
                    out.append((w, file, key, "synonym", i))
                if plain(w) in plain(gloss):
                    out.append((w, file, key, "gloss", i))
    return sorted(out)


@pytest.fixture
def table():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcD 12-é") for _ in range(n))
    entries = [(f"f{i % 3}", word(6), [(word(12), [word(4), None]), (None, None)] if i % 4 else None) for i in range(60)] + [("f", None, [("aaaa" * 3000, [])])]
    words = [word(rng.randint(0, 5)) for _ in range(300)] + ["", "-", "a", "zz", "aaa", "aaaaaaa", "a", "a" * 2000]
    return entries, words


def test_joined_keywords_are_those_of_the_plain_reading(spark, monkeypatch, table):
    entries, words = table
    df = spark.createDataFrame(entries, ENTRIES)
    want = brute(entries, words)
    assert len(want) > 100 and rows(match.matches(df, words)) == want
    monkeypatch.setattr(match, "LITERAL_KEYWORDS", 5)
    assert rows(match.matches(df, words)) == want
    asked = spark.createDataFrame([(w,) for w in [*words, None]], "keyword string")
    assert rows(match.matches(df, asked)) == want
    monkeypatch.setattr(match, "BROADCAST_KEYWORDS", 50)  # several parts
    assert rows(match.matches(df, asked)) == want


def test_clashing_columns_and_empty_tables(spark, monkeypatch, table):
    monkeypatch.setattr(match, "LITERAL_KEYWORDS", 0)
    entries, words = table
    df = spark.createDataFrame([(*e, 1, "x") for e in entries], f"{ENTRIES}, gram int, keyword string")
    assert rows(match.matches(df, words)) == brute(entries, words)
    assert rows(match.matches(df.limit(0), words)) == []
    assert rows(match.matches(df, ["-", ""])) == []


def test_a_run_in_all_entries_makes_no_task_large(spark, monkeypatch):
    """Nothing is shuffled but counts of runs; entries meet keywords by broadcasts alone."""
    monkeypatch.setattr(match, "LITERAL_KEYWORDS", 0)
    df = spark.createDataFrame([("f", f"common{i}", None) for i in range(500)], ENTRIES)
    found = match.matches(df, ["common", "mon12", "nothing"])
    assert found.groupBy("keyword").count().orderBy("keyword").collect() == [("common", 500), ("mon12", 11)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_keywords_spelt_alike_are_judged_once_and_impossible_ones_never(spark, monkeypatch, table):
    monkeypatch.setattr(match, "LITERAL_KEYWORDS", 0)
    df = spark.createDataFrame([("f", f"common{i}", None) for i in range(20)], ENTRIES)
    words = spark.createDataFrame([(w,) for w in ["on", "ön", "öon", "o-n", "ONé", "zzz", "xcommon"]], "keyword string")
    assert [(r.normal, len(r.keywords)) for r in match._listed(match._judged(df), words).collect() if r.normal == "on"] == [("on", 4)]
    assert {r.normal for r in match._listed(match._judged(df), words).collect()} == {"n", "on"}
    assert match.matches(df, words).groupBy("keyword").count().orderBy("keyword").collect() == [("ONé", 20), ("o-n", 20), ("on", 20), ("ön", 20), ("öon", 20)]


def test_entries_of_one_file_are_many_tasks(spark, monkeypatch, table):
    entries, words = table
    monkeypatch.setattr(match, "ENTRY_ROWS", 10, raising=False)
    df = spark.createDataFrame(entries, ENTRIES).coalesce(1)
    found = match.matches(df, words)
    assert found.rdd.getNumPartitions() == 7 and rows(found) == brute(entries, words)


def test_many_keywords_are_read_once(spark, monkeypatch):
    """Words of all documents are costly to read: once to see that they are many, up to a limit, and once in all."""
    monkeypatch.setattr(match, "LITERAL_KEYWORDS", 5)
    monkeypatch.setattr(match, "LITERAL_ROWS", 5, raising=False)
    monkeypatch.setattr(match, "BROADCAST_KEYWORDS", 100)  # several parts
    seen = spark.sparkContext.accumulator(0)

    def word(i):
        seen.add(1)
        return f"k{i % 300}"

    words = spark.range(0, 2000, 1, 4).select(F.udf(word)("id").alias("keyword"))
    entries = [("f", f"k{i}", None) for i in range(0, 300, 7)]
    found = match.matches(spark.createDataFrame(entries, ENTRIES), words)
    assert rows(found) == brute(entries, [f"k{i}" for i in range(300)])
    assert seen.value < 2 * 2000


def test_a_keyword_in_a_text_many_times_is_there_once(spark, monkeypatch):
    monkeypatch.setattr(match, "LITERAL_KEYWORDS", 0)
    long = "x".join("ab" * i for i in range(1, 40)) + "q-7"  # over many pieces
    entries = [("f", "abab", [("ab ab abab", ["ab", "a", "bab"]), (long, [long, "abx"])]), ("f", "", [(long + long, [])]), ("f", "abab", [("ab ab abab", ["ab", "a", "bab"])])]
    words = ["a", "ab", "ba", "aba", "abab", "babx", "ab" * 39 + "q", "ab" * 40, "x" + "ab" * 38 + "x", "q7", "q7abx", "bq7", "7", long, long[1:], long[:-1], long[60:90], long[64:128], long[63:81]]
    assert rows(match.matches(spark.createDataFrame(entries, ENTRIES), words)) == brute(entries, words)
    monkeypatch.setattr(match, "PIECE", 1, raising=False)
    assert rows(match.matches(spark.createDataFrame(entries, ENTRIES), words)) == brute(entries, words)
