import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexiqua.functions import fuzzy


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def column(spark, words):
    return spark.createDataFrame([(w,) for w in words], "w string")


def drawn(letters, longest, n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)})


def test_ratio(spark):
    words = drawn("abc", 9, 60, 1) + ["red widgets", "é漢字x", "a" * 60, "abcabcabcabc"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words[::3]], "a string, b string").select("a", "b", fuzzy.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - plain(r.a, r.b)) < 1e-12 for r in rows)
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(fuzzy.ratio(F.col("a"), F.col("b"))).first()[0] is None


@pytest.mark.parametrize("least", [1.0, 0.9, 0.8, 0.6, 0.3])
def test_all_near_pairs(spark, monkeypatch, least):
    left, right = drawn("abcdef", 8, 150, 2) + ["abababab"], drawn("abcdef", 8, 120, 3) + ["babababa"]
    want = {(a, b) for a in left for b in right if plain(a, b) >= least - 1e-12}
    found = lambda: fuzzy.similar(column(spark, [*left, None, left[1]]), column(spark, right), least).collect()
    rows = found()
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want and all(abs(r.ratio - plain(r.a, r.b)) < 1e-12 for r in rows)
    monkeypatch.setattr(fuzzy, "SPREAD", 5)  # frequent keys are dealt to several tasks
    assert {(r.a, r.b) for r in found()} == want


def test_compared_pairs_grow_with_near_ones(spark, sf_dir):
    """Words of two letters are in common to nearly all; of what meets on them little is compared."""
    words = drawn("onthea", 14, 400, 4)
    w = column(spark, words)
    near = sum(plain(a, b) >= 0.8 for a in words for b in words if a != b)
    assert fuzzy.compared(fuzzy.candidates(w, w, 0.8), 0.8).count() <= 20 * len(words) and fuzzy.similar(w, w, 0.8).count() == near + len(words)


def test_empty(spark):
    assert fuzzy.similar(column(spark, []), column(spark, ["a"]), 0.8).count() == 0
    with pytest.raises(ValueError):
        fuzzy.similar(column(spark, []), column(spark, []), 0.0)
