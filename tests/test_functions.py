import datetime as dt
import itertools
import math
import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexiqua.functions import dates, formulas, fuzzy, mathexpr, sets, text


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_fragments_keep_separator_words(spark):
    assert one(spark, text.fragments(F.col("t")), t="One thing, which shines; two. Three where? x!") == ["One thing", "which", "shines", "two", "Three", "where", "x!"]
    assert one(spark, text.fragments(F.col("t")), t="") == []


def test_text_functions(spark):
    get = lambda c, t: one(spark, c(F.col("t")), t=t)
    assert get(text.normalize, "Ab-1 É") == "ab1"
    assert get(text.tokenize, "The CAT, and the été cat") == ["cat", "t", "cat"]
    assert [get(text.is_noise, t) for t in ("", "www1", "org", "123", "a" * 26, "word")] == [True] * 5 + [False]
    assert get(text.with_periods, "hello there. what\n(is) this? ok") == "Hello there. What. (Is) this? Ok."
    assert get(text.singularize, "cities") == "city" and get(text.singularize, "phases") == "phas" and get(text.singularize, "glass") == "glass" and get(text.singularize, "dogs") == "dog"
    assert get(text.strip_punct, "end?!.") == "end"
    assert get(text.signed_integers, "a-5 b7") == [-5, 7] and get(text.signed_integers, "1234567890123456 -9223372036854775808 9223372036854775808") == [1234567890123456, -(1 << 63), None]
    assert get(text.clean_definition, "See https://x.org/a [1] wiki  now") == "See now"
    assert get(lambda c: text.truncated(c, 10), "x" * 11) == "x" * 7 + "..."
    assert get(lambda c: text.first_chunk_containing(c, "BETA"), "alpha. has beta here\nmore") == "has beta here"
    assert get(lambda c: text.ngrams(F.split(c, " "), 2), "a b c") == ["a b", "b c"] and get(lambda c: text.ngrams(F.split(c, " "), 4), "a b") == []


def test_similarity_of_empty_sets_is_one(spark):
    a, b = F.array().cast("array<string>"), F.array(F.lit("x"))
    assert [one(spark, c) for c in (sets.jaccard(a, a), sets.jaccard(a, b), sets.jaccard(b, b))] == [1.0, 0.0, 1.0]
    assert one(spark, sets.inclusion(b, F.array(F.lit("x"), F.lit("x"), F.lit("y")))) == 2 / 3


def test_business_days_against_stepping(spark):
    rng = random.Random(1)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(400)), n) for n in range(-40, 41) for _ in range(4)]
    got = spark.createDataFrame(rows, "d date, n int").select("d", "n", dates.add_business_days(F.col("d"), F.col("n")).alias("x")).collect()
    for d, n, x in got:
        left, sign = abs(n), 1 if n > 0 else -1
        while left:
            d += dt.timedelta(days=sign)
            left -= d.weekday() < 5
        assert x == d


def test_dates(spark):
    got = [one(spark, dates.parse_date(F.col("t")), t=t) for t in ("2024-02-05", "2024/2/5", "05-02-2024", "5/2/2024", "no")]
    assert got == [dt.date(2024, 2, 5)] * 4 + [None]
    a, b = F.lit(dt.date(2024, 3, 1)), F.lit(dt.date(2023, 12, 31))
    assert tuple(one(spark, dates.diff_parts(a, b))) == (0, 2, -1)  # a day is borrowed from February
    assert tuple(one(spark, dates.diff_parts(F.lit(dt.date(2020, 1, 1)), F.lit(dt.date(2024, 3, 15))))) == (-4, 2, 14)
    assert one(spark, dates.add_months(F.lit(dt.date(2024, 1, 31)), F.lit(1))) == dt.date(2024, 2, 29)


def test_expressions(spark):
    value = lambda e, **v: one(spark, mathexpr.compile_expression(e, {k: F.lit(x) for k, x in v.items()}))
    assert value("2 + 3 * 4 ^ 2 - -1") == 51 and value("x / 0", x=1) is None and value("-7 % 3") == 2 and value("-7 // 2") == -4
    for bad in ("__import__('os')", "a.b", "x", "1 if 2 else 3", "[1]", "True", "1 +", "9" * 501):
        with pytest.raises(mathexpr.ExpressionError):
            mathexpr.compile_expression(bad, {})
    assert abs(one(spark, mathexpr.convert(F.lit(212.0), "degF", "degC")) - 100) < 1e-9
    with pytest.raises(mathexpr.ExpressionError):
        mathexpr.convert(F.lit(1.0), "m", "kg")
    assert one(spark, mathexpr.triangular(F.lit(10))) == 55


def test_catalogue_is_whole_and_runs(spark):
    """Each formula analyses and gives a value for plain arguments; forms that need arrays, structs or functions get them."""
    names = {(f.domain, f.name) for f in formulas.every()}
    assert len(names) == 321  # and order_of_operations, which is mathexpr, and standard_deviation_discrete, below
    formulas.register(spark)
    kinds = {"values": "array(1D, 2D)", "coeffs": "array(1D, 2D)", "xs": "array(1D, 2D)", "ys": "array(1D, 2D)", "ps": "array(0.5D, 0.5D)", "ws": "array(1D, 2D)", "rs": "array(1D, 2D)", "*coords": "1D, 2D"}
    matrix = {"matrix_addition", "matrix_subtraction", "scalar_multiplication", "matrix_multiplication", "matrix_transpose"}
    columns = []
    for f in formulas.every():
        if f.over_rows or not f.solved:
            continue
        values = {a.lstrip("*"): kinds.get(a, "2D") for a in f.args if a not in f.takes_functions}
        if f.domain == "complex_numbers":
            values |= {a: "named_struct('re', 1D, 'im', 2D)" for a in ("z", "z1", "z2") if a in f.args}
        if f.domain in ("linear_algebra", "vectors"):
            values |= {a: "array(1D, 2D, 3D)" for a in ("v", "w") if a in f.args}
        if f.domain == "linear_algebra" and f.name in matrix:
            values |= {a: "array(array(1D, 2D), array(3D, 4D))" for a in ("A", "B") if a in f.args}
        columns.append(f.column({g: (lambda x: f"({x}) * 3") for g in f.takes_functions}, **values).cast("string").alias(f"{f.domain}_{f.name}_{len(columns)}"))
    got = spark.range(1).select(*columns).first()
    assert len(got) > 290 and got["geometry_area_square_" + next(c for c in got.__fields__ if c.startswith("geometry_area_square_")).rpartition("_")[2]] == "4.0"


def test_known_values_of_formulas(spark):
    formulas.register(spark)
    get = lambda domain, name, **a: one(spark, formulas.formula(domain, name).column(**a))
    assert abs(get("statistics", "normal_cdf_approx", x="1D", mean="0D", sd="1D") - statistics.NormalDist().cdf(1)) < 1e-12
    assert get("statistics", "combination", n="52", k="5") == math.comb(52, 5) and get("statistics", "combination", n="5", k="0") == 1
    assert get("linear_algebra", "matrix_multiplication", A="array(array(1D, 2D), array(3D, 4D))", B="array(array(5D, 6D), array(7D, 8D))") == [[19.0, 22.0], [43.0, 50.0]]
    assert get("algebra", "quadratic_formula", a="1D", b="-3D", c="2D") == [2.0, 1.0]
    assert get("economics", "money_multiplier", rr="0D") is None
    assert abs(get("finance", "loan_payment", P="1000D", r="0.01D", n="12D") - 88.8487886783) < 1e-8


def test_nearest_word(spark):
    words = spark.createDataFrame([("apple",), ("apply",), ("zebra",), ("a",)], "w string")
    left = spark.createDataFrame([("appel",), ("zebras",), ("q",), ("a",), (None,)], "t string")
    got = {r.t: (r.nearest, r.ratio) for r in fuzzy.nearest(left, "t", words, "w").collect()}
    assert got["appel"][0] == "apple" and got["zebras"][0] == "zebra" and got["q"] == (None, None) and got["a"] == ("a", 1.0) and got[None] == (None, None)


def test_nearest_of_short_words(spark):
    """Words of two and three letters may reach the ratio without a pair of adjoining letters."""
    words = ["".join(x) for n in range(5) for x in itertools.product("abx", repeat=n)]
    left, right = (spark.createDataFrame([(w,) for w in ws], "t string") for ws in (words, words[1::2]))
    for least in (0.9, 0.8, 0.7):
        want = {}
        for a in words:
            score = {b: SequenceMatcher(None, a, b).ratio() for b in words[1::2]}
            best = min(score, key=lambda b: (-score[b], b))
            want[a] = (best, score[best]) if score[best] >= least else (None, None)
        assert {r.t: (r.nearest, r.ratio) for r in fuzzy.nearest(left, "t", right, "t", least).collect()} == want
    only = fuzzy.nearest(left.filter("t = 'ab'"), "t", left.filter("t = 'axb'"), "t").first()
    assert (only.nearest, only.ratio) == ("axb", 0.8)


def test_participles_at_the_end_go_however_many(spark, monkeypatch):
    from lexiqua.functions import prompts

    said = ["walking", "one two, walked; ", " a\t b ", "stay " + "going. " * 40, "going " * 40, "", None, "x ...", "...", "so .ended:, went"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, s string")
    for most in (1, 3, 16):
        monkeypatch.setattr(prompts, "LAST_WORDS", most)
        got = [r.c for r in df.orderBy("i").select(prompts.without_trailing_participles(F.col("s")).alias("c")).collect()]
        assert got == ["", "one two,", "a b", "stay", "", "", "", "x ...", "...", "so"]
